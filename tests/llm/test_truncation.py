import random

import pytest

from tidemark.llm.truncation import OTHER, EndModel, LanguageModel, _tagged, _text_codes, describe_ends, page_verdict, truncated_texts, truncation_report

NOUNS = ["lantern", "harbour", "window", "garden", "ladder", "kettle", "market", "bridge", "orchard", "tower"]
SCHEMA = "doc_id long, source string, text string, raw binary, lang string, n_chars string"


def sentence(r):
    return f"The {r.choice(NOUNS)} behind the {r.choice(NOUNS)} was painted by the keeper of the {r.choice(NOUNS)}, and nobody sold the old {r.choice(NOUNS)}."


def article(r, n=8):
    return "\n".join(" ".join(sentence(r) for _ in range(n)) for _ in range(2))


def corpus(with_raw):
    r = random.Random(3)
    rows, cut = [], set()
    for i in range(400):
        body, limit = article(r), i % 4 == 0
        text, page = body, f"<html><body><h1>A {i}</h1>" + "".join(f"<p>{p}</p>" for p in body.split("\n")) + "</body></html>"
        source = "limited" if limit else f"s{i % 3}"
        if limit and i % 8 == 0:
            text = body[:900]
        elif i % 10 == 1:
            text = body[: r.randrange(300, 700)]
        elif i % 10 == 2:
            text += "\nHome | Contact | Imprint"
        elif i % 10 == 3:
            text += "\nRead more …"
        if text != body and text[-1] != "." and body.startswith(text):
            cut.add(i)
        rows.append((i, source, text, page.encode() if with_raw else None, "xx", "clash"))
    return rows, cut


def test_held_out_accuracy(spark):
    rows, cut = corpus(True)
    got = {r.doc_id for r in truncated_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    hit = len(got & cut)
    assert hit / len(cut) > 0.9 and hit / len(got) > 0.98


def test_the_page_has_no_part_in_the_verdict(spark):
    rows, _ = corpus(True)
    df = spark.createDataFrame(rows, SCHEMA)
    with_page = {r.doc_id: (r.truncated, r.raw_says) for r in describe_ends(df, raw="raw").collect()}
    without = {r.doc_id: r.truncated for r in describe_ends(df).collect()}
    assert {k: v[0] for k, v in with_page.items()} == without and "cut" in {v[1] for v in with_page.values()}


#: Sentences of three languages, to be filled with names.
PATTERNS = {
    "en": "The {} behind the {} was painted by the keeper of the {}, and nobody sold the old {}.",
    "de": "Der Wärter von {} hat das Tor hinter dem {} gestrichen, doch niemand wollte den alten {} bei {} kaufen.",
    "fr": "Le gardien de {} avait repeint la porte derrière {}, mais personne ne voulait vendre le vieux {} près de {}.",
}


def test_held_out_cuts_by_language(spark):
    """Texts cut at random places within words, in three languages of which one is rarely tagged, against whole texts and pages ending in a menu."""
    r = random.Random(12)
    rows, cut = [], {k: set() for k in PATTERNS}
    for i in range(900):
        lang = list(PATTERNS)[i % 3]
        text = "\n".join(" ".join(PATTERNS[lang].format(*(r.choice(NOUNS) for _ in range(4))) for _ in range(7)) for _ in range(2))
        if i % 7 == 0:
            at = r.randrange(200, len(text) - 50)
            while not (text[at - 1].isalpha() and text[at].isalpha()):
                at += 1
            text = text[:at]
            cut[lang].add(i)
        elif i % 7 == 1:
            text += "\nHome | Contact | Imprint"
        tag = {0: lang.upper(), 1: f"{lang}-XX", 2: None, 3: "und"}.get(r.randrange(6), lang) if lang != "fr" or r.random() < 0.2 else None
        rows.append((i, f"s{i % 5}", text, None, tag, None))
    got = {x.doc_id: x for x in describe_ends(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[i].lang == list(PATTERNS)[i % 3] for i in got) == len(rows)
    found = {i for i, x in got.items() if x.truncated}
    for lang, mine in cut.items():
        assert len(found & mine) >= 0.9 * len(mine), (lang, len(found & mine), len(mine))
    assert len(found & set.union(*cut.values())) >= 0.97 * len(found)


def test_report_and_edges(spark):
    rows, cut = corpus(True)
    rows += [(1000, None, None, None, None, None), (1001, None, "", None, None, None), (1002, None, "Word", b"", None, None), (1003, "s1", "..." * 9, b"\xff\xfe", None, None), (1004, "s1", "\n\n", None, None, None)]
    rows += [(5, "s1", rows[5][2], rows[5][3], None, None), (1005, "s1", "a" * 200_000, None, None, None), (1006, "s1", rows[1][2], None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    ends = describe_ends(df).collect()
    assert len(ends) == len(rows) - 2
    report = {r.source: r for r in truncation_report(df).collect()}
    assert report[None].n_texts == 1 and report["limited"].n_at_limit >= 40
    assert sum(r.n_texts for r in report.values()) == len(ends)
    assert report["limited"].truncated_share == pytest.approx(report["limited"].n_truncated / report["limited"].n_texts, abs=1e-6)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert truncated_texts(df).collect() == [] and truncation_report(df).collect() == []


def test_page_verdicts():
    page = b"<p>The lantern was sold near the old harbour wall.</p><p>By 1900 the garden behind the tower was closed</p><footer>Contact</footer>"
    assert page_verdict("The lantern was sold near the old har", page) == "cut"
    assert page_verdict("x\nBy 1900 the garden behind the tower was closed", page) == "whole"
    assert page_verdict("x\nSomething that is not on the page at all", page) == ""
    assert page_verdict("The lantern was sold near the [...]", page) == "cut"
    assert page_verdict("The lantern was so", b"<p>The lantern was so") == "cut"


def test_language(spark):
    texts = {k: " ".join([p.format(*NOUNS[:4])] * 5) for k, p in PATTERNS.items()}
    rows = [(i, "s", texts[k], None, tag, None) for i, (k, tag) in enumerate([("en", "en"), ("en", "en-GB"), ("en", "de"), ("de", "DE"), ("de", "de"), ("de", None), ("fr", "fr_CA"), ("fr", "fr"), ("fr", "und")] * 3)]
    model = LanguageModel.fit(spark.createDataFrame(rows, SCHEMA), "text", "lang")
    assert model.names == ["de", "en", "fr"]
    assert [model.name(_text_codes(t)) for t in texts.values()] == list(PATTERNS)
    assert model.name(_text_codes("誰もその橋がなぜ売られたのか知らない。")) == OTHER and model.name(_text_codes("")) == OTHER
    assert LanguageModel({}).name(_text_codes("abc")) == ""
    assert [_tagged(t) for t in ("en-GB", "PT_br", "und", None, "", "english", " de")] == ["en", "pt", "", "", "", "", "de"]


def test_model_tells_ends_from_middles(spark):
    rows, _ = corpus(False)
    none = spark.sparkContext.broadcast(LanguageModel({}))
    model = EndModel.fit(spark.createDataFrame(rows, SCHEMA), "text", none)
    odds = model.log_odds(["", "", "", "zz", ""], ["and nobody sold the old lantern", "and nobody sold the old lant", "was painted by the", "abc", ""])
    assert odds[0] > odds[1] and odds[2] < 0 and odds[3] == odds[4] == 0.0
    assert model.log_odds([], []).tolist() == [] and model.log_odds([""], ["lantern"])[0] == pytest.approx(model.log_odds(["zz", ""], ["x", "lantern"])[1])


def test_lines_not_first_words_are_plates(spark):
    r = random.Random(5)
    rows, cut = [], set()
    for i in range(160):
        # headings make 'Solnick' a word whose lines do not end in a full stop
        body = f"Solnick {r.choice(NOUNS)} {i}\n" + article(r)
        text, page = body, None
        if i % 10 == 0:
            text = f"{body}\nSolnick {sentence(r)[:-9]}"
            cut.add(i)
        elif i % 10 == 5:
            text = f"{body}\nSolnick has stree"  # short, so that the line may be a heading: not asked for
        elif i % 10 < 5:
            text = f"{body}\nContinue reading …" + ("\nHome" if i % 2 else "")
        rows.append((i, f"s{i % 3}", text, page, None, None))
    got = {x.doc_id for x in truncated_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert cut <= got and not {i for i in got if i % 10 in (2, 4)}
