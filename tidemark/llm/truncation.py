"""Finding texts that were cut off before their page's own text ended."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.folding import plain, redecoded
from tidemark.llm.leakage import RollingHash, window_hashes
from tidemark.session import dealt, written

#: Context lengths of the model, and hash buckets of each: with the languages, a bound on its size.
LEVELS = (1, 2, 3, 4, 6)
BUCKETS = 1 << 16
#: Letters of the contexts by which languages are told apart, the least share of all text that makes a language, and the mean log-probability below which a text is in none.
LETTERS, LEAST_SHARE, FOREIGN = 3, 0.0005, -10.0
#: Language codes that name no one language.
NO_LANGUAGE = ("und", "mul", "zxx", "mis")
OTHER = "other"
_TAG = re.compile(r"\s*([a-z]{2,3})(?:[^a-z]|$)")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_UPPER = re.compile("[А-ЯЁ]")
_MARK = re.compile(r"\s*(?:\[\s*(?:\.{3}|…)\s*\]|…|\.{3})\s*$")
_CLOSED = re.compile(r"(?:[.!?。！？](?:[\"”»’'」』)\]]|&quot;|&#x27;)*|[.!?][\"”»]?\s?[»”\"])\s*$")
_DIGIT = re.compile(r"\d")
#: Longest line that can be a plate by its first word, and by being repeated whole; least texts, and share of its language's texts, that show a repeated line; log-odds of a plate's first word.
PLATE_CHARS, REPEATED_CHARS, REPEATED_TEXTS, REPEATED_SHARE, PLATE_ODDS = 60, 120, 3, 0.0005, 6.0
#: A length is a limit of its source if texts pile up there against the lengths around: so many times as dense, and by chance with a probability under exp(-this).
PILE_DENSITY, PILE_ODDS = 6.0, 13.8
_ENDERS = np.array([ord(c) for c in ".!?。"], dtype=np.uint64)


def _text_codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)


def _cells(codes: np.ndarray, k: int) -> np.ndarray:
    return (window_hashes(codes, k) >> np.uint64(48)).astype(np.int64)


def _tagged(tag: str | None) -> str:
    """The language a tag names, '' for none: 'DE', 'en-GB' and 'pt_BR' are de, en and pt."""
    found = _TAG.match(tag.lower()) if tag else None
    return found.group(1) if found and found.group(1) not in NO_LANGUAGE else ""


class LanguageModel:
    """Character n-grams of each language, from texts tagged with it; a wrong tag here and there does no harm."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        total = sum(int(c.sum()) for c in counts.values())
        self.names = sorted(k for k, c in counts.items() if c.sum() >= LEAST_SHARE * total)
        rows = [np.log((counts[k] + 0.05) / (counts[k].sum() + 0.05 * BUCKETS)) for k in self.names]
        self.odds = np.array(rows, dtype=np.float32).reshape(len(rows), BUCKETS)

    @classmethod
    def fit(cls, documents: DataFrame, text: str, tag: str | None) -> LanguageModel:
        if tag is None:
            return cls({})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables: dict[str, np.ndarray] = {}
            for batch in batches:
                held: dict[str, list[str]] = {}
                for t, given in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if lang := _tagged(given):
                        held.setdefault(lang, []).append(t)
                for lang, texts in held.items():
                    for a in range(0, len(texts), 200):
                        cells = _cells(_text_codes("\0".join(texts[a : a + 200])), LETTERS)
                        tables[lang] = tables.get(lang, 0) + np.bincount(cells, minlength=BUCKETS)
            for lang, n in tables.items():
                cell = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell)), pa.array(cell.astype(np.int32)), pa.array(n[cell])], names=["lang", "cell", "n"])

        slim = documents.select(text, F.col(tag).cast("string")).where(F.col(text).isNotNull() & F.col(tag).isNotNull())
        rows = dealt(slim).mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
        counts: dict[str, np.ndarray] = {}
        # at most three-letter codes x buckets rows, whatever the corpus
        for batch in rows.toArrow().to_batches():
            langs = np.array(batch.column(0).to_pylist())
            cell, n = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            for lang in np.unique(langs):
                counts.setdefault(str(lang), np.zeros(BUCKETS, dtype=np.int64))[cell[langs == lang]] = n[langs == lang]
        return cls(counts)

    def name(self, codes: np.ndarray) -> str:
        """The language of a whole text, given as codes: the likeliest; without any tags, all texts are in one, ''."""
        if not self.names:
            return ""
        cells = _cells(codes, LETTERS)
        if not len(cells):
            return OTHER
        cells, n = np.unique(cells, return_counts=True)
        odds = self.odds[:, cells] @ n.astype(np.float32) / n.sum()
        best = int(np.argmax(odds))
        return self.names[best] if odds[best] >= FOREIGN else OTHER


def _count(codes: np.ndarray, mid: np.ndarray, end: np.ndarray) -> None:
    """Adds the contexts of texts: of every character to ``mid``, of the ends of sentences and of lines but the last to ``end``."""
    after = np.append(codes[1:], np.uint64(0))
    stop = np.isin(codes, _ENDERS) & ((after == 10) | (after == 32) | (codes == 0x3002))
    ends = np.flatnonzero((codes == 10) | stop)
    for level, k in enumerate(LEVELS):
        cells = _cells(codes, k)
        mid[level] += np.bincount(cells, minlength=BUCKETS)
        at = ends[ends >= k] - k
        end[level] += np.bincount(cells[at], minlength=BUCKETS)


def context_counts(documents: DataFrame, text: str, languages) -> DataFrame:
    """The model's counts over all texts: (``lang``, ``level``, ``cell``, ``n_mid``, ``n_end``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[str, list[np.ndarray]] = {}
        size: Counter[str] = Counter()
        between = np.zeros(1, dtype=np.uint64)

        def add(lang: str) -> None:
            if lang not in tables:
                tables[lang] = tuple(np.zeros((len(LEVELS), BUCKETS), dtype=np.int64) for _ in range(2))
            _count(np.concatenate(held.pop(lang)), *tables[lang])
            size[lang] = 0

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    codes = _text_codes(t)
                    lang = languages.value.name(codes)
                    held.setdefault(lang, []).extend((codes, between))
                    size[lang] += len(t)
                    if size[lang] > 500_000:
                        add(lang)
        for lang in list(held):
            add(lang)
        for lang, (mid, end) in tables.items():
            level, cell = np.nonzero(mid)
            for a in range(0, len(level), 100_000):
                s = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(level[s])), pa.array(level[s].astype(np.int32)), pa.array(cell[s].astype(np.int32)), pa.array(mid[level[s], cell[s]]), pa.array(end[level[s], cell[s]])], names=["lang", "level", "cell", "n_mid", "n_end"])

    counted = dealt(documents.select(text).where(F.col(text).isNotNull())).mapInArrow(run, "lang string, level int, cell int, n_mid long, n_end long")
    return counted.groupBy("lang", "level", "cell").agg(F.sum("n_mid").alias("n_mid"), F.sum("n_end").alias("n_end"))


class EndModel:
    """Backward character n-gram model: how likely a context is before an end, against before a continuation."""

    def __init__(self, tables: dict[str, tuple[np.ndarray, np.ndarray]], weight: float = 2.0) -> None:
        self.tables, self.weight = tables, weight
        self.total = {lang: (mid[0].sum(), end[0].sum()) for lang, (mid, end) in tables.items()}

    @classmethod
    def fit(cls, documents: DataFrame, text: str, languages) -> EndModel:
        tables = {}
        # at most languages x levels x buckets rows, whatever the corpus
        for rows in context_counts(documents, text, languages).toArrow().to_batches():
            langs = np.array(rows.column(0).to_pylist())
            level, cell, mid, end = (np.asarray(rows.column(i)) for i in range(1, 5))
            for lang in np.unique(langs):
                pair = tables.setdefault(str(lang), tuple(np.zeros((len(LEVELS), BUCKETS), dtype=np.int64) for _ in range(2)))
                at = langs == lang
                pair[0][level[at], cell[at]] = mid[at]
                pair[1][level[at], cell[at]] = end[at]
        return cls(tables)

    def log_odds(self, langs: Sequence[str], contexts: Sequence[str]) -> np.ndarray:
        """Above 0: a context is more typical of an end; 0 in a language without counts. The characters are taken from the last backwards, each given those behind it."""
        longest = LEVELS[-1]
        codes = _text_codes("".join(c[-longest:].rjust(longest, "\0") for c in contexts)).reshape(-1, longest)
        size = np.array([min(len(c), longest) for c in contexts], dtype=np.int64)
        out, names, w = np.zeros(len(size)), np.array(langs, dtype=object), self.weight
        cells = [(RollingHash(codes[:, longest - k :].ravel()).stretches(np.arange(len(size)) * k, np.full(len(size), k)) >> np.uint64(48)).astype(np.int64) for k in LEVELS] if len(size) else []
        for lang in set(langs):
            if lang not in self.tables:
                continue
            at = np.flatnonzero(names == lang)
            (mid, end), (m0, e0) = self.tables[lang], self.total[lang]
            m0, e0 = np.full(len(at), m0), np.full(len(at), e0)
            for level, k in enumerate(LEVELS):
                cell = cells[level][at]
                m, e = mid[level, cell], end[level, cell]
                prior = (m + e + 0.5) / (m0 + e0 + 1)
                step = np.log((e + w * prior) / (e0 + w)) - np.log((m + w * prior) / (m0 + w))
                out[at] += np.where(size[at] >= k, step, 0.0)
                m0, e0 = m, e
        return out


def _mark(text: str) -> int | None:
    """Where the mark of an omission at the end of a text begins, spaces before it included."""
    text = text.rstrip()
    found = _MARK.search(text, max(0, len(text) - 64))
    return len(text[: found.start()].rstrip()) if found else None


def _closed(text: str) -> bool:
    """Whether a text ends in a full stop, quotation marks and brackets behind it included."""
    text = text.rstrip()
    end = text.rstrip("\"”»’'」』)]").endswith((".", "!", "?", "。", "！", "？", "&quot;", "&#x27;", " "))
    return end and bool(_CLOSED.search(text, max(0, len(text) - 256)))


def page_verdict(text: str, raw: bytes) -> str:
    """'cut', 'whole' or '' by the page itself: what follows the text's last characters there. For measuring the model; no verdict rests on it."""
    tail = "".join(plain(_MARK.sub("", text).rsplit("\n", 1)[-1]))[-28:]
    if len(tail) < 8:
        return ""
    verdicts = set()
    for charset in ("utf-8", "cp1252", "shift_jis", "euc_jp", "cp1251", "utf-16"):
        page = raw.decode(charset, "ignore")
        page = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "\x01", page)
        pieces = re.split("<[^<>]*>|\x01", page)
        for k, piece in enumerate(pieces):
            if len(piece) < 6:
                continue
            stream = "".join(plain(piece))
            at = stream.find(tail)
            while at >= 0:
                if at + len(tail) < len(stream):
                    verdicts.add("cut")
                else:
                    verdicts.add("cut" if k == len(pieces) - 1 and not _CLOSED.search(text) else "whole")
                at = stream.find(tail, at + 1)
        if verdicts:
            break
    return verdicts.pop() if len(verdicts) == 1 else ""


def _opener(line: str) -> str:
    return line.split(" ", 1)[0][:8].lower()


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _fold(line: str) -> int | None:
    """Of a line that can be a repeated one, its digest, whatever its digits."""
    return _digest(_DIGIT.sub("#", line)) if len(line) <= REPEATED_CHARS else None


_LINES = pa.list_(pa.struct([("opener", pa.string()), ("fold", pa.int64()), ("closed", pa.bool_())]))


def _with_plates(rows: DataFrame) -> DataFrame:
    """``rows`` with ``repeated``, whether the last line stands whole in other texts, and ``plate``, whether it is short and its first word opens lines that do not end in a full stop.

    Lines are counted by language, over distinct texts, and without the last line of each,
    which may itself be cut; as repeated, last lines count once for each line before
    them, since copies of one page may be cut at one place. Of a first word, the upper 95 % bound of the share of closed
    lines decides, so that few lines do not.
    """
    texts = rows.select("text_hash", "lang", "fold", "before", "lines").dropDuplicates(["text_hash"])
    lines = texts.select("text_hash", "lang", F.explode("lines").alias("l")).select("text_hash", "lang", "l.*")
    z2 = 1.645**2
    n, k = F.col("n"), F.col("n_closed")
    kinds = lines.groupBy(F.col("lang").alias("k_lang"), F.col("opener").alias("k_opener")).agg(F.count(F.lit(1)).alias("n"), F.count_if("closed").alias("n_closed"))
    kinds = kinds.where((k + z2 / 2 + F.sqrt(z2 * (k * (n - k) / n + z2 / 4))) / (n + z2) < 0.25).select("k_lang", "k_opener", F.lit(True).alias("k_plate"))
    # a text repeats a line of its own at times
    once = lines.select("text_hash", "lang", "fold").union(texts.select("before", "lang", "fold")).where("fold IS NOT NULL").dropDuplicates()
    folds = once.groupBy(F.col("lang").alias("f_lang"), F.col("fold").alias("f_fold")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= REPEATED_TEXTS)
    totals = texts.groupBy(F.col("lang").alias("t_lang")).agg(F.count(F.lit(1)).alias("n_texts"))
    folds = folds.join(F.broadcast(totals), F.col("f_lang") == F.col("t_lang")).where(F.col("n") >= F.col("n_texts") * REPEATED_SHARE).select("f_lang", "f_fold", F.lit(True).alias("f_plate"))
    rows = rows.drop("lines", "text_hash", "before").join(kinds, (F.col("lang") == F.col("k_lang")) & (F.col("opener") == F.col("k_opener")), "left")
    rows = rows.join(folds, (F.col("lang") == F.col("f_lang")) & (F.col("fold") == F.col("f_fold")), "left")
    plate = F.col("k_plate").isNotNull() & (F.col("last_chars") <= PLATE_CHARS)
    return rows.withColumns({"repeated": F.col("f_plate").isNotNull(), "plate": plate}).drop("k_lang", "k_opener", "k_plate", "f_lang", "f_fold", "f_plate")


def _describe(model, languages):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = model.value
        for batch in batches:
            out = {c: [] for c in ("lang", "closed", "marked", "odds", "odds_end", "odds_mid", "raw_says", "opener", "n_words", "last_chars", "any_closed", "text_hash", "fold", "before", "lines")}
            for text, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                lang = languages.value.name(_text_codes(text))
                if not text.isascii() and len(_UPPER.findall(text)) > 0.45 * (n_letters := len(_CYRILLIC.findall(text))) and n_letters > 0.2 * len(text):
                    text = redecoded(text) or text
                mark = _mark(text)
                body = (text if mark is None else text[:mark]).rstrip("�")
                marked = mark is not None
                closed = not marked and _closed(text)
                last = body.rstrip().rsplit("\n", 1)[-1]
                inner = [m.start() for m in re.finditer(r"[.!?。](?=[\s]|[^\x00-\x7f])", text[:-1])]
                middle = len(text) // 2
                out["lang"].append(lang)
                out["closed"].append(closed)
                out["marked"].append(marked)
                # an end that a false charset left unreadable says nothing
                out["odds"].append(None if "\ufffd" in body[-LEVELS[-1] :] else body[-LEVELS[-1] :])
                out["odds_end"].append(text[: inner[len(inner) // 2]][-LEVELS[-1] :] if inner else None)
                out["odds_mid"].append(text[:middle][-LEVELS[-1] :] if middle > 20 and text[middle - 1 : middle + 1].isalpha() else None)
                out["raw_says"].append(page_verdict(text, raw) if raw and not closed else "")
                out["opener"].append(_opener(last))
                out["n_words"].append(len(text.split()))
                out["last_chars"].append(len(last))
                out["any_closed"].append(bool(inner) or closed)
                *others, end = text.rstrip().split("\n")
                out["text_hash"].append(_digest(text))
                out["fold"].append(_fold(end))
                out["before"].append(_digest(_DIGIT.sub("#", next((x for x in reversed(others) if x), ""))))
                out["lines"].append([{"opener": _opener(x), "fold": _fold(x), "closed": _closed(x)} for x in others if x])
            for c in ("odds", "odds_end", "odds_mid"):  # so far contexts
                known = [x is not None for x in out[c]]
                odds = ends.log_odds(out["lang"], [x or "" for x in out[c]])
                out[c] = [float(o) if k else None for o, k in zip(odds, known, strict=True)]
            kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), _LINES)
            cols = [batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)), batch.column(4), batch.column(5)]
            yield pa.RecordBatch.from_arrays(cols, names=["__tm_id", "source", *out, "n_chars", "n_bytes"])

    return run


def _piled_up(n: Column, expected: Column) -> Column:
    """Whether ``n`` texts are far more than ``expected``, in density and by the Poisson tail (its Chernoff bound), so that the same share of a source counts in tables of any size."""
    return (n > PILE_DENSITY * expected) & (n * F.log(n / expected) - n + expected > PILE_ODDS)


def _at_limit(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at_limit``: whether the text's length is one at which its source has far more texts than at lengths around it."""
    for measure, near, around in (("n_chars", 6, 90), ("n_bytes", 3, 90), ("n_words", 3, 40)):
        counts = rows.groupBy("source", measure).agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("source").orderBy(measure)
        counts = counts.withColumns({"close": F.sum("n").over(w.rangeBetween(-near, near)), "wide": F.sum("n").over(w.rangeBetween(-around, around))})
        inside, outside = 2 * near + 1, 2 * (around - near)
        peak = _piled_up(F.col("close"), (F.col("wide") - F.col("close") + 1) * inside / outside)
        peaks = counts.where(peak).select(F.col("source").alias("s"), F.col(measure).alias("m"), F.lit(True).alias(f"peak_{measure}"))
        rows = rows.join(peaks, rows["source"].eqNullSafe(peaks["s"]) & (rows[measure] == peaks["m"]), "left").drop("s", "m")
    return rows.withColumn("at_limit", F.coalesce("peak_n_chars", "peak_n_bytes", "peak_n_words", F.lit(False)))


def describe_ends(documents: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", lang: str | None = "lang", raw: str | None = None) -> DataFrame:
    """Every document with a text, and whether it is ``truncated``, with the grounds of that verdict.

    Languages are told apart by character n-grams, counted over the texts whose ``lang``
    tag names one. For each language a backward character n-gram model is trained over
    all texts: contexts before ends of sentences and lines against contexts before any
    character. A text's last context gives its log-odds; below the threshold of its
    language and of this column, which lies between those of known ends and known middles
    of words, it is a candidate. An end mark ('…', '[...]') and a length at which its source
    piles up shift the odds, and so does a short last line whose first word opens lines that
    never end in a full stop (menus, footers, tags). A candidate is no case if its last line
    stands whole in other texts (menus, notices, teasers).

    Result: ``ident``, ``source``, ``lang`` (detected), ``truncated``, ``odds``,
    ``threshold``, ``at_limit``, ``marked``, ``raw_says``. ``odds`` is null where the end
    is unreadable; such a text is judged by marks and limits only. ``raw_says`` tells whether the page
    as stored, if ``raw`` names one, goes on behind the text ('cut', 'whole' or ''); it has
    no part in the verdict. Null and empty texts give no row; a null source is a source
    of its own; without tags all texts are one language; a text like none of them
    ('other') is only judged by marks and limits. Ids need not be unique. An empty table
    gives no rows.
    """
    spark = documents.sparkSession
    languages = spark.sparkContext.broadcast(LanguageModel.fit(documents, text, lang if lang in documents.columns else None))
    model = spark.sparkContext.broadcast(EndModel.fit(documents, text, languages))
    has = F.col(text).isNotNull() & (F.length(text) > 0)
    kind = documents.schema[ident].dataType.simpleString()
    slim = documents.where(has).select(
        F.col(ident).alias("__tm_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("__tm_text"), (F.col(raw) if raw else F.lit(None).cast("binary")).alias("__tm_page"),
        F.length(text).cast("long").alias("n_chars"), F.octet_length(text).cast("long").alias("n_bytes"),
    )
    schema = f"__tm_id {kind}, source string, lang string, closed boolean, marked boolean, odds double, odds_end double, odds_mid double, raw_says string, opener string, n_words long, last_chars long, any_closed boolean, text_hash long, fold long, before long, lines array<struct<opener: string, fold: long, closed: boolean>>, n_chars long, n_bytes long"
    rows = written(dealt(slim).mapInArrow(_describe(model, languages), schema), "ends")

    cuts = rows.groupBy(F.col("lang").alias("__tm_l")).agg((F.percentile_approx("odds_end", 0.03, 1000) * 0.5 + F.percentile_approx("odds_mid", 0.9, 1000) * 0.5).alias("threshold"))
    judged = _with_plates(_at_limit(rows))
    judged = judged.join(F.broadcast(cuts), F.col("lang") == F.col("__tm_l"), "left").drop("__tm_l")
    shifted = F.coalesce("odds", "threshold", F.lit(0.0)) - F.when(F.col("at_limit"), 6.0).otherwise(0.0) - F.when(F.col("marked"), 6.0).otherwise(0.0) + F.when(F.col("plate"), PLATE_ODDS).otherwise(0.0)
    # of a text in no known language the model knows too little to speak alone
    known = (F.col("lang") != OTHER) | F.col("at_limit") | F.col("marked")
    candidate = ~F.col("closed") & known & (shifted < F.coalesce("threshold", F.lit(0.0)))
    article = ~F.col("repeated") & (F.col("any_closed") | (F.col("last_chars") > 70))
    return judged.withColumn("truncated", candidate & article).select(F.col("__tm_id").alias(ident), "source", "lang", "truncated", "odds", "threshold", "at_limit", "marked", "raw_says")


def truncated_texts(documents: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Ids of the texts that were cut off; see ``describe_ends``."""
    return describe_ends(documents, ident, source, text, lang).where("truncated").select(ident)


def truncation_report(documents: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """How often each source truncates: texts, truncated texts, their share, and those at a length limit."""
    ends = describe_ends(documents, ident, source, text, lang)
    return ends.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if("truncated").alias("n_truncated"),
        F.round(F.avg(F.col("truncated").cast("double")), 6).alias("truncated_share"), F.count_if(F.col("truncated") & F.col("at_limit")).alias("n_at_limit"),
    )
