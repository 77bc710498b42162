import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm.packing import SumOfSquares, pack_documents, token_counts


def squares_after(levels, capacity, fill, size):
    levels = dict(levels)
    if fill:
        levels[fill] -= 1
    if fill + size < capacity:
        levels[fill + size] = levels.get(fill + size, 0) + 1
    return sum(n * n for n in levels.values())


def test_each_item_goes_where_the_sum_of_squares_is_least():
    rng = random.Random(0)
    packer, fills = SumOfSquares(20), {}
    for _ in range(600):
        size = rng.randint(1, 20)
        levels = defaultdict(int)
        for f in fills.values():
            if f < 20:
                levels[f] += 1
        choices = [0, *(f for f, n in levels.items() if n and f + size <= 20)]
        cost = {f: squares_after(levels, 20, f, size) for f in choices}
        window, at = packer.place(size)
        assert cost[at] == min(cost.values()) and at == max(f for f in choices if cost[f] == min(cost.values()))
        assert fills.get(window, 0) == at
        fills[window] = at + size
    assert packer.fills().tolist() == [fills[w] for w in range(len(fills))]


def test_little_room_is_left():
    rng = np.random.default_rng(1)
    packer = SumOfSquares(2048)
    sizes = np.clip(rng.lognormal(5.8, 0.9, 20_000).astype(int), 1, 2048)
    for s in sizes:
        packer.place(int(s))
    assert sizes.sum() / 2048 / packer.windows > 0.99


@pytest.mark.parametrize("lane_tokens", [4_000_000, 300])
def test_whole_corpus(spark, lane_tokens):
    rng = random.Random(2)
    words = ["stone", "river", "letter", "window", "mountain"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 5, 30, 90, 300]))) for _ in range(120)]
    texts += [None, "", "x", "x", "日本語の文章です。" * 40, "<|endoftext|>"]
    df = spark.createDataFrame([(i if i != 5 else None, t, "clash", 7) for i, t in enumerate(texts)], "doc_id long, text string, piece string, n_tokens int")
    sizes = {r[0]: r.n_tokens for r in token_counts(df, "doc_id", "text").collect()}
    assert 120 not in sizes and 121 not in sizes and sizes[122] == 1 and sizes[125] > 1
    rows = pack_documents(df, capacity=64, lane_tokens=lane_tokens, slack=2).collect()
    by_doc, by_box = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_box[r.container].append(r)
    for doc, n in sizes.items():
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert sum(p.n_tokens for p in pieces) == n
        assert [p.start_token for p in pieces] == list(range(0, n, 64))
        assert all(p.n_tokens == 64 for p in pieces[:-1])
    for box in by_box.values():
        at = 0
        for r in sorted(box, key=lambda r: r.position):
            assert r.position == at
            at += r.n_tokens
        assert at == box[0].filled <= 64
    assert set(by_doc) == set(sizes)


def test_result_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i, "word " * (i % 50 + 1)) for i in range(200)], "doc_id long, text string")
    a, b = (sorted(map(tuple, pack_documents(df.repartition(n), capacity=64, lane_tokens=500).collect())) for n in (1, 7))
    assert a == b


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
