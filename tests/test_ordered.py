import random

from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.operators.ordered import CHUNK, IDX, chunk_rows, dominant_keys, number_rows, per_key_counts, per_key_profile


def skewed(spark, n=3000, seed=3):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice([None, *range(500)]), rng.choice([None, 1.0, 2.0]), "extra") for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, seq long, t long, v double, __tm_x string")


def test_numbers_are_exact_however_many_partitions_a_key_spans(spark, monkeypatch):
    monkeypatch.setattr(ordered, "part_count", lambda df: 16)
    rows, df = skewed(spark)
    got = {r.seq: r[IDX] for r in number_rows(df, ["k"], ["seq"]).collect()}
    count = {}
    for k, seq, *_ in rows:
        assert got[seq] == count.get(k, 0)
        count[k] = count.get(k, 0) + 1


def test_chunks_have_one_size_and_their_halo(spark):
    rows, df = skewed(spark)
    pieces = chunk_rows(df, ["k"], ["seq"], 100, 10)
    hot = sum(r[0] == "hot" for r in rows)
    sizes = {r[CHUNK]: (r.n, r.own) for r in pieces.where("k = 'hot'").groupBy(CHUNK).agg(F.count("*").alias("n"), F.count_if(F.floor(F.col(IDX) / 100) == F.col(CHUNK)).alias("own")).collect()}
    assert sum(own for _, own in sizes.values()) == hot
    assert all(own == 100 for c, (_, own) in sizes.items() if c < max(sizes))
    assert sizes[1][0] == 120 and sizes[0][0] == 110


def test_profile_equals_a_loop(spark):
    rows, df = skewed(spark)
    got = {r.k: r for r in per_key_profile(df, ["k"], ["seq"], "t", "v", size=64).collect()}
    assert len(got) == 4
    for key in ("hot", "a", "b", None):
        mine = [r for r in rows if r[0] == key]
        t = [r[2] for r in mine]
        steps = [b - a for a, b in zip(t, t[1:], strict=False) if a is not None and b is not None]
        known = [x for x in t if x is not None]
        r = got[key]
        assert (r.n_rows, r.first_time, r.last_time) == (len(mine), known[0], known[-1])
        assert (r.n_backwards, r.max_gap) == (sum(s < 0 for s in steps), max(steps))
        assert r.n_changes == sum(a[3] != b[3] for a, b in zip(mine, mine[1:], strict=False))


def test_counts_and_dominant_keys(spark):
    rows, df = skewed(spark)
    counts = {r.k: r.n_rows for r in per_key_counts(df, ["k"], ["seq"], size=50).collect()}
    assert counts == {k: sum(r[0] == k for r in rows) for k in ("hot", "a", "b", None)}
    one = df.withColumn("g", F.lit(1))
    assert [r.k for r in dominant_keys(one, ["g"], "k", ["seq"], 0.5).collect()] == ["hot"]
    exact = spark.createDataFrame([(1, "a", i) for i in range(19)] + [(1, "b", 19)], "g int, k string, seq long")
    assert {r.k for r in dominant_keys(exact, ["g"], "k", ["seq"], 0.05).collect()} == {"a", "b"}


def test_empty_table(spark):
    _, df = skewed(spark)
    none = df.where("false")
    assert number_rows(none, ["k"], ["seq"]).collect() == []
    assert per_key_profile(none, ["k"], ["seq"], "t").collect() == []
    assert dominant_keys(none.withColumn("g", F.lit(1)), ["g"], "k", ["seq"], 0.1).collect() == []


def test_ties_and_repeated_rows_are_each_numbered(spark):
    df = spark.createDataFrame([("a", 1)] * 50, "k string, seq long")
    assert sorted(r[IDX] for r in number_rows(df, ["k"], ["seq"]).collect()) == list(range(50))
