import random

import pytest

from tidemark.llm.matching import match_nearest


def nearest(rows, records, tolerance):
    out = []
    for k, t, i in rows:
        near = [(abs(rt - t), rt, ri) for rk, rt, ri in records if None not in (k, t, i, rk, rt, ri) and rk == k and abs(rt - t) <= tolerance]
        if near:
            out.append((i, min(near)[2], min(near)[1] - t))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_several_tables_equal_brute_force(spark, seed):
    r = random.Random(seed)
    make = lambda n: [(r.choice([1, 1, 1, 2, None]), r.choice([None, *range(-50, 400)]), r.choice([None, *range(-5, n)])) for _ in range(n)]
    a, b, records = make(200), make(90), make(150)
    schema = "k int, t long, id long, feed string, __tm_row int"
    frames = [spark.createDataFrame([(*x, "clash", 0) for x in rows], schema) for rows in (a, b, records)]
    got = match_nearest({"a": (frames[0], "t", "id"), "b": (frames[1], "t", "id")}, frames[2], ["k"], "t", "id", 6).collect()
    for name, rows in (("a", a), ("b", b)):
        assert sorted((x.row_id, x.record_id, x.distance) for x in got if x.feed == name) == nearest(rows, records, 6)


def test_empty_tables(spark):
    one = spark.createDataFrame([(1, 10, 0), (1, 10, 0)], "k int, t long, id long")
    none = one.where("false")
    assert match_nearest({"a": (none, "t", "id"), "b": (none, "t", "id")}, one, ["k"], "t", "id", 5).collect() == []
    assert match_nearest({"a": (one, "t", "id")}, none, ["k"], "t", "id", 5).collect() == []
    assert len(match_nearest({"a": (one, "t", "id"), "b": (none, "t", "id")}, one, ["k"], "t", "id", 0).collect()) == 2


def test_the_problems_have_their_queries():
    import __spark_entry__ as entry

    assert {"p3_found", "p6_pack", "p7_found", "p8_found"} <= set(entry.queries()) and "p3_found" in entry.oracle_sql()
