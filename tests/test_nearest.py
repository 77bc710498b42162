import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import nearest
from tidemark.operators.nearest import nearest_by_time


def brute(left, right, tolerance, direction):
    out = []
    for k, t, i in left:
        if None in (k, t, i):
            continue
        best = None
        for rk, rt, ri in right:
            if None in (rk, rt, ri) or rk != k:
                continue
            if tolerance is not None and abs(rt - t) > tolerance or direction == "backward" and rt > t or direction == "forward" and rt < t:
                continue
            cand = (abs(rt - t), rt, ri)
            best = min(best, cand) if best else cand
        if best:
            out.append((k, i, best[2], best[1] - t))
    return sorted(out)


@pytest.mark.parametrize("direction,tolerance", [("nearest", 5), ("backward", 8), ("forward", None)])
@pytest.mark.parametrize("parts", [1, 23])
def test_equals_brute_force_with_a_hot_key_over_many_partitions(spark, monkeypatch, direction, tolerance, parts):
    monkeypatch.setattr(nearest, "part_count", lambda df: parts)
    rng = random.Random(parts)
    make = lambda n: [(rng.choice([1, 1, 1, 1, 2, None]), rng.choice([None, *range(400)]), rng.choice([*range(n), None])) for _ in range(n)]
    left, right = make(300), make(120)
    a = spark.createDataFrame([(*r, "x", 0) for r in left], "k int, t long, id long, __tm_t string, q int")
    b = spark.createDataFrame([(*r, 1.0) for r in right], "k int, t long, id long, q double")
    got = nearest_by_time(a, b, ["k"], "t", "id", "t", "id", tolerance, direction)
    assert sorted((r.k, r.left_id, r.right_id, r.distance) for r in got.collect()) == brute(left, right, tolerance, direction)


def test_ties_take_the_earlier_then_the_smallest_id(spark):
    a = spark.createDataFrame([(1, 10, 0), (1, 10, 0)], "k int, t long, id long")
    b = spark.createDataFrame([(1, 12, 1), (1, 8, 5), (1, 8, 3), (1, 8, 4)], "k int, t long, id long")
    assert [(r.right_id, r.distance) for r in nearest_by_time(a, b, ["k"], "t", "id", "t", "id", 5).collect()] == [(3, -2)] * 2


def test_one_moment_that_fills_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(nearest, "part_count", lambda df: 16)
    a = spark.createDataFrame([(1, 10, i) for i in range(200)], "k int, t long, id long")
    b = spark.createDataFrame([(1, 10, i) for i in range(200, 0, -1)], "k int, t long, id long")
    assert {r.right_id for r in nearest_by_time(a, b, ["k"], "t", "id", "t", "id", 0).collect()} == {1}


def test_empty_sides(spark):
    a = spark.createDataFrame([(1, 10, 0)], "k int, t long, id long")
    for x, y in ((a, a.where("false")), (a.where("false"), a), (a.where("false"), a.where("false"))):
        assert nearest_by_time(x, y, ["k"], "t", "id", "t", "id", 5).collect() == []


def test_prefix_scan_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 4)
    rng = random.Random(2)
    vals = [rng.choice([None, i]) for i in range(30)]
    parts = spark.createDataFrame(list(enumerate(vals)), f"{nearest.PID} int, v int")
    up = {r[0]: r.out for r in nearest.prefix_max(parts, "v", "out").select(nearest.PID, "out").collect()}
    down = {r[0]: r.out for r in nearest.prefix_max(parts, "v", "out", reverse=True).select(nearest.PID, "out").collect()}
    for i in range(30):
        assert up[i] == max((v for v in vals[:i] if v is not None), default=None)
        assert down[i] == min((v for v in vals[i + 1 :] if v is not None), default=None)


def test_scan_does_not_depend_on_batches():
    """Left rows wait for the right row after them, whatever the batch it comes in."""
    rng = np.random.default_rng(4)
    n = 400
    rows = sorted(zip(rng.integers(0, 4, n).tolist(), rng.integers(0, 60, n).tolist(), (rng.random(n) < 0.6).astype(int).tolist(), rng.integers(0, 99, n).tolist(), strict=True))
    table = pa.table({"k": [r[0] for r in rows], "t": [r[1] for r in rows], "id": [r[3] for r in rows], "tag": pa.array([r[2] for r in rows], pa.int32())})

    def scan(at_once):
        out = pa.Table.from_batches(nearest._scan(1, at_once)(iter(table.to_batches(max_chunksize=at_once))))
        return sorted(map(str, out.to_pylist()))

    whole = scan(1000)
    assert len(whole) == sum(r[2] for r in rows) + 2
    assert scan(1) == scan(7) == scan(50) == whole
