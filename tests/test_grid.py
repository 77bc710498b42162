from tidemark.operators.grid import regular_grid

SCHEMA = "k string, t long, seq long, v double, s double, value string"


def grid(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    out = regular_grid(df, ["k"], "t", "v", 10, "seq", "s", **kw)
    return sorted(((r.k or "", r.bucket_us, r.value, r.volume, r.n_readings, r.gap, r.synthetic) for r in out.collect()), key=lambda r: r[:2])


def test_gaps_by_length(spark):
    rows = [("a", 5, 1, 1.0, 2.0), ("a", 7, 2, 2.0, 1.0), ("a", 25, 3, 4.0, 1.0), ("a", 61, 4, 8.0, 1.0)]
    got = grid(spark, rows, interpolate_up_to=1, hold_up_to=2)
    assert [r[1:3] for r in got] == [(0, 2.0), (10, 3.0), (20, 4.0), (30, None), (40, None), (50, None), (60, 8.0)]
    assert [r[5] for r in got] == [None, 1, None, 3, 3, 3, None]
    assert got[0][3:5] == (3.0, 2) and got[1][3:5] == (0.0, 0)
    assert [r[2] for r in grid(spark, rows, hold_up_to=3)][3:6] == [4.0] * 3


def test_last_reading_by_time_then_sequence(spark):
    assert [r[2] for r in grid(spark, [("a", 7, 1, 1.0, 1.0), ("a", 5, 9, 2.0, 1.0), ("a", 7, 2, 3.0, 1.0)])] == [3.0]


def test_nulls_repeats_and_times_before_the_epoch(spark):
    rows = [(None, -5, 1, 1.0, 1.0), (None, 15, 2, 2.0, 1.0), ("a", None, 3, 1.0, 1.0), ("b", 3, 4, None, 1.0), ("c", 3, 5, 1.0, None), ("c", 3, 5, 1.0, None)]
    got = grid(spark, rows)
    assert [r[:2] for r in got] == [("", -10), ("", 0), ("", 10), ("c", 0)]
    assert got[3][3:5] == (None, 2)


def test_bounds_extend_only_outward(spark):
    b = spark.createDataFrame([("a", -15, 45), ("b", 12, 14), ("z", 0, 100)], "k string, from_us long, to_us long")
    got = grid(spark, [("a", 5, 1, 1.0, 1.0), ("b", 5, 1, 1.0, 1.0), ("b", 25, 1, 3.0, 1.0)], bounds=b, hold_up_to=4, interpolate_up_to=1)
    assert [r[1:3] for r in got if r[0] == "a"] == [(-20, None), (-10, None), (0, 1.0), (10, 1.0), (20, 1.0), (30, 1.0), (40, 1.0)]
    assert [r[1:3] for r in got if r[0] == "b"] == [(0, 1.0), (10, 2.0), (20, 3.0)]


def test_empty(spark):
    assert grid(spark, []) == []


def test_one_stray_time_makes_no_long_row(spark):
    rows = [(1, 0, 1.0), (1, 60_000_000 * 20_000, 2.0), (1, 60_000_000 * 20_002, 3.0)]
    out = regular_grid(spark.createDataFrame(rows, "k int, t long, v double"), ["k"], "t", "v", 60_000_000)
    got = [r.bucket_us // 60_000_000 for r in out.where("synthetic").orderBy("bucket_us").collect()]
    assert got == [*range(1, 20_000), 20_001]
