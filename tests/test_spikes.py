import numpy as np
import pytest

from tidemark.functions.isolation import Forest, mean_path
from tidemark.operators.spikes import Facts, Piece, SpikeLimits, _edge_states, _merge_runs, _run_feature, _runs, _timed, implausible_readings

TRADES = "recording_id long, ticker_id int, timestamp_us long, seq long, price double, size double, feed string"
L2 = "recording_id long, ticker_id int, timestamp long, seq long, price double, kind int, side int, position int, operation int"


def frames(spark, trades, l2):
    i = spark.createDataFrame([(1, 0.01), (2, 0.01)], "ticker_id int, tick_size double")
    return spark.createDataFrame(trades, TRADES), spark.createDataFrame(l2, L2), i


def walk(ticker, n=600, seed=0):
    rng = np.random.default_rng(seed)
    price = np.round(100 + np.cumsum(rng.normal(0, 0.05, n)), 2)
    size = rng.integers(1, 20, n)
    return [[1, ticker, i * 1_000_000, ticker * 10_000 + i, float(p), float(s), "x"] for i, (p, s) in enumerate(zip(price, size, strict=True))]


@pytest.mark.parametrize("segment", [50_000, 250])
def test_planted_cases(spark, segment):
    rows = walk(1)
    rows[100][4] *= 1.2
    rows[101][4] *= 1.2  # a short burst
    rows[200][4], rows[201][4], rows[202][4] = float("nan"), -1.0, float("inf")
    rows[203][5] = 0.0
    rows[300][5] = 5000.0  # beyond what the ticker trades
    rows[310][5] = 120.0  # a block trade
    for r in rows[400:]:
        r[4] += 8.0  # a lasting change of level
    for r in rows[450:490]:
        r[4] = rows[449][4]  # stuck
    rows[448][4] = rows[449][4] + 0.07
    rows[520][4] = None
    rows.append([1, 1, None, 20_000, 500.0, 5.0, "x"])  # no time: placed by arrival
    rows.append([*rows[100][:3], 20_001, *rows[100][4:]])  # recorded again
    t, l2, i = frames(spark, [tuple(r) for r in rows], [])
    got = {(r.seq - 10_000, r.field, r.reason) for r in implausible_readings(t, l2, i, SpikeLimits(segment=segment)).collect()}
    want = {(100, "price", "spike"), (101, "price", "spike"), (10_001, "price", "spike"), (10_000, "price", "spike"), (300, "size", "spike"), (203, "size", "physical")}
    want |= {(k, "price", "physical") for k in (200, 201, 202)}
    want |= {(k, "price", "stuck") for k in range(450, 490)}
    assert got == want


def test_book_rules(spark):
    rows = []
    for i in range(900):
        mid = 50 + 0.02 * np.sin(i / 9) * 5
        kind, side = (1, i % 2) if i % 3 else (2, (i // 3) % 2)
        rows.append([2, 1, i * 1_000_000, i, round(float(mid) + (0.01 if side == 0 else -0.01), 2), kind, side, 0, 1])
    rows[500][4] = 60.0
    rows[501][8], rows[501][4] = 2, 0.0  # a delete's price is no reading
    t, l2, i = frames(spark, [], [tuple(r) for r in rows])
    assert [(r.feed, r.seq, r.reason) for r in implausible_readings(t, l2, i).collect()] == [("l2", 500, "spike")]


def test_degenerate_inputs(spark):
    t, l2, i = frames(spark, [], [])
    assert implausible_readings(t, l2, i).collect() == []
    few = [(None, None, None, 1, 5.0, 1.0, None), (1, 9, 5, 2, None, None, None), (1, 9, 5, 3, 0.0, 2.0, None), (1, 9, 5, 3, 0.0, 2.0, None)]
    t, l2, i = frames(spark, few, [(1, 1, 5, 9, 7.0, None, None, None, None)])
    assert sorted((r.seq, r.field) for r in implausible_readings(t, l2, i).collect()) == [(3, "price"), (3, "price")]
    same = [(1, 1, i, i, 5.0, 1.0, None) for i in range(10)]
    assert implausible_readings(*frames(spark, same, [])).collect() == []


def marks(spark, rows, l2=(), **limits):
    t, book, i = frames(spark, [tuple(r) for r in rows], [tuple(r) for r in l2])
    return {(r.feed, r.seq, r.field, r.reason) for r in implausible_readings(t, book, i, SpikeLimits(**limits)).collect()}


def test_marks_do_not_depend_on_the_pieces(spark):
    """A drifting source with null times, a run across the border of pieces and one over whole pieces; a side of the book that stands still."""
    rows = walk(1, 3000, seed=2)
    for i, r in enumerate(rows):
        r[4] = round(r[4] + 0.02 * i, 2)
    for k in (700, 1400, 2100):
        rows[k][2] = None
    rows[1700][4] *= 1.3
    for r in rows[970:1030]:
        r[4] = rows[970][4]
    for r in rows[2190:2650]:
        r[4] = rows[2190][4]
    rows[500][5] = 9000.0
    book = []
    rng = np.random.default_rng(3)
    mid = 50 + np.cumsum(rng.normal(0, 0.01, 2400))
    for i in range(2400):
        kind, side = (1, i % 2) if i % 3 else (2, (i // 3) % 2)
        frozen = kind == 1 and side == 0 and 780 <= i < 1250
        book.append([1, 1, i * 1_000_000, i, round(float(mid[780 if frozen else i]) + (0.01 if side == 0 else -0.01), 2), kind, side, 0, 1])
    whole = marks(spark, rows, book)
    assert ("trade", 11_700, "price", "spike") in whole and ("trade", 10_500, "size", "spike") in whole
    assert {s - 10_000 for f, s, _, r in whole if f == "trade" and r == "stuck"} == {*range(971, 1030), *range(2191, 2650)}
    assert not {s for f, s, *_ in whole if f == "trade"} & {10_700, 11_400, 12_100}
    assert {s for f, s, _, r in whole if f == "l2" and r == "stuck"} >= {i for i in range(800, 1240) if i % 3 and i % 2 == 0}
    for segment in (1000, 200):
        assert marks(spark, rows, book, segment=segment) == whole


def test_the_score_decides(spark):
    rows = walk(1)
    rows[100][4] *= 1.2
    for r in rows[300:360]:
        r[4] = rows[300][4]
    rows[500][4] = -1.0
    assert {r for *_, r in marks(spark, rows)} == {"physical", "spike", "stuck"}
    assert {r for *_, r in marks(spark, rows, score=0.999)} == {"physical"}
    assert len(marks(spark, rows, score=0.5)) > len(marks(spark, rows))


def test_rows_without_time_are_placed_by_arrival(spark):
    df = spark.createDataFrame([(1, 7, None, 0), (1, 7, 100, 1), (1, 8, 300, 20), (1, 7, None, 40), (1, 7, 500, 60), (2, 7, None, 50), (None, 7, 900, 5), (None, 7, None, 100_000)], "recording_id long, ticker_id int, time long, seq long")
    got = {(r.recording_id, r.seq): r.t for r in _timed(df, "time").collect()}
    assert got == {(1, 0): 100, (1, 1): 100, (1, 20): 300, (1, 40): 300, (1, 60): 500, (2, 50): 0, (None, 5): 900, (None, 100_000): 900}


def test_merged_runs_equal_runs_of_the_whole():
    rng = np.random.default_rng(9)
    n, lim = 400, SpikeLimits()
    stream, v = rng.integers(0, 2, n), np.repeat(rng.integers(1, 4, 80), 5).astype(float)
    stream[100:220] = 1  # one stream is silent for whole pieces
    t = np.sort(rng.integers(0, 300, n))
    make = lambda low, high: Piece(2, v, t, np.arange(n), stream, np.zeros(n, dtype=np.int64), 0.0, low, high, 1)
    whole = make(0, n)
    for size in (7, 50, 150):
        pieces = {k: make(a, min(n, a + size)) for k, a in enumerate(range(0, n, size))}
        states = {k: _edge_states(p, lim) for k, p in pieces.items()}
        edges, lengths = _merge_runs({k: s for k, (s, _) in states.items()}, lim)
        facts = Facts(bounds={0: 3.0, 1: 3.0})
        want = _run_feature(whole, facts, SpikeLimits(stuck=2))
        got = np.concatenate([_run_feature(p, Facts(bounds=facts.bounds, edges=edges[k]), SpikeLimits(stuck=2)) for k, p in pieces.items()])
        assert np.array_equal(got, want)
        for s in (0, 1):
            runs = sorted([*lengths.get(s, []), *(x for _, w in states.values() for x in w.get(s, []))])
            assert runs == sorted(_runs(whole, s).length)


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (500, 4)).astype(np.float32)
    x[7] = 9
    forest = Forest(x[rng.integers(8, 500, (32, 64))], 1)
    s = forest.score(x)
    assert s.argmax() == 7 and s[7] > 0.7 and 0.35 < np.median(s) < 0.55
    far = forest.score(np.outer([2, 4, 8, 16], np.ones(4)))  # beyond all points, and still told apart
    assert (np.diff(far) > 0).all()
    constant = np.ones((20, 4), dtype=np.float32)
    assert len(set(Forest(constant[None].repeat(8, 0), 1).score(constant).tolist())) == 1
    assert Forest(x[None, :1], 1).score(x[:1]).shape == (1,)
    assert mean_path(np.array([1, 2])).tolist() == [0, 1]
