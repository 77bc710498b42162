import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_series import S, bars
from tidemark.functions.mathx import autoregression
from tidemark.operators import permute, strategy
from tidemark.operators.live_bars import last_trade_pairs, live_bars, with_running_max
from tidemark.operators.strategy import REGISTRY, Strategy, best_parameters, grid_scores, modal_parameters, walk_forward, with_strategy_returns
from tidemark.operators.trades import performance, trade_table

MIN = 60_000_000
T0 = 1_704_103_200_000_000
TRADES = "ticker string, seq long, timestamp_us long, price double, size double"


def trades(spark, rows):
    return spark.createDataFrame([("X", i, T0 + int(s * 1e6), p, v) for i, (s, p, v) in enumerate(rows)], TRADES)


def made(spark, rows, **kw):
    out = live_bars(trades(spark, rows), ["ticker"], "timestamp_us", "seq", "price", "size", **kw)
    return [((r.bucket_us - T0) // MIN, r.open, r.high, r.low, r.close, r.volume, r.synthetic) for r in out.orderBy("bucket_us").collect()]


def test_live_bar_rules(spark):
    day = [(0, 10.0, 1.0), (10, 12.0, 2.0), (20, 9.0, 3.0), (59, 11.0, 4.0), (60, 11.5, 1.0)]
    assert made(spark, day, discard_boot=False) == [(0, 10.0, 12.0, 9.0, 11.0, 10.0, False)]
    assert [r[0] for r in made(spark, [(30, 10.0, 1.0), (60, 10.5, 1.0), (120, 11.0, 1.0)])] == [1]
    assert made(spark, [(0, 10.0, 1.0), (180, 12.0, 1.0)], discard_boot=False) == [(0, 10.0, 10.0, 10.0, 10.0, 1.0, False), (1, 10.0, 10.0, 10.0, 10.0, 0.0, True), (2, 10.0, 10.0, 10.0, 10.0, 0.0, True)]
    assert len(made(spark, [(0, 10.0, 1.0), (3600, 12.0, 1.0)], max_gap=5, discard_boot=False)) == 1
    late = made(spark, [(0, 10.0, 1.0), (60, 11.0, 1.0), (5, 99.0, 1.0), (120, 11.0, 1.0)], discard_boot=False)
    assert [r[2] for r in late] == [10.0, 11.0]
    assert made(spark, [(0, -1.0, 1.0), (1, 1.0, 0.0), (2, None, 1.0)]) == []
    assert [r[4] for r in made(spark, [(0, 10.0, 1.0), (50, 11.0, 1.0), (40, 12.0, 1.0), (60, 1.0, 1.0)], discard_boot=False)] == [12.0]
    assert [(r[0], r[6]) for r in made(spark, [(0, 10.0, 1.0), (120, 11.0, 1.0), (180, 11.0, 1.0)])] == [(1, True), (2, False)]
    assert [r[0] for r in made(spark, [(0, 10.0, 1.0), (120, 11.0, 1.0), (180, 11.0, 1.0)], fill_gaps=False)] == [2]


def test_running_max_over_pieces(spark):
    rng = np.random.default_rng(1)
    v = [int(x) for x in rng.integers(0, 1000, 300)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, seq long, x long")
    got = [r.m for r in with_running_max(df, ["k"], ["seq"], "x", "m", size=16).orderBy("seq").collect()]
    assert got == [None, *[max(v[:i]) for i in range(1, 300)]]


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.bars import stream_bars, stream_sma_cross, watermarked_bars

    rng = np.random.default_rng(2)
    n = 600
    t = T0 + np.cumsum(rng.integers(0, 40, n)) * 1_000_000 + rng.integers(-90, 5, n) * 1_000_000 * (rng.random(n) < 0.2)
    pdf = pd.DataFrame({"ticker": rng.choice(["X", "Y"], n), "seq": np.arange(n), "timestamp_us": t, "price": np.round(100 + rng.normal(0, 1, n), 2), "size": rng.integers(0, 5, n).astype(float)})
    for k in range(3):
        spark.createDataFrame(pdf.iloc[k * 200 : (k + 1) * 200], TRADES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(TRADES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = stream_bars(stream, max_gap=3).writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    batch = live_bars(spark.createDataFrame(pdf, TRADES), ["ticker"], "timestamp_us", "seq", "price", "size", max_gap=3)
    cols = ["ticker", "bucket_us", "open", "high", "low", "close", "volume", "n_trades", "synthetic"]
    a, b = (d.select(cols).toPandas().sort_values(cols[:2]).reset_index(drop=True) for d in (spark.table("bars_out"), batch))
    pd.testing.assert_frame_equal(a, b)
    assert stream_sma_cross(stream.selectExpr("ticker", "timestamp_us AS bucket_us", "price AS close")).isStreaming
    assert watermarked_bars(stream).isStreaming


def test_tick_pairing(spark):
    rows = [("X", 0, 5, 3.0, 1), ("X", 1, 4, 10.0, 2), ("X", 2, 5, 7.0, 3), ("X", 3, 5, 8.0, 4), ("X", 4, 4, 0.0, 5), ("X", 5, 68, 11.0, 6), ("X", 6, 71, 1.0, 7), ("X", 7, 1, 9.0, 8)]
    df = spark.createDataFrame(rows, "k string, seq long, kind int, v double, t long")
    got = [(r.seq, r.timestamp_us, r.price, r.size) for r in last_trade_pairs(df, ["k"], "seq", "kind", "v", "t").orderBy("seq").collect()]
    assert got == [(2, 2, 10.0, 7.0), (3, 2, 10.0, 8.0), (6, 6, 11.0, 1.0)]


def with_signal(spark, closes, signal):
    n = len(closes)
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=n, freq="h"), "seq": range(n), "open": closes, "high": closes, "low": closes, "close": closes})
    return spark.createDataFrame(pdf).join(spark.createDataFrame([(i, s) for i, s in enumerate(signal)], "seq long, signal double"), "seq")


def test_trades_and_metrics(spark):
    closes = [100.0, 110.0, 105.0, 95.0, 100.0, 120.0]
    df = with_signal(spark, closes, [1.0, 1.0, -2.0, None, 0.5, 0.5])
    got = [(r.position, r.entry_price, r.exit_price, r.pnl, r.trade_size, r.result, r.holding_hours) for r in trade_table(df, S).orderBy("entry_time").collect()]
    assert got == [("long", 100.0, 105.0, 5.0, 1.0, "WIN", 2.0), ("short", 105.0, 95.0, 10.0, 2.0, "WIN", 1.0)]
    m = performance(df, S).collect()[0]
    assert (m.total_trades, m.winning_trades, m.total_pnl, m.win_rate, m.max_consecutive_wins, m.long_trades, m.short_trades) == (2, 2, 15.0, 1.0, 2, 1, 1)
    assert m.profit_factor == math.inf and m.payoff_ratio == math.inf and m.kelly == 0.0 and m.max_drawdown == 0.0 and not m.adequate_sample
    x = np.array([0, math.log(1.1), math.log(105 / 110), -2 * math.log(95 / 105), 0, 0.5 * math.log(1.2)])
    assert m.avg_return == pytest.approx(x.mean()) and m.sharpe_ratio == pytest.approx(x.mean() / x.std(ddof=1) * math.sqrt(252))
    flat = performance(with_signal(spark, closes, [0.0] * 6), S).collect()[0]
    assert flat.total_trades == 0 and flat.total_pnl is None


def test_nan_signal_is_flat(spark):
    assert trade_table(with_signal(spark, [1.0, 2.0, 3.0], [float("nan"), 1.0, float("nan")]), S).count() == 1


def test_buy_and_hold_and_costs(spark):
    b = spark.createDataFrame(bars(60))
    held = with_strategy_returns(REGISTRY.get("constant").apply(b, S, side=1.0), S).agg(F.sum("strategy_ret")).first()[0]
    p = bars(60).close.to_numpy()
    assert held == pytest.approx(math.log(p[-1] / p[0]))
    flip = b.withColumn("signal", F.when(F.col("seq") % 2 == 0, 1.0).otherwise(-1.0))
    free, paid = (with_strategy_returns(flip, S, spread_bps=c, commission_bps=c / 2).agg(F.sum("strategy_ret")).first()[0] for c in (0.0, 1.0))
    assert free - paid == pytest.approx((1 + 58 * 2) * 1.5e-4)


def test_registry():
    assert REGISTRY.get("DONCHIAN") is REGISTRY.get("donchian")
    assert len(REGISTRY.get("bollinger").combinations()) == 120 and Strategy("x", strategy.momentum).combinations() == [{}]
    with pytest.raises(KeyError):
        REGISTRY.get("nothing")


def test_grid_and_walk_forward_equal_loops(spark):
    pdf = bars(130, 5)
    df = spark.createDataFrame(pdf)
    st = Strategy("d", strategy.donchian, {"lookback": (5, 9, 14)}, holds=True)

    def signal(c, n):
        hi, lo = c.shift(1).rolling(n - 1).max(), c.shift(1).rolling(n - 1).min()
        return pd.Series(np.where(c > hi, 1.0, np.where(c < lo, -1.0, np.nan)), c.index).ffill()

    def score(c, n):
        r = (signal(c, n).shift(1).fillna(0) * np.log(c).diff().fillna(0)).to_numpy()
        gain, loss = r[r > 0].sum(), -r[r < 0].sum()
        return gain / loss if loss > 0 else (math.inf if gain > 0 else 0.0)

    got = {r.param_id: r.score for r in grid_scores(df, S, st, batch=2).collect()}
    assert got == pytest.approx({i: score(pdf.close, n) for i, n in enumerate((5, 9, 14))})
    out, choices = walk_forward(df, S, st, 60, 25)
    chosen = {r.win_id: r.param_id for r in choices.collect()}
    want, sig = {}, np.full(130, np.nan)
    for j, i in enumerate(range(60, 130, 25)):
        scores = [score(pdf.close.iloc[i - 60 : i].reset_index(drop=True), n) for n in (5, 9, 14)]
        want[j] = int(np.argmax(scores))
        sig[i : i + 25] = signal(pdf.close, (5, 9, 14)[want[j]])[i : i + 25]
    assert chosen == want
    np.testing.assert_array_equal(out.orderBy("seq").toPandas().signal.astype(float), sig)
    assert modal_parameters(choices, ["symbol"]).count() == 1
    ties = spark.createDataFrame([("a", 1, 2.0), ("a", 0, 2.0), ("a", 2, float("nan")), ("a", 3, None)], "symbol string, param_id int, score double")
    assert best_parameters(ties, ["symbol"]).first().param_id == 0


def test_permuted_bars(spark):
    pdf = pd.concat([bars(80, 1, "A"), bars(80, 2, "B")])
    df = spark.createDataFrame(pdf)
    out = permute.permute_bars(df, S, 3, start_index=20, extra=["volume"]).toPandas().sort_values(["perm_id", "symbol", "seq"])
    assert len(out) == 3 * 160
    for (p, symbol), g in out.groupby(["perm_id", "symbol"]):
        real = pdf[pdf.symbol == symbol].reset_index(drop=True)
        g = g.reset_index(drop=True)
        np.testing.assert_allclose(g.close.iloc[:21], real.close.iloc[:21])
        assert g.close.iloc[-1] == pytest.approx(real.close.iloc[-1]) and not np.allclose(g.close, real.close)
        assert ((g.high >= g[["open", "close"]].max(axis=1) - 1e-9) & (g.low <= g[["open", "close"]].min(axis=1) + 1e-9)).all()
        inside = np.sort(np.log(g.close / g.open).iloc[21:])
        np.testing.assert_allclose(inside, np.sort(np.log(real.close / real.open).iloc[21:]), atol=1e-12)
    a, b = (out[(out.perm_id == 1) & (out.symbol == s)].reset_index(drop=True) for s in "AB")
    ra, rb = (bars(80, k) for k in (1, 2))
    at = [int(np.argmin(np.abs(np.log(ra.close / ra.open) - x))) for x in np.log(a.close / a.open).iloc[21:]]
    np.testing.assert_allclose(np.log(b.close / b.open).iloc[21:], np.log(rb.close / rb.open).iloc[at], atol=1e-12)


def test_other_resampling(spark):
    pdf = bars(90, 1)
    df = spark.createDataFrame(pdf.assign(spot=pdf.close, futures=pdf.close * 1.01 + np.random.default_rng(0).normal(0, 0.1, 90)))
    rows = permute.permute_rows(df.select("symbol", "ts", "seq", "close"), S, 2, 10).toPandas()
    for _, g in rows.groupby("perm_id"):
        g = g.sort_values("seq")
        np.testing.assert_allclose(g.close.iloc[:10], pdf.close.iloc[:10])
        np.testing.assert_allclose(np.sort(g.close), np.sort(pdf.close))
    block = permute.bootstrap_blocks(df, S, 2, 0, 7).toPandas()
    moves = np.round(np.log(pdf.close).diff().fillna(0), 9)
    for _, g in block.groupby("perm_id"):
        assert set(np.round(np.log(g.sort_values("seq").close).diff().dropna(), 9)) <= set(moves)
    ar = permute.simulate_ar1(df, S, 2).toPandas()
    for _, g in ar.groupby("perm_id"):
        g = g.sort_values("seq").reset_index(drop=True)
        np.testing.assert_allclose(g.close, g.futures)
        np.testing.assert_allclose(g.futures.iloc[:50], df.toPandas().futures.iloc[:50])
    orders = permute.random_orders(spark, 10, 3).toPandas()
    assert all(sorted(g.source) == list(range(10)) for _, g in orders.groupby("perm_id"))


def test_permutation_test_finds_a_planted_edge(spark):
    rng = np.random.default_rng(4)
    out = []
    for k, phi in enumerate((0.35, 0.0)):
        r = np.zeros(800)
        for i in range(1, 800):
            r[i] = phi * r[i - 1] + rng.normal(0, 0.01)
        close = 100 * np.exp(np.cumsum(r))
        b = bars(800, symbol="AB"[k])
        b["close"], b["open"] = close, np.append(100.0, close[:-1])
        out.append(b.assign(high=np.maximum(b.open, b.close), low=np.minimum(b.open, b.close)))
    res = {r.symbol: r for r in permute.permutation_test(spark.createDataFrame(pd.concat(out)), S, REGISTRY.get("momentum"), 30).collect()}
    assert res["A"].p_value == pytest.approx(1 / 30) and res["B"].p_value > 1 / 30


def test_empty_inputs(spark):
    none = spark.createDataFrame(bars(3)).where("false")
    assert trade_table(none.withColumn("signal", F.lit(1.0)), S).count() == 0
    assert permute.permute_bars(none, S, 2).count() == 0
    assert live_bars(trades(spark, []), ["ticker"], "timestamp_us", "seq", "price", "size").count() == 0


def test_holdout_and_dispatch(spark):
    from tidemark.operators.validate import analyse, hybrid_walk_forward, split_holdout

    n = 200
    pdf = bars(n, 5).assign(ts=pd.date_range("2024-01-01", periods=n, freq="D"))
    df = spark.createDataFrame(pdf)
    split = split_holdout(df, S, 2).toPandas()
    assert split[split.is_holdout].ts.min() == pdf.ts.max() - pd.DateOffset(months=2)
    st = Strategy("d", strategy.donchian, {"lookback": (5, 9)}, holds=True)
    r = hybrid_walk_forward(df, S, st, 60, 20, 2).collect()[0]
    frozen = with_strategy_returns(st.apply(split_holdout(df, S, 2), S, lookback=(5, 9)[r.param_id]).where("is_holdout"), S).agg(F.sum("strategy_ret")).first()[0]
    assert r.holdout_return == pytest.approx(frozen) and r.verdict in ("severe", "moderate", "acceptable", "better", None)
    kinds = analyse(df, S, st, "walkforward", permutations=4, lookback=60, step=20)
    assert set(kinds) == {"walkforward", "choices", "walkforward_test"}
    t = kinds["walkforward_test"].first()
    assert t.p_value == (1 + t.n_at_least) / 4 and 0 <= t.n_at_least <= 3
    assert analyse(df, S, REGISTRY.get("momentum"), "metrics", end="2024-02-01")["metrics"].count() == 1
    with pytest.raises(ValueError):
        analyse(df, S, st, "other")


def test_top_of_book_on_price_and_size_ticks(spark):
    from tidemark.operators.live_bars import top_of_book

    ticks = [(1, 1, 10.0), (2, 0, 5.0), (3, 2, 11.0), (4, 1, 10.5), (5, 66, -1.0), (6, 0, 7.0), (7, 1, 10.2), (8, 70, 3.0), (9, 4, 99.0), (10, 3, None), (11, 67, 12.0)]
    df = spark.createDataFrame([("a", seq, kind, v, seq * 100) for seq, kind, v in ticks], "k string, seq long, kind int, v double, t long")
    got = [(r.seq, r.timestamp_us, r.side, r.price, r.size) for r in top_of_book(df, ["k"], "seq", "kind", "v", "t").orderBy("seq").collect()]
    assert got == [(2, 200, 1, 10.0, 5.0), (4, 400, 1, 10.5, 5.0), (7, 700, 1, 10.2, 7.0), (8, 800, 0, 11.0, 3.0), (11, 1100, 0, 12.0, 3.0)]


def test_permutation_test_moments(spark):
    from tidemark.operators.strategy import with_strategy_returns

    df = spark.createDataFrame(bars(120, 3))
    r = permute.permutation_test(df, S, REGISTRY.get("momentum"), 6).first()
    own = type(S)([permute.PERM, *S.keys], S.order)
    done = with_strategy_returns(REGISTRY.get("momentum").apply(permute.permute_bars(df, S, 5), own), own, "signal", 0.0, 0.0)
    totals = done.groupBy(permute.PERM).agg(F.sum("strategy_ret").alias("x")).toPandas().x
    assert len(totals) == 5 and r.permuted_mean == pytest.approx(totals.mean()) and r.permuted_std == pytest.approx(totals.std(ddof=0))


def test_live_counters(spark):
    from tidemark.operators.live_bars import live_counters

    minutes = [(1, 0, 1.0), (2, 1, 1.0), (3, 4, 1.0), (4, 1, 1.0), (5, 4, -1.0), (6, 4, None), (7, 300, 1.0)]
    df = spark.createDataFrame([("a", m * 60_000_000, q, p, 1.0) for q, m, p in minutes] + [(None, 0, 1, 0.0, 1.0)], "k string, t long, seq long, price double, size double")
    got = {r.k: tuple(r)[1:] for r in live_counters(df, ["k"], "t", "seq", "price", "size").collect()}
    assert got == {"a": (5, 1, 2, 4, 2, 1, 1), None: (0, 0, 1, 0, 0, 0, 0)}


def series_bars(n=240, seed=5, symbol="A", start="2024-01-01", freq="min"):
    r = np.random.default_rng(seed)
    close = 60 + 9 * np.sin(np.arange(n) / 11) + r.random(n)
    open_ = close + r.random(n) - 0.5
    return pd.DataFrame({"symbol": symbol, "ts": pd.date_range(start, periods=n, freq=freq), "seq": np.arange(n), "open": open_, "high": np.maximum(open_, close) + 0.2, "low": np.minimum(open_, close) - 0.2, "close": close, "volume": 1000.0})


def test_extra_columns_of_permuted_bars(spark):
    pdf = series_bars(12)
    pdf.loc[5, "volume"] = 0.0
    pdf["futures"], pdf["tag"] = pdf.close + 1, 7.0
    df = spark.createDataFrame(pdf)
    out = permute.permute_bars(df, S, 3, extra=["volume"]).toPandas()
    assert np.allclose(out.volume, 1000.0)  # the move from and to a zero is none
    kept = permute.permute_bars(df, S, 2, extra=["futures", "tag"], extra_mode="preserve").toPandas().sort_values(["perm_id", "seq"])
    assert np.allclose(kept.futures, np.tile(pdf.futures, 2)) and (kept.tag == 7.0).all()
    synced = permute.permute_bars(df, S, 2, extra=["futures", "tag"], extra_mode="sync_close").toPandas()
    moved = synced[synced.seq > 0]
    assert np.allclose(moved.futures, moved.close) and (synced.tag == 7.0).all()
    with pytest.raises(ValueError):
        permute.permute_bars(df, S, 2, extra_mode="other")


def test_series_of_one_index(spark):
    a, b = series_bars(30), series_bars(30, 6, "B")
    assert permute.unaligned_series(spark.createDataFrame(pd.concat([a, b])), S).count() == 0
    off = spark.createDataFrame(pd.concat([a, b.iloc[:-1]]))
    assert [r.n_rows for r in permute.unaligned_series(off, S).collect()] == [1]
    with pytest.raises(ValueError):
        permute.permute_bars(off, S, 2, aligned=True)


def test_autoregression_equals_the_recursion():
    e = np.random.default_rng(2).normal(0, 1, 333)
    for phi in (0.0, 0.4, -0.9, 0.999):
        y, want = 2.5, []
        for x in e:
            y = phi * y + x
            want.append(y)
        np.testing.assert_allclose(autoregression(e, phi, 2.5), want, rtol=1e-9)


def test_paper_demo_and_curves(spark):
    from tidemark.operators import trades

    pdf = series_bars(80)
    pdf["target"] = np.where(pdf.seq < 10, 0.0, np.sign(np.sin(pdf.seq / 9)))
    df = spark.createDataFrame(pdf)
    p = trades.paper_bars(df, S).toPandas().sort_values("seq").reset_index(drop=True)
    held = pdf.target.shift(fill_value=0.0)
    flip = held.diff().fillna(held).abs()
    net = held * pdf.close.diff().fillna(0) - flip * 1e-4 * pdf.close
    assert np.allclose(p.held, held) and np.allclose(p.net, net)
    papered = trades.paper_bars(df, S)
    (s,) = trades.paper_summary(papered, S).collect()
    assert s.n_flips == (flip > 0).sum() == trades.paper_fills(papered, S).count() and s.sharpe == pytest.approx(net.mean() / net.std(ddof=0))
    assert s.win_rate == pytest.approx(100 * (net > 0).sum() / (net != 0).sum())
    table = trades.trade_table(df.withColumnRenamed("target", "signal"), S).toPandas()
    curve = trades.trade_pnl_curve(df.withColumnRenamed("target", "signal"), S).toPandas().sort_values("seq")
    assert curve.cum_pnl.iloc[-1] == pytest.approx(table.pnl.sum()) and curve.cum_pnl.iloc[0] == 0
    equity = trades.equity_curve(df.withColumnRenamed("target", "signal"), S).toPandas().sort_values("seq")
    assert equity.equity.iloc[-1] == pytest.approx((held * np.log(pdf.close).diff().fillna(0)).sum())
    assert trades.last_signals(df, S, "target").first().target == pdf.target.iloc[-1]


def test_latest_profit_of_each_ticker(spark):
    from tidemark.operators.trades import latest_pnl

    rows = [(1, 1, 1, 5.0, 1.0), (1, 1, 3, 7.0, 2.0), (1, 2, 2, -1.0, 0.5), (1, -1, 9, 99.0, 99.0), (2, 1, 4, None, 3.0), (2, 1, None, 8.0, 8.0)]
    got = latest_pnl(spark.createDataFrame(rows, "g int, k int, n int, r double, u double"), ["g"], "k", "n", "r", "u").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 2, 6.0, 2.5), (2, 1, None, 3.0)]


def test_registry_file(tmp_path):
    from tidemark.operators.strategy import Registry, Strategy

    path = str(tmp_path / "known.json")
    REGISTRY.save(path)
    again = Registry.load(path)
    assert again.get("Donchian").signal is strategy.donchian and list(again.get("bollinger").grid["std_multiplier"]) == [1.5, 2.0, 2.5] and again.get("donchian").holds
    mine = Registry.load()
    mine.register(Strategy("own", strategy.momentum))
    assert "OWN" in mine.names() and "OWN" not in REGISTRY.names()
    with pytest.raises(FileNotFoundError):
        Registry.load(str(tmp_path / "none.json"))


def test_window_defaults():
    from tidemark.operators.validate import default_windows

    assert default_windows(600) == (200, 33) and default_windows(120) == (40, 10) and default_windows(300_000) == (20_000, 3333) and default_windows(9_000) == (3_000, 500)


def test_stream_and_batch_agree_on_nan_and_null(spark, tmp_path):
    from tidemark.operators.live_bars import live_bars, live_counters
    from tidemark.streaming.bars import COUNTERS, stream_bars, stream_counters

    r = np.random.default_rng(3)
    rows = []
    for i in range(600):
        t = None if i % 97 == 0 else int(i * 7_000_000 - (400_000_000 if i % 53 == 0 else 0) + (180_000_000 if i > 300 else 0) + (1_200_000_000 if i > 450 else 0))
        rows.append(("AB"[i % 2], i, t, (float("nan"), None, -1.0)[i % 3] if i % 41 == 0 else float(r.integers(90, 110)), float(r.integers(1, 9)) if i % 59 else None))
    df = spark.createDataFrame(rows, TRADES)
    for k in range(6):
        df.where(f"seq >= {k * 100} AND seq < {k * 100 + 100}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(TRADES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = stream_bars(stream, max_gap=3).writeStream.format("memory").queryName("bars_nan").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    cols = ["ticker", "bucket_us", "open", "high", "low", "close", "volume", "n_trades", "synthetic"]
    got = sorted(map(str, map(tuple, spark.table("bars_nan").select(cols).collect())))
    want = live_bars(df, ["ticker"], "timestamp_us", "seq", "price", "size", max_gap=3).select(cols).collect()
    counting = stream_counters(stream, max_gap=3).writeStream.format("memory").queryName("bars_counted").outputMode("update").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    counting.awaitTermination(120)
    names = ["ticker", *COUNTERS]
    last = spark.table("bars_counted").groupBy("ticker").agg(*(F.max(c).alias(c) for c in COUNTERS))
    counted = live_counters(df, ["ticker"], "timestamp_us", "seq", "price", "size", max_gap=3).select(names)
    assert sorted(map(tuple, last.select(names).collect())) == sorted(map(tuple, counted.collect())) and counted.agg(F.min("large_gaps")).first()[0] > 0
    assert got == sorted(map(str, map(tuple, want))) and any("True" in x for x in got)


def test_tick_sink_by_ticker_and_kind(spark, tmp_path):
    from tidemark.streaming.bars import read_ticks, write_ticks

    schema = "ticker string, kind int, seq long, value double"
    spark.createDataFrame([("A", 1, 1, 2.0), ("A", 2, 2, 3.0), ("B", 1, 3, 4.0)], schema).write.parquet(f"{tmp_path}/in")
    write_ticks(read_ticks(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").where("ticker = 'A'").count() == 2
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} >= {"ticker=A", "ticker=B"}
