"""Queries for the series, order-flow, trading and validation operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.mathx import day_number, normal_cdf_sql
from tidemark.functions.model import FrozenLogistic
from tidemark.operators import features, micro, permute, pit, strategy
from tidemark.operators.grid import bucket_start
from tidemark.operators.joins import asof_backward, asof_forward, matching_contract, trailing_count
from tidemark.operators.labeling import triple_barrier
from tidemark.operators.live_bars import last_trade_pairs, live_bars, live_counters, routed, top_of_book
from tidemark.operators.trades import equity_curve, last_signals, latest_pnl, paper_bars, paper_fills, paper_summary, performance, trade_pnl_curve, trade_table
from tidemark.operators.validate import hybrid_walk_forward
from tidemark.operators.windows import Series, in_segments
from tidemark.session import new_path
from tidemark.sources import readers, wire
from tidemark.sources.tables import table

MINUTE = 60_000_000
S = Series()


def _rounded(df: DataFrame, keep: list[str], digits: int = 6) -> DataFrame:
    """Doubles but ``keep`` rounded; NaN and infinities as they are."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double" and c not in keep})


def bars(spark: SparkSession, d: str) -> DataFrame:
    """One bar for each symbol and minute: of repeated ones the first that arrived."""
    once = Window.partitionBy("symbol", "ts").orderBy("seq")
    raw = features.clean_bars(table(spark, d, "bars")).select("symbol", "ts", "seq", "open", "high", "low", "close", "volume")
    return raw.withColumn("__tm_n", F.row_number().over(once)).where("__tm_n = 1").drop("__tm_n")


B = """
    b AS (
        SELECT symbol, ts, seq, open, high, low, close, volume FROM bars
        QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq) = 1
    )
"""
W = "(PARTITION BY symbol ORDER BY ts, seq)"


def roll(n: int, part: str = "symbol") -> str:
    return f"(PARTITION BY {part} ORDER BY ts, seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int, part: str = "symbol") -> str:
    return f"CASE WHEN count({x}) OVER {roll(n, part)} >= {n} THEN {agg}({x}) OVER {roll(n, part)} END"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""
    WITH {B}, r AS (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS ret, ln(close) - ln(lag(close) OVER {W}) AS log_ret, lag(close) OVER {W} AS pc FROM b),
    q AS (
        SELECT *, greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) AS tr,
            CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss,
            {full('avg', 'close', 20)} AS sma, {full('stddev_samp', 'close', 20)} AS std,
            {full('min', 'low', 20)} AS low_n, {full('max', 'high', 20)} AS high_n,
            CASE WHEN count(close) OVER {roll(20)} >= 20 THEN (len(list_filter(list(close) OVER {roll(20)}, lambda v: v <= close)) - 1) / 19 END AS rank
        FROM r
    ), p AS (SELECT *, {full('avg', 'gain', 14)} AS up, {full('avg', 'loss', 14)} AS down, {full('stddev_samp', 'log_ret', 20)} AS rv, {full('avg', 'tr', 14)} AS atr14 FROM q)
    SELECT symbol, ts, seq, round(ret, 6) AS ret, round(log_ret, 6) AS log_ret, round(tr, 6) AS tr, round(sma, 6) AS sma, round(std, 6) AS std,
        round(CASE WHEN std > 1e-9 THEN (close - sma) / std END, 4) + 0 AS zscore, round(rank, 6) AS rank, round(low_n, 6) AS low_n, round(high_n, 6) AS high_n,
        round(rv, 6) AS realized_vol, round(atr14, 6) AS atr, round(CASE WHEN down = 0 THEN 100 WHEN down > 0 THEN 100 - 100 / (1 + up / down) END, 6) AS rsi
    FROM p
""")
def bar_features(spark: SparkSession, d: str) -> DataFrame:
    """Returns, averages, deviations, rank, ranges and RSI of all bars, in segments that a hot symbol is cut into."""
    done = in_segments(bars(spark, d), S, 64, lambda df, s: features.with_features(df, s))
    z = F.when(F.col("std") > 1e-9, F.col("zscore"))
    out = done.withColumn("zscore", F.round(z, 4) + 0.0).drop("open", "high", "low", "close", "volume")
    return _rounded(out, ["zscore"])


@query(f"""
    WITH {B}, n AS (SELECT *, row_number() OVER {W} - 1 AS k FROM b)
    SELECT x.symbol, x.ts, x.seq, round(sum(CASE WHEN y.k = 0 THEN 1 ELSE 2.0::DOUBLE / 21 END * pow(19.0::DOUBLE / 21, x.k - y.k) * y.close), 5) AS ema
    FROM n x JOIN n y ON x.symbol = y.symbol AND y.k <= x.k AND x.k - y.k < 500 GROUP BY ALL
""")
def bar_ema(spark: SparkSession, d: str) -> DataFrame:
    """Exponential moving average of span 20."""
    return features.with_ema(bars(spark, d), S, "close", 20, "ema").select("symbol", "ts", "seq", F.round("ema", 5).alias("ema"))


def _bvc_sql(mode: str) -> str:
    move = {"close_return": "ln(greatest(close, 1e-12)) - ln(greatest(lag(close) OVER " + W + ", 1e-12))", "close_minus_open": "close - open", "close_close_lag1": f"close - lag(close) OVER {W}"}[mode]
    first = "WHEN false THEN 0.0" if mode == "close_minus_open" else f"WHEN lag(1) OVER {W} IS NULL THEN 0.0"
    return f"""
        m_{mode} AS (SELECT *, CASE {first} ELSE {move} END AS m FROM b),
        s_{mode} AS (SELECT *, CASE WHEN count(m) OVER {roll(30)} >= 10 THEN stddev_samp(m) OVER {roll(30)} END AS dev FROM m_{mode}),
        z_{mode} AS (SELECT *, greatest(least(m / CASE WHEN dev > 1e-12 THEN dev ELSE 1e-12 END, 8.0), -8.0) AS z FROM s_{mode}),
        f_{mode} AS (SELECT symbol, ts, seq, volume, {normal_cdf_sql('z', '')} AS buy_fraction FROM z_{mode})"""


@query(f"""
    WITH {B}, {_bvc_sql('close_return')}, {_bvc_sql('close_minus_open')}, {_bvc_sql('close_close_lag1')}
    SELECT a.symbol, a.ts, a.seq, round(a.buy_fraction, 5) AS close_return, round(c.buy_fraction, 5) AS close_minus_open, round(e.buy_fraction, 5) AS close_close_lag1
    FROM f_close_return a JOIN f_close_minus_open c USING (symbol, ts, seq) JOIN f_close_close_lag1 e USING (symbol, ts, seq)
""")
def bulk_volume(spark: SparkSession, d: str) -> DataFrame:
    """Bought share of each bar's volume in the three modes."""
    out = bars(spark, d)
    for mode in micro.MODES:
        out = micro.with_buy_fraction(out, S, mode, out=mode)
    return _rounded(out.select("symbol", "ts", "seq", *micro.MODES), [], 5)


@query(f"""
    WITH {B}, {_bvc_sql('close_return')},
    v AS (SELECT *, sum(volume) OVER {W} AS e FROM f_close_return WHERE volume > 1e-12),
    c AS (SELECT *, unnest(generate_series(CAST(floor((e - volume) / 2000) AS BIGINT), greatest(CAST(ceil(e / 2000) AS BIGINT) - 1, CAST(floor((e - volume) / 2000) AS BIGINT)))) AS bucket_id FROM v),
    o AS (SELECT *, greatest(least(e, (bucket_id + 1) * 2000.0::DOUBLE) - greatest(e - volume, bucket_id * 2000.0::DOUBLE), 0) AS p FROM c),
    g AS (SELECT symbol, bucket_id, sum(p * coalesce(buy_fraction, 0.5)) AS vb, sum(p * (1 - coalesce(buy_fraction, 0.5))) AS vs, max(ts) AS bucket_end_ts FROM o WHERE p > 0 GROUP BY ALL),
    k AS (SELECT *, abs(vb - vs) / greatest(vb + vs, 1e-12) AS ai, (vb - vs) / greatest(vb + vs, 1e-12) AS di FROM g WHERE vb + vs >= 2000 - 1e-9)
    SELECT symbol, bucket_id, round(vb, 3) AS v_buy, round(vs, 3) AS v_sell, round(ai, 5) AS abs_imbalance, round(di, 5) AS dir_imbalance, bucket_end_ts,
        round(avg(ai) OVER q, 5) AS vpin, round(avg(di) OVER q, 5) AS tib
    FROM k WINDOW q AS (PARTITION BY symbol ORDER BY bucket_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)
""")
def vpin(spark: SparkSession, d: str) -> DataFrame:
    """Buckets of volume 2000 with their imbalance, VPIN and TIB."""
    out = micro.vpin_pipeline(bars(spark, d), S, bucket=2000.0).drop("v_total")
    return _rounded(out, ["v_buy", "v_sell"], 5).withColumns({c: F.round(c, 3) for c in ("v_buy", "v_sell")})


@query("""
    WITH s AS (
        SELECT vec_id, [abs(x::DOUBLE) for x in embedding[1:5]] AS bids, [abs(x::DOUBLE) for x in embedding[6:10]] AS asks FROM embeddings
    ), w AS (
        SELECT vec_id, list_sum(list_transform(bids, lambda x, i: x / i)) AS b, list_sum(list_transform(asks, lambda x, i: x / i)) AS a FROM s
    )
    SELECT vec_id, round(b / (a + b), 6) AS imbalance, CASE WHEN b / (a + b) >= 0.6 THEN 'BUY' WHEN b / (a + b) <= 0.4 THEN 'SELL' END AS pressure FROM w
""")
def book_pressure(spark: SparkSession, d: str) -> DataFrame:
    """Depth-weighted book imbalance, with five levels a side taken from vectors."""
    e = table(spark, d, "embeddings")
    side = lambda a: F.transform(F.slice("embedding", a, 5), lambda x: F.abs(x.cast("double")))
    imbalance = micro.book_imbalance(side(1), side(6))
    return e.withColumn("i", imbalance).select("vec_id", F.round("i", 6).alias("imbalance"), micro.pressure(F.col("i")).alias("pressure"))


@query("""
    SELECT l_orderkey, l_linenumber,
        round(1 / (1 + exp(-(0.25 + (l_quantity - 25) / 14 * 0.8 + (ln(1 + l_extendedprice) - 10) / 0.9 * -0.35 + (l_discount - 0.05) / 0.03 * 0.5))), 6) AS probability
    FROM lineitem
""")
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """A frozen logistic model over order lines."""
    m = FrozenLogistic(("l_quantity", "l_extendedprice", "l_discount"), (25.0, 10.0, 0.05), (14.0, 0.9, 0.03), (0.8, -0.35, 0.5), 0.25, ("l_extendedprice",))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(m.probability(), 6).alias("probability"))


_AS_OF = """
    WITH q AS (SELECT recording_id, ticker_id, timestamp AS t, min(bar_id) AS id FROM ohlc GROUP BY ALL)
    SELECT x.recording_id, x.ticker_id, x.seq, q.id AS bar_id, q.t - x.timestamp_us AS distance
    FROM trades x ASOF JOIN q ON x.recording_id = q.recording_id AND x.ticker_id = q.ticker_id AND x.timestamp_us {op} q.t
    WHERE x.timestamp_us IS NOT NULL
"""
_KEY = ["recording_id", "ticker_id"]


@query(_AS_OF.format(op=">="))
def asof_last_bar(spark: SparkSession, d: str) -> DataFrame:
    """For each trade, the vendor bar stamped last at or before it."""
    near = asof_backward(table(spark, d, "trades"), table(spark, d, "ohlc"), _KEY, "timestamp_us", "seq", "timestamp", "bar_id")
    return near.withColumnsRenamed({"left_id": "seq", "right_id": "bar_id"})


@query(_AS_OF.format(op="<="))
def asof_next_bar(spark: SparkSession, d: str) -> DataFrame:
    """For each trade, the vendor bar stamped first at or after it."""
    near = asof_forward(table(spark, d, "trades"), table(spark, d, "ohlc"), _KEY, "timestamp_us", "seq", "timestamp", "bar_id")
    return near.withColumnsRenamed({"left_id": "seq", "right_id": "bar_id"})


@query("""
    SELECT e.report_id, CAST(count(t.seq) AS BIGINT) AS n_observations
    FROM exec_reports e LEFT JOIN trades t ON t.recording_id = e.recording_id AND t.ticker_id = e.ticker_id
        AND t.timestamp_us > e.received_us - 30000000 AND t.timestamp_us <= e.received_us
    GROUP BY e.report_id
""")
def support_counts(spark: SparkSession, d: str) -> DataFrame:
    """Trades of a report's ticker in the 30 seconds up to it."""
    events = table(spark, d, "exec_reports").select("report_id", *_KEY, F.col("received_us").alias("t"))
    seen = table(spark, d, "trades").where("timestamp_us IS NOT NULL").select(*_KEY, F.col("timestamp_us").alias("t"))
    return trailing_count(events, seen, _KEY, "t", 30_000_000).select("report_id", "n_observations")


def _mid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ohlc").where("close > 0").select(*_KEY, F.col("timestamp").alias("t"), "bar_id", "close")


@query("""
    WITH q AS (SELECT recording_id, ticker_id, timestamp AS t, bar_id AS s, close AS m FROM ohlc WHERE close > 0 AND timestamp IS NOT NULL),
    e AS (SELECT recording_id, ticker_id, report_id AS event_id, received_us AS et, CASE WHEN report_id % 2 = 0 THEN 1 ELSE -1 END AS d FROM exec_reports WHERE received_us IS NOT NULL),
    f AS (SELECT recording_id, ticker_id, max((t, s)) AS fin FROM q GROUP BY ALL),
    p AS (SELECT e.*, q.t, q.s, q.m FROM e JOIN q ON e.recording_id = q.recording_id AND e.ticker_id = q.ticker_id AND q.t BETWEEN et AND et + 600000000),
    n AS (SELECT *, first_value(m) OVER w AS base, first_value(t) OVER w AS t0, first_value(s) OVER w AS s0 FROM p WINDOW w AS (PARTITION BY recording_id, ticker_id, event_id ORDER BY t, s)),
    h AS (SELECT *, CASE WHEN d > 0 THEN m >= base * (1 + 0.002::DOUBLE) ELSE m <= base * (1 - 0.002::DOUBLE) END AS won, CASE WHEN d > 0 THEN m <= base * (1 - 0.002::DOUBLE) ELSE m >= base * (1 + 0.002::DOUBLE) END AS lost FROM n),
    g AS (
        SELECT recording_id, ticker_id, event_id, any_value(base) AS base, any_value(t0) AS t0, any_value(s0) AS s0,
            min(t) FILTER (WHERE won) AS wt, arg_min(m, (t, s)) FILTER (WHERE won) AS wm, min(t) FILTER (WHERE lost) AS xt, arg_min(m, (t, s)) FILTER (WHERE lost) AS xm,
            max(t) AS zt, arg_max(m, (t, s)) AS zm
        FROM h GROUP BY ALL
    ), l AS (SELECT g.*, CASE WHEN xt IS NOT NULL AND (wt IS NULL OR xt <= wt) THEN -1 WHEN wt IS NOT NULL THEN 1 ELSE 0 END AS label FROM g JOIN f USING (recording_id, ticker_id) WHERE (t0, s0) < fin)
    SELECT recording_id, ticker_id, event_id, t0 AS t_start, CAST(label AS INTEGER) AS label, CASE label WHEN -1 THEN xt WHEN 1 THEN wt ELSE zt END AS t_end,
        round(ln(CASE label WHEN -1 THEN xm WHEN 1 THEN wm ELSE zm END) - ln(base), 6) AS realized_ret
    FROM l
""")
def barrier_labels(spark: SparkSession, d: str) -> DataFrame:
    """Triple-barrier labels of execution reports on vendor closes: 20 basis points either way, ten minutes."""
    events = table(spark, d, "exec_reports").select("report_id", *_KEY, "received_us", F.when(F.col("report_id") % 2 == 0, 1).otherwise(-1).alias("side"))
    out = triple_barrier(events, _mid(spark, d), _KEY, "report_id", "received_us", "side", "t", "bar_id", "close", 20.0, 20.0, 600_000_000)
    return out.withColumn("realized_ret", F.round("realized_ret", 6))


_LIVE_SQL = """
    WITH v AS (
        SELECT recording_id, ticker_id, seq, timestamp_us - timestamp_us % 60000000 AS b, price, size FROM trades
        WHERE price > 0 AND size > 0 AND timestamp_us IS NOT NULL
    ), r AS (SELECT *, max(b) OVER (PARTITION BY recording_id, ticker_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM v),
    g AS (
        SELECT recording_id, ticker_id, b, arg_min(price, seq) AS o, max(price) FILTER (WHERE NOT isnan(price)) AS h, min(price) FILTER (WHERE NOT isnan(price)) AS l,
            arg_max(price, seq) AS c, sum(size) AS s, count(*) AS n
        FROM r WHERE reached IS NULL OR b >= reached GROUP BY ALL
    ), p AS (SELECT *, lead(b) OVER w AS nb, lag(b) OVER w IS NULL AS boot FROM g WINDOW w AS (PARTITION BY recording_id, ticker_id ORDER BY b)),
    x AS (
        SELECT *, unnest(list_concat(CASE WHEN boot THEN []::BIGINT[] ELSE [b] END,
            CASE WHEN (nb - b) // 60000000 - 1 BETWEEN 1 AND 120 THEN generate_series(b + 60000000, nb - 60000000, 60000000) ELSE []::BIGINT[] END)) AS k
        FROM p WHERE nb IS NOT NULL
    )
    SELECT recording_id, ticker_id, k AS bucket_us, CASE WHEN k <> b THEN c ELSE o END AS open, CASE WHEN k <> b THEN c ELSE h END AS high,
        CASE WHEN k <> b THEN c ELSE l END AS low, c AS close, round(CASE WHEN k <> b THEN 0 ELSE s END, 4) AS volume, CAST(CASE WHEN k <> b THEN 0 ELSE n END AS BIGINT) AS n_trades, k <> b AS synthetic
    FROM x
"""


@query(_LIVE_SQL)
def live_minute_bars(spark: SparkSession, d: str) -> DataFrame:
    """One-minute bars as the live aggregator makes them, late trades dropped, first bar discarded, gaps filled."""
    out = live_bars(table(spark, d, "trades"), _KEY, "timestamp_us", "seq", "price", "size")
    return out.withColumn("volume", F.round("volume", 4))


@query(_LIVE_SQL.split(",\n    x AS (")[0] + """,
    a AS (SELECT recording_id, ticker_id, count(*) FILTER (WHERE price > 0 AND size > 0 AND timestamp_us IS NOT NULL) AS received, count(*) AS n_all FROM trades GROUP BY ALL),
    y AS (SELECT *, (nb - b) // 60000000 - 1 AS gap FROM p),
    m AS (
        SELECT recording_id, ticker_id, CAST(sum(n) AS BIGINT) AS kept, count(*) FILTER (WHERE nb IS NOT NULL AND NOT boot) AS whole, CAST(coalesce(sum(gap) FILTER (WHERE gap BETWEEN 1 AND 120), 0) AS BIGINT) AS synthetic,
            count(*) FILTER (WHERE nb IS NOT NULL AND boot) AS boot, count(*) FILTER (WHERE gap > 120) AS large_gaps
        FROM y GROUP BY ALL
    )
    SELECT a.recording_id, a.ticker_id, received, received - coalesce(kept, 0) AS late, n_all - received AS invalid, coalesce(whole, 0) + coalesce(m.synthetic, 0) AS emitted,
        coalesce(m.synthetic, 0) AS synthetic, coalesce(m.boot, 0) AS boot, coalesce(m.large_gaps, 0) AS large_gaps
    FROM a LEFT JOIN m ON a.recording_id IS NOT DISTINCT FROM m.recording_id AND a.ticker_id IS NOT DISTINCT FROM m.ticker_id
""")
def live_bar_counters(spark: SparkSession, d: str) -> DataFrame:
    """What the live aggregator counts while it makes these bars, by recording and ticker."""
    return live_counters(table(spark, d, "trades"), _KEY, "timestamp_us", "seq", "price", "size")


@query("""
    WITH t AS (
        SELECT recording_id, ticker_id, seq * 2 AS seq, 4 AS kind, price AS v, timestamp_us AS t FROM trades
        UNION ALL SELECT recording_id, ticker_id, seq * 2 + 1, 5, size, timestamp_us FROM trades
    ), l AS (
        SELECT *, last_value(CASE WHEN kind = 4 THEN (t, v) END IGNORE NULLS) OVER (PARTITION BY recording_id, ticker_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p
        FROM t WHERE v > 0
    )
    SELECT recording_id, ticker_id, seq, p[1] AS timestamp_us, p[2] AS price, v AS size FROM l WHERE kind = 5 AND p IS NOT NULL
""")
def paired_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Trades put together again from a feed of single price and size ticks."""
    t = table(spark, d, "trades")
    price = t.select(*_KEY, (F.col("seq") * 2).alias("seq"), F.lit(4).alias("kind"), F.col("price").alias("v"), F.col("timestamp_us").alias("t"))
    size = t.select(*_KEY, (F.col("seq") * 2 + 1).alias("seq"), F.lit(5).alias("kind"), F.col("size").alias("v"), F.col("timestamp_us").alias("t"))
    return last_trade_pairs(price.unionByName(size), _KEY, "seq", "kind", "v", "t")


@query("""
    WITH t AS (
        SELECT recording_id, ticker_id, side, seq * 2 AS seq, timestamp AS t, price AS p, NULL AS s FROM l2_updates WHERE kind = 1 AND side IN (0, 1) AND price IS NOT NULL
        UNION ALL SELECT recording_id, ticker_id, side, seq * 2 + 1, timestamp, NULL, size FROM l2_updates WHERE kind = 1 AND side IN (0, 1) AND size IS NOT NULL
    ), l AS (
        SELECT recording_id, ticker_id, seq, t AS timestamp_us, side, last_value(p IGNORE NULLS) OVER w AS price, last_value(s IGNORE NULLS) OVER w AS size
        FROM t WINDOW w AS (PARTITION BY recording_id, ticker_id, side ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    )
    SELECT recording_id, ticker_id, seq, timestamp_us, side, 0 AS position, 1 AS operation, price, CAST(size AS DOUBLE) AS size FROM l WHERE price > 0 AND NOT isnan(price) AND size > 0
""")
def top_of_book_updates(spark: SparkSession, d: str) -> DataFrame:
    """Top of book put together again from a feed of single price and size ticks, an update for each of either."""
    t = table(spark, d, "l2_updates").where("kind = 1 AND side IN (0, 1)")
    kinds = {"price": (1, 2, 0), "size": (0, 3, 1)}
    ticks = [
        t.select(*_KEY, (F.col("seq") * 2 + k).alias("seq"), F.when(F.col("side") == 1, bid).otherwise(ask).alias("kind"), F.col(c).cast("double").alias("v"), F.col("timestamp").alias("t"))
        for c, (bid, ask, k) in kinds.items()
    ]
    return top_of_book(ticks[0].unionByName(ticks[1]), _KEY, "seq", "kind", "v", "t")


@query("""
    SELECT recording_id, seq, timestamp, CASE WHEN CAST(u.price AS VARCHAR) <> 'nan' THEN u.price END AS price, CAST(u.price AS VARCHAR) = 'nan' AS no_number, position, operation, side, size, ticker_id FROM l2_updates u WHERE u.price IS NOT NULL AND size IS NOT NULL
""")
def wire_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Book updates written as binary messages and read again; a message holds no null, so rows with one have none."""
    sent = wire.encode(table(spark, d, "l2_updates").drop("kind"), wire.DEPTH)
    slim = sent.select("recording_id", "seq", "ticker_id", "message").where("message IS NOT NULL")
    back = wire.decode(slim, "message", wire.DEPTH)
    return back.withColumns({"no_number": F.isnan("price"), "price": F.when(~F.isnan("price"), F.col("price"))})


_SIGNALS = f"""
    {B}, m AS (
        SELECT *, max(close) OVER q AS hi, min(close) OVER q AS lo, count(close) OVER q AS nq, {full('avg', 'close', 20)} AS slow, {full('avg', 'close', 10)} AS fast, {full('stddev_samp', 'close', 20)} AS dev
        FROM b WINDOW q AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)
    ), r AS (
        SELECT *, CASE WHEN nq >= 19 AND close > hi THEN 1.0::DOUBLE WHEN nq >= 19 AND close < lo THEN -1.0::DOUBLE END AS dr,
            CASE WHEN close < slow - 2 * dev - 1e-9 THEN 1.0::DOUBLE WHEN close > slow + 2 * dev + 1e-9 THEN -1.0::DOUBLE END AS br,
            CASE WHEN fast > slow + 1e-9 THEN 1.0::DOUBLE WHEN fast < slow - 1e-9 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS cross_raw
        FROM m
    ), g AS (
        SELECT *, last_value(dr IGNORE NULLS) OVER u AS donchian, last_value(br IGNORE NULLS) OVER u AS bollinger
        FROM r WINDOW u AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    )
"""


@query(f"WITH {_SIGNALS} SELECT symbol, ts, seq, donchian FROM g")
def donchian_signal(spark: SparkSession, d: str) -> DataFrame:
    """Breakout signal, held until the next."""
    return strategy.REGISTRY.get("Donchian").apply(bars(spark, d), S, "donchian").select("symbol", "ts", "seq", "donchian")


_TRADES = f"""
    {_SIGNALS}, pos AS (SELECT *, CASE WHEN donchian > 0 THEN 'long' WHEN donchian < 0 THEN 'short' ELSE 'flat' END AS position FROM g),
    turn AS (SELECT * FROM (SELECT *, coalesce(lag(position) OVER {W}, 'flat') AS was FROM pos) WHERE position <> was),
    done AS (
        SELECT * FROM (SELECT *, lead(ts) OVER {W} AS exit_time, lead(close) OVER {W} AS exit_price, lead(donchian) OVER {W} AS exit_signal FROM turn)
        WHERE position <> 'flat' AND exit_time IS NOT NULL
    ), tt AS (
        SELECT symbol, ts AS entry_time, exit_time, close AS entry_price, exit_price, position, abs(donchian) AS trade_size,
            CASE WHEN position = 'long' THEN exit_price - close ELSE close - exit_price END AS pnl, donchian AS entry_signal, exit_signal,
            (epoch_us(exit_time) - epoch_us(ts)) / 3.6e9::DOUBLE AS holding_hours
        FROM done
    )
"""


@query(f"""
    WITH {_TRADES} SELECT symbol, entry_time, exit_time, entry_price, exit_price, position, trade_size, round(pnl, 6) AS pnl,
        round(CASE WHEN entry_price > 0 THEN pnl / entry_price ELSE 0 END, 6) AS return_pct, CASE WHEN pnl > 0 THEN 'WIN' WHEN pnl < 0 THEN 'LOSS' ELSE 'BREAKEVEN' END AS result,
        round(holding_hours, 6) AS holding_hours, entry_signal, exit_signal FROM tt
""")
def donchian_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades of the breakout signal."""
    signal = strategy.REGISTRY.get("donchian").apply(bars(spark, d), S)
    return _rounded(trade_table(signal, S), ["entry_price", "exit_price"])


@query(f"""
    WITH {_TRADES}, sr AS (
        SELECT *, coalesce(lag(donchian) OVER {W}, 0) AS held, coalesce(ln(close) - ln(lag(close) OVER {W}), 0) AS mv FROM g
    ), ret AS (SELECT *, held * mv AS x FROM sr),
    ex AS (SELECT symbol, exit_time AS ts, sum(pnl) AS pnl FROM tt GROUP BY ALL),
    eq AS (SELECT r.symbol, r.ts, r.seq, r.x, 10000 + sum(coalesce(pnl, 0)) OVER (PARTITION BY r.symbol ORDER BY r.ts, r.seq) AS eq FROM ret r LEFT JOIN ex ON r.symbol = ex.symbol AND r.ts = ex.ts),
    dd AS (SELECT *, max(eq) OVER {W} AS pk FROM eq), d2 AS (SELECT *, (pk - eq) / pk * 100 AS dd FROM dd),
    di AS (SELECT *, sum(CASE WHEN dd > 0 THEN 0 ELSE 1 END) OVER {W} AS i FROM d2),
    dl AS (SELECT symbol, max(n) AS max_drawdown_bars FROM (SELECT symbol, i, count(*) AS n FROM di WHERE dd > 0 GROUP BY ALL) GROUP BY symbol),
    bb AS (
        SELECT symbol, avg(x) AS avg_return, stddev_samp(x) AS volatility, stddev_samp(x) FILTER (WHERE x < 0) AS down, sum(x) AS total,
            floor((max(epoch_us(ts)) - min(epoch_us(ts))) / 86400000000) AS days, max(dd) AS max_drawdown FROM d2 GROUP BY symbol
    ), ag AS (
        SELECT symbol, count(*) AS total_trades, count(*) FILTER (WHERE pnl > 0) AS w, count(*) FILTER (WHERE pnl < 0) AS l,
            coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0) AS aw, coalesce(avg(pnl) FILTER (WHERE pnl < 0), 0) AS al, sum(pnl) AS tp,
            coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS gp, coalesce(-sum(pnl) FILTER (WHERE pnl < 0), 0) AS gl, max(holding_hours) AS mh,
            count(*) FILTER (WHERE position = 'long') AS nl
        FROM tt GROUP BY symbol
    )
    SELECT bb.symbol, CAST(coalesce(total_trades, 0) AS BIGINT) AS total_trades, CAST(coalesce(w, 0) AS BIGINT) AS winning_trades, round(coalesce(w, 0) / nullif(total_trades, 0), 6) AS win_rate,
        round(aw, 6) AS avg_win, round(al, 6) AS avg_loss, round(tp, 4) AS total_pnl, round(CASE WHEN gl > 0 THEN gp / gl WHEN gp > 0 THEN 'inf'::DOUBLE WHEN gp = 0 THEN 0 END, 4) AS profit_factor,
        round(CASE WHEN aw <> 0 AND al <> 0 THEN (w / total_trades) / abs(al) - (1 - w / total_trades) / abs(aw) WHEN aw IS NOT NULL THEN 0 ELSE 0 END, 4) AS kelly,
        round(CASE WHEN volatility > 0 THEN avg_return / volatility * sqrt(252) ELSE 0 END, 5) AS sharpe_ratio, round(CASE WHEN down > 0 THEN avg_return / down * sqrt(252) ELSE 0 END, 5) AS sortino_ratio,
        round(CASE WHEN max_drawdown > 0 THEN CASE WHEN days > 0 THEN total / (days / 365.25) ELSE 0 END / max_drawdown ELSE 0 END, 3) AS calmar_ratio,
        round(max_drawdown, 6) AS max_drawdown, CAST(coalesce(max_drawdown_bars, 0) AS BIGINT) AS max_drawdown_bars, round(mh, 6) AS max_hold_hours, CAST(coalesce(nl, 0) AS BIGINT) AS long_trades
    FROM bb LEFT JOIN ag USING (symbol) LEFT JOIN dl USING (symbol)
""")
def donchian_performance(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the breakout signal, by symbol."""
    m = performance(strategy.REGISTRY.get("donchian").apply(bars(spark, d), S), S)
    digits = {"win_rate": 6, "avg_win": 6, "avg_loss": 6, "total_pnl": 4, "profit_factor": 4, "kelly": 4, "sharpe_ratio": 5, "sortino_ratio": 5, "calmar_ratio": 3, "max_drawdown": 6, "max_hold_hours": 6}
    win = F.when(F.col("total_trades") > 0, F.col("win_rate"))
    m = m.withColumn("win_rate", win)
    return m.select("symbol", "total_trades", "winning_trades", *(F.round(c, k).alias(c) for c, k in digits.items()), "max_drawdown_bars", "long_trades")


#: Closes a little apart, so that no two averages are equal but for their rounding.
_APART = "close * (1 + (seq * 37 % 997) * 1e-7)"
_NUDGED = _SIGNALS.replace("FROM bars", "FROM (SELECT * REPLACE (" + _APART + " AS close) FROM bars)")


@query(f"WITH {_NUDGED} SELECT symbol, ts, seq, bollinger, cross_raw AS sma_cross FROM g")
def band_and_cross_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals of the two built-in strategies on averages, on closes that are a little apart."""
    b = bars(spark, d).withColumn("close", F.expr(_APART))
    both = strategy.REGISTRY.get("bollinger").apply(b, S, "bollinger", period=20, std_multiplier=2.0)
    return strategy.REGISTRY.get("sma_cross").apply(both, S, "sma_cross", fast_ma=10, slow_ma=20).select("symbol", "ts", "seq", "bollinger", "sma_cross")


_GRID = strategy.Strategy("donchian_grid", strategy.donchian, {"lookback": (12, 16, 20, 24, 32)}, holds=True)


def _grid_sql(part: str, source: str, x: str = "g", lookbacks: Sequence[int] = _GRID.grid["lookback"]) -> str:
    """Scores of the lookbacks, by default five, for each ``part`` of ``source``."""
    own = f"(PARTITION BY {part} ORDER BY ts, seq)"
    cols, ids = [], []
    for i, n in enumerate(lookbacks):
        w = f"(PARTITION BY {part} ORDER BY ts, seq ROWS BETWEEN {n - 1} PRECEDING AND 1 PRECEDING)"
        ready = f"count(close) OVER {w} >= {n - 1}"
        cols.append(f"CASE WHEN {ready} AND close > max(close) OVER {w} THEN 1.0 WHEN {ready} AND close < min(close) OVER {w} THEN -1.0 END AS d{i}")
        ids.append(i)
    held = ", ".join(f"last_value(d{i} IGNORE NULLS) OVER (PARTITION BY {part} ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h{i}" for i in ids)
    moved = ", ".join(f"coalesce(lag(h{i}) OVER {own}, 0) * mv AS x{i}" for i in ids)
    union = " UNION ALL ".join(
        f"SELECT {part}, {i} AS param_id, coalesce(sum(x{i}) FILTER (WHERE x{i} > 0), 0) AS gain, coalesce(-sum(x{i}) FILTER (WHERE x{i} < 0), 0) AS loss FROM {x}m GROUP BY {part}" for i in ids
    )
    return f"""
        {x}r AS (SELECT *, coalesce(ln(close) - ln(lag(close) OVER {own}), 0) AS mv, {', '.join(cols)} FROM {source}),
        {x}h AS (SELECT *, {held} FROM {x}r), {x}m AS (SELECT *, {moved} FROM {x}h),
        {x}s AS (SELECT *, CASE WHEN loss > 0 THEN gain / loss WHEN gain > 0 THEN 'inf'::DOUBLE ELSE 0 END AS score FROM ({union}))
    """


@query(f"WITH {B}, {_grid_sql('symbol', 'b')} SELECT symbol, CAST(param_id AS INTEGER) AS param_id, round(score, 5) AS score FROM gs")
def grid_search(spark: SparkSession, d: str) -> DataFrame:
    """Profit factor of five breakout lookbacks, by symbol."""
    return strategy.grid_scores(bars(spark, d), S, _GRID).withColumn("score", F.round("score", 5))


@query(f"WITH {B}, {_grid_sql('symbol', 'b', 'g', strategy.REGISTRY.get('donchian').grid['lookback'])} SELECT symbol, CAST(param_id AS INTEGER) AS param_id, round(score, 5) AS score FROM gs")
def whole_grid_search(spark: SparkSession, d: str) -> DataFrame:
    """Profit factor of all 157 breakout lookbacks of the built-in strategy, by symbol."""
    return strategy.grid_scores(bars(spark, d), S, strategy.REGISTRY.get("donchian")).withColumn("score", F.round("score", 5))


def _band_grid_sql(periods: Sequence[int], multipliers: Sequence[float]) -> str:
    """Scores of all bands on closes that are a little apart."""
    combos = [(n, k) for n in periods for k in multipliers]
    dev = ", ".join(f"{full('avg', 'close', n)} AS a{n}, {full('stddev_samp', 'close', n)} AS s{n}" for n in periods)
    raw = ", ".join(f"CASE WHEN close < a{n} - {k} * s{n} THEN 1.0 WHEN close > a{n} + {k} * s{n} THEN -1.0 END AS d{i}" for i, (n, k) in enumerate(combos))
    held = ", ".join(f"last_value(d{i} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h{i}" for i in range(len(combos)))
    moved = ", ".join(f"coalesce(lag(h{i}) OVER {W}, 0) * mv AS x{i}" for i in range(len(combos)))
    union = " UNION ALL ".join(f"SELECT symbol, {i} AS param_id, coalesce(sum(x{i}) FILTER (WHERE x{i} > 0), 0) AS gain, coalesce(-sum(x{i}) FILTER (WHERE x{i} < 0), 0) AS loss FROM bm GROUP BY symbol" for i in range(len(combos)))
    return f"""
        {B.replace('FROM bars', 'FROM (SELECT * REPLACE (' + _APART + ' AS close) FROM bars)')},
        ba AS (SELECT *, coalesce(ln(close) - ln(lag(close) OVER {W}), 0) AS mv, {dev} FROM b), br AS (SELECT symbol, ts, seq, mv, {raw} FROM ba),
        bh AS (SELECT *, {held} FROM br), bm AS (SELECT *, {moved} FROM bh),
        bs AS (SELECT *, CASE WHEN loss > 0 THEN gain / loss WHEN gain > 0 THEN 'inf'::DOUBLE ELSE 0 END AS score FROM ({union}))
    """


@query(f"WITH {_band_grid_sql(*strategy.REGISTRY.get('bollinger').grid.values())} SELECT symbol, CAST(param_id AS INTEGER) AS param_id, round(score, 5) AS score FROM bs")
def whole_band_search(spark: SparkSession, d: str) -> DataFrame:
    """Profit factor of all 120 bands of the built-in strategy, by symbol, on closes that are a little apart."""
    b = bars(spark, d).withColumn("close", F.expr(_APART))
    return strategy.grid_scores(b, S, strategy.REGISTRY.get("bollinger")).withColumn("score", F.round("score", 5))


@query()
def walk_forward_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Permutation test of the whole walk-forward, its choices included, against nine permuted series, by symbol."""
    from tidemark.operators.validate import walk_forward_test

    out = walk_forward_test(bars(spark, d), S, _GRID, 10, 120, 40)
    return out.select("symbol", F.round("real_return", 6).alias("real_return"), "n_at_least", "p_value")


def _walk_sql(source: str, lookback: int, step: int, x: str = "g") -> str:
    """CTEs: rows numbered (n), training slices (tr), choices (ch), and the rows with the chosen ``signal`` and its window (sg)."""
    held = " ".join(f"WHEN {i} THEN h{i}" for i in range(len(_GRID.grid["lookback"])))
    return f"""
        n AS (SELECT *, row_number() OVER {W} - 1 AS rw, count(*) OVER (PARTITION BY symbol) - 1 AS top FROM {source}),
        tr AS (SELECT n.*, unnest(generate_series(greatest((CAST(floor((rw - {lookback}) / {step}.0) AS BIGINT)) + 1, 0), least(rw // {step}, CAST(floor((top - {lookback}) / {step}.0) AS BIGINT)))) AS win_id FROM n),
        {_grid_sql('symbol, win_id', 'tr', x)},
        ch AS (SELECT symbol, win_id, param_id, score FROM {x}s QUALIFY row_number() OVER (PARTITION BY symbol, win_id ORDER BY score DESC, param_id) = 1),
        {_grid_sql('symbol', 'n', x + 'w')},
        wn AS (SELECT *, CASE WHEN rw >= {lookback} THEN (rw - {lookback}) // {step} END AS win FROM {x}wh),
        sg AS (SELECT wn.*, ch.win_id, CASE ch.param_id {held} END AS signal FROM wn LEFT JOIN ch ON wn.symbol = ch.symbol AND wn.win = ch.win_id)
    """


@query(f"WITH {B}, {_walk_sql('b', 120, 40)} SELECT symbol, CAST(win_id AS INTEGER) AS win_id, CAST(param_id AS INTEGER) AS param_id, round(score, 5) AS score FROM ch")
def walk_forward_choices(spark: SparkSession, d: str) -> DataFrame:
    """Lookback chosen in each training window of 120 bars, every 40 bars."""
    choices = strategy.walk_forward(bars(spark, d), S, _GRID, 120, 40)[1]
    return choices.select("symbol", "win_id", "param_id", F.round("score", 5).alias("score"))


@query(f"""
    WITH {B}, {_walk_sql('b', 120, 40)}, x AS (SELECT symbol, signal, coalesce(lag(signal) OVER {W}, 0) * mv AS r FROM sg)
    SELECT symbol, count(signal) AS n_traded, round(sum(r), 6) AS total_return FROM x GROUP BY symbol
""")
def walk_forward_returns(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-sample return of the walk-forward signal, by symbol."""
    signal = strategy.walk_forward(bars(spark, d), S, _GRID, 120, 40)[0]
    done = strategy.with_strategy_returns(signal, S)
    return done.groupBy("symbol").agg(F.count("signal").alias("n_traded"), F.round(F.sum("strategy_ret"), 6).alias("total_return"))


@query(f"""
    WITH {B}, {_walk_sql('b', 120, 40)}, m AS (SELECT symbol, param_id, count(*) AS n_windows, min(win_id) AS f FROM ch GROUP BY ALL)
    SELECT symbol, CAST(param_id AS INTEGER) AS param_id, n_windows FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n_windows DESC, f) <= 5
""")
def frequent_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The five lookbacks that the walk-forward chose most often, by symbol."""
    choices = strategy.walk_forward(bars(spark, d), S, _GRID, 120, 40)[1]
    return strategy.modal_parameters(choices, ["symbol"], 5)


@query(f"""
    WITH {B}, n AS (SELECT *, row_number() OVER {W} - 1 AS rw, ln(open) - ln(lag(close) OVER {W}) AS o, ln(close) - ln(open) AS c FROM b WHERE symbol IN (SELECT symbol FROM b GROUP BY 1 HAVING count(*) > 0)),
    cp AS (SELECT n.*, p.p FROM n, (SELECT unnest(generate_series(1, 19)) AS p) p WHERE rw > 0),
    i AS (SELECT symbol, p, c, row_number() OVER (PARTITION BY p, symbol ORDER BY md5(concat_ws('-', 'in', p, rw)), rw) AS slot FROM cp),
    u AS (SELECT symbol, p, o, row_number() OVER (PARTITION BY p, symbol ORDER BY md5(concat_ws('-', 'out', p, rw)), rw) AS slot FROM cp),
    m AS (SELECT symbol, p, slot, i.c + u.o AS r FROM i JOIN u USING (symbol, p, slot)),
    x AS (SELECT symbol, p, sum(coalesce(pos, 0) * r) AS total FROM (SELECT *, lag(sign(r)) OVER (PARTITION BY p, symbol ORDER BY slot) AS pos FROM m) GROUP BY ALL),
    rr AS (SELECT symbol, coalesce(sum(coalesce(pos, 0) * r), 0) AS total FROM (SELECT *, lag(sign(r)) OVER (PARTITION BY symbol ORDER BY rw) AS pos FROM (SELECT symbol, rw, o + c AS r FROM n WHERE rw > 0)) GROUP BY ALL)
    SELECT x.symbol, round(rr.total, 6) AS real_return, count(*) FILTER (WHERE x.total >= rr.total) AS n_at_least, (1 + count(*) FILTER (WHERE x.total >= rr.total)) / 20 AS p_value
    FROM x JOIN rr USING (symbol) GROUP BY x.symbol, rr.total
""")
def permutation_p_values(spark: SparkSession, d: str) -> DataFrame:
    """Permutation test of one-bar momentum against 19 permuted series, by symbol; moves below 1e-9 are rounding and count as none."""
    steady = strategy.Strategy("steady", lambda s: F.coalesce(F.when(F.abs(features.log_returns(s)) > 1e-12, F.signum(features.log_returns(s))), F.lit(0.0)))
    out = permute.permutation_test(bars(spark, d), S, steady, 20)
    return out.select("symbol", F.round("real_return", 6).alias("real_return"), "n_at_least", "p_value")


@query()
def permutation_moments(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation of the returns of the 19 permuted series of ``permutation_p_values``, by symbol."""
    steady = strategy.Strategy("steady", lambda s: F.coalesce(F.when(F.abs(features.log_returns(s)) > 1e-12, F.signum(features.log_returns(s))), F.lit(0.0)))
    out = permute.permutation_test(bars(spark, d), S, steady, 20)
    return out.select("symbol", F.round("permuted_mean", 6).alias("permuted_mean"), F.round("permuted_std", 6).alias("permuted_std"))


ORACLES["permutation_moments"] = ORACLES["permutation_p_values"].split("    SELECT x.symbol, round(rr.total")[0] + "    SELECT symbol, round(avg(total), 6) AS permuted_mean, round(stddev_pop(total), 6) AS permuted_std FROM x GROUP BY symbol"


@query(f"""
    WITH {B}, n AS (
        SELECT *, row_number() OVER {W} - 1 AS rw, count(*) OVER (PARTITION BY symbol) AS k, coalesce(ln(close) - ln(lag(close) OVER {W}), 0) AS mv, first_value(close) OVER {W} AS c0 FROM b
    ), p AS (
        SELECT n.symbol, n.rw, n.k, n.c0, p.p, least(('0x' || substr(md5(concat_ws('-', 'block', p.p, n.rw // 10)), 1, 12))::BIGINT % greatest(n.k - 9, 1) + n.rw % 10, n.k - 1) AS src
        FROM n, (SELECT unnest(generate_series(1, 10)) AS p) p
    )
    SELECT p.symbol, p.p AS perm_id, count(*) AS n_bars, round(exp(ln(min(p.c0)) + sum(CASE WHEN p.rw > 0 THEN n.mv ELSE 0 END)), 4) AS last_close
    FROM p JOIN n ON n.symbol = p.symbol AND n.rw = p.src GROUP BY ALL
""")
def block_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Last close of each of ten block-bootstrapped series, by symbol."""
    out = permute.bootstrap_blocks(bars(spark, d), S, 10)
    return out.groupBy("symbol", "perm_id").agg(F.count(F.lit(1)).alias("n_bars"), F.round(F.max_by("close", F.struct("ts", "seq")), 4).alias("last_close"))


@query(f"""
    WITH {B}, n AS (SELECT *, row_number() OVER {W} - 1 AS rw FROM b),
    p AS (SELECT n.*, p.p, row_number() OVER (PARTITION BY p.p, n.symbol ORDER BY md5(concat_ws('-', 'row', p.p, n.symbol, n.rw)), n.rw) AS slot FROM n, (SELECT unnest(generate_series(1, 5)) AS p) p)
    SELECT symbol, p AS perm_id, count(*) AS n_bars, round(sum(close), 4) AS sum_close, round(sum(close * slot) / sum(slot), 6) AS centre FROM p GROUP BY ALL
""")
def row_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Of each of five row-shuffled series, by symbol: bars, summed closes, which shuffling keeps, and their mean weighted by place, which it does not."""
    own = Series([permute.PERM, "symbol"], S.order)
    out = permute.permute_rows(bars(spark, d), S, 5).withColumn("slot", F.row_number().over(own.all()))
    return out.groupBy("symbol", "perm_id").agg(F.count(F.lit(1)).alias("n_bars"), F.round(F.sum("close"), 4).alias("sum_close"), F.round(F.sum(F.col("close") * F.col("slot")) / F.sum("slot"), 6).alias("centre"))


@query("""
    WITH f AS (SELECT recording_id, ticker_id, min(timestamp_us) AS t FROM trades GROUP BY ALL)
    SELECT e.report_id FROM exec_reports e LEFT JOIN f USING (recording_id, ticker_id) WHERE f.t IS NULL OR e.received_us < f.t
""")
def reports_before_data(spark: SparkSession, d: str) -> DataFrame:
    """Reports earlier than the first trade of their ticker, or of a ticker without trades."""
    events = table(spark, d, "exec_reports").select("report_id", *_KEY, F.col("received_us").alias("t"))
    return pit.events_before_data(events, table(spark, d, "trades").select(*_KEY, F.col("timestamp_us").alias("t")), _KEY, "t").select("report_id")


_MIDDLE_SQL = "SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS cut FROM bars"


def _leaks(spark: SparkSession, d: str, pipeline) -> DataFrame:
    """Rows up to the middle of time whose outputs change when later bars do."""
    b = bars(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    cutoff = b.agg(F.expr("(min(us) + max(us)) div 2")).first()[0]
    leaks = pit.future_leaks(b, pipeline, ["symbol", "seq", "ts"], "us", cutoff or 0, ["open", "high", "low", "close", "volume"])
    return leaks.select("symbol", "ts", "seq")


@query("SELECT symbol, ts, seq FROM bars WHERE false")
def feature_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Rows of which any feature changes when later bars do: none, since features are causal; that the check finds one, ``planted_leaks`` shows."""
    return _leaks(spark, d, lambda x: features.with_features(x, S))


@query(f"""
    WITH {B}, m AS ({_MIDDLE_SQL}), x AS (SELECT symbol, ts, seq, lead(ts) OVER {W} AS nx FROM b)
    SELECT symbol, ts, seq FROM x, m WHERE epoch_us(ts) <= cut AND epoch_us(nx) > cut
""")
def planted_leaks(spark: SparkSession, d: str) -> DataFrame:
    """The same check of features with one that looks a bar ahead: the last row before the middle of each symbol."""
    return _leaks(spark, d, lambda x: features.with_features(x, S).withColumn("ahead", F.lead("close").over(S.all())))


@query("""
    WITH m AS (SELECT recording_id, ticker_id, timestamp AS t, min(bar_id) AS id FROM ohlc WHERE close > 0 GROUP BY ALL), q AS (SELECT m.*, o.close AS mid FROM m JOIN ohlc o ON o.bar_id = m.id),
    x AS (
        SELECT t.recording_id, t.ticker_id, sign(t.price - q.mid) AS seen, CASE WHEN t.seq % 2 = 0 THEN 1 ELSE -1 END AS side
        FROM trades t ASOF JOIN q ON t.recording_id = q.recording_id AND t.ticker_id = q.ticker_id AND t.timestamp_us >= q.t
        WHERE t.price IS NOT NULL AND t.timestamp_us IS NOT NULL AND isfinite(t.price)
    )
    SELECT recording_id, ticker_id, count(*) FILTER (WHERE seen <> 0) AS n_trades, round(coalesce(avg(CASE WHEN seen = side THEN 1 ELSE 0 END) FILTER (WHERE seen <> 0), 1), 6) AS agreement
    FROM x GROUP BY ALL
""")
def side_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often a trade's side (here the parity of its number) agrees with its price against the last vendor close."""
    t = table(spark, d, "trades").where("price IS NOT NULL AND NOT isnan(price) AND abs(price) < double('infinity')")
    t = t.select(*_KEY, F.col("timestamp_us").alias("t"), "seq", "price", F.when(F.col("seq") % 2 == 0, 1).otherwise(-1).alias("side"))
    out = pit.aggressor_agreement(t, _mid(spark, d), _KEY, "t", "seq", "price", "side", "bar_id", "close")
    return out.withColumn("agreement", F.round("agreement", 6))


@query("""
    SELECT a.ticker_id, b.ticker_id AS r_ticker_id FROM instruments a JOIN instruments b
        ON a.exchange = b.exchange AND (a.currency IS NULL OR b.currency IS NULL OR a.currency = '' OR b.currency = '' OR a.currency = b.currency)
        AND (a.sec_type = b.sec_type OR a.sec_type = '' OR b.sec_type = '' OR a.sec_type IS NULL OR b.sec_type IS NULL)
    QUALIFY row_number() OVER (PARTITION BY a.ticker_id ORDER BY b.ticker_id) = 1
""")
def contract_matches(spark: SparkSession, d: str) -> DataFrame:
    """For each instrument the first of its exchange that nothing it states contradicts."""
    i = table(spark, d, "instruments")
    return matching_contract(i, i, "exchange", ["currency", "sec_type"], F.col("ticker_id")).select("ticker_id", "r_ticker_id")


@query("""
    WITH g AS (SELECT recording_id, received_us - lag(received_us) OVER (PARTITION BY recording_id ORDER BY report_id) AS gap FROM exec_reports)
    SELECT recording_id, round(quantile_cont(gap, 0.5), 3) AS p50, round(quantile_cont(gap, 0.99), 3) AS p99, round(quantile_cont(gap, 0.999), 3) AS p999, max(gap) AS longest FROM g GROUP BY recording_id
""")
def report_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the time between reports, interpolated, by recording."""
    w = Window.partitionBy("recording_id").orderBy("report_id")
    gaps = table(spark, d, "exec_reports").withColumn("gap", F.col("received_us") - F.lag("received_us").over(w))
    p = lambda q: F.round(F.percentile("gap", q), 3)
    return gaps.groupBy("recording_id").agg(p(0.5).alias("p50"), p(0.99).alias("p99"), p(0.999).alias("p999"), F.max("gap").alias("longest"))


@query("""
    WITH t AS (SELECT ticker_id, timestamp_us - timestamp_us % 3600000000 AS h, seq, price, size FROM trades WHERE timestamp_us IS NOT NULL AND price > 0 AND size > 0 AND isfinite(price) AND isfinite(size)),
    h AS (SELECT ticker_id, h, arg_min(price, seq) AS o, max(price) AS hi, min(price) AS lo, arg_max(price, seq) AS c, count(*) AS n FROM t GROUP BY ALL)
    SELECT ticker_id, h AS hour_us, o AS open, hi AS high, lo AS low, c AS close, n AS n_trades, CASE WHEN lag(c) OVER w > 0 THEN round(c / lag(c) OVER w - 1, 6) END AS ret
    FROM h WINDOW w AS (PARTITION BY ticker_id ORDER BY h)
""")
def hourly_bars(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of all trades, with their returns."""
    ok = "timestamp_us IS NOT NULL AND price > 0 AND size > 0 AND NOT isnan(price) AND NOT isnan(size) AND price < double('infinity') AND size < double('infinity')"
    t = table(spark, d, "trades").where(ok).withColumn("hour_us", bucket_start(F.col("timestamp_us"), 3_600_000_000))
    h = t.groupBy("ticker_id", "hour_us").agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.count(F.lit(1)).alias("n_trades"))
    before = F.lag("close").over(Window.partitionBy("ticker_id").orderBy("hour_us"))
    return h.withColumn("ret", F.when(before > 0, F.round(F.col("close") / before - 1, 6)))


def _trades_sql(source: str, x: str) -> str:
    """CTE {x}: trades of the ``signal`` of a table of bars, by symbol, with their profit."""
    return f"""
        {x}p AS (SELECT *, CASE WHEN signal > 0 THEN 'long' WHEN signal < 0 THEN 'short' ELSE 'flat' END AS position FROM {source}),
        {x}t AS (SELECT * FROM (SELECT *, coalesce(lag(position) OVER {W}, 'flat') AS was FROM {x}p) WHERE position <> was),
        {x}x AS (SELECT *, lead(close) OVER {W} AS out_price FROM {x}t),
        {x} AS (SELECT symbol, CASE WHEN position = 'long' THEN out_price - close ELSE close - out_price END AS pnl FROM {x}x WHERE position <> 'flat' AND out_price IS NOT NULL)
    """


def _part_sql(trades: str, source: str, name: str) -> str:
    """Metrics of the trades and summed returns of a part, by symbol."""
    return f"""
        {name}_m AS (
            SELECT symbol, count(*) AS k, count(*) FILTER (WHERE pnl > 0) AS w, sum(pnl) AS pnl,
                coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS gain, coalesce(-sum(pnl) FILTER (WHERE pnl < 0), 0) AS pain FROM {trades} GROUP BY symbol
        ), {name}_r AS (SELECT symbol, sum(r) AS total FROM (SELECT symbol, coalesce(lag(signal) OVER {W}, 0) * coalesce(ln(close) - ln(lag(close) OVER {W}), 0) AS r FROM {source}) GROUP BY symbol),
        {name} AS (
            SELECT r.symbol, CASE WHEN pain > 0 THEN gain / pain WHEN gain > 0 THEN 'inf'::DOUBLE WHEN gain = 0 THEN 0 END AS pf, pnl, coalesce(k, 0) AS trades,
                CASE WHEN k > 0 THEN w / k ELSE 0 END AS rate, total FROM {name}_r r LEFT JOIN {name}_m m ON r.symbol = m.symbol
        )
    """


@query(f"""
    WITH {B}, h AS (SELECT *, row_number() OVER {W} * 2 > count(*) OVER (PARTITION BY symbol) AS later FROM b),
    dt AS (SELECT * REPLACE (CASE WHEN later THEN ts + INTERVAL 40 DAY ELSE ts END AS ts) FROM h),
    sp AS (SELECT dt.*, ts >= max(ts) OVER (PARTITION BY symbol) - INTERVAL 1 MONTH AS is_holdout FROM dt),
    dv AS (SELECT * FROM sp WHERE NOT is_holdout), {_walk_sql('dv', 60, 20)},
    mp AS (SELECT * FROM (SELECT symbol, param_id, count(*) AS n_windows, min(win_id) AS f FROM ch GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n_windows DESC, f) = 1),
    dev_rows AS (SELECT symbol, ts, seq, close, signal FROM sg WHERE win_id IS NOT NULL),
    {_grid_sql('symbol', 'sp', 'q')},
    held_rows AS (SELECT q.symbol, q.ts, q.seq, q.close, CASE mp.param_id {' '.join(f'WHEN {i} THEN h{i}' for i in range(len(_GRID.grid['lookback'])))} END AS signal FROM qh q JOIN mp ON q.symbol = mp.symbol WHERE is_holdout),
    {_trades_sql('dev_rows', 'dt_')}, {_trades_sql('held_rows', 'ht_')}, {_part_sql('dt_', 'dev_rows', 'dev')}, {_part_sql('ht_', 'held_rows', 'held')},
    z AS (SELECT mp.symbol, mp.param_id, n_windows, d.pf AS dpf, d.pnl AS dpnl, d.trades AS dt, d.rate AS dr, d.total AS dtot, e.pf AS hpf, e.pnl AS hpnl, e.trades AS ht, e.rate AS hr, e.total AS htot,
        CASE WHEN d.pf > 0 AND e.pf > 0 AND isfinite(d.pf) THEN (d.pf - e.pf) / d.pf * 100 END AS x FROM mp JOIN dev d ON mp.symbol = d.symbol JOIN held e ON mp.symbol = e.symbol)
    SELECT symbol, CAST(param_id AS INTEGER) AS param_id, n_windows, round(dpf, 4) AS dev_profit_factor, round(dpnl, 4) AS dev_total_pnl, dt AS dev_total_trades, round(dr, 6) AS dev_win_rate, round(dtot, 6) AS dev_return,
        round(hpf, 4) AS holdout_profit_factor, round(hpnl, 4) AS holdout_total_pnl, ht AS holdout_total_trades, round(hr, 6) AS holdout_win_rate, round(htot, 6) AS holdout_return,
        round(x, 3) AS degradation_pct, CASE WHEN x > 50 THEN 'severe' WHEN x > 25 THEN 'moderate' WHEN x < 0 THEN 'better' WHEN x IS NOT NULL THEN 'acceptable' END AS verdict FROM z
""")
def holdout_check(spark: SparkSession, d: str) -> DataFrame:
    """Walk-forward choices frozen on a holdout: here the second half of each symbol's bars, dated 40 days later."""
    half = F.row_number().over(S.all()) * 2 > F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    dated = bars(spark, d).withColumn("later", half)
    dated = dated.withColumn("ts", F.when(F.col("later"), F.expr("ts + make_dt_interval(40)")).otherwise(F.col("ts"))).drop("later")
    out = hybrid_walk_forward(dated, S, _GRID, 60, 20, 1)
    digits = {"profit_factor": 4, "total_pnl": 4, "win_rate": 6, "return": 6}
    parts = {f"{p}_{c}": F.round(f"{p}_{c}", k) for p in ("dev", "holdout") for c, k in digits.items()}
    return out.withColumns(parts | {"degradation_pct": F.round("degradation_pct", 3)})


_DONCHIAN = strategy.REGISTRY.get("donchian")


@query(f"""
    WITH {_SIGNALS}, h AS (SELECT *, coalesce(lag(donchian) OVER {W}, 0) AS held, coalesce(ln(close) - ln(lag(close) OVER {W}), 0) AS mv FROM g),
    x AS (SELECT symbol, held * mv - coalesce(abs(held - lag(held) OVER {W}), 0) * 0.0005 AS r FROM h),
    a AS (SELECT symbol, sum(r) AS total, coalesce(sum(r) FILTER (WHERE r > 0), 0) AS gain, coalesce(-sum(r) FILTER (WHERE r < 0), 0) AS pain, avg(r) AS m, stddev_samp(r) AS dev FROM x GROUP BY symbol)
    SELECT symbol, round(total, 6) AS total, round(CASE WHEN pain > 0 THEN gain / pain WHEN gain > 0 THEN 'inf'::DOUBLE ELSE 1 END, 4) AS profit_factor, round(CASE WHEN dev > 0 THEN m / dev ELSE 0 END, 5) AS sharpe FROM a
""")
def returns_after_costs(spark: SparkSession, d: str) -> DataFrame:
    """Return of the breakout signal after a spread of 3 and a commission of 2 basis points on changes of position; profit factor and Sharpe ratio of the bars."""
    done = strategy.with_strategy_returns(_DONCHIAN.apply(bars(spark, d), S), S, "signal", 3.0, 2.0)
    x = F.col("strategy_ret")
    return done.groupBy("symbol").agg(F.round(F.sum(x), 6).alias("total"), F.round(strategy.profit_factor(x, 1.0), 4).alias("profit_factor"), F.round(strategy.sharpe(x), 5).alias("sharpe"))


def _streak_sql(flag: str, out: str) -> str:
    w = "(PARTITION BY symbol ORDER BY exit_time, entry_time)"
    return f"SELECT symbol, max(n) AS {out} FROM (SELECT symbol, i, count(*) AS n FROM (SELECT *, sum(CASE WHEN {flag} THEN 0 ELSE 1 END) OVER {w} AS i FROM tt) WHERE {flag} GROUP BY ALL) GROUP BY symbol"


@query(f"""
    WITH {_TRADES}, sr AS (SELECT symbol, coalesce(lag(donchian) OVER {W}, 0) * coalesce(ln(close) - ln(lag(close) OVER {W}), 0) AS x FROM g),
    bb AS (SELECT symbol, avg(x) AS avg_return, stddev_samp(x) AS volatility FROM sr GROUP BY symbol),
    cw AS ({_streak_sql('pnl > 0', 'cw')}), cl AS ({_streak_sql('pnl < 0', 'cl')}),
    rt AS (SELECT *, CASE WHEN entry_price > 0 THEN pnl / entry_price ELSE 0 END AS ret FROM tt),
    a AS (
        SELECT symbol, count(*) AS k, count(*) FILTER (WHERE pnl > 0) AS w, coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0) AS aw, coalesce(avg(pnl) FILTER (WHERE pnl < 0), 0) AS al, avg(pnl) AS ap,
            coalesce(max(pnl) FILTER (WHERE pnl > 0), 0) AS lw, coalesce(min(pnl) FILTER (WHERE pnl < 0), 0) AS ll,
            coalesce(avg(ln(1 + ret)) FILTER (WHERE 1 + ret > 0), '-inf'::DOUBLE) AS lu, coalesce(avg(1 - 1 / (1 + ret)) FILTER (WHERE 1 + ret > 0), '-inf'::DOUBLE) AS cu,
            avg(holding_hours) AS ah, min(holding_hours) AS mh, count(*) FILTER (WHERE position = 'long') AS nl, count(*) FILTER (WHERE position = 'short') AS ns,
            count(*) FILTER (WHERE position = 'long' AND pnl > 0) AS lwn, count(*) FILTER (WHERE position = 'short' AND pnl > 0) AS swn,
            coalesce(avg(pnl) FILTER (WHERE position = 'long'), 0) AS lap, coalesce(avg(pnl) FILTER (WHERE position = 'short'), 0) AS sap
        FROM rt GROUP BY symbol
    )
    SELECT a.symbol, round(avg_return, 9) AS avg_return, round(volatility, 9) AS volatility, round(ap, 6) AS average_pnl, round(lw, 6) AS largest_win, round(ll, 6) AS largest_loss,
        round(lu, 9) AS log_utility, round(cu, 9) AS crra_utility, round(ah, 6) AS avg_hold_hours, round(mh, 6) AS min_hold_hours, ns AS short_trades,
        coalesce(cw, 0) AS max_consecutive_wins, coalesce(cl, 0) AS max_consecutive_losses, round(CASE WHEN al <> 0 THEN aw / al ELSE 'inf'::DOUBLE END, 4) AS payoff_ratio,
        round(w / k * aw + (1 - w / k) * al, 6) AS expectancy, k >= 30 AS adequate_sample, round(CASE WHEN nl > 0 THEN lwn / nl ELSE 0 END, 6) AS long_win_rate,
        round(CASE WHEN ns > 0 THEN swn / ns ELSE 0 END, 6) AS short_win_rate, round(lap, 6) AS long_avg_pnl, round(sap, 6) AS short_avg_pnl
    FROM a JOIN bb ON a.symbol = bb.symbol LEFT JOIN cw ON a.symbol = cw.symbol LEFT JOIN cl ON a.symbol = cl.symbol
""")
def donchian_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The other metrics of the breakout signal, of symbols with a trade."""
    m = performance(_DONCHIAN.apply(bars(spark, d), S), S).where("total_trades > 0")
    digits = {
        "avg_return": 9, "volatility": 9, "average_pnl": 6, "largest_win": 6, "largest_loss": 6, "log_utility": 9, "crra_utility": 9, "avg_hold_hours": 6, "min_hold_hours": 6, "payoff_ratio": 4,
        "expectancy": 6, "long_win_rate": 6, "short_win_rate": 6, "long_avg_pnl": 6, "short_avg_pnl": 6,
    }
    kept = ("short_trades", "max_consecutive_wins", "max_consecutive_losses", "adequate_sample")
    return m.select("symbol", *kept, *(F.round(c, k).alias(c) for c, k in digits.items()))


@query(f"""
    WITH {_TRADES}, ex AS (SELECT symbol, exit_time AS ts, sum(pnl) AS pnl FROM tt GROUP BY ALL),
    mv AS (SELECT *, coalesce(lag(donchian) OVER {W}, 0) * coalesce(ln(close) - ln(lag(close) OVER {W}), 0) AS x FROM g)
    SELECT m.symbol, m.ts, m.seq, round(sum(coalesce(pnl, 0)) OVER {W.replace('symbol', 'm.symbol').replace('ts', 'm.ts').replace('seq', 'm.seq')}, 5) AS cum_pnl,
        round(sum(x) OVER {W.replace('symbol', 'm.symbol').replace('ts', 'm.ts').replace('seq', 'm.seq')}, 6) AS equity FROM mv m LEFT JOIN ex ON m.symbol = ex.symbol AND m.ts = ex.ts
""")
def profit_curves(spark: SparkSession, d: str) -> DataFrame:
    """Profit of trades left and summed returns of the breakout signal, bar by bar."""
    signal = _DONCHIAN.apply(bars(spark, d), S)
    return _rounded(trade_pnl_curve(signal, S), [], 5).join(_rounded(equity_curve(signal, S), [], 6), ["symbol", "ts", "seq"])


_PAPER_SQL = f"""
    {B.replace('FROM bars', 'FROM (SELECT * REPLACE (' + _APART + ' AS close) FROM bars)')},
    c AS (SELECT *, {full('avg', 'close', 10)} AS fast, {full('avg', 'close', 40)} AS slow FROM b),
    tg AS (SELECT *, CASE WHEN fast IS NULL OR slow IS NULL THEN 0.0::DOUBLE WHEN fast > slow THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS target FROM c),
    hd AS (SELECT *, coalesce(lag(target) OVER {W}, 0) AS held, coalesce(close - lag(close) OVER {W}, 0) AS mv FROM tg),
    fl AS (SELECT *, abs(held - coalesce(lag(held) OVER {W}, 0)) AS flip, held * mv AS gross FROM hd),
    nt AS (SELECT *, gross - flip * 0.0001 * close AS net FROM fl)
"""


def _papered(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d).withColumn("close", F.expr(_APART))
    fast, slow = features.sma(S, "close", 10), features.sma(S, "close", 40)
    target = F.when(fast.isNull() | slow.isNull(), 0.0).when(fast > slow, 1.0).otherwise(-1.0)
    return paper_bars(b.withColumn("target", target), S)


@query(f"""
    WITH {_PAPER_SQL} SELECT symbol, count(*) AS n_bars, count(*) FILTER (WHERE flip > 0) AS n_flips, round(sum(gross), 5) AS gross_pnl, round(sum(net), 5) AS net_pnl,
        round(CASE WHEN count(*) FILTER (WHERE net <> 0) > 0 THEN 100.0 * count(*) FILTER (WHERE net > 0) / count(*) FILTER (WHERE net <> 0) ELSE 0 END, 5) AS win_rate,
        round(CASE WHEN stddev_pop(net) > 0 THEN avg(net) / stddev_pop(net) ELSE 0 END, 6) AS sharpe FROM nt GROUP BY symbol
""")
def paper_results(spark: SparkSession, d: str) -> DataFrame:
    """Summary of the paper run of an average crossing, by symbol."""
    return _rounded(_rounded(paper_summary(_papered(spark, d), S), ["sharpe"], 5), ["gross_pnl", "net_pnl", "win_rate"], 6)


@query(f"""
    WITH {_PAPER_SQL} SELECT symbol, ts, seq, CASE WHEN held > 0 THEN 'LONG' WHEN held < 0 THEN 'SHORT' ELSE 'FLAT' END AS side, round(close, 6) AS price, held AS target_position FROM nt WHERE flip > 0
""")
def paper_journal(spark: SparkSession, d: str) -> DataFrame:
    """Fills of that run."""
    return _rounded(paper_fills(_papered(spark, d), S), ["target_position"])


@query(f"WITH {_SIGNALS} SELECT symbol, arg_max(coalesce(donchian, 0), (ts, seq)) AS signal FROM g GROUP BY symbol")
def latest_signals(spark: SparkSession, d: str) -> DataFrame:
    """The breakout signal of each symbol's last bar; 0 for none."""
    return last_signals(_DONCHIAN.apply(bars(spark, d), S).na.fill(0.0, ["signal"]), S)


@query("""
    WITH l AS (SELECT recording_id, ticker_id, arg_max(filled, report_id) AS f, arg_max(remaining, report_id) AS r FROM exec_reports WHERE ticker_id <> -1 GROUP BY ALL)
    SELECT recording_id, count(*) AS n_tickers, CAST(sum(f) AS BIGINT) AS realized, CAST(sum(r) AS BIGINT) AS unrealized FROM l GROUP BY recording_id
""")
def latest_totals(spark: SparkSession, d: str) -> DataFrame:
    """Latest report of each ticker, summed by recording; filled and remaining stand for realised and unrealised profit."""
    out = latest_pnl(table(spark, d, "exec_reports"), ["recording_id"], "ticker_id", "report_id", "filled", "remaining")
    return out.withColumnsRenamed({"filled": "realized", "remaining": "unrealized"})


@query("SELECT CAST(floor((received_us / 1000000.0 - 6 * 3600) / 86400) AS BIGINT) AS day, count(*) AS n_reports FROM exec_reports WHERE received_us IS NOT NULL GROUP BY ALL")
def reports_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Reports by day, a day beginning at six."""
    day = day_number(F.col("received_us") / 1e6, 6)
    return table(spark, d, "exec_reports").where("received_us IS NOT NULL").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n_reports"))


@query("""
    WITH m AS (SELECT *, CASE ticker_id % 3 WHEN 0 THEN 'TRADE' WHEN 1 THEN 'TICK_L1' ELSE 'TICK_L2' END AS mode FROM instruments),
    t AS (SELECT seq, ticker_id, 4 AS kind FROM trades UNION ALL SELECT seq, ticker_id, kind FROM l2_updates)
    SELECT t.kind, m.mode, count(*) AS n_ticks FROM t JOIN m USING (ticker_id) WHERE (kind = 4 AND mode <> 'TICK_L2') OR (kind <> 4 AND mode <> 'TRADE') GROUP BY ALL
""")
def ticks_by_mode(spark: SparkSession, d: str) -> DataFrame:
    """Ticks that reach the engine if a third of the tickers want trades only, and a third the book only."""
    mode = F.element_at(F.array(F.lit("TRADE"), F.lit("TICK_L1"), F.lit("TICK_L2")), F.pmod("ticker_id", F.lit(3)) + 1)
    modes = table(spark, d, "instruments").select("ticker_id", mode.alias("mode"))
    ticks = table(spark, d, "trades").select("seq", "ticker_id", F.lit(4).alias("kind")).unionByName(table(spark, d, "l2_updates").select("seq", "ticker_id", "kind"))
    return routed(ticks, modes, ["ticker_id"], "kind").join(modes, "ticker_id").groupBy("kind", "mode").agg(F.count(F.lit(1)).alias("n_ticks"))


@query(f"""
    WITH {B}, k AS (SELECT count(DISTINCT symbol) AS k FROM b), m AS (SELECT ts, count(*) AS n_rows, count(DISTINCT symbol) AS n_series FROM b GROUP BY ts)
    SELECT ts, n_rows, n_series FROM m, k WHERE n_rows <> k OR n_series <> k
""")
def unaligned_minutes(spark: SparkSession, d: str) -> DataFrame:
    """Minutes that not all symbols have a bar of."""
    return permute.unaligned_series(bars(spark, d), S)


@query(f"""
    WITH {B}, n AS (SELECT *, row_number() OVER {W} - 1 AS rw, CASE WHEN volume <> 0 THEN ln(greatest(volume, 1e-10)) END AS lv FROM b),
    cp AS (SELECT n.*, coalesce(lv - lag(lv) OVER {W}, 0) AS mv, first_value(lv) OVER {W} AS v0 FROM n),
    i AS (SELECT c.symbol, p.p, c.mv, c.v0, row_number() OVER (PARTITION BY p.p, c.symbol ORDER BY md5(concat_ws('-', 'in', p.p, c.rw)), c.rw) AS slot FROM cp c, (SELECT unnest(generate_series(1, 4)) AS p) p WHERE c.rw > 0),
    x AS (SELECT *, exp(v0 + sum(mv) OVER (PARTITION BY p, symbol ORDER BY slot)) AS v FROM i)
    SELECT symbol, p AS perm_id, count(v) AS n_volumes, round(ln(sum(v * slot) / sum(slot)), 6) AS centre FROM x GROUP BY ALL
""")
def permuted_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Of the volumes that go along with four permuted series, by symbol: their number, and the logarithm of their mean weighted by place."""
    own = Series([permute.PERM, "symbol"], S.order)
    out = permute.permute_bars(bars(spark, d), S, 4, extra=["volume"]).withColumn("slot", F.row_number().over(own.all()) - 1).where("slot > 0")
    return out.groupBy("symbol", "perm_id").agg(F.count("volume").alias("n_volumes"), F.round(F.log(F.sum(F.col("volume") * F.col("slot")) / F.sum("slot")), 6).alias("centre"))


def _kept(df: DataFrame, name: str, write) -> str:
    """Writes a table to the shared folder by ``write(df, path)`` and gives its path."""
    path = new_path(df.sparkSession, name)
    write(df, path)
    return path


@query("SELECT symbol, date_trunc('second', ts) AS ts, seq, open, high, low, close, volume FROM bars WHERE hash(symbol) IS NOT NULL AND epoch_us(ts) >= (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM bars)")
def stored_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars written by interval and symbol and read back, from the middle of time on."""
    raw = table(spark, d, "bars").select("symbol", "ts", "seq", "open", "high", "low", "close", "volume")
    middle = raw.agg(F.expr("timestamp_micros((min(unix_micros(cast(ts AS timestamp))) + max(unix_micros(cast(ts AS timestamp)))) div 2)").cast("timestamp_ntz")).first()[0]
    root = _kept(raw.withColumn("interval", F.lit("1m")), "bars", readers.write_bars)
    return readers.load_bars(spark, root, interval="1m", start=middle).select(*raw.columns)


@query("SELECT symbol, ts, seq, open, close FROM bars WHERE year(ts) BETWEEN 2000 AND 2100 AND ts < '2100-01-01'")
def bars_of_years(spark: SparkSession, d: str) -> DataFrame:
    """Bars of a range of years, read by a file's suffix."""
    rows = readers.read_table(spark, f"{d}/bars.parquet").select("symbol", "ts", "seq", "open", "close")
    return readers.between(readers.in_years(rows, "ts", 2000, 2100), "ts", end="2100-01-01")


@query("SELECT ticker_id, symbol, exchange, tick_size FROM instruments")
def instruments_as_csv(spark: SparkSession, d: str) -> DataFrame:
    """Instruments written as CSV with a header and read back with the types inferred."""
    raw = table(spark, d, "instruments").select("ticker_id", "symbol", "exchange", "tick_size")
    path = _kept(raw, "instruments", lambda df, p: df.write.csv(p + ".csv", header=True))
    return readers.read_table(spark, path + ".csv")


@query(f"""
    WITH {_PAPER_SQL} SELECT symbol, count(*) AS n_fills, round(sum(close), 4) AS turnover FROM nt WHERE flip > 0 GROUP BY symbol
""")
def stored_fills(spark: SparkSession, d: str) -> DataFrame:
    """The journal of the paper run, appended to a file in two parts and read back."""
    fills = paper_fills(_papered(spark, d), S).withColumn("symbol_side", F.concat_ws("/", "symbol", "side")).drop("side").withColumnRenamed("symbol_side", "side")
    path = new_path(spark, "fills")
    early = F.pmod(F.hash("symbol"), F.lit(2)) == 0
    for part in (fills.where(early), fills.where(~early)):
        readers.append_fills(part, path)
    back = spark.read.parquet(path)
    return back.groupBy(F.split("side", "/")[0].alias("symbol")).agg(F.count(F.lit(1)).alias("n_fills"), F.round(F.sum("price"), 4).alias("turnover"))


@query("""
    WITH i AS (SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) AS INTEGER) AS ticker_id FROM instruments)
    SELECT b.symbol, i.ticker_id, count(*) AS n FROM bars b JOIN i ON b.symbol = i.symbol GROUP BY ALL
""")
def ordinal_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids from 1 by the order of a configuration, here the sorted symbols of the instruments, joined to the bars."""
    configured = sorted(r[0] for r in table(spark, d, "instruments").select("symbol").collect())
    return table(spark, d, "bars").select("symbol").join(readers.ticker_ids(configured, spark), "symbol").groupBy("symbol", "ticker_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH q AS (SELECT recording_id, ticker_id, timestamp AS t FROM ohlc),
    e AS (SELECT r.report_id, r.received_us, min(q.t) AS entry FROM exec_reports r LEFT JOIN q ON r.recording_id = q.recording_id AND r.ticker_id = q.ticker_id AND q.t >= r.received_us - 30000000 GROUP BY ALL)
    SELECT report_id FROM e WHERE entry IS NULL OR entry < received_us
""")
def early_entries(spark: SparkSession, d: str) -> DataFrame:
    """Reports whose entry, taken half a minute too early, lies before them, or that have none: what the check of labels must find."""
    e = table(spark, d, "exec_reports").select("report_id", *_KEY, "received_us", (F.col("received_us") - 30_000_000).alias("from_us"))
    near = asof_forward(e, table(spark, d, "ohlc"), _KEY, "from_us", "report_id", "timestamp", "bar_id")
    labels = e.join(near.select(F.col("left_id").alias("report_id"), "distance"), "report_id", "left").withColumn("entry_us", F.col("from_us") + F.col("distance"))
    return pit.entries_before_events(labels, "received_us", "entry_us").select("report_id")


@query("""
    WITH o AS (SELECT recording_id, ticker_id, received_us AS t FROM exec_reports),
    c AS (SELECT e.bar_id, count(o.t) AS n FROM ohlc e LEFT JOIN o ON o.recording_id = e.recording_id AND o.ticker_id = e.ticker_id AND o.t > e.timestamp - 600000000 AND o.t <= e.timestamp WHERE e.timestamp IS NOT NULL GROUP BY ALL)
    SELECT bar_id, n AS n_observations FROM c WHERE n < 2
""")
def unsupported_bars(spark: SparkSession, d: str) -> DataFrame:
    """Vendor bars with under two reports in the ten minutes before them."""
    e = table(spark, d, "ohlc").where("timestamp IS NOT NULL").select("bar_id", *_KEY, F.col("timestamp").alias("t"))
    o = table(spark, d, "exec_reports").select(*_KEY, F.col("received_us").alias("t"))
    return pit.unsupported_events(e, o, _KEY, "t", 600_000_000, 2).select("bar_id", "n_observations")


_CONTRACTS_SQL = """
    c AS (SELECT ticker_id, symbol, sec_type, exchange, currency, CASE WHEN ticker_id % 2 = 0 THEN '202512' END AS expiry FROM instruments),
    r AS (
        SELECT ticker_id * 3 AS id, symbol, sec_type, exchange, currency, CASE WHEN ticker_id % 3 = 0 THEN '202603' WHEN ticker_id % 3 = 1 THEN '202512' END AS expiry FROM instruments
        UNION ALL SELECT ticker_id * 3 + 1, symbol, sec_type, '', NULL, CASE WHEN ticker_id % 5 > 0 THEN '' ELSE '202603' END FROM instruments
        UNION ALL SELECT ticker_id * 3 + 2, symbol, 'OTHER', exchange, currency, NULL FROM instruments
    )
"""


@query(f"""
    WITH {_CONTRACTS_SQL}, m AS (
        SELECT c.ticker_id, r.id FROM c JOIN r ON c.symbol = r.symbol
            AND (coalesce(c.sec_type, '') = '' OR coalesce(r.sec_type, '') = '' OR c.sec_type = r.sec_type) AND (coalesce(c.exchange, '') = '' OR coalesce(r.exchange, '') = '' OR c.exchange = r.exchange)
            AND (coalesce(c.currency, '') = '' OR coalesce(r.currency, '') = '' OR c.currency = r.currency) AND (coalesce(c.expiry, '') = '' OR coalesce(r.expiry, '') = '' OR c.expiry = r.expiry)
    )
    SELECT ticker_id, min(id) AS r_id FROM m GROUP BY ticker_id
""")
def contracts_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    """For each contract the first registered one of its symbol whose type, exchange, currency and expiry do not contradict it; three are registered for each symbol."""
    i = table(spark, d, "instruments")
    at = lambda n: F.pmod("ticker_id", F.lit(n))
    c = i.select("ticker_id", "symbol", "sec_type", "exchange", "currency", F.when(at(2) == 0, "202512").alias("expiry"))
    plain = ["symbol", "sec_type", "exchange", "currency"]
    r = i.select((F.col("ticker_id") * 3).alias("id"), *plain, F.when(at(3) == 0, "202603").when(at(3) == 1, "202512").alias("expiry"))
    r = r.unionByName(i.select((F.col("ticker_id") * 3 + 1).alias("id"), "symbol", "sec_type", F.lit("").alias("exchange"), F.lit(None).cast("string").alias("currency"), F.when(at(5) > 0, "").otherwise("202603").alias("expiry")))
    r = r.unionByName(i.select((F.col("ticker_id") * 3 + 2).alias("id"), "symbol", F.lit("OTHER").alias("sec_type"), "exchange", "currency", F.lit(None).cast("string").alias("expiry")))
    return matching_contract(c, r, "symbol", ["sec_type", "exchange", "currency", "expiry"], F.col("id")).select("ticker_id", "r_id")


@query()
def simulated_basis(spark: SparkSession, d: str) -> DataFrame:
    """Bars of three series with a simulated basis (closes over opens), by symbol: their number and mean close."""
    b = bars(spark, d).withColumns({"spot": F.col("open"), "futures": F.col("close")})
    out = permute.simulate_ar1(b, S, 3)
    return out.groupBy("symbol", permute.PERM).agg(F.count(F.lit(1)).alias("n_bars"), F.round(F.avg("close"), 4).alias("mean_close"))
