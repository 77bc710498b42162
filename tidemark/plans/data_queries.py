"""Queries over the trading tables for the data-processing operators (p1, p2, p4, p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.changefeed import apply_changes
from tidemark.operators.grid import regular_grid
from tidemark.operators.ordered import dominant_keys, per_key_profile
from tidemark.operators.spikes import implausible_readings
from tidemark.sources.tables import table

MINUTE_US = 60_000_000
TICKER = ["recording_id", "ticker_id"]
SLOT = [*TICKER, "side", "position"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    marks = implausible_readings(table(spark, d, "trades"), table(spark, d, "l2_updates"), table(spark, d, "instruments"))
    return marks.select("feed", "seq", "field")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    marks = implausible_readings(table(spark, d, "trades"), table(spark, d, "l2_updates"), table(spark, d, "instruments"))
    return marks.groupBy("feed", "field", "reason", "ticker_id").agg(F.count(F.lit(1)).alias("n_readings"))


def _book(spark: SparkSession, d: str) -> DataFrame:
    depth = table(spark, d, "l2_updates").where("kind = 2")
    return apply_changes(depth, SLOT, ["timestamp"], "seq", "operation", ["price", "size"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _book(spark, d).select("recording_id", "ticker_id", "side", "position", "seq")


def p2_book(spark: SparkSession, d: str) -> DataFrame:
    return _book(spark, d)


def _valid_trades(spark: SparkSession, d: str) -> DataFrame:
    ok = "timestamp_us IS NOT NULL AND price > 0 AND size > 0 AND NOT isnan(price) AND NOT isnan(size)"
    return table(spark, d, "trades").where(ok).select(*TICKER, "timestamp_us", "seq", "price", "size")


def _bar_readings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bars").select(*TICKER, F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "seq", F.coalesce("close", F.lit(0.0)).alias("close"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    trades = regular_grid(_valid_trades(spark, d), TICKER, "timestamp_us", "price", MINUTE_US, "seq")
    bars = regular_grid(_bar_readings(spark, d), TICKER, "ts_us", "close", MINUTE_US, "seq")
    both = trades.withColumn("feed", F.lit("trade")).unionByName(bars.withColumn("feed", F.lit("bar")))
    return both.where("synthetic").select("feed", *TICKER, "bucket_us")


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid: gaps up to 2 minutes on a line, up to 10 held, longer ones marked; extended to the recording's bounds."""
    trades = _valid_trades(spark, d)
    sessions = table(spark, d, "recordings").select("recording_id", F.col("started_us").alias("from_us"), F.col("ended_us").alias("to_us"))
    bounds = trades.select(*TICKER).distinct().join(sessions, "recording_id")
    grid = regular_grid(trades, TICKER, "timestamp_us", "price", MINUTE_US, "seq", "size", interpolate_up_to=2, hold_up_to=10, bounds=bounds)
    return grid.withColumns({"value": F.round("value", 6), "volume": F.round("volume", 4)})


def _frames(spark: SparkSession, d: str) -> DataFrame:
    trades = table(spark, d, "trades").select(*TICKER, "seq", F.lit(3).alias("kind"), F.col("timestamp_us").alias("t"), "price")
    depth = table(spark, d, "l2_updates").select(*TICKER, "seq", "kind", F.col("timestamp").alias("t"), "price")
    return trades.unionByName(depth)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cols = ["feed", *TICKER, "seq"]
    frames = _frames(spark, d).withColumn("feed", F.lit("frames"))
    reports = table(spark, d, "exec_reports").select(F.lit("executions").alias("feed"), *TICKER, F.col("report_id").alias("seq"))
    rows = frames.select(cols).unionByName(reports)
    return dominant_keys(rows, ["feed", "recording_id"], "ticker_id", ["seq"], 0.05).select("feed", *TICKER)


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per feed and ticker, in order of arrival: rows, first and last time, steps back in time, longest gap, changes of price; trades, book updates and reports alike."""
    feeds = (("trade", "trades", "timestamp_us", "seq"), ("l2", "l2_updates", "timestamp", "seq"), ("execution", "exec_reports", "received_us", "report_id"))
    rows = None
    for feed, name, time, order in feeds:
        part = table(spark, d, name).select(F.lit(feed).alias("feed"), F.col("ticker_id"), F.col(time).alias("t"), F.col(order).alias("n"), F.col("price"))
        rows = part if rows is None else rows.unionByName(part)
    return per_key_profile(rows, ["feed", "ticker_id"], ["n"], "t", "price")


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p2_found, p2_book, p4_found, p4_grid, p5_found, p5_profile)}

_BOOK_SQL = """
    WITH once AS (
        SELECT min(seq) AS seq, recording_id, ticker_id, kind, timestamp, price, position, operation, side, size
        FROM l2_updates WHERE kind = 2 GROUP BY ALL
    ), marked AS (
        SELECT *, row_number() OVER slot AS n,
            sum(CASE WHEN operation IN (0, 2) THEN 1 ELSE 0 END) OVER slot AS era
        FROM once WINDOW slot AS (PARTITION BY recording_id, ticker_id, side, position ORDER BY timestamp NULLS FIRST, seq)
    ), eras AS (
        SELECT *, max(era) OVER (PARTITION BY recording_id, ticker_id, side, position) AS last_era FROM marked
    )
    SELECT recording_id, ticker_id, side, position,
        arg_max(price, n) FILTER (WHERE operation <> 2) AS price,
        arg_max(size, n) FILTER (WHERE operation <> 2) AS size,
        arg_max(seq, n) AS seq
    FROM eras WHERE era = last_era
    GROUP BY ALL HAVING count(*) FILTER (WHERE operation <> 2) > 0
"""

_GRID_DATA = """
    SELECT recording_id, ticker_id, timestamp_us - ((timestamp_us % 60000000) + 60000000) % 60000000 AS b,
        arg_max(price, (timestamp_us, seq)) AS v, sum(size) AS s, count(*) AS n
    FROM trades WHERE timestamp_us IS NOT NULL AND price > 0 AND size > 0 AND NOT isnan(price) AND NOT isnan(size)
    GROUP BY ALL
"""

ORACLES = {
    "p2_book": _BOOK_SQL,
    "p2_found": f"SELECT recording_id, ticker_id, side, position, seq FROM ({_BOOK_SQL})",
    "p4_found": f"""
        WITH d AS (
            SELECT 'trade' AS feed, recording_id, ticker_id, b FROM ({_GRID_DATA})
            UNION ALL SELECT DISTINCT 'bar', recording_id, ticker_id, epoch_us(ts) - epoch_us(ts) % 60000000 FROM bars
        ), n AS (SELECT *, lead(b) OVER (PARTITION BY feed, recording_id, ticker_id ORDER BY b) AS nxt FROM d)
        SELECT feed, recording_id, ticker_id, unnest(generate_series(b + 60000000, nxt - 60000000, 60000000)) AS bucket_us
        FROM n WHERE nxt > b + 60000000
    """,
    "p4_grid": f"""
        WITH d AS ({_GRID_DATA}), n AS (
            SELECT d.*, lead(b) OVER w AS nb, lead(v) OVER w AS nv, lag(b) OVER w AS pb,
                r.started_us - r.started_us % 60000000 AS lo, r.ended_us - r.ended_us % 60000000 AS hi
            FROM d LEFT JOIN recordings r USING (recording_id) WINDOW w AS (PARTITION BY recording_id, ticker_id ORDER BY b)
        ), k AS (SELECT *, coalesce(nb, CASE WHEN hi > b THEN hi + 60000000 END) AS stop FROM n),
        g AS (
            SELECT *, unnest(list_concat(
                CASE WHEN pb IS NULL AND lo < b THEN generate_series(lo, b - 60000000, 60000000) ELSE []::BIGINT[] END, [b],
                CASE WHEN stop > b + 60000000 THEN generate_series(b + 60000000, stop - 60000000, 60000000) ELSE []::BIGINT[] END)) AS g
            FROM k
        ), h AS (SELECT *, CASE WHEN g > b THEN (stop - b) // 60000000 - 1 WHEN g < b THEN (b - lo) // 60000000 END AS gap FROM g)
        SELECT recording_id, ticker_id, g AS bucket_us,
            round(CASE WHEN g = b THEN v WHEN g > b AND nb IS NOT NULL AND gap <= 2 THEN v + (nv - v) * (CAST(g - b AS DOUBLE) / (nb - b)) WHEN g > b AND gap <= 10 THEN v END, 6) AS value,
            round(CASE WHEN g = b THEN s ELSE 0.0 END, 4) AS volume,
            CAST(CASE WHEN g = b THEN n ELSE 0 END AS BIGINT) AS n_readings, CAST(gap AS BIGINT) AS gap, g <> b AS synthetic
        FROM h
    """,
    "p5_found": """
        WITH r AS (
            SELECT 'frames' AS feed, recording_id, ticker_id FROM trades
            UNION ALL SELECT 'frames', recording_id, ticker_id FROM l2_updates
            UNION ALL SELECT 'executions', recording_id, ticker_id FROM exec_reports
        ), c AS (SELECT feed, recording_id, ticker_id, count(*) AS n FROM r GROUP BY ALL),
        s AS (SELECT *, sum(n) OVER (PARTITION BY feed, recording_id) AS total FROM c)
        SELECT feed, recording_id, ticker_id FROM s WHERE n >= 0.05 * total AND ticker_id IS NOT NULL
    """,
    "p5_profile": """
        WITH r AS (
            SELECT 'trade' AS feed, ticker_id, timestamp_us AS t, seq AS n, price FROM trades
            UNION ALL SELECT 'l2', ticker_id, timestamp, seq, price FROM l2_updates
            UNION ALL SELECT 'execution', ticker_id, received_us, report_id, price FROM exec_reports
        ), s AS (
            SELECT feed, ticker_id, n, t, price, lag(t) OVER w AS pt, lag(price) OVER w AS pp, row_number() OVER w AS rn
            FROM r WINDOW w AS (PARTITION BY feed, ticker_id ORDER BY n)
        )
        SELECT feed, ticker_id, count(*) AS n_rows, arg_min(t, n) FILTER (WHERE t IS NOT NULL) AS first_time,
            arg_max(t, n) FILTER (WHERE t IS NOT NULL) AS last_time, count(*) FILTER (WHERE t < pt) AS n_backwards,
            max(t - pt) AS max_gap, count(*) FILTER (WHERE rn > 1 AND price IS DISTINCT FROM pp) AS n_changes
        FROM s GROUP BY feed, ticker_id
    """,
}
