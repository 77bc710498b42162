"""Queries of the problems p3 and p6 to p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.leakage import leaked_passages
from tidemark.llm.matching import match_nearest
from tidemark.llm.packing import pack_documents
from tidemark.llm.truncation import truncated_texts, truncation_report
from tidemark.sources.tables import table


TICKER = ["recording_id", "ticker_id"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    wanted = {"trade": (table(spark, d, "trades"), "timestamp_us", "seq"), "ohlc": (table(spark, d, "ohlc"), "timestamp", "bar_id")}
    near = match_nearest(wanted, table(spark, d, "l2_updates").where("kind = 1"), TICKER, "timestamp", "seq", 1_500_000)
    return near.select("feed", "row_id", F.col("record_id").alias("quote_seq"))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"))


def p6_room(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of room left unused."""
    packed = pack_documents(table(spark, d, "documents"))
    total = packed.agg(F.countDistinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return total.withColumn("unused_share", 1 - F.col("n_tokens") / (F.col("n_containers") * 2048))


#: Share of a passage's words that makes a leak even if they do not stand in its order.
REORDERED = 0.8


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Which test items leaked: documents that show words running, those that only show most of the passage in another order, most words running and best coverage by tiles."""
    leaks = leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), min_coverage=REORDERED)
    running = F.col("words_running") >= 20
    return leaks.groupBy("item_id").agg(
        F.count_if(running).alias("n_documents"), F.count_if(~running).alias("n_reordered"),
        F.max("words_running").alias("words_running"), F.round(F.max("coverage"), 6).alias("coverage"),
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated_texts(table(spark, d, "documents"))


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation_report(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p6_pack, p6_room, p7_found, p7_items, p8_found, p8_sources)}
ORACLES = {
    "p3_found": """
        WITH q AS (SELECT recording_id, ticker_id, timestamp AS t, min(seq) AS seq FROM l2_updates WHERE kind = 1 GROUP BY ALL),
        w AS (
            SELECT 'trade' AS feed, seq AS row_id, recording_id, ticker_id, timestamp_us AS t FROM trades WHERE timestamp_us IS NOT NULL
            UNION ALL SELECT 'ohlc', bar_id, recording_id, ticker_id, timestamp FROM ohlc WHERE timestamp IS NOT NULL
        ), b AS (
            SELECT w.*, q.t AS bt, q.seq AS bs FROM w ASOF LEFT JOIN q
                ON w.recording_id = q.recording_id AND w.ticker_id = q.ticker_id AND w.t >= q.t
        ), f AS (
            SELECT b.*, q.t AS ft, q.seq AS fs FROM b ASOF LEFT JOIN q
                ON b.recording_id = q.recording_id AND b.ticker_id = q.ticker_id AND b.t <= q.t
        )
        SELECT feed, row_id, CASE WHEN bt IS NOT NULL AND t - bt <= 1500000 AND (ft IS NULL OR t - bt <= ft - t) THEN bs ELSE fs END AS quote_seq
        FROM f WHERE t - bt <= 1500000 OR ft - t <= 1500000
    """,
}
