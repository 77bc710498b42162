"""Triple-barrier labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import interval_join


def triple_barrier(
    events: DataFrame, quotes: DataFrame, keys: Sequence[str], event_id: str, event_us: str, direction: str, quote_us: str, quote_seq: str, mid: str,
    profit_bps: float = 100.0, stop_bps: float = 100.0, horizon_us: int = 300_000_000,
) -> DataFrame:
    """Which barrier each event's position touches first.

    Entry is the first quote at or after the event; the barriers lie ``profit_bps`` and
    ``stop_bps`` from its price, mirrored for a ``direction`` not above 0. Quotes up to
    ``horizon_us`` after the event count, bounds included, from the entry on. Label 1:
    profit first; -1: stop first, or both at one time; 0: neither, closed at the last
    quote in the horizon. No row for events with no quote in their horizon, or whose entry is the
    series' last quote. Result: keys, ``event_id``, ``t_start``, ``label``, ``t_end``,
    ``realized_ret`` (natural log of exit over entry). Events and quotes with nulls are
    left out; quotes at one time are ordered by ``quote_seq``.

    Events meet quotes by an interval join on time bins as wide as the horizon. A window
    over each event's quotes gives its entry, and an aggregation, which needs no further
    shuffle, the first touches.
    """
    ks = list(keys)
    e = events.select(*ks, F.col(event_id).alias("event_id"), F.col(event_us).cast("long").alias("__tm_e"), F.col(direction).alias("__tm_d")).na.drop()
    q = quotes.select(*ks, F.col(quote_us).cast("long").alias("__tm_q"), F.col(quote_seq).alias("__tm_s"), F.col(mid).cast("double").alias("__tm_m")).na.drop()
    last = q.groupBy(*ks).agg(F.max(F.struct("__tm_q", "__tm_s")).alias("__tm_final"))
    spans = e.withColumn("__tm_until", F.col("__tm_e") + F.lit(horizon_us))
    pairs = interval_join(q, spans, ks, "__tm_q", "__tm_e", "__tm_until", horizon_us)
    at = F.struct("__tm_q", "__tm_s")
    per_event = Window.partitionBy(*ks, "event_id", "__tm_e", "__tm_d")
    entry = pairs.withColumn("__tm_entry", F.min(F.struct("__tm_q", "__tm_s", "__tm_m")).over(per_event))
    base, m = F.col("__tm_entry.__tm_m"), F.col("__tm_m")
    d = F.when(F.col("__tm_d") > 0, 1.0).otherwise(-1.0)
    sign = F.col("__tm_d").cast("double")
    take, stop = base * (1 + sign * profit_bps / 1e4), base * (1 - sign * stop_bps / 1e4)
    won = F.when(d > 0, m >= take).otherwise(m <= take)
    lost = F.when(d > 0, m <= stop).otherwise(m >= stop)
    touch = F.struct("__tm_q", "__tm_s", "__tm_m")
    found = entry.groupBy(*ks, "event_id", "__tm_e", "__tm_d").agg(
        F.first("__tm_entry").alias("__tm_entry"),
        F.min(F.when(won, touch)).alias("__tm_won"),
        F.min(F.when(lost, touch)).alias("__tm_lost"),
        F.max(touch).alias("__tm_end"),
    )
    first_entry = F.struct(F.col("__tm_entry.__tm_q"), F.col("__tm_entry.__tm_s"))
    labelled = found.join(last, ks).where(first_entry < F.col("__tm_final"))
    w, x = F.col("__tm_won"), F.col("__tm_lost")
    label = F.when(x.isNotNull() & (w.isNull() | (x["__tm_q"] <= w["__tm_q"])), -1).when(w.isNotNull(), 1).otherwise(0)
    closed = F.when(label == -1, x).when(label == 1, w).otherwise(F.col("__tm_end"))
    return labelled.select(
        *ks, "event_id", F.col("__tm_entry.__tm_q").alias("t_start"), label.alias("label"), closed["__tm_q"].alias("t_end"),
        (F.log(closed["__tm_m"]) - F.log(F.col("__tm_entry.__tm_m"))).alias("realized_ret"),
    )
