"""Point-in-time checks: each gives the rows, or the numbers, that break a rule of causality."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import asof_backward, trailing_count


def events_before_data(events: DataFrame, data: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Events earlier than their key's first data, or without any."""
    first = data.groupBy(*keys).agg(F.min(time).alias("__tm_first"))
    return events.join(first, list(keys), "left").where(F.col("__tm_first").isNull() | (F.col(time) < F.col("__tm_first"))).select(*events.columns)


def unsupported_events(events: DataFrame, observations: DataFrame, keys: Sequence[str], time: str, width: int, least: int) -> DataFrame:
    """Events with under ``least`` observations in the ``width`` before them, the event's own time included."""
    return trailing_count(events, observations, keys, time, width).where(F.col("n_observations") < least)


def entries_before_events(labels: DataFrame, event_time: str, entry_time: str) -> DataFrame:
    """Labels whose entry lies before their event, or is missing."""
    return labels.where(F.col(entry_time).isNull() | (F.col(entry_time) < F.col(event_time)))


def future_leaks(data: DataFrame, pipeline: Callable[[DataFrame], DataFrame], keys: Sequence[str], time: str, cutoff, columns: Sequence[str], compare: Sequence[str] | None = None, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Outputs up to ``cutoff`` that change when the inputs after it do: a causal pipeline gives no row.

    The ``columns`` of later rows are scaled by factors of 1.5 to 2.5 and raised by 1.
    ``pipeline`` must keep ``keys`` and ``time``, together unique, and give ``compare``; left
    out, these are all numeric columns that both runs give.
    """
    late = F.col(time) > F.lit(cutoff)
    changed = data.withColumns({c: F.when(late, F.col(c) * (1.5 + F.pmod(F.xxhash64(time, *keys), F.lit(100)) / 100) + 1).otherwise(F.col(c)) for c in columns})
    before, after = pipeline(data), pipeline(changed)
    if compare is None:
        numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
        common = set(after.columns) - {*keys, time}
        compare = [c for c, t in before.dtypes if c in common and (t in numeric or t.startswith("decimal"))]
    a = before.where(F.col(time) <= F.lit(cutoff)).select(*keys, time, *compare)
    b = after.where(F.col(time) <= F.lit(cutoff)).select(*keys, time, *(F.col(c).alias(f"__tm_{c}") for c in compare))
    joined = a.join(b, [*keys, time], "full")
    bad = F.lit(False)
    for c in compare:
        x, y = F.col(c), F.col(f"__tm_{c}")
        same = x.eqNullSafe(y) | (F.abs(x - y) <= atol + rtol * F.abs(y))
        bad = bad | ~F.coalesce(same, F.lit(False))
    return joined.where(bad)


def aggressor_agreement(trades: DataFrame, mids: DataFrame, keys: Sequence[str], time: str, trade_id: str, price: str, side: str, mid_id: str, mid: str) -> DataFrame:
    """Per key, how often a trade's side agrees with its price against the last mid before it: ``n_trades``, ``agreement`` (1 if none can be told)."""
    near = asof_backward(trades, mids, keys, time, trade_id, time, mid_id)
    t = trades.select(*keys, F.col(trade_id).alias("left_id"), F.col(price).alias("__tm_p"), F.col(side).alias("__tm_side"))
    m = mids.select(*keys, F.col(mid_id).alias("right_id"), F.col(mid).alias("__tm_mid"))
    met = near.join(t, [*keys, "left_id"]).join(m, [*keys, "right_id"])
    seen = F.signum(F.col("__tm_p") - F.col("__tm_mid"))
    told = (seen != 0) & (F.signum("__tm_side") != 0) & ~F.isnan(seen)
    return met.groupBy(*keys).agg(F.count_if(told).alias("n_trades"), F.coalesce(F.avg(F.when(told, (seen == F.signum("__tm_side")).cast("double"))), F.lit(1.0)).alias("agreement"))
