"""Joins in time: as-of, interval, and counts over trailing intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.nearest import nearest_by_time
from tidemark.operators.ordered import IDX, number_rows
from tidemark.session import written


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, left_id: str, right_time: str, right_id: str, tolerance: int | None = None) -> DataFrame:
    """Last right row at or before each left row; see ``nearest_by_time``."""
    return nearest_by_time(left, right, keys, left_time, left_id, right_time, right_id, tolerance, "backward")


def asof_forward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, left_id: str, right_time: str, right_id: str, tolerance: int | None = None) -> DataFrame:
    """First right row at or after each left row; see ``nearest_by_time``."""
    return nearest_by_time(left, right, keys, left_time, left_id, right_time, right_id, tolerance, "forward")


def interval_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, low: str, high: str, width: int) -> DataFrame:
    """Pairs of a span and each point of the same keys with ``low <= time <= high``, all BIGINT.

    Time is cut into bins of ``width``; a span is repeated for each bin it touches, so
    the join is on equality of keys and bin, with the bounds as a residual condition.
    Choose a ``width`` near the usual length of a span. Rows with nulls in keys, time
    or bounds, and spans that end before they begin, have no partner. Column names of the
    two tables must differ but for the keys.
    """
    bin_ = "__tm_bin"
    w = F.lit(width)
    bins = F.sequence(F.floor(F.col(low) / w), F.floor(F.col(high) / w))
    left = spans.where(F.col(low) <= F.col(high)).withColumn(bin_, F.explode(bins))
    right = points.withColumn(bin_, F.floor(F.col(time) / w))
    return left.join(right, [*keys, bin_]).where(F.col(time).between(F.col(low), F.col(high))).drop(bin_)


def trailing_count(events: DataFrame, observations: DataFrame, keys: Sequence[str], time: str, width: int, out: str = "n_observations") -> DataFrame:
    """``events`` with the number of observations of their keys in (time - width, time]; both tables call their time ``time``, BIGINT.

    Events with a null time or key count none. Observations are numbered in order of time;
    the count is the number of the last one at or before the event less that of the last
    one at or before its time - width, both by one as-of join. So a key of either table may
    exceed a task.
    """
    ks = list(keys)
    seen = number_rows(observations.select(*ks, F.col(time).cast("long").alias("__tm_at")).na.drop(), ks, ["__tm_at"])
    # of observations at one time the join takes the smallest id, so the last one gets it
    seen = seen.withColumn("__tm_id", -F.col(IDX) - 1)
    own = written(events.withColumn("__tm_row", F.monotonically_increasing_id()), "events")
    ends = F.explode(F.array(F.struct(F.col(time).cast("long").alias("t"), (F.col("__tm_row") * 2).alias("i")), F.struct((F.col(time) - F.lit(width)).cast("long").alias("t"), (F.col("__tm_row") * 2 + 1).alias("i"))))
    wanted = own.select(*ks, ends.alias("__tm_e")).select(*ks, F.col("__tm_e.t").alias("__tm_t"), F.col("__tm_e.i").alias("__tm_i"))
    near = asof_backward(wanted, seen, ks, "__tm_t", "__tm_i", "__tm_at", "__tm_id")
    sign = F.when(F.pmod("left_id", F.lit(2)) == 0, -F.col("right_id")).otherwise(F.col("right_id"))
    counts = near.groupBy(F.shiftright("left_id", 1).alias("__tm_n")).agg(F.sum(sign).alias(out))
    return own.join(counts, F.col("__tm_row") == F.col("__tm_n"), "left").select(*events.columns, F.coalesce(out, F.lit(0)).cast("long").alias(out))


def matching_contract(contracts: DataFrame, registered: DataFrame, same: str, optional: Sequence[str], rank: Column) -> DataFrame:
    """For each contract the first registered one, by ``rank``, with the same ``same`` and no conflict in ``optional``.

    An optional property conflicts only if both sides give it (neither null nor empty) and
    they differ. The right table's columns come with the prefix ``r_``; contracts
    without a match are left out.
    """
    r = registered.select(*(F.col(c).alias(f"r_{c}") for c in registered.columns), rank.alias("__tm_rank"))
    cond = F.col(same) == F.col(f"r_{same}")
    for c in optional:
        a, b = F.col(c), F.col(f"r_{c}")
        cond = cond & ((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "") | (a == b))
    numbered = contracts.withColumn("__tm_row", F.monotonically_increasing_id())
    first = Window.partitionBy("__tm_row").orderBy("__tm_rank")
    return numbered.join(r, cond).withColumn("__tm_n", F.row_number().over(first)).where("__tm_n = 1").drop("__tm_row", "__tm_rank", "__tm_n")
