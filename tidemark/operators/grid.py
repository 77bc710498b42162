"""Irregular readings laid onto a regular time grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Buckets of a gap that are exploded from one row.
SPAN = 4096


def bucket_start(us, step_us: int):
    """Start of the bucket of ``step_us`` microseconds that holds a time, also before the epoch."""
    return us - F.pmod(us, F.lit(step_us))


def regular_grid(
    readings: DataFrame,
    keys: Sequence[str],
    time_us: str,
    value: str,
    step_us: int,
    seq: str | None = None,
    size: str | None = None,
    interpolate_up_to: int = 0,
    hold_up_to: int = 0,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """One row per key and grid time from a key's first to its last reading.

    Result: keys, ``bucket_us`` (start, a multiple of ``step_us``), ``value`` (the
    bucket's last reading by time, then ``seq``), ``volume`` (sum of ``size``; 0 in
    filled rows; null without ``size``), ``n_readings``, ``gap`` (empty buckets of the
    gap that a filled row belongs to) and ``synthetic``. A filled row has, by the
    length of its gap in buckets: at most ``interpolate_up_to``, a value on the line
    between the gap's neighbours; else at most ``hold_up_to``, the value before the
    gap; else null, so the period is only marked.

    ``bounds`` (keys, ``from_us``, ``to_us``) extends each key's grid to the buckets of
    those times where they lie outside its readings; such rows have no neighbour on
    one side, hence are held (behind the last reading, within ``hold_up_to``) or null.
    Keys in ``bounds`` alone get no rows; keys missing from it are not extended; it
    must have one row per key.

    Readings with a null time or value are left out; NaN values are readings. Null
    keys are keys of their own. Empty input gives no rows. Repeated rows fall into one
    bucket.

    The readings are reduced to buckets with partial aggregation before the shuffle,
    so a busy key costs no more than its grid. Only empty grid times are exploded, a long gap
    first into spans of ``SPAN`` buckets, so that no row holds a whole gap.
    """
    ks = list(keys)
    order = F.struct(F.col(time_us), F.col(seq)) if seq else F.col(time_us)
    volume = F.sum(size) if size else F.lit(None).cast("double")
    data = (
        readings.where(F.col(time_us).isNotNull() & F.col(value).isNotNull())
        .withColumn("__tm_b", bucket_start(F.col(time_us).cast("long"), step_us))
        .groupBy(*ks, "__tm_b")
        .agg(F.max_by(F.col(value), order).alias("__tm_v"), volume.alias("__tm_s"), F.count(F.lit(1)).alias("__tm_n"))
    )
    w = Window.partitionBy(*ks).orderBy("__tm_b")
    paired = data.withColumns({"__tm_next": F.lead("__tm_b").over(w), "__tm_nextv": F.lead("__tm_v").over(w), "__tm_prev": F.lag("__tm_b").over(w)})
    if bounds is not None:
        b = bounds.select(*(F.col(k).alias(f"__tm_bk{i}") for i, k in enumerate(ks)), F.col("from_us").cast("long").alias("__tm_from"), F.col("to_us").cast("long").alias("__tm_to"))
        same = F.lit(True)
        for i, k in enumerate(ks):
            same = same & F.col(k).eqNullSafe(F.col(f"__tm_bk{i}"))
        paired = paired.join(b, same, "left").drop(*(f"__tm_bk{i}" for i in range(len(ks))))
    else:
        paired = paired.withColumns({"__tm_from": F.lit(None).cast("long"), "__tm_to": F.lit(None).cast("long")})
    step, none = F.lit(step_us).cast("long"), F.array().cast("array<struct<a:bigint,z:bigint>>")
    first, stop = bucket_start(F.col("__tm_from"), step_us), bucket_start(F.col("__tm_to"), step_us)
    b_ = F.col("__tm_b")
    big = F.lit(SPAN * step_us).cast("long")

    def spans(low, high):
        return F.transform(F.sequence(low, high, big), lambda x: F.struct(x.alias("a"), F.least(x + big - step, high).alias("z")))

    until = F.coalesce("__tm_next", F.when(stop > b_, stop + step))
    ahead = F.when(F.col("__tm_prev").isNull() & (first < b_), spans(first, b_ - step)).otherwise(none)
    behind = F.when(until > b_ + step, spans(b_ + step, until - step)).otherwise(none)
    parts = paired.withColumn("__tm_p", F.explode(F.concat(ahead, F.array(F.struct(b_.alias("a"), b_.alias("z"))), behind)))
    exploded = parts.withColumn("__tm_g", F.explode(F.sequence("__tm_p.a", "__tm_p.z", step)))
    g = F.col("__tm_g")
    filled = g != b_
    gap = F.when(g > b_, (until - b_) / step - 1).when(g < b_, (b_ - first) / step).cast("long")
    share = (g - b_) / (F.col("__tm_next") - b_)
    v = F.col("__tm_v")
    fill = F.when((g > b_) & F.col("__tm_next").isNotNull() & (gap <= interpolate_up_to), v + (F.col("__tm_nextv") - v) * share)
    fill = fill.when((g > b_) & (gap <= hold_up_to), v)
    zero = F.lit(0.0) if size else F.lit(None).cast("double")
    return exploded.select(
        *ks,
        g.alias("bucket_us"),
        F.when(filled, fill).otherwise(v).alias("value"),
        F.when(filled, zero).otherwise(F.col("__tm_s")).alias("volume"),
        F.when(filled, F.lit(0)).otherwise(F.col("__tm_n")).cast("long").alias("n_readings"),
        F.when(filled, gap).alias("gap"),
        filled.alias("synthetic"),
    )
