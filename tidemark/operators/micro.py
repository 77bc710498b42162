"""Order-flow measures: bulk volume classification, constant-volume buckets, VPIN, book imbalance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.mathx import normal_cdf
from tidemark.operators.ordered import with_running
from tidemark.operators.windows import Series, positive_ln

EPS = 1e-12
MODES = ("close_return", "close_minus_open", "close_close_lag1")


def with_buy_fraction(df: DataFrame, s: Series, mode: str = "close_return", window: int = 30, out: str = "buy_fraction") -> DataFrame:
    """Share of each bar's volume taken as bought: the normal distribution at its move over the moves' usual size.

    The first move of a series is 0 and counts in the deviation, which needs a third of
    the window, 3 values at least; where it is missing or below 1e-12 it is 1e-12, so an
    early move counts as extreme. The score is cut at 8 either way. Null where a price
    is missing.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    floor = F.lit(EPS)
    first = F.lag(F.lit(1)).over(s.all()).isNull()
    if mode == "close_return":
        move = positive_ln(F.greatest("close", floor)) - positive_ln(F.greatest(s.lag("close"), floor))
    elif mode == "close_close_lag1":
        move = F.col("close") - s.lag("close")
    else:
        move, first = F.col("close") - F.col("open"), F.lit(False)
    moved = df.withColumn("__tm_m", F.when(first & F.col("close").isNotNull(), 0.0).otherwise(move))
    least = max(3, window // 3)
    dev = s.full(F.stddev_samp("__tm_m"), "__tm_m", window, least)
    dev = F.when(dev > floor, dev).otherwise(floor)
    z = F.greatest(F.least(F.col("__tm_m") / dev, F.lit(8.0)), F.lit(-8.0))
    scored = moved.withColumn("__tm_z", F.when(F.col("__tm_m").isNotNull(), z))
    return scored.withColumn(out, normal_cdf("__tm_z")).drop("__tm_m", "__tm_z")


RUNNING = "__tm_running"


def with_running_volume(df: DataFrame, s: Series, volume: str = "volume") -> DataFrame:
    """``df`` with the running volume of its series, of bars whose volume counts in ``volume_buckets``."""
    v = F.col(volume).cast("double")
    return with_running(df, s.keys, s.order, {RUNNING: ("sum", F.when((v > EPS) & ~F.isnan(v), v))})


def volume_buckets(df: DataFrame, s: Series, bucket: float, volume: str = "volume", buy: str = "buy_fraction", time: str = "ts", running: str | None = None) -> DataFrame:
    """Buckets of constant volume: keys, ``bucket_id``, ``v_buy``, ``v_sell``, ``v_total``, ``abs_imbalance``, ``dir_imbalance``, ``bucket_end_ts``.

    A bar's volume fills the open bucket and as many after it as it spans, split by its
    buy share (one half where that is missing). Bars whose volume is missing or not
    above 1e-12 add nothing; the last bucket of a series is dropped unless full (to
    1e-9). ``bucket_end_ts`` is the time of the bar that closed it.

    Closed form: a bar covers the interval (S, E] of its series' running volume, and
    bucket k the interval (k*bucket, (k+1)*bucket]; only the overlaps are exploded. The
    running volume is carried over pieces of a series, which may exceed a task; ``running``
    names a column that has it already (``with_running_volume``).
    """
    if bucket <= 0:
        raise ValueError("the bucket volume must be positive")
    b = F.lit(float(bucket))
    v = F.col(volume)
    some = df.where((v > EPS) & ~F.isnan(v))
    if running is None:
        some = with_running_volume(some.select(*s.keys, *s.order, *sorted({volume, buy, time} - {*s.keys, *s.order})), s, volume)
    run = some.withColumn("__tm_e", F.col(running or RUNNING)).withColumn("__tm_s", F.col("__tm_e") - v)
    lo, hi = F.floor(F.col("__tm_s") / b), F.greatest(F.ceil(F.col("__tm_e") / b) - 1, F.floor(F.col("__tm_s") / b))
    cut = run.withColumn("bucket_id", F.explode(F.sequence(lo, hi)))
    k = F.col("bucket_id").cast("double")
    part = F.greatest(F.least(F.col("__tm_e"), (k + 1) * b) - F.greatest(F.col("__tm_s"), k * b), F.lit(0.0))
    share = F.coalesce(F.when(~F.isnan(buy), F.col(buy)), F.lit(0.5))
    sums = (
        cut.withColumn("__tm_p", part)
        .where("__tm_p > 0")
        .groupBy(*s.keys, "bucket_id")
        .agg(F.sum(F.col("__tm_p") * share).alias("v_buy"), F.sum(F.col("__tm_p") * (1 - share)).alias("v_sell"), F.max(time).alias("bucket_end_ts"))
        .withColumn("v_total", F.col("v_buy") + F.col("v_sell"))
        .where(F.col("v_total") >= b - 1e-9)
    )
    total = F.greatest("v_total", F.lit(EPS))
    net = F.col("v_buy") - F.col("v_sell")
    return sums.withColumns({"abs_imbalance": F.abs(net) / total, "dir_imbalance": net / total})


def with_vpin(buckets: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``vpin`` and ``tib``: means of the absolute and the signed imbalance over the last ``n`` buckets, fewer at the start."""
    if n < 1:
        return buckets.where(F.lit(False)).withColumns({"vpin": F.lit(None).cast("double"), "tib": F.lit(None).cast("double")})
    w = Window.partitionBy(*keys).orderBy("bucket_id").rowsBetween(-(n - 1), 0)
    return buckets.withColumns({"vpin": F.avg("abs_imbalance").over(w), "tib": F.avg("dir_imbalance").over(w)})


def vpin_pipeline(bars: DataFrame, s: Series, bucket: float = 50_000.0, buckets: int = 50, mode: str = "close_return", window: int = 30) -> DataFrame:
    """Bars to VPIN: running volume (first, while rows are cheap to read twice), buy fractions, buckets, rolling means."""
    slim = bars.select(*s.keys, *s.order, *sorted({"open", "close", "volume"} - {*s.keys, *s.order}))
    scored = with_buy_fraction(with_running_volume(slim, s), s, mode, window)
    return with_vpin(volume_buckets(scored, s, bucket, time=s.order[0], running=RUNNING), s.keys, buckets)


def book_imbalance(bids: Column, asks: Column) -> Column:
    """Share of the bid side in depth-weighted volume, the level at place i weighing 1/(i+1); null if a side is empty or both weigh 0."""

    def side(levels: Column) -> Column:
        return F.aggregate(F.transform(levels, lambda x, i: x / (i + 1)), F.lit(0.0), lambda a, x: a + x)

    total = side(bids) + side(asks)
    return F.when((F.size(bids) > 0) & (F.size(asks) > 0) & (total > 0), side(bids) / total)


def pressure(imbalance: Column, threshold: float = 0.6) -> Column:
    """'BUY' from the threshold on, 'SELL' up to its mirror, else null."""
    return F.when(imbalance >= threshold, "BUY").when(imbalance <= 1 - threshold, "SELL")
