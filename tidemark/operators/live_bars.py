"""Trades to bars by the rules of a live aggregator, computed on stored trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.grid import bucket_start
from tidemark.operators.ordered import with_running


def with_running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, out: str, size: int = 200_000) -> DataFrame:
    """``df`` with the maximum of ``x`` over the rows before each row, per key and in order; null at first. A key may exceed a task."""
    return with_running(df, keys, order, {out: ("max", F.col(x))}, inclusive=False, size=size)


def _valid(time_us: str, seq: str, price: str, size: str):
    return F.coalesce((F.col(price) > 0) & (F.col(size) > 0) & F.col(time_us).isNotNull() & F.col(seq).isNotNull(), F.lit(False))


def _placed(trades: DataFrame, ks: list[str], time_us: str, seq: str, price: str, size: str, step: int) -> DataFrame:
    """The real bars of each series, the last one too, with the bucket after each and whether it is the first."""
    valid = trades.where(_valid(time_us, seq, price, size))
    slim = valid.select(*ks, F.col(seq).alias("__tm_seq"), bucket_start(F.col(time_us), step).alias("bucket_us"), F.col(price).cast("double").alias("__tm_p"), F.col(size).cast("double").alias("__tm_s"))
    kept = with_running_max(slim, ks, ["__tm_seq"], "bucket_us", "__tm_reached").where("__tm_reached IS NULL OR bucket_us >= __tm_reached")
    real = F.when(~F.isnan("__tm_p"), F.col("__tm_p"))
    bars = kept.groupBy(*ks, "bucket_us").agg(
        F.min_by("__tm_p", "__tm_seq").alias("open"), F.max(real).alias("high"), F.min(real).alias("low"), F.max_by("__tm_p", "__tm_seq").alias("close"),
        F.sum("__tm_s").alias("volume"), F.count(F.lit(1)).alias("n_trades"),
    )
    w = Window.partitionBy(*ks).orderBy("bucket_us")
    return bars.withColumns({"__tm_next": F.lead("bucket_us").over(w), "__tm_first": F.lag("bucket_us").over(w).isNull()})


def live_bars(
    trades: DataFrame, keys: Sequence[str], time_us: str, seq: str, price: str, size: str, interval_s: int = 60, fill_gaps: bool = True, max_gap: int = 120, discard_boot: bool = True,
) -> DataFrame:
    """Bars as a live aggregator emits them: keys, ``bucket_us``, ``open``, ``high``, ``low``, ``close``, ``volume``, ``n_trades``, ``synthetic``.

    Trades are taken in order of arrival (``seq``). One whose price or size is missing or
    not above 0, or whose time is missing, is invalid; one whose bucket lies before one already reached is late; both are
    left out. Open and close go by arrival, not by time. A bar ends only when a trade
    of a later bucket arrives, so each series' last bar is never emitted; with
    ``discard_boot`` its first, incomplete one is not either. With ``fill_gaps`` up to
    ``max_gap`` empty buckets between two bars become synthetic bars at the last close
    (that of the discarded first bar too) with volume 0; a longer gap stays open.
    """
    ks = list(keys)
    step = interval_s * 1_000_000
    placed = _placed(trades, ks, time_us, seq, price, size, step).where("__tm_next IS NOT NULL")
    missing = (F.col("__tm_next") - F.col("bucket_us")) / step - 1
    filled = F.when(F.lit(fill_gaps) & (missing >= 1) & (missing <= max_gap), F.sequence(F.col("bucket_us") + step, F.col("__tm_next") - step, F.lit(step).cast("long")))
    own = F.when(F.lit(discard_boot) & F.col("__tm_first"), F.array().cast("array<bigint>")).otherwise(F.array("bucket_us"))
    rows = placed.withColumn("__tm_b", F.explode(F.concat(own, F.coalesce(filled, F.array().cast("array<bigint>")))))
    synthetic = F.col("__tm_b") != F.col("bucket_us")
    prices = [F.when(synthetic, F.col("close")).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close")]
    return rows.select(
        *ks, F.col("__tm_b").alias("bucket_us"), *prices, F.when(synthetic, 0.0).otherwise(F.col("volume")).alias("volume"),
        F.when(synthetic, 0).otherwise(F.col("n_trades")).cast("long").alias("n_trades"), synthetic.alias("synthetic"),
    )


def live_counters(
    trades: DataFrame, keys: Sequence[str], time_us: str, seq: str, price: str, size: str, interval_s: int = 60, fill_gaps: bool = True, max_gap: int = 120, discard_boot: bool = True,
) -> DataFrame:
    """What the live aggregator counts while it makes ``live_bars``, by series: keys, ``received``, ``late``, ``invalid``, ``emitted``, ``synthetic``, ``boot``, ``large_gaps``.

    Late trades are received ones, synthetic bars emitted ones. ``boot`` counts discarded
    first bars, ``large_gaps`` gaps of more than ``max_gap`` buckets, which stay open.
    """
    ks = list(keys)
    step = interval_s * 1_000_000
    good, none = _valid(time_us, seq, price, size), F.lit(0).cast("long")
    names = ("received", "late", "invalid", "emitted", "synthetic", "boot", "large_gaps")
    arrived = trades.groupBy(*ks).agg(F.count_if(good).alias("received"), F.count_if(good).alias("late"), F.count_if(~good).alias("invalid"), *(none.alias(c) for c in names[3:]))
    closed = F.col("__tm_next").isNotNull()
    missing = F.when(closed & F.lit(fill_gaps), (F.col("__tm_next") - F.col("bucket_us")) / step - 1)
    filled = F.when((missing >= 1) & (missing <= max_gap), missing.cast("long")).otherwise(none)
    boot = closed & F.col("__tm_first") & F.lit(discard_boot)
    made = _placed(trades, ks, time_us, seq, price, size, step).groupBy(*ks).agg(
        none.alias("received"), (-F.sum("n_trades")).alias("late"), none.alias("invalid"), (F.count_if(closed & ~boot) + F.sum(filled)).alias("emitted"),
        F.sum(filled).alias("synthetic"), F.count_if(boot).alias("boot"), F.count_if(missing > max_gap).alias("large_gaps"),
    )
    return arrived.unionByName(made).groupBy(*ks).agg(*(F.sum(c).alias(c) for c in names))


def last_trade_pairs(ticks: DataFrame, keys: Sequence[str], seq: str, kind: str, value: str, time_us: str, price_kinds: Sequence[int] = (4, 68), size_kinds: Sequence[int] = (5, 71)) -> DataFrame:
    """Trades out of separate price and size ticks: each size tick with the last price that arrived before it, at that price's time.

    Prices and sizes not above 0 are skipped, and sizes before any price. Result: keys,
    ``seq`` (of the size tick), ``timestamp_us``, ``price``, ``size``. A key may exceed a task.
    """
    good = ticks.where(F.col(value) > 0).select(*keys, seq, kind, value, time_us)
    price = F.when(F.col(kind).isin(*price_kinds), F.struct(F.col(time_us).alias("t"), F.col(value).alias("p")))
    good = with_running(good, keys, [seq, kind], {"__tm_last": ("last", price)})
    paired = good.where(F.col(kind).isin(*size_kinds) & F.col("__tm_last").isNotNull())
    return paired.select(*keys, F.col(seq).alias("seq"), F.col("__tm_last.t").alias("timestamp_us"), F.col("__tm_last.p").alias("price"), F.col(value).alias("size"))


def top_of_book(ticks: DataFrame, keys: Sequence[str], seq: str, kind: str, value: str, time_us: str, bid_kinds: tuple = ((1, 66), (0, 69)), ask_kinds: tuple = ((2, 67), (3, 70))) -> DataFrame:
    """Level-0 updates out of separate price and size ticks: one for each tick of a side, of either kind, while the side's last price and last size are both above 0.

    ``bid_kinds`` and ``ask_kinds`` are the kinds of price ticks and of size ticks. A value not
    above 0 is kept as the side's state, so that nothing is put out until the next good
    one; a missing one is no tick. Result: keys, ``seq``, ``timestamp_us`` (both of the
    tick), ``side`` (1 bid, 0 ask), ``position`` 0, ``operation`` 1, ``price``, ``size``. A
    side of a key may exceed a task.
    """
    prices, sizes = ([*b, *a] for b, a in zip(bid_kinds, ask_kinds, strict=True))
    side = F.when(F.col(kind).isin(*bid_kinds[0], *bid_kinds[1]), 1).when(F.col(kind).isin(*ask_kinds[0], *ask_kinds[1]), 0)
    last = {name: ("last", F.when(F.col(kind).isin(*kinds), F.col(value))) for name, kinds in (("__tm_price", prices), ("__tm_size", sizes))}
    own = ticks.select(*keys, seq, kind, value, time_us, side.alias("side")).where(F.col("side").isNotNull() & F.col(value).isNotNull())
    state = with_running(own, [*keys, "side"], [seq, kind], last)
    known = state.where("__tm_price > 0 AND NOT isnan(__tm_price) AND __tm_size > 0 AND NOT isnan(__tm_size)")
    return known.select(
        *keys, F.col(seq).alias("seq"), F.col(time_us).alias("timestamp_us"), "side", F.lit(0).alias("position"), F.lit(1).alias("operation"),
        F.col("__tm_price").alias("price"), F.col("__tm_size").alias("size"),
    )


#: What each data mode wants of a ticker's feed.
MODES = {"TRADE": {"trades"}, "TICK_L1": {"book", "trades"}, "TICK_L2": {"book"}}


def routed(ticks: DataFrame, modes: DataFrame, keys: Sequence[str], kind: str, trade_kinds: Sequence[int] = (4, 5, 68, 71), mode: str = "mode") -> DataFrame:
    """The ticks that their ticker's data mode wants: trade ticks unless it is TICK_L2, ticks of the book unless it is TRADE; none of a ticker without a known mode.

    ``modes`` has a row for each ticker: ``keys`` and ``mode``.
    """
    trade = F.col(kind).isin(*trade_kinds)
    wants = lambda what: F.col("__tm_mode").isin(*(m for m, w in MODES.items() if what in w))
    met = ticks.join(modes.select(*keys, F.upper(mode).alias("__tm_mode")), list(keys))
    return met.where((trade & wants("trades")) | (~trade & wants("book"))).select(*ticks.columns)
