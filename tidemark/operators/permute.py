"""Permuted and resampled bar series, and the Monte-Carlo permutation test on them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.mathx import autoregression
from tidemark.operators.strategy import Strategy, profit_factor, with_strategy_returns
from tidemark.operators.windows import Series

PERM = "perm_id"


def digest_order(s: Series, salt: str) -> Column:
    """A shuffled order of rows that any engine can repeat: by the md5 digest of permutation and row number."""
    return F.md5(F.concat_ws("-", F.lit(salt), F.col(PERM).cast("string"), F.col("__tm_row").cast("string")))


def numbered(bars: DataFrame, s: Series) -> DataFrame:
    return bars.withColumn("__tm_row", F.row_number().over(s.all()) - 1)


EXTRA_MODES = ("permute", "preserve", "sync_close")


def unaligned_series(bars: DataFrame, s: Series) -> DataFrame:
    """Order values that some series of the table lack or repeat, with ``n_rows`` and ``n_series``: none if all share one index, as a common shuffle needs."""
    n = bars.select(*s.keys).distinct().count()  # a number
    held = bars.groupBy(*s.order[:1]).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.struct(*s.keys)).alias("n_series"))
    return held.where((F.col("n_rows") != n) | (F.col("n_series") != n))


def permute_bars(bars: DataFrame, s: Series, permutations: int, start_index: int = 0, extra: Sequence[str] = (), extra_mode: str = "permute", aligned: bool = False) -> DataFrame:
    """``permutations`` series for each one, with shuffled moves: ``perm_id`` from 1, keys, order columns, open, high, low, close.

    Rows up to ``start_index`` stay. After it the moves from a close to the next open are
    shuffled in one way and the moves inside a bar in another, and chained on again, so
    that the last close is the original one. Series of one table are shuffled alike, row
    number for row number, so what they have in common stays; ``aligned`` raises unless
    they share one index (``unaligned_series``).

    ``extra`` columns by ``extra_mode``: 'permute' shuffles their own log moves like the
    moves inside bars (zeros and nulls are missing, a move from or to one is 0, negatives count
    as 1e-10; a missing value at the start stays missing), 'preserve' leaves them as they were,
    'sync_close' too but for ``futures``, which becomes the permuted close.

    Each permuted close is the start's log plus a running sum of moves. The copies are
    shuffled once, by permutation and series; numbering, putting the moves of a slot
    together and summing them up all keep that partitioning, and so do a strategy's
    windows on the result.
    """
    if extra_mode not in EXTRA_MODES:
        raise ValueError(f"extra_mode must be one of {EXTRA_MODES}")
    if aligned and (off := unaligned_series(bars, s).head(1)):
        raise ValueError(f"series differ in their index, at {off[0][0]}")
    columns, shuffled = list(extra), list(extra) if extra_mode == "permute" else []
    rows = numbered(bars, s)
    prev = F.lag(F.log("close")).over(s.all())
    moves = rows.withColumns({"__tm_o": F.log("open") - prev, "__tm_c": F.log("close") - F.log("open"), "__tm_h": F.log("high") - F.log("open"), "__tm_l": F.log("low") - F.log("open")})
    for c in shuffled:
        safe = _positive_log(c)
        moves = moves.withColumn(f"__tm_x_{c}", F.coalesce(safe - F.lag(safe).over(s.all()), F.lit(0.0)))
    inside = ["__tm_c", "__tm_h", "__tm_l", *(f"__tm_x_{c}" for c in shuffled)]
    own = [*s.order, "open", "high", "low", "close", *columns]
    ids = bars.sparkSession.range(1, permutations + 1).withColumnRenamed("id", PERM)
    part = [PERM, *s.keys]
    copies = moves.select(*s.keys, "__tm_row", "__tm_o", *inside, *own).crossJoin(F.broadcast(ids)).repartition(*part)  # a stated number of copies
    fixed = F.col("__tm_row") <= start_index
    by = Window.partitionBy(*part, fixed)
    # slot n of the permuted series takes the moves that come n-th in shuffled order; what comes from which row is put together within the partition
    slots = {f"__tm_{k}": F.when(fixed, F.col("__tm_row")).otherwise(F.row_number().over(by.orderBy(digest_order(s, k), "__tm_row")) + start_index) for k in ("in", "out")}
    none = lambda cols: [F.lit(None).cast(copies.schema[c].dataType).alias(c) for c in cols]
    pieces = F.array(
        F.struct(F.col("__tm_in").alias("__tm_slot"), *inside, *none(["__tm_o"]), *none(own)),
        F.struct(F.col("__tm_out").alias("__tm_slot"), *none(inside), "__tm_o", *none(own)),
        F.struct(F.col("__tm_row").alias("__tm_slot"), *none(inside), *none(["__tm_o"]), *own),
    )
    split = copies.withColumns(slots).select(*part, F.explode(pieces).alias("__tm_e")).select(*part, "__tm_e.*")
    met = split.groupBy(*part, "__tm_slot").agg(
        *(F.max(c).alias(c) for c in ["__tm_o", *inside]), *(F.max(c).alias(f"__tm_own_{c}") for c in own),
    )
    upto = Window.partitionBy(*part).orderBy("__tm_slot").rowsBetween(Window.unboundedPreceding, 0)
    moved = F.col("__tm_slot") > start_index
    start = F.col("__tm_slot") == start_index
    base = F.last(F.when(start, F.log("__tm_own_close")), ignorenulls=True).over(upto)
    path = met.withColumn("__tm_close", base + F.sum(F.when(moved, F.col("__tm_o") + F.col("__tm_c")).otherwise(0.0)).over(upto))
    opened = F.col("__tm_close") - F.col("__tm_c")
    made = {"open": opened, "high": opened + F.col("__tm_h"), "low": opened + F.col("__tm_l"), "close": F.col("__tm_close")}
    for c in shuffled:
        from_ = F.last(F.when(start, F.struct(_positive_log(f"__tm_own_{c}").alias("v"))), ignorenulls=True).over(upto)["v"]
        made[c] = from_ + F.sum(F.when(moved, F.col(f"__tm_x_{c}")).otherwise(0.0)).over(upto)
    values = {c: F.when(moved, F.exp(x)).otherwise(F.col(f"__tm_own_{c}")) for c, x in made.items()}
    kept = {c: F.col(f"__tm_own_{c}") for c in own if c not in values}
    if extra_mode == "sync_close" and "futures" in columns:
        kept["futures"] = F.when(moved, values["close"]).otherwise(F.col("__tm_own_futures"))
    return path.select(*part, *({**kept, **values}[c].alias(c) for c in own))


def _positive_log(c: str) -> Column:
    x = F.when((F.col(c) != 0) & ~F.isnan(c), F.col(c))
    return F.when(x.isNotNull(), F.log(F.greatest(x, F.lit(1e-10))))


def permute_rows(bars: DataFrame, s: Series, permutations: int, start_index: int = 0) -> DataFrame:
    """Whole rows after ``start_index`` shuffled, each series in its own way; the order columns stay in place."""
    rows = numbered(bars, s)
    ids = bars.sparkSession.range(1, permutations + 1).withColumnRenamed("id", PERM)
    copies = rows.crossJoin(F.broadcast(ids))
    own = F.md5(F.concat_ws("-", F.lit("row"), F.col(PERM).cast("string"), *(F.col(k).cast("string") for k in s.keys), F.col("__tm_row").cast("string")))
    part = Window.partitionBy(PERM, *s.keys, F.col("__tm_row") >= start_index)
    slot = F.when(F.col("__tm_row") < start_index, F.col("__tm_row")).otherwise(F.row_number().over(part.orderBy(own, "__tm_row")) - 1 + start_index)
    values = [c for c in bars.columns if c not in s.keys and c not in s.order]
    shuffled = copies.withColumn("__tm_slot", slot).select(PERM, *s.keys, "__tm_slot", *values)
    when = rows.select(*s.keys, F.col("__tm_row").alias("__tm_slot"), *s.order)
    return shuffled.join(when, [*s.keys, "__tm_slot"]).select(PERM, *s.keys, *s.order, *values)


def bootstrap_blocks(bars: DataFrame, s: Series, permutations: int, start_index: int = 0, block: int = 10, scaled: Sequence[str] = ("open", "high", "low", "close")) -> DataFrame:
    """Moving-block bootstrap of close returns with replacement; prices are scaled by the new close over the old, other columns stay.

    Blocks of ``block`` rows begin at random rows from ``start_index`` on, drawn by digest.
    """
    rows = numbered(bars, s)
    size = rows.groupBy(*s.keys).agg((F.max("__tm_row") + 1).alias("__tm_n"))
    move = F.coalesce(F.log("close") - F.lag(F.log("close")).over(s.all()), F.lit(0.0))
    rows = rows.withColumn("__tm_move", move).join(size, s.keys)
    ids = bars.sparkSession.range(1, permutations + 1).withColumnRenamed("id", PERM)
    copies = rows.crossJoin(F.broadcast(ids))
    at = F.col("__tm_row") - start_index
    which = F.floor(at / block)
    draw = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit("block"), F.col(PERM).cast("string"), which.cast("string"))), 1, 12), 16, 10).cast("long")
    choices = F.greatest(F.col("__tm_n") - block + 1 - start_index, F.lit(1))
    source = F.when(at < 0, F.col("__tm_row")).otherwise(F.least(start_index + F.pmod(draw, choices) + F.pmod(at, F.lit(block)), F.col("__tm_n") - 1))
    moves = rows.select(*s.keys, F.col("__tm_row").alias("__tm_src"), F.col("__tm_move").alias("__tm_new"))
    drawn = copies.withColumn("__tm_src", source.cast(rows.schema["__tm_row"].dataType)).join(moves, [*s.keys, "__tm_src"])
    w = Window.partitionBy(PERM, *s.keys).orderBy("__tm_row").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.log("close")).over(w)
    path = first + F.sum(F.when(F.col("__tm_row") > 0, F.col("__tm_new")).otherwise(0.0)).over(w)
    out = drawn.withColumn("__tm_ratio", F.exp(path) / F.col("close"))
    keep = [c for c in bars.columns if c not in scaled]
    return out.select(PERM, *keep, *((F.col(c) * F.col("__tm_ratio")).alias(c) for c in scaled))


def simulate_ar1(bars: DataFrame, s: Series, permutations: int, start_index: int = 0, seed: int = 1000) -> DataFrame:
    """Series whose basis (futures over spot) is simulated by an AR(1) model fitted on the first third, 50 rows at least, or up to ``start_index``.

    A permutation's residuals are drawn and run through the recursion in one task per
    permutation and series, 64 rows at a time.
    """
    keys, order = s.keys, s.order
    ids = bars.sparkSession.range(1, permutations + 1).withColumnRenamed("id", PERM)
    copies = bars.select(*keys, *order, "open", "high", "low", "close", "spot", "futures").crossJoin(F.broadcast(ids))

    def simulate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        n = len(pdf)
        basis = ((pdf.futures - pdf.spot) / pdf.spot).to_numpy()
        train = max(start_index, max(50, n // 3))
        if train >= n:
            return pdf
        mean = basis[:train].mean()
        centred = basis[:train] - mean
        phi = float(np.corrcoef(centred[1:], centred[:-1])[0, 1]) if centred.std() > 0 else 0.0
        left = centred[1:] - phi * centred[:-1]
        shocks = np.random.default_rng(seed + int(pdf[PERM].iloc[0])).choice(left, n - train)
        made = basis.copy()
        made[train:] = mean + autoregression(shocks, phi, centred[-1])
        close = pdf.spot * (1 + made)
        scale = close / pdf.close
        return pdf.assign(open=pdf.open * scale, high=pdf.high * scale, low=pdf.low * scale, close=close, futures=close)

    return copies.groupBy(PERM, *keys).applyInPandas(simulate, copies.schema)


def random_orders(spark: SparkSession, rows: int, permutations: int, seed: int = 1000) -> DataFrame:
    """(``perm_id``, ``slot``, ``source``): NumPy's permutations of ``rows`` for the seeds ``seed + perm_id``."""

    def draw(batches):
        for batch in batches:
            for p in batch["id"]:
                order = np.random.default_rng(seed + int(p)).permutation(rows)
                yield pd.DataFrame({PERM: p, "slot": np.arange(rows), "source": order})

    return spark.range(1, permutations + 1).mapInPandas(draw, f"{PERM} long, slot long, source long")


def permutation_test(bars: DataFrame, s: Series, strategy: Strategy, n: int = 20, start_index: int = 0, mode: str = "bar", spread_bps: float = 0.0, commission_bps: float = 0.0, **params) -> DataFrame:
    """Monte-Carlo permutation test per series: keys, ``real_return``, ``n_at_least``, ``permuted_mean``, ``permuted_std``, ``p_value``, ``real_profit_factor``.

    ``n - 1`` permuted series are compared with the real one on the summed strategy return;
    p = (1 + number at least as high) / n. Mean and deviation of the permuted sums are
    the population's. All permutations run side by side, as one
    more key of the series; only sums leave them.
    """
    make = {"bar": permute_bars, "row": permute_rows, "block": bootstrap_blocks}[mode]

    def total(df: DataFrame, keys: list[str]) -> DataFrame:
        own = Series(keys, s.order)
        done = with_strategy_returns(strategy.apply(df, own, **params), own, "signal", spread_bps, commission_bps)
        return done.groupBy(*keys).agg(F.sum("strategy_ret").alias("total"), profit_factor(F.col("strategy_ret"), 1.0).alias("factor"))

    real = total(bars, s.keys).withColumnsRenamed({"total": "real_return", "factor": "real_profit_factor"})
    permuted = total(make(bars, s, n - 1, start_index), [PERM, *s.keys])
    compared = permuted.join(real, s.keys).groupBy(*s.keys, "real_return", "real_profit_factor").agg(
        F.count_if(F.col("total") >= F.col("real_return")).alias("n_at_least"), F.avg("total").alias("permuted_mean"), F.stddev_pop("total").alias("permuted_std"),
    )
    return compared.withColumn("p_value", (1 + F.col("n_at_least")) / F.lit(float(n)))
