"""Whole analyses of a strategy: metrics, permutation tests, walk-forward with a holdout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.permute import PERM, permutation_test, permute_bars
from tidemark.operators.strategy import Strategy, modal_parameters, walk_forward, with_strategy_returns
from tidemark.operators.trades import performance
from tidemark.operators.windows import Series


def split_holdout(bars: DataFrame, s: Series, months: int) -> DataFrame:
    """``bars`` with ``is_holdout``: whether a bar lies in the last ``months`` calendar months of its series, their first moment included."""
    time = s.order[0]
    last = bars.groupBy(*s.keys).agg(F.max(time).alias("__tm_last"))
    start = F.expr(f"__tm_last - make_ym_interval(0, {int(months)})")
    return bars.join(last, s.keys).withColumn("is_holdout", F.col(time) >= start).drop("__tm_last")


def default_windows(rows: int) -> tuple[int, int]:
    """(training window, step) for a series of so many rows: a third of them, 20 000 at most; a sixth of that, but no less than a twentieth of the rows between 10 and 1000."""
    lookback = min(rows // 3, 20_000)
    return lookback, max(lookback // 6, min(max(rows // 20, 10), 1000))


def picked_signal(bars: DataFrame, s: Series, strategy: Strategy, chosen: DataFrame) -> DataFrame:
    """``bars`` with the ``signal`` of the combination that ``chosen`` (keys, ``param_id``) names for each series; all combinations are columns of one pass."""
    combos = strategy.combinations()
    cols = [f"__tm_r{i}" for i in range(len(combos))]
    whole = bars.withColumns({c: strategy.signal(s, **p) for c, p in zip(cols, combos, strict=True)})
    if strategy.holds:
        whole = whole.withColumns({c: s.fill(c) for c in cols})
    signal = F.coalesce(*(F.when(F.col("param_id") == i, F.col(c)) for i, c in enumerate(cols)))
    return whole.join(chosen.select(*s.keys, "param_id"), s.keys).withColumn("signal", signal).select(*bars.columns, "signal")


def hybrid_walk_forward(bars: DataFrame, s: Series, strategy: Strategy, lookback: int, step: int, holdout_months: int) -> DataFrame:
    """Walk-forward on all but the holdout, and the parameters it chose most often, frozen, on the holdout.

    Per series: ``param_id``, ``n_windows`` (that chose it) and, with the prefixes ``dev_``
    (rows after the first training window) and ``holdout_``, ``profit_factor``, ``total_pnl``,
    ``total_trades`` and ``win_rate`` of the trades and ``return`` (summed bar returns), each
    part taken by itself; ``degradation_pct`` of the profit factor, null unless both are above 0
    and the first is finite, and ``verdict``: 'severe' above 50, 'moderate' above 25,
    'better' below 0, else 'acceptable'; null without a degradation. Signals on the
    holdout are those over the whole series, which for causal signals equals computing
    them bar by bar.
    """
    split = split_holdout(bars, s, holdout_months)
    out, choices = walk_forward(split.where("NOT is_holdout"), s, strategy, lookback, step)
    modal = modal_parameters(choices, s.keys)
    dev = out.where("win_id IS NOT NULL").drop("win_id")
    held = picked_signal(split, s, strategy, modal).where("is_holdout")
    parts = []
    for name, part in (("dev", dev), ("holdout", held)):
        metrics = performance(part, s).select(*s.keys, *(F.col(c).alias(f"{name}_{c}") for c in ("profit_factor", "total_pnl", "total_trades", "win_rate")))
        total = with_strategy_returns(part, s).groupBy(*s.keys).agg(F.sum("strategy_ret").alias(f"{name}_return"))
        parts.append(metrics.join(total, s.keys))
    both = modal.join(parts[0], s.keys).join(parts[1], s.keys)
    before, after = F.col("dev_profit_factor"), F.col("holdout_profit_factor")
    drop = F.when((before > 0) & (after > 0) & (before < float("inf")), (before - after) / before * 100)
    x = F.col("degradation_pct")
    verdict = F.when(x > 50, "severe").when(x > 25, "moderate").when(x < 0, "better").when(x.isNotNull(), "acceptable")
    return both.withColumn("degradation_pct", drop).withColumn("verdict", verdict)


def walk_forward_test(bars: DataFrame, s: Series, strategy: Strategy, n: int, lookback: int, step: int) -> DataFrame:
    """Permutation test of the whole walk-forward, its choices included: keys, ``real_return``, ``n_at_least``, ``p_value``.

    Each of the ``n - 1`` permuted series is walked like the real one, as one more key; the
    first training window is permuted too, and there are no costs.
    """

    def total(df: DataFrame, own: Series) -> DataFrame:
        return with_strategy_returns(walk_forward(df, own, strategy, lookback, step)[0], own).groupBy(*own.keys).agg(F.sum("strategy_ret").alias("total"))

    real = total(bars, s).withColumnRenamed("total", "real_return")
    permuted = total(permute_bars(bars, s, n - 1), Series([PERM, *s.keys], s.order))
    met = permuted.join(real, s.keys).groupBy(*s.keys, "real_return").agg(F.count_if(F.col("total") >= F.col("real_return")).alias("n_at_least"))
    return met.withColumn("p_value", (1 + F.col("n_at_least")) / F.lit(float(n)))


def analyse(bars: DataFrame, s: Series, strategy: Strategy, what: str = "metrics", permutations: int = 100, lookback: int = 250, step: int = 50, start=None, end=None, **params) -> dict[str, DataFrame]:
    """'metrics', 'insample', 'walkforward' or 'both' for the bars of [start, end): frames by name. Unknown kinds raise."""
    if what not in ("metrics", "insample", "walkforward", "both"):
        raise ValueError(f"no such analysis: {what}")
    time = s.order[0]
    if start is not None:
        bars = bars.where(F.col(time) >= F.lit(start))
    if end is not None:
        bars = bars.where(F.col(time) < F.lit(end))
    out = {}
    if what == "metrics":
        out["metrics"] = performance(strategy.apply(bars, s, **params), s)
    if what in ("insample", "both"):
        out["insample"] = permutation_test(bars, s, strategy, permutations, **params)
    if what in ("walkforward", "both"):
        signal, choices = walk_forward(bars, s, strategy, lookback, step)
        out["walkforward"] = performance(signal.drop("win_id"), s)
        out["choices"] = choices
        out["walkforward_test"] = walk_forward_test(bars, s, strategy, permutations, lookback, step)
    return out
