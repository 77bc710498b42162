"""Signals: how a strategy plugs in, the built-in ones, parameter grids and the registry."""

from __future__ import annotations

import importlib
import itertools
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.features import log_returns, rolling_std, sma
from tidemark.operators.windows import Series


@dataclass(frozen=True)
class Strategy:
    """A signal, +1/0/-1 or any number, for each bar: ``signal(series, **params)`` is a column over the bars' windows.

    ``grid`` has the values to try of each parameter, ``halo`` how many rows a signal
    looks back for given parameters. ``holds`` says that a signal stands until the next.
    """

    name: str
    signal: Callable[..., Column]
    grid: Mapping[str, Sequence[Any]] = field(default_factory=dict)
    holds: bool = False

    def apply(self, bars: DataFrame, s: Series, out: str = "signal", **params: Any) -> DataFrame:
        raw = bars.withColumn("__tm_raw", self.signal(s, **params))
        return raw.withColumn(out, s.fill("__tm_raw") if self.holds else F.col("__tm_raw")).drop("__tm_raw")

    def combinations(self) -> list[dict[str, Any]]:
        """All combinations of the grid, the last parameter varying fastest; one empty one without a grid."""
        return [dict(zip(self.grid, values, strict=True)) for values in itertools.product(*self.grid.values())]


def donchian(s: Series, lookback: int = 20) -> Column:
    """+1 above, -1 below all closes of the ``lookback - 1`` bars before; null between."""
    w = s.all().rowsBetween(-(lookback - 1), -1)
    ready = F.count("close").over(w) >= lookback - 1
    up, down = F.col("close") > F.max("close").over(w), F.col("close") < F.min("close").over(w)
    return F.when(ready & up, 1.0).when(ready & down, -1.0)


def bollinger(s: Series, period: int = 20, std_multiplier: float = 2.0) -> Column:
    """+1 below, -1 above the band of ``std_multiplier`` deviations around the mean; null inside."""
    mid, width = sma(s, "close", period), rolling_std(s, "close", period) * F.lit(float(std_multiplier))
    return F.when(F.col("close") < mid - width, 1.0).when(F.col("close") > mid + width, -1.0)


def sma_cross(s: Series, fast_ma: int = 10, slow_ma: int = 20) -> Column:
    """+1 if the fast average is above the slow one, -1 below, else 0."""
    fast, slow = sma(s, "close", fast_ma), sma(s, "close", slow_ma)
    return F.when(fast > slow, 1.0).when(fast < slow, -1.0).otherwise(0.0)


def momentum(s: Series) -> Column:
    """Sign of the last move."""
    return F.coalesce(F.signum(log_returns(s)), F.lit(0.0))


class Registry:
    """Strategies by name, whatever its case."""

    def __init__(self) -> None:
        self._known: dict[str, Strategy] = {}

    def register(self, strategy: Strategy) -> None:
        self._known[strategy.name.upper()] = strategy

    def get(self, name: str) -> Strategy:
        if name.upper() not in self._known:
            raise KeyError(f"no strategy {name!r}; there are {self.names()}")
        return self._known[name.upper()]

    def remove(self, name: str) -> None:
        self.get(name)
        del self._known[name.upper()]

    def names(self) -> list[str]:
        return sorted(self._known)

    def to_json(self) -> str:
        """Each strategy's function, as module and name, its grid and whether it holds. One defined on the spot has no function to name and is left out."""
        kept = {}
        for n, s in self._known.items():
            name = getattr(s.signal, "__qualname__", "")
            if name.isidentifier():
                kept[n] = {"module": s.signal.__module__, "function": name, "grid": {k: list(v) for k, v in s.grid.items()}, "holds": s.holds}
        return json.dumps(kept, sort_keys=True, indent=2)

    def save(self, path: str) -> None:
        with open(path, "w") as file:
            file.write(self.to_json())

    @classmethod
    def load(cls, path: str | None = None) -> Registry:
        """The strategies of a file written by ``save``; the built-in ones without a path. A file that is missing, or no such file, raises."""
        out = cls()
        if path is None:
            for s in REGISTRY._known.values():
                out.register(s)
            return out
        with open(path) as file:
            known = json.load(file)
        for name, d in known.items():
            signal = getattr(importlib.import_module(d["module"]), d["function"])
            out.register(Strategy(name.lower(), signal, d["grid"], d["holds"]))
        return out


REGISTRY = Registry()
REGISTRY.register(Strategy("donchian", donchian, {"lookback": range(12, 169)}, holds=True))
REGISTRY.register(Strategy("bollinger", bollinger, {"period": range(10, 50), "std_multiplier": (1.5, 2.0, 2.5)}, holds=True))
REGISTRY.register(Strategy("sma_cross", sma_cross, {"fast_ma": (5, 10, 20), "slow_ma": (20, 30, 50)}))
REGISTRY.register(Strategy("momentum", momentum))
REGISTRY.register(Strategy("constant", lambda s, side=0.0: F.lit(float(side)), {"side": (-1.0, 0.0, 1.0)}))


def with_strategy_returns(bars: DataFrame, s: Series, signal: str = "signal", spread_bps: float = 0.0, commission_bps: float = 0.0, out: str = "strategy_ret") -> DataFrame:
    """Return of each bar under the position decided at the bar before, less costs on changes of position.

    Missing signals and moves count as 0. The position is shifted exactly once, here.
    """
    held = bars.withColumns({"__tm_pos": F.coalesce(F.lag(signal).over(s.all()), F.lit(0.0)), "__tm_move": log_returns(s)})
    cost = F.coalesce(F.abs(F.col("__tm_pos") - F.lag("__tm_pos").over(s.all())), F.lit(0.0)) * F.lit((spread_bps + commission_bps) / 1e4)
    return held.withColumn(out, F.col("__tm_pos") * F.coalesce("__tm_move", F.lit(0.0)) - cost).drop("__tm_pos", "__tm_move")


def profit_factor(x: Column, no_losses: float = 0.0) -> Column:
    """Gains over losses; without losses infinite if there are gains, else ``no_losses``."""
    gains, losses = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.coalesce(-F.sum(F.when(x < 0, x)), F.lit(0.0))
    return F.when(losses > 0, gains / F.when(losses > 0, losses)).when(gains > 0, F.lit(float("inf"))).otherwise(F.lit(no_losses))


def sharpe(x: Column) -> Column:
    """Mean over deviation, not annualised; 0 without deviation."""
    dev = F.stddev_samp(x)
    return F.when(dev > 0, F.avg(x) / dev).otherwise(0.0)


def grid_scores(bars: DataFrame, s: Series, strategy: Strategy, score: Callable[[Column], Column] = profit_factor, batch: int = 24) -> DataFrame:
    """Score of each parameter combination for each series: keys, ``param_id``, ``score``.

    Signals of up to ``batch`` combinations are columns of one pass over one sort; the
    columns become rows after they are reduced to scores, so nothing is multiplied by
    the size of the grid but the final rows.
    """
    combos = strategy.combinations()
    out = None
    for a in range(0, len(combos), batch):
        part = bars.withColumn("__tm_move", F.coalesce(log_returns(s), F.lit(0.0)))
        ids = range(a, min(a + batch, len(combos)))
        part = part.withColumns({f"__tm_r{i}": strategy.signal(s, **combos[i]) for i in ids})
        if strategy.holds:
            part = part.withColumns({f"__tm_r{i}": s.fill(f"__tm_r{i}") for i in ids})
        part = part.withColumns({f"__tm_r{i}": F.coalesce(F.lag(f"__tm_r{i}").over(s.all()), F.lit(0.0)) * F.col("__tm_move") for i in ids})
        scores = part.groupBy(*s.keys).agg(*(score(F.col(f"__tm_r{i}")).alias(f"s{i}") for i in ids))
        pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("param_id"), F.col(f"s{i}").alias("score")) for i in ids)))
        rows = scores.select(*s.keys, pairs.alias("p")).select(*s.keys, "p.param_id", "p.score")
        out = rows if out is None else out.unionByName(rows)
    return out


def best_parameters(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The combination with the highest score, the earliest of equal ones; NaN and null never win over a number."""
    order = F.when(~F.isnan("score"), F.col("score")).desc_nulls_last()
    w = Window.partitionBy(*keys).orderBy(order, "param_id")
    return scores.withColumn("__tm_n", F.row_number().over(w)).where("__tm_n = 1").drop("__tm_n")


def modal_parameters(chosen: DataFrame, keys: Sequence[str], top: int = 1) -> DataFrame:
    """The ``top`` most frequent choices over windows, of equal ones the first chosen: keys, ``param_id``, ``n_windows``."""
    counted = chosen.groupBy(*keys, "param_id").agg(F.count(F.lit(1)).alias("n_windows"), F.min("win_id").alias("first_win"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n_windows"), "first_win")
    return counted.withColumn("__tm_n", F.row_number().over(w)).where(F.col("__tm_n") <= top).drop("__tm_n", "first_win")


def walk_forward(bars: DataFrame, s: Series, strategy: Strategy, lookback: int, step: int, score: Callable[[Column], Column] = profit_factor) -> tuple[DataFrame, DataFrame]:
    """Walk-forward signal: (bars with ``win_id`` and ``signal``, choices with keys, ``win_id``, ``param_id``, ``score``).

    Window j trains on rows [j*step, j*step + lookback) of a series, with signals and
    returns computed inside that slice alone, and trades the ``step`` rows after it with
    the winning parameters' signal over the whole series. Rows before ``lookback`` have
    no signal.

    Each bar is repeated once for every window that trains on it, so all windows of
    all series are scored in one pass, side by side.
    """
    numbered = bars.withColumn("__tm_row", F.row_number().over(s.all()) - 1)
    size = numbered.groupBy(*s.keys).agg(F.max("__tm_row").alias("__tm_top"))
    numbered = numbered.join(size, s.keys)
    row, lb, st = F.col("__tm_row"), F.lit(lookback), F.lit(step)
    # windows whose test range begins inside the series
    low = F.greatest(F.floor((row - lb) / st) + 1, F.lit(0)).cast("int")
    high = F.least(F.floor(row / st), F.floor((F.col("__tm_top") - lb) / st)).cast("int")
    train = numbered.where(high >= low).withColumn("win_id", F.explode(F.sequence(low, high)))
    slices = Series([*s.keys, "win_id"], s.order)
    choices = best_parameters(grid_scores(train, slices, strategy, score), slices.keys)
    combos = strategy.combinations()
    whole = numbered.withColumns({f"__tm_r{i}": strategy.signal(s, **c) for i, c in enumerate(combos)})
    if strategy.holds:
        whole = whole.withColumns({f"__tm_r{i}": s.fill(f"__tm_r{i}") for i in range(len(combos))})
    whole = whole.withColumn("win_id", F.when(row >= lb, F.floor((row - lb) / st)).cast("int"))
    picked = whole.join(choices.select(*slices.keys, "param_id"), slices.keys, "left")
    signal = F.coalesce(*(F.when(F.col("param_id") == i, F.col(f"__tm_r{i}")) for i in range(len(combos))))
    return picked.withColumn("signal", signal).drop("__tm_row", "__tm_top", "param_id", *(f"__tm_r{i}" for i in range(len(combos)))), choices
