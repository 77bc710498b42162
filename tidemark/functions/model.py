"""Scoring with a frozen linear model, compiled into a column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FrozenLogistic:
    """Numbers of a fitted logistic model: features in order, those taken as ln(1+x), scaling, weights."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...]
    intercept: float
    log1p: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not len(self.features) == len(self.mean) == len(self.scale) == len(self.coef):
            raise ValueError("features, mean, scale and coef differ in length")

    def probability(self) -> Column:
        """Null or NaN in a feature stays null or NaN; the order of the table's columns does not matter."""
        total = F.lit(self.intercept)
        for name, mean, scale, weight in zip(self.features, self.mean, self.scale, self.coef, strict=True):
            x = F.col(name).cast("double")
            x = F.log1p(x) if name in self.log1p else x
            total = total + (x - F.lit(mean)) / F.lit(scale) * F.lit(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
