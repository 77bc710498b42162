"""Window helpers shared by all series operators: one order, one partitioning, gated frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.ordered import CHUNK, IDX, chunk_rows


class Series:
    """The partitioning and order of a table of series: keys, then a total order (time, sequence)."""

    def __init__(self, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "seq")) -> None:
        self.keys, self.order = list(keys), list(order)

    def all(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def last(self, n: int) -> WindowSpec:
        """The row itself and the ``n - 1`` before it."""
        return self.all().rowsBetween(-(n - 1), 0)

    def upto(self) -> WindowSpec:
        return self.all().rowsBetween(Window.unboundedPreceding, 0)

    def before(self) -> WindowSpec:
        return self.all().rowsBetween(Window.unboundedPreceding, -1)

    def lag(self, x: Column | str, default=None) -> Column:
        return F.lag(x, 1, default).over(self.all())

    def full(self, aggregate: Column, x: Column | str, n: int, least: int | None = None) -> Column:
        """An aggregate over the last ``n`` rows, null until ``least`` (or all ``n``) of them have a value."""
        return F.when(F.count(x).over(self.last(n)) >= (least or n), aggregate.over(self.last(n)))

    def fill(self, x: Column | str) -> Column:
        """The last value that is not null."""
        return F.last(x, ignorenulls=True).over(self.upto())


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0."""
    return F.try_divide(a, b)


def positive_ln(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def in_segments(df: DataFrame, series: Series, halo: int, fn: Callable[[DataFrame, Series], DataFrame], size: int = 200_000) -> DataFrame:
    """``fn`` over segments of ``size`` rows, for functions that look back at most ``halo`` rows.

    A series longer than a task can hold becomes several segments; each sees the
    ``halo`` rows before it, so the result is that of the whole series.
    """
    pieces = chunk_rows(df, series.keys, series.order, size, halo)
    done = fn(pieces, Series([*series.keys, CHUNK], [IDX]))
    return done.where(F.floor(F.col(IDX) / F.lit(size)) == F.col(CHUNK)).drop(IDX, CHUNK)
