"""Causal features of bar series: each value uses its own row and rows before it, never later ones.

Rules for all: nulls are gaps (NaN is read as null by ``clean_bars``); a window gives null
until it has all its values; a ratio over 0 is null; results are DOUBLE.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.mathx import autoregression
from tidemark.operators.ordered import KIND, LEAD, PID, new_run, part_count
from tidemark.operators.windows import Series, positive_ln, ratio
from tidemark.session import written_apart

PRICES = ("open", "high", "low", "close")


def clean_bars(df: DataFrame, required: Sequence[str] = PRICES) -> DataFrame:
    """Column names in lower case, the required ones present, NaN read as null."""
    named = df.toDF(*(c.lower() for c in df.columns))
    missing = [c for c in required if c not in named.columns]
    if missing:
        raise ValueError(f"bars lack columns: {missing}")
    return named.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in named.dtypes if t in ("double", "float")})


def returns(s: Series, close: str = "close") -> Column:
    return ratio(F.col(close), s.lag(close)) - 1


def log_returns(s: Series, close: str = "close") -> Column:
    return positive_ln(F.col(close)) - positive_ln(s.lag(close))


def sma(s: Series, x: Column | str, n: int) -> Column:
    return s.full(F.avg(x), x, n)


def rolling_std(s: Series, x: Column | str, n: int, ddof: int = 1) -> Column:
    if ddof == 1:
        return s.full(F.stddev_samp(x), x, n)
    return F.when(F.lit(n > ddof), F.sqrt(s.full(F.var_pop(x), x, n) * F.lit(n / max(n - ddof, 1))))


def zscore(s: Series, x: str, n: int) -> Column:
    return ratio(F.col(x) - sma(s, x, n), rolling_std(s, x, n))


def rolling_min(s: Series, x: str, n: int) -> Column:
    return s.full(F.min(x), x, n)


def rolling_max(s: Series, x: str, n: int) -> Column:
    return s.full(F.max(x), x, n)


def rolling_rank(s: Series, x: str, n: int) -> Column:
    """Share of the window's other values that are no greater; 0.5 for a window of one."""
    if n == 1:
        return F.when(F.col(x).isNotNull(), F.lit(0.5))
    window = F.collect_list(x).over(s.last(n))
    below = F.size(F.filter(window, lambda v: v <= F.col(x))) - 1
    return F.when((F.count(x).over(s.last(n)) >= n) & F.col(x).isNotNull(), below / F.lit(float(n - 1)))


def true_range(s: Series) -> Column:
    before = s.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_features(df: DataFrame, s: Series, n: int = 20, short: int = 14) -> DataFrame:
    """All bar features at once; two passes over one sort, since some are windows over others."""
    first = df.withColumns(
        {
            "ret": returns(s), "log_ret": log_returns(s), "tr": true_range(s), "delta": F.col("close") - s.lag("close"),
            "sma": sma(s, "close", n), "std": rolling_std(s, "close", n), "zscore": zscore(s, "close", n),
            "rank": rolling_rank(s, "close", n), "low_n": rolling_min(s, "low", n), "high_n": rolling_max(s, "high", n),
        }
    )
    first = first.withColumns({"gain": F.greatest("delta", F.lit(0.0)), "loss": F.greatest(-F.col("delta"), F.lit(0.0))})
    first = first.withColumns({c: F.when(F.col("delta").isNotNull(), F.col(c)) for c in ("gain", "loss")})
    up, down = sma(s, "gain", short), sma(s, "loss", short)
    rsi = F.when(down == 0, 100.0).when(down > 0, 100 - 100 / (1 + up / down))
    return first.withColumns({"realized_vol": rolling_std(s, "log_ret", n), "atr": sma(s, "tr", short), "rsi": rsi}).drop("delta", "gain", "loss")


def with_ema(df: DataFrame, s: Series, x: str, span: int, out: str) -> DataFrame:
    """Exponential moving average ``out``: the first value starts it, then y += 2/(span+1) * (x - y).

    Rows without a value keep the average before them and do not age it; before the
    first value it is null. A recursion is no SQL window, but it is linear: each partition
    of the table sorted by series runs it from 0, and what a series had reached before
    a partition is added with the weight left of it. Only a partition's first series
    can have begun earlier; its carry comes from two rows a partition. So a series may
    span any number of tasks.
    """
    a = 2.0 / (span + 1)
    keep = max(1.0 - a, 0.0)
    order = [*s.keys, *s.order]
    ranged = df.repartitionByRange(part_count(df), *order).sortWithinPartitions(*order)
    extra = [T.StructField(_Y, T.DoubleType()), T.StructField(_M, T.LongType()), T.StructField(LEAD, T.BooleanType()), T.StructField(_FIRST, T.DoubleType()), T.StructField(KIND, T.IntegerType())]
    ran = ranged.mapInArrow(_recursion(s.keys, x, a, keep), T.StructType([*df.schema.fields, *extra]))
    rows, edges = written_apart(ran.withColumn(PID, F.spark_partition_id()), "ema", KIND)
    # each earlier partition of a series adds a value at least, so from `reach` on nothing is left
    reach = 1 if keep == 0 else math.ceil(37 / -math.log(keep))
    past = F.collect_list(F.struct(_Y, _M, _FIRST)).over(Window.partitionBy(*s.keys).orderBy(PID, F.desc(LEAD)).rowsBetween(-reach, -1))
    carry = F.aggregate(past, F.lit(None).cast("double"), lambda acc, e: e[_Y] + F.coalesce(acc, e[_FIRST]) * F.pow(F.lit(keep), e[_M]))
    carries = edges.where(F.col(_M) > 0).withColumn("__tm_carry", carry).where(LEAD).select(F.col(PID).alias("__tm_p"), "__tm_carry", F.col(_FIRST).alias("__tm_start"))
    # a partition whose first series has no value here still shows what came before
    silent = edges.where(F.col(LEAD) & (F.col(_M) == 0))
    earlier = edges.where(F.col(_M) > 0).select(*(F.col(k).alias(f"__tm_k{i}") for i, k in enumerate(s.keys)), F.col(PID).alias("__tm_q"), F.struct(F.col(_Y), F.col(_M), F.col(_FIRST)).alias("__tm_e"))
    same = F.col("__tm_q") < F.col(PID)
    for i, k in enumerate(s.keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__tm_k{i}"))
    held = silent.join(F.broadcast(earlier), same).groupBy(F.col(PID).alias("__tm_p")).agg(F.sort_array(F.collect_list(F.struct("__tm_q", "__tm_e"))).alias("__tm_all"))
    held = held.select("__tm_p", F.aggregate("__tm_all", F.lit(None).cast("double"), lambda acc, e: e["__tm_e"][_Y] + F.coalesce(acc, e["__tm_e"][_FIRST]) * F.pow(F.lit(keep), e["__tm_e"][_M])).alias("__tm_carry"), F.lit(None).cast("double").alias("__tm_start"))
    joined = rows.join(F.broadcast(carries.unionByName(held)), F.col(LEAD) & (F.col(PID) == F.col("__tm_p")), "left")
    start = F.coalesce("__tm_carry", F.when(F.col(_M) > 0, F.col("__tm_start")))
    value = F.when(F.col(LEAD), F.col(_Y) + start * F.pow(F.lit(keep), F.col(_M))).otherwise(F.col(_Y))
    return joined.withColumn(out, value).select(*df.columns, out)


_Y, _M, _FIRST = "__tm_y", "__tm_m", "__tm_first"


def _recursion(keys: Sequence[str], x: str, a: float, keep: float):
    """Of each row of a sorted partition, the average run from 0 (of a series other than the first: from its first value) and the number of values in it; at the end, a row each for the first and the last series (kind 1)."""

    def marked(batch: pa.RecordBatch, y: np.ndarray, m: np.ndarray, lead: np.ndarray, first: np.ndarray, kind: int) -> pa.RecordBatch:
        cols = [pa.array(y, mask=np.isnan(y) & ~lead & (m == 0)), pa.array(m), pa.array(lead), pa.array(first, mask=m == 0), pa.array(np.full(len(m), kind, dtype=np.int32))]
        return pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, _Y, _M, LEAD, _FIRST, KIND])

    def run(batches):
        last, lead, y, m, first, head = None, True, 0.0, 0, np.nan, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            starts = new_run(cols)
            if last is not None and tuple(c[0].as_py() for c in cols) == last:
                starts[0] = False
            column = batch.column(batch.schema.get_field_index(x))
            known, values = np.asarray(column.is_valid()), np.asarray(column.cast(pa.float64()).fill_null(0.0))
            begin = np.flatnonzero(starts)
            begin = begin if len(begin) and begin[0] == 0 else np.append(0, begin)
            ys, ms, firsts = np.empty(len(values)), np.empty(len(values), dtype=np.int64), np.empty(len(values))
            leads = np.zeros(len(values), dtype=bool)
            for i, j in zip(begin, np.append(begin[1:], len(values)), strict=True):
                if starts[i]:
                    lead, y, m, first = last is None and i == 0, 0.0, 0, np.nan
                some = known[i:j]
                mine = values[i:j][some]
                if len(mine) and m == 0:
                    first = mine[0]
                    y = 0.0 if lead else first
                path = np.append(y if m or not lead else 0.0, autoregression(a * mine, keep, y)) if len(mine) else np.array([y])
                nth = np.cumsum(some)
                ys[i:j] = np.where((nth == 0) & (m == 0) & (not lead), np.nan, path[nth])
                ms[i:j], firsts[i:j], leads[i:j] = m + nth, first, lead
                if lead:
                    head = (batch.slice(i, 1), path[-1], m + int(nth[-1]), first)
                y, m = path[-1], m + int(nth[-1])
            last, tail = tuple(c[-1].as_py() for c in cols), batch.slice(batch.num_rows - 1, 1)
            yield marked(batch, ys, ms, leads, firsts, 0)
        one = lambda v: np.array([v])
        if head is not None:
            yield marked(head[0], one(head[1]), one(head[2]), one(True), one(head[3]), 1)
            if not lead:
                # what it has reached from its own first value, as from 0 and that value carried
                yield marked(tail, one(y - first * keep**m if m else 0.0), one(m), one(False), one(first), 1)

    return run
