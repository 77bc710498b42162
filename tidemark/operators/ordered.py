"""Numbering the rows of skewed keys, and working on them in pieces of equal size.

A key that holds a third of all rows cannot be one task. Here the table is
range-partitioned by (keys, order), so that such a key simply spans several
partitions; each partition numbers its own rows, and the number at which a
partition starts follows from a prefix sum over the counts of the partitions
before it. From then on (key, number // size) are pieces of one size, whatever
the skew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import input_bytes, written_apart

PID, RN, LEAD, IDX, CHUNK = "__tm_pid", "__tm_rn", "__tm_lead", "__tm_idx", "__tm_chunk"

KIND = "__tm_kind"

#: Bytes of input that one range partition is meant to hold, and the most partitions there are: a bound on bounds, edges and offsets at any scale.
PART_BYTES = 12 << 20
MAX_PARTS = 20_000


def part_count(df: DataFrame) -> int:
    """Range partitions for ``df``: by the size of the tables it reads, enough to occupy the cluster, and at most ``MAX_PARTS``.

    Beyond that partitions grow; they are sorted with spilling and scanned in batches, so any size will do.
    """
    spark = df.sparkSession
    cores, size = spark.sparkContext.defaultParallelism, input_bytes(df)
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions")) if size is None else -(-size // PART_BYTES)
    return max(cores, min(MAX_PARTS, wanted))


def new_run(columns: Sequence[pa.ChunkedArray]) -> np.ndarray:
    """Marks the rows of a sorted table at which any of ``columns`` differs from the row before; nulls are equal."""
    n = len(columns[0]) if columns else 0
    out = np.zeros(n, dtype=bool)
    if not n:
        return out
    out[0] = True
    for col in columns:
        a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        if isinstance(a, pa.ChunkedArray):
            a = pa.concat_arrays(a.chunks)
        differs = pc.fill_null(pc.not_equal(a[1:], a[:-1]), False)
        nulls = np.asarray(pc.is_null(a))
        out[1:] |= np.asarray(differs) | (nulls[1:] != nulls[:-1])
    return out


def _number(keys: Sequence[str]) -> Callable:
    """Numbers the rows of a sorted partition within their keys; at its end, a row each for its first and its last key with their counts."""

    def marked(batch: pa.RecordBatch, rn: np.ndarray, lead: np.ndarray, kind: int) -> pa.RecordBatch:
        extra = [pa.array(rn.astype(np.int64)), pa.array(lead), pa.array(np.full(batch.num_rows, kind, dtype=np.int32))]
        return pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, RN, LEAD, KIND])

    def run(batches):
        last, count, first_run, head = None, 0, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            starts = new_run(cols)
            begun = last is not None
            if begun and tuple(c[0].as_py() for c in cols) == last:
                starts[0] = False
            at = np.arange(batch.num_rows)
            begin = np.maximum.accumulate(np.where(starts, at, -1))
            rn = np.where(begin < 0, at + count, at - begin)
            if begun:
                lead = (begin < 0) & first_run
            else:
                lead = begin == 0
            if head is None or lead.any():
                n_lead = int(lead.sum())
                head = (batch.slice(0, 1), int(rn[n_lead - 1]) + 1)
            last, count, first_run, tail = tuple(c[-1].as_py() for c in cols), int(rn[-1]) + 1, bool(lead[-1]), batch.slice(batch.num_rows - 1, 1)
            yield marked(batch, rn, lead, 0)
        if head is not None:
            yield marked(head[0], np.array([head[1]]), np.array([True]), 1)
            if not first_run:
                yield marked(tail, np.array([count]), np.array([False]), 1)

    return run


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``df`` with ``__tm_idx``, the 0-based number of each row within its key.

    Rows are ordered by ``order`` (nulls first); give it a unique last column, or
    rows that tie are numbered in any one order. Null keys are keys of their own.
    An empty table gives an empty table. All columns of ``df`` are kept, so select
    what is needed first.

    Any key may exceed a task. A partition counts its first and its last key while it
    numbers its rows; only those can span partitions, so the number at which a
    partition's first key goes on follows from two rows a partition, at most
    ``2 * MAX_PARTS`` rows, which are broadcast.
    """
    n = part_count(df)
    by = [*(F.col(k) for k in keys), *(F.col(o) if isinstance(o, str) else o for o in order)]
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    schema = T.StructType([*df.schema.fields, T.StructField(RN, T.LongType()), T.StructField(LEAD, T.BooleanType()), T.StructField(KIND, T.IntegerType())])
    table, edges = written_apart(ranged.mapInArrow(_number(list(keys)), schema).withColumn(PID, F.spark_partition_id()), "numbered", KIND)
    before = F.sum(RN).over(Window.partitionBy(*keys).orderBy(PID, F.desc(LEAD)).rowsBetween(Window.unboundedPreceding, -1))
    offsets = edges.withColumn("__tm_off", before).where(F.col(LEAD) & (F.col("__tm_off") > 0)).select(PID, "__tm_off")
    return (
        table.join(F.broadcast(offsets), PID, "left")
        .withColumn(IDX, F.col(RN) + F.when(F.col(LEAD), F.coalesce("__tm_off", F.lit(0))).otherwise(0))
        .select(*df.columns, IDX)
    )


def chunk_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], size: int, halo: int = 0) -> DataFrame:
    """``number_rows`` plus ``__tm_chunk``: pieces of ``size`` consecutive rows of one key.

    With a ``halo``, the ``halo`` rows on either side of a piece are repeated in it;
    a row's own piece is ``__tm_idx // size``.
    """
    rows = number_rows(df, keys, order)
    own = F.floor(F.col(IDX) / F.lit(size)).cast("long")
    if not halo:
        return rows.withColumn(CHUNK, own)
    if halo > size:
        raise ValueError("halo must not exceed the chunk size")
    at = F.col(IDX) % F.lit(size)
    pieces = F.array_compact(F.array(own, F.when((at < halo) & (own > 0), own - 1), F.when(at >= size - halo, own + 1)))
    return rows.withColumn(CHUNK, F.explode(pieces))


def per_key_profile(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, value: str | None = None, size: int = 100_000) -> DataFrame:
    """Ordered per-key results of a skewed table, computed on pieces of equal size.

    For each key, over its rows in the given order: ``n_rows``, ``first_time`` and
    ``last_time`` (of the first and last row that has a time), ``n_backwards`` (rows
    whose time is below that of the row before), ``max_gap`` (largest step from one
    row's time to the next) and, if ``value`` is given, ``n_changes`` (rows whose
    value differs from the row before; null equals null).

    A piece yields its inner result and its boundary state (first and last row).
    Merging runs over the pieces in order, where the step between two neighbours is
    made from their states; only pieces, never rows, meet in one task.

    Rows with a null time count in ``n_rows`` and take no part in time steps that
    touch them. Null keys are keys of their own. An empty table gives no rows.
    """
    val = F.col(value) if value else F.lit(None).cast("int")
    slim = df.select(*keys, *[o for o in order if o not in keys], F.col(time).alias("__tm_t"), val.alias("__tm_v"))
    rows = chunk_rows(slim, keys, order, size)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(IDX)
    step = F.col("__tm_t") - F.lag("__tm_t").over(inside)
    changed = F.lag(IDX).over(inside).isNotNull() & ~F.col("__tm_v").eqNullSafe(F.lag("__tm_v").over(inside))
    known = F.col("__tm_t").isNotNull()
    states = (
        rows.withColumns({"__tm_step": step, "__tm_chg": changed})
        .groupBy(*keys, CHUNK)
        .agg(
            F.count(F.lit(1)).alias("__tm_n"),
            F.min_by("__tm_t", IDX).alias("__tm_head"),
            F.max_by("__tm_t", IDX).alias("__tm_tail"),
            F.min_by("__tm_v", IDX).alias("__tm_vhead"),
            F.max_by("__tm_v", IDX).alias("__tm_vtail"),
            F.min_by("__tm_t", F.when(known, F.col(IDX))).alias("__tm_first"),
            F.max_by("__tm_t", F.when(known, F.col(IDX))).alias("__tm_last"),
            F.count_if(F.col("__tm_step") < 0).alias("__tm_back"),
            F.max("__tm_step").alias("__tm_gap"),
            F.count_if("__tm_chg").alias("__tm_nchg"),
        )
    )
    across = Window.partitionBy(*keys).orderBy(CHUNK)
    jump = F.col("__tm_head") - F.lag("__tm_tail").over(across)
    turned = F.lag(CHUNK).over(across).isNotNull() & ~F.col("__tm_vhead").eqNullSafe(F.lag("__tm_vtail").over(across))
    merged = states.withColumns({"__tm_jump": jump, "__tm_turn": turned}).groupBy(*keys).agg(
        F.sum("__tm_n").alias("n_rows"),
        F.min_by("__tm_first", F.when(F.col("__tm_first").isNotNull(), F.col(CHUNK))).alias("first_time"),
        F.max_by("__tm_last", F.when(F.col("__tm_last").isNotNull(), F.col(CHUNK))).alias("last_time"),
        (F.sum("__tm_back") + F.count_if(F.col("__tm_jump") < 0)).alias("n_backwards"),
        F.greatest(F.max("__tm_gap"), F.max("__tm_jump")).alias("max_gap"),
        (F.sum("__tm_nchg") + F.count_if("__tm_turn")).alias("n_changes"),
    )
    return merged if value else merged.drop("n_changes")


def per_key_counts(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 100_000) -> DataFrame:
    """Rows of each key, ``n_rows``, merged from counts of pieces of equal size."""
    slim = df.select(*keys, *[o for o in order if o not in keys])
    pieces = chunk_rows(slim, keys, order, size).groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("__tm_n"))
    return pieces.groupBy(*keys).agg(F.sum("__tm_n").alias("n_rows"))


def dominant_keys(df: DataFrame, group: Sequence[str], key: str, order: Sequence[str], share: float, size: int = 100_000) -> DataFrame:
    """Keys that hold at least ``share`` of the rows of their group, with ``n_rows`` and ``group_rows``.

    A null key is no key and never returned, but its rows count in the group.
    """
    counts = per_key_counts(df, [*group, key], order, size)
    total = F.sum("n_rows").over(Window.partitionBy(*group))
    return counts.withColumn("group_rows", total).where((F.col("n_rows") >= F.col("group_rows") * F.lit(share)) & F.col(key).isNotNull())


def with_running(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, tuple[str, Column]], inclusive: bool = True, size: int = 100_000) -> DataFrame:
    """``df`` with running values per key in order: ``columns`` maps a name to ('last' | 'sum' | 'max', column).

    'last' is the last value that is not null, 'sum' and 'max' skip nulls; null before the
    first value. ``inclusive`` takes the row itself in, else only those before it. Null
    keys are keys of their own. Computed inside pieces of equal size and carried across
    them, so that a key may exceed a task: only pieces, never rows, meet in one. Sums and
    maxima of numbers are made in one scan of the sorted partitions, which are the pieces
    then.
    """
    ks = list(keys)
    named = {f"__tm_v{i}": column for i, (_, column) in enumerate(columns.values())}
    kinds = [kind for kind, _ in columns.values()]
    types = [f.dataType for f in df.select(*named.values()).schema.fields]
    if all(k in ("sum", "max") for k in kinds) and all(isinstance(t, (T.LongType, T.IntegerType, T.DoubleType)) for t in types):
        return _with_totals(df, ks, list(order), list(columns), kinds, named, types, inclusive)
    rows = chunk_rows(df.withColumns(named), ks, list(order), size)
    fold = {"last": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "max": F.max}
    upto = Window.partitionBy(*ks, CHUNK).orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = {f"__tm_i{i}": fold[kind](c).over(upto) for i, (kind, c) in enumerate(zip(kinds, named, strict=True))}
    whole = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(IDX))) if kind == "last" else fold[kind](c) for kind, c in zip(kinds, named, strict=True)]
    pieces = rows.groupBy(*ks, CHUNK).agg(*(w.alias(f"__tm_w{i}") for i, w in enumerate(whole)))
    before = Window.partitionBy(*ks).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carries = pieces.select(
        *(F.col(k).alias(f"__tm_k{i}") for i, k in enumerate(ks)), F.col(CHUNK).alias("__tm_c"),
        *(fold[kind](f"__tm_w{i}").over(before).alias(f"__tm_p{i}") for i, kind in enumerate(kinds)),
    ).where("__tm_c > 0")
    same = F.col(CHUNK) == F.col("__tm_c")
    for i, k in enumerate(ks):
        same = same & F.col(k).eqNullSafe(F.col(f"__tm_k{i}"))
    joined = rows.withColumns(inner).join(carries, same, "left")
    out = []
    for i, (name, kind) in enumerate(zip(columns, kinds, strict=True)):
        own, past = F.col(f"__tm_i{i}"), F.col(f"__tm_p{i}")
        value = {"last": F.coalesce(own, past), "sum": F.when(own.isNull() & past.isNull(), None).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce(past, F.lit(0))), "max": F.greatest(own, past)}[kind]
        out.append(value.alias(name))
    return joined.select(*df.columns, *out)


def _with_totals(df: DataFrame, ks: list[str], order: list, names: list[str], kinds: list[str], named: dict[str, Column], types: list[T.DataType], inclusive: bool) -> DataFrame:
    wide = {v: c.cast("double" if isinstance(t, T.DoubleType) else "long") for (v, c), t in zip(named.items(), types, strict=True)}
    typed = df.withColumns(wide)
    by = [*(F.col(k) for k in ks), *(F.col(o) if isinstance(o, str) else o for o in order)]
    ranged = typed.repartitionByRange(part_count(typed), *by).sortWithinPartitions(*by)
    made = [T.StructField(f"__tm_i{i}", typed.schema[v].dataType) for i, v in enumerate(named)]
    schema = T.StructType([*typed.schema.fields, *made, T.StructField(LEAD, T.BooleanType()), T.StructField(KIND, T.IntegerType())])
    table, edges = written_apart(ranged.mapInArrow(_accumulate(ks, list(named), kinds, inclusive), schema).withColumn(PID, F.spark_partition_id()), "running", KIND)
    before = Window.partitionBy(*ks).orderBy(PID, F.desc(LEAD)).rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "max": F.max}
    carries = edges.withColumns({f"__tm_p{i}": fold[kind](f"__tm_i{i}").over(before) for i, kind in enumerate(kinds)}).where(LEAD).select(PID, *(f"__tm_p{i}" for i in range(len(kinds))))
    joined = table.join(F.broadcast(carries), PID, "left")
    out = []
    for i, (name, kind, t) in enumerate(zip(names, kinds, types, strict=True)):
        own, past = F.col(f"__tm_i{i}"), F.when(F.col(LEAD), F.col(f"__tm_p{i}"))
        value = F.greatest(own, past) if kind == "max" else F.coalesce(own + past, own, past)
        out.append((value.cast(t) if kind == "max" else value).alias(name))
    return joined.select(*df.columns, *out)


def _accumulate(keys: Sequence[str], values: Sequence[str], kinds: Sequence[str], inclusive: bool) -> Callable:
    """Running sums and maxima of the rows of a sorted partition within their keys; at its end, a row each for its first and its last key with their totals (kind 1)."""
    folds = [np.add if kind == "sum" else np.maximum for kind in kinds]

    def marked(batch: pa.RecordBatch, cols: list[tuple[np.ndarray, np.ndarray]], lead: np.ndarray, kind: int) -> pa.RecordBatch:
        made = [pa.array(v, mask=~seen) for v, seen in cols]
        return pa.RecordBatch.from_arrays([*batch.columns, *made, pa.array(lead), pa.array(np.full(batch.num_rows, kind, dtype=np.int32))], names=[*batch.schema.names, *(f"__tm_i{i}" for i in range(len(made))), LEAD, KIND])

    def run(batches):
        last, lead, head = None, True, None
        state: list = [None] * len(values)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            starts = new_run(cols) if cols else np.arange(n) == 0
            if last is not None and tuple(c[0].as_py() for c in cols) == last:
                starts[0] = False
            begin = np.flatnonzero(starts)
            begin = begin if len(begin) and begin[0] == 0 else np.append(0, begin)
            given = [batch.column(batch.schema.get_field_index(v)) for v in values]
            known = [np.asarray(c.is_valid()) for c in given]
            given = [np.asarray(c.fill_null(0)) for c in given]
            out = [(np.zeros(n, dtype=g.dtype), np.zeros(n, dtype=bool)) for g in given]
            leads = np.zeros(n, dtype=bool)
            for i, j in zip(begin, np.append(begin[1:], n), strict=True):
                if starts[i]:
                    lead, state = last is None and i == 0, [None] * len(values)
                leads[i:j] = lead
                for k, fold in enumerate(folds):
                    some = known[k][i:j]
                    mine = given[k][i:j][some]
                    before = mine[:0] if state[k] is None else np.array([state[k]], dtype=given[k].dtype)
                    path = fold.accumulate(np.append(before, mine)) if len(before) + len(mine) else mine
                    at = np.cumsum(some) - (0 if inclusive else some) - 1 + len(before)  # the last value so far
                    seen = at >= 0
                    out[k][1][i:j] = seen
                    if len(path):
                        out[k][0][i:j] = path[np.maximum(at, 0)]
                        state[k] = path[-1]
                if lead:
                    head = (batch.slice(i, 1), list(state))
            last, tail = tuple(c[-1].as_py() for c in cols), batch.slice(n - 1, 1)
            kind_of = [g.dtype for g in given]
            yield marked(batch, out, leads, 0)
        for row, totals, first in ([] if head is None else [(*head, True)] + ([] if lead else [(tail, state, False)])):
            cols = [(np.array([0 if t is None else t], dtype=d), np.array([t is not None])) for t, d in zip(totals, kind_of, strict=True)]
            yield marked(row, cols, np.array([first]), 1)

    return run
