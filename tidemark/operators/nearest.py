"""Pairing records of two tables by nearest time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import KIND, PID, new_run, part_count
from tidemark.session import written_apart

T_, ID, TAG = "__tm_t", "__tm_id", "__tm_tag"
RIGHT, LEFT = 0, 1
BLOCK = 1024


def _scan(n_keys: int, at_once: int = 50_000):
    """Of each left row of a sorted partition, the nearest right rows before and after it (kind 0); of the right rows, the partition's first and last (kind 1).

    Batches are scanned as they come. Rows are held back only from the last right row
    of the key at hand on, since what follows them is not known yet.
    """
    found = ("__tm_bt", "__tm_bid", "__tm_ft", "__tm_fid")

    def rows(table: pa.Table, pick: np.ndarray, kind: int, values=None) -> pa.Table:
        out = table.take(pa.array(pick))
        for name in found:
            col = pa.nulls(len(pick), pa.int64()) if values is None else values[name]
            out = out.append_column(name, col)
        return out.append_column(KIND, pa.array(np.full(len(pick), kind, dtype=np.int32)))

    def run(batches):
        held, first, last = None, None, None
        for batch in _with_end(batches, at_once):
            final = batch is None
            if final:
                table = held
            else:
                table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                break
            table = table.combine_chunks()
            t, ident = np.asarray(table.column(n_keys)), np.asarray(table.column(n_keys + 1))
            right = np.asarray(table.column(n_keys + 2)) == RIGHT
            n = len(t)
            at = np.arange(n)
            new_key = new_run([table.column(k) for k in range(n_keys)]) if n_keys else at == 0
            key_start = np.maximum.accumulate(np.where(new_key, at, 0))
            # the first row at each (key, time): rights sort first there, by id
            new_time = new_key.copy()
            new_time[1:] |= t[1:] != t[:-1]
            time_start = np.maximum.accumulate(np.where(new_time, at, 0))
            before = np.maximum.accumulate(np.where(right, at, -1))
            if right.any():
                edge = np.flatnonzero(right)
                if first is None:
                    first = rows(table, edge[:1], 1)
                last = rows(table, time_start[edge[-1:]], 1)
            has_before = before >= key_start
            before = time_start[np.maximum(before, 0)]
            ends = np.append(np.flatnonzero(new_key)[1:], n)
            key_end = ends[np.cumsum(new_key) - 1]
            after = np.minimum.accumulate(np.where(right, at, n)[::-1])[::-1]
            has_after = after < key_end
            after = np.minimum(after, n - 1)
            # rows of ended keys, and those before the last right row, are settled
            latest = before[-1] if has_before[-1] else key_start[-1]
            settled = n if final else latest
            pick = np.flatnonzero(~right[:settled])
            if len(pick):
                values = {
                    "__tm_bt": pa.array(t[before[pick]], mask=~has_before[pick]), "__tm_bid": pa.array(ident[before[pick]], mask=~has_before[pick]),
                    "__tm_ft": pa.array(t[after[pick]], mask=~has_after[pick]), "__tm_fid": pa.array(ident[after[pick]], mask=~has_after[pick]),
                }
                yield from rows(table, pick, 0, values).to_batches(max_chunksize=20_000)
            held = table.slice(latest)
        for edge in (first, last):
            if edge is not None:
                yield from edge.combine_chunks().to_batches()

    return run


def _with_end(batches, at_once: int):
    """Batches of at least ``at_once`` rows, then None."""
    some, n = [], 0
    for batch in batches:
        if batch.num_rows:
            some.append(batch)
            n += batch.num_rows
        if n >= at_once:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some, n = [], 0
    if some:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
    yield None


def prefix_max(parts: DataFrame, value: str, out: str, reverse: bool = False) -> DataFrame:
    """The maximum (``reverse``: the minimum, from the end) of ``value`` over all partitions before (after) each, null where there is none.

    Blocks of partitions are scanned side by side, then the blocks' totals, and the
    two are put together; nulls are skipped.
    """
    best = F.min if reverse else F.max
    past = (1, Window.unboundedFollowing) if reverse else (Window.unboundedPreceding, -1)
    block = F.floor(F.col(PID) / F.lit(BLOCK))
    rows = parts.withColumn("__tm_block", block)
    inner = best(value).over(Window.partitionBy("__tm_block").orderBy(PID).rowsBetween(*past))
    totals = rows.groupBy("__tm_block").agg(best(value).alias("__tm_total"))
    outer = best("__tm_total").over(Window.orderBy("__tm_block").rowsBetween(*past))
    carried = totals.select("__tm_block", outer.alias("__tm_outer"))
    both = F.least if reverse else F.greatest
    return rows.withColumn("__tm_inner", inner).join(carried, "__tm_block").withColumn(out, both("__tm_inner", "__tm_outer")).drop("__tm_block", "__tm_inner", "__tm_outer")


def nearest_by_time(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, left_id: str, right_time: str, right_id: str, tolerance: int | None = None, direction: str = "nearest",
) -> DataFrame:
    """For each left row, the right row of the same keys that is nearest in time, at most ``tolerance`` away (None: however far).

    ``direction`` 'nearest' looks both ways, 'backward' takes the last right row at or
    before the left row's time, 'forward' the first at or after it. Times and ids are
    BIGINT. Of equally near right rows the earlier counts, of those at one time the
    one with the smallest id. Result: keys, ``left_id``, ``right_id`` and ``distance``
    (right minus left), a row for each left row that has a partner, repeats included;
    ids need not be unique. Other columns of the inputs are ignored, whatever their
    names. Rows with a null in a key, a time or an id have no partner. Empty inputs
    give no rows.

    Both tables are range-partitioned together by (keys, time) with a final sort on
    the id, so a key may span any number of partitions, even one moment may. Each
    partition is scanned on its own; what a partition needs from others is the last
    right row before it and the first after it, which a prefix scan over one row per
    partition provides: ``MAX_PARTS`` rows at most, and these are broadcast. Only left
    rows leave the scan.
    """
    if direction not in ("nearest", "backward", "forward"):
        raise ValueError(f"no such direction: {direction}")
    def side(df: DataFrame, time: str, ident: str, tag: int) -> DataFrame:
        cols = [F.col(k).alias(f"__tm_k{i}") for i, k in enumerate(keys)]
        cols += [F.col(time).cast("long").alias(T_), F.col(ident).cast("long").alias(ID), F.lit(tag).alias(TAG)]
        return df.select(*cols).na.drop()

    ks = [f"__tm_k{i}" for i in range(len(keys))]
    both = side(left, left_time, left_id, LEFT).unionByName(side(right, right_time, right_id, RIGHT))
    order: list[Column | str] = [*ks, T_, TAG, ID]
    n_parts = part_count(both)
    ranged = both.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    longs = [T.StructField(c, T.LongType()) for c in ("__tm_bt", "__tm_bid", "__tm_ft", "__tm_fid")]
    schema = T.StructType([*both.schema.fields, *longs, T.StructField(KIND, T.IntegerType())])
    scanned, edges = written_apart(ranged.mapInArrow(_scan(len(keys)), schema).withColumn(PID, F.spark_partition_id()), "nearest", KIND)

    key = F.struct(*ks)
    edge = F.struct(key.alias("k"), F.col(T_).alias("t"), (-F.col(ID)).alias("nid"))
    edge_up = F.struct(key.alias("k"), F.col(T_).alias("t"), F.col(ID).alias("id"))
    parts = edges.groupBy(PID).agg(F.max(edge).alias("__tm_last"), F.min(edge_up).alias("__tm_next"))
    # a partition without right rows has no edge of its own, but may need others'
    parts = edges.sparkSession.range(n_parts).select(F.col("id").cast("int").alias(PID)).join(F.broadcast(parts), PID, "left")
    parts = prefix_max(parts, "__tm_last", "__tm_back")
    parts = prefix_max(parts, "__tm_next", "__tm_fwd", reverse=True).select(PID, "__tm_back", "__tm_fwd")

    rows = scanned.join(F.broadcast(parts), PID, "left")

    def candidate(t: Column, ident: Column, valid: Column) -> Column:
        if tolerance is not None:
            valid = valid & (F.abs(t - F.col(T_)) <= tolerance)
        if direction == "backward":
            valid = valid & (t <= F.col(T_))
        elif direction == "forward":
            valid = valid & (t >= F.col(T_))
        return F.when(valid, F.struct(F.abs(t - F.col(T_)).alias("d"), t.alias("t"), ident.alias("id")))

    near = F.array_min(
        F.array(
            candidate(F.col("__tm_bt"), F.col("__tm_bid"), F.col("__tm_bt").isNotNull()),
            candidate(F.col("__tm_ft"), F.col("__tm_fid"), F.col("__tm_ft").isNotNull()),
            candidate(F.col("__tm_back.t"), -F.col("__tm_back.nid"), F.col("__tm_back.k") == key),
            candidate(F.col("__tm_fwd.t"), F.col("__tm_fwd.id"), F.col("__tm_fwd.k") == key),
        )
    )
    return (
        rows.withColumn("__tm_near", near)
        .where("__tm_near IS NOT NULL")
        .select(
            *(F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)),
            F.col(ID).alias("left_id"),
            F.col("__tm_near.id").alias("right_id"),
            (F.col("__tm_near.t") - F.col(T_)).alias("distance"),
        )
    )
