"""Matching records of several tables with the nearest record in time of another."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.nearest import nearest_by_time


def match_nearest(wanted: Mapping[str, tuple[DataFrame, str, str]], records: DataFrame, keys: Sequence[str], time: str, ident: str, tolerance: int | None = None, direction: str = "nearest") -> DataFrame:
    """For each row of the ``wanted`` tables, given by name as (table, time, id), the record of the same keys nearest in time.

    Result: ``feed`` (the name), ``row_id``, ``record_id`` and ``distance`` in time (record
    minus row), a row for each wanted row with a record at most ``tolerance`` away (None:
    however far), repeats included. Of equally near records the earlier counts, of those
    at one time the one with the smallest id. Rows with a null in a key, a time or an id
    have no partner. Columns of other names are ignored, and empty tables give no rows.

    All tables are range-partitioned together by entity and time, in one pass however
    many are wanted, and scanned partition by partition; the records at the edges of
    partitions come by a prefix scan (``nearest_by_time``). An entity may exceed any task.
    """
    names = list(wanted)
    packed = None
    for n, (df, at, row) in enumerate(wanted.values()):
        # the id carries its table
        part = df.select(*keys, F.col(at).cast("long").alias("__tm_at"), (F.col(row).cast("long") * len(names) + n).alias("__tm_row"))
        packed = part if packed is None else packed.unionByName(part)
    near = nearest_by_time(packed, records, keys, "__tm_at", "__tm_row", time, ident, tolerance, direction)
    which = F.pmod("left_id", F.lit(len(names)))
    feed = F.coalesce(*(F.when(which == n, F.lit(name)) for n, name in enumerate(names)))
    return near.select(feed.alias("feed"), F.expr(f"(left_id - pmod(left_id, {len(names)})) div {len(names)}").alias("row_id"), F.col("right_id").alias("record_id"), "distance")
