"""Rebuilding a table's state from a feed of inserts, updates and deletes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

INSERT, UPDATE, DELETE = 0, 1, 2


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def apply_changes(feed: DataFrame, slot: Sequence[str], order: Sequence[str], seq: str, op: str, fields: Sequence[str]) -> DataFrame:
    """The state each slot has after all changes: one row for each slot that holds something.

    Changes of one slot take effect by ``order``, then ``seq``. A delete empties the
    slot; an insert replaces it, so fields it leaves null are null; an update sets
    the fields it gives and keeps the others, and on an empty slot acts as an insert
    of those fields. Rows equal in every column of ``feed`` but ``seq`` are one change,
    the one with the smallest ``seq``. Columns beside those named take part in that
    comparison only; drop them beforehand if they should not.

    Result: the slot columns, ``fields``, and ``seq`` of the change that set the slot.
    Null slot values form slots of their own; a null in ``order`` sorts first; rows
    whose ``op`` is null or unknown, or whose ``seq`` is null, are no changes. An
    empty feed gives no rows.

    Last writer wins by column: for a field the latest change that gives it a value
    counts, unless the slot was emptied or replaced after it. Both sides of that
    comparison are maxima, so one aggregation does it, with partial results on the
    map side; no slot, however hot, is gathered or sorted.
    """
    cols = [c for c in feed.columns if c != seq]
    named = ", ".join(_ident(c) for c in cols)
    slots = ", ".join(_ident(c) for c in slot)
    at = "struct(" + ", ".join([*(_ident(c) for c in order), "__tm_seq"]) + ")"
    o = _ident(op)
    parts = [
        f"max({at}) FILTER (WHERE {o} = {DELETE}) AS __tm_gone",
        f"max({at}) FILTER (WHERE {o} IN ({INSERT}, {DELETE})) AS __tm_reset",
        f"max({at}) FILTER (WHERE {o} IN ({INSERT}, {UPDATE})) AS __tm_set",
    ]
    for k, f in enumerate(fields):
        parts.append(f"max(struct({at} AS at, {_ident(f)} AS v)) FILTER (WHERE {o} IN ({INSERT}, {UPDATE}) AND {_ident(f)} IS NOT NULL) AS __tm_f{k}")
    values = [f"CASE WHEN __tm_reset IS NULL OR __tm_f{k}.at >= __tm_reset THEN __tm_f{k}.v END AS {_ident(f)}" for k, f in enumerate(fields)]
    query = f"""
        WITH changes AS (
            SELECT {named}, min({_ident(seq)}) AS __tm_seq
            FROM {{feed}}
            WHERE {o} IN ({INSERT}, {UPDATE}, {DELETE}) AND {_ident(seq)} IS NOT NULL
            GROUP BY {named}
        ), state AS (
            SELECT {slots}, {", ".join(parts)} FROM changes GROUP BY {slots}
        )
        SELECT {", ".join([slots, *values, f"__tm_set.__tm_seq AS {_ident(seq)}"])}
        FROM state
        WHERE __tm_set IS NOT NULL AND (__tm_gone IS NULL OR __tm_set > __tm_gone)
    """
    return feed.sparkSession.sql(query, feed=feed)
