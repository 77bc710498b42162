"""Binary messages to columns and back, a batch at a time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Version and layouts of the protocol, little-endian without padding but as named.
PROTOCOL_VERSION = 3


@dataclass(frozen=True)
class Layout:
    """A message: field names with NumPy types in order, its size, and whether its first byte is the version."""

    name: str
    fields: tuple[tuple[str, str], ...]
    versioned: bool = True

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(([("version", "u1"), ("_pad", "V3")] if self.versioned else []) + list(self.fields))

    @property
    def schema(self) -> str:
        kinds = {"<f8": "double", "<i8": "long", "<i4": "int", "<u4": "long"}
        return ", ".join(f"{n} {kinds[t]}" for n, t in self.fields)


TRADE = Layout("trade", (("timestamp_us", "<i8"), ("price", "<f8"), ("size", "<i4"), ("ticker_id", "<i4")))
DEPTH = Layout("depth", (("timestamp", "<i8"), ("price", "<f8"), ("position", "<i4"), ("operation", "<i4"), ("side", "<i4"), ("size", "<i4")), versioned=False)
EXECUTION = Layout("execution", (("price", "<f8"), ("ticker_id", "<i4"), ("order_id", "<i4"), ("status", "<i4"), ("filled", "<i4"), ("remaining", "<i4")))
POSITION = Layout("position", (("ticker_id", "<i4"), ("position", "<i4"), ("average_cost", "<f8")))
TARGET = Layout("target", (("limit_price", "<f8"), ("ticker_id", "<i4"), ("target", "<i4"), ("order_type", "<i4"), ("strategy_id", "<i4")))
HEARTBEAT = Layout("heartbeat", (("seq", "<u4"), ("timestamp_us", "<i8")))
#: Fixed value: the order type of a limit order, which needs a price above 0.
LIMIT_ORDER = 2
LAYOUTS = {x.name: x for x in (TRADE, DEPTH, EXECUTION, POSITION, TARGET, HEARTBEAT)}


def decode(messages: DataFrame, column: str, layout: Layout, errors: str = "raise") -> DataFrame:
    """Columns of the other fields, then those of the message; ``errors`` 'drop' leaves out messages of a wrong size or version, 'raise' fails on them. Null messages are left out."""
    others = [c for c in messages.columns if c != column]
    size = layout.dtype.itemsize

    def run(batches):
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
            known = np.asarray(raw.is_valid())
            good = known & (np.diff(offsets) == size)
            if layout.versioned:
                at = np.flatnonzero(good)
                good[at] = data[offsets[at]] == PROTOCOL_VERSION
            if errors == "raise" and (known & ~good).any():
                raise ValueError(f"not a {layout.name} message of {size} bytes, version {PROTOCOL_VERSION}")
            rows = data[offsets[:-1][good][:, None] + np.arange(size)].reshape(-1).view(layout.dtype)
            kept = batch.filter(pa.array(good))
            cols = [kept.column(kept.schema.get_field_index(c)) for c in others]
            cols += [pa.array(rows[n].astype(np.int64) if t == "<u4" else np.ascontiguousarray(rows[n])) for n, t in layout.fields]
            yield pa.RecordBatch.from_arrays(cols, names=[*others, *(n for n, _ in layout.fields)])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema.fields if f.name != column]
    return messages.mapInArrow(run, ", ".join([*kinds, layout.schema]))


def encode(df: DataFrame, layout: Layout, out: str = "message") -> DataFrame:
    """``df`` with the message made of its columns of the layout's names; a row with a null among them gets a null message. A limit order without a price above 0 raises."""
    names = [n for n, _ in layout.fields]
    if layout is TARGET:
        wrong = (F.col("order_type") == LIMIT_ORDER) & ~F.coalesce(F.col("limit_price") > 0, F.lit(False))
        df = df.withColumn("order_type", F.when(wrong, F.raise_error(F.lit("a limit order needs a price above 0")).cast("int")).otherwise(F.col("order_type")))

    def run(batches):
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            rows = np.zeros(batch.num_rows, dtype=layout.dtype)
            if layout.versioned:
                rows["version"] = PROTOCOL_VERSION
            known = np.ones(batch.num_rows, dtype=bool)
            for (n, t), c in zip(layout.fields, cols, strict=True):
                known &= np.asarray(c.is_valid())
                rows[n] = np.asarray(c.fill_null(0)).astype(t)
            whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(layout.dtype.itemsize), len(rows), [None, pa.py_buffer(rows.tobytes())])
            made = pa.compute.if_else(pa.array(known), whole, None).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInArrow(run, ", ".join([*kinds, f"{out} binary"]))
