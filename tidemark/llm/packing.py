"""Filling windows of fixed capacity with documents."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import new_run
from tidemark.session import dealt, task_count, written

#: Tokens a lane is meant to hold: windows are filled lane by lane, each lane in one task.
LANE_TOKENS = 20_000_000


def default_vocabulary() -> str:
    """The installed public vocabulary that covers many languages."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, ident: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(``ident``, ``n_tokens``) of each row whose text has tokens; null and empty texts have none. Special tokens in a text are ordinary text."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        encoding = _encoding(path)
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["__tm_id", "n_tokens"])

    kind = df.schema[ident].dataType.simpleString()
    slim = df.select(F.col(ident).alias("__tm_id"), F.col(text).alias("__tm_text")).where("__tm_text IS NOT NULL")
    return dealt(slim).mapInArrow(run, f"__tm_id {kind}, n_tokens long").where("n_tokens > 0")


class SumOfSquares:
    """Online packing into windows of one capacity by the sum-of-squares rule.

    ``level[h]`` counts the windows filled up to ``h``, for 0 < h < capacity. An item
    goes to the level at which the sum of the squared counts is smallest afterwards;
    a new window is level 0. Of equal choices the fullest window is taken.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.windows = 0

    def place(self, size: int) -> tuple[int, int]:
        """Window and offset at which an item of ``size`` goes, 0 < size <= capacity."""
        room = self.capacity - size
        level = self.level[: room + 1]
        change = 2 * self.level[size : size + room + 1] - 2 * level + 2
        change[0] = 2 * self.level[size] + 1
        if room:
            change[room] = 1 - 2 * level[room]  # the window is full then and counts no more
        else:
            change[0] = 0
        change[1:][level[1:] == 0] = np.iinfo(np.int64).max
        at = room - int(np.argmin(change[::-1]))
        if at:
            window = self.open[at].pop()
            self.level[at] -= 1
        else:
            window = self.windows
            self.windows += 1
        if at + size < self.capacity:
            self.level[at + size] += 1
        self.open[at + size].append(window)
        return window, at

    def fills(self) -> np.ndarray:
        """How far each window is filled."""
        out = np.zeros(self.windows, dtype=np.int64)
        for fill, windows in enumerate(self.open):
            out[windows] = fill
        return out


def _pack(capacity: int, turn: int):
    def packed(table: pa.Table) -> pa.RecordBatch:
        lane = table.column("lane")[0].as_py()
        packer = SumOfSquares(capacity)
        placed = np.array([packer.place(s) for s in table.column("n_tokens").to_pylist()], dtype=np.int64).reshape(-1, 2)
        fill = packer.fills()[placed[:, 0]]
        number = (np.int64(turn) << 60) + (np.int64(lane) << 32) + placed[:, 0]
        cols = [table.column(c).combine_chunks() for c in ("__tm_id", "piece", "start_token", "n_tokens")]
        out = pa.table([*cols, pa.array(number), pa.array(placed[:, 1]), pa.array(fill)], names=["__tm_id", "piece", "start_token", "n_tokens", "container", "position", "filled"])
        return out.combine_chunks().to_batches()[0]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            starts = np.flatnonzero(new_run([table.column("lane")]))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield packed(table.slice(a, b - a))
            held = table.slice(starts[-1]).to_batches()
        if held:
            yield packed(pa.Table.from_batches(held))

    return run


def _turn(items: DataFrame, capacity: int, turn: int, lane_tokens: int) -> DataFrame:
    total = items.agg(F.sum("n_tokens")).first()[0] or 0
    lanes = max(1, -(-int(total) // lane_tokens))
    kind = items.schema["__tm_id"].dataType.simpleString()
    dealt = items.withColumn("lane", F.pmod(F.xxhash64("__tm_id", "piece", F.lit(turn)), F.lit(lanes)))
    tasks = dealt.repartition(min(lanes, max(task_count(items.sparkSession), lanes // 64)), "lane").sortWithinPartitions("lane", "__tm_id", "piece", "n_tokens")
    schema = f"__tm_id {kind}, piece int, start_token long, n_tokens long, container long, position long, filled long"
    return written(tasks.mapInArrow(_pack(capacity, turn), schema), "packed")


def pack_documents(
    documents: DataFrame, ident: str = "doc_id", text: str = "text", capacity: int = 2048, vocabulary: str | None = None, slack: int = 8, lane_tokens: int = LANE_TOKENS,
) -> DataFrame:
    """Where each document goes: a row per document, or per piece of one longer than ``capacity``.

    Result: ``ident``, ``piece`` (from 0), ``start_token`` (of the piece in its text),
    ``n_tokens``, ``container``, ``position`` (of its first token in the container),
    ``filled`` (tokens in that container). A document is split only if it alone
    exceeds the capacity: into pieces of exactly ``capacity`` and a rest that is packed
    like any other. Texts that are null, empty or without tokens take no room and give
    no row. Rows with equal or null ids are items of their own. An empty table gives
    no rows.

    Items are dealt evenly to lanes by a hash, a lane holding ``lane_tokens`` tokens
    whatever the size of the corpus; sum-of-squares packing runs lane by lane. What a
    lane leaves in windows with more than ``slack`` tokens of room goes through a second
    turn, dealt to as few lanes as its tokens need. The result does not depend on how
    the cluster is divided.
    """
    sizes = token_counts(documents, ident, text, vocabulary)
    cap = F.lit(capacity).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, cap)
    pieces = sizes.select("__tm_id", F.col("n_tokens").alias("__tm_all"), F.posexplode(starts).alias("piece", "start_token"))
    items = written(pieces.select("__tm_id", "piece", "start_token", F.least(cap, F.col("__tm_all") - F.col("start_token")).alias("n_tokens")), "items")
    first = _turn(items, capacity, 0, lane_tokens)
    again = F.col("filled") < capacity - slack
    second = _turn(first.where(again).select(*items.columns), capacity, 1, lane_tokens)
    return first.where(~again).unionByName(second).withColumnRenamed("__tm_id", ident)
