"""Structured Streaming twins of the batch bar operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BAR_SCHEMA = "ticker string, bucket_us long, open double, high double, low double, close double, volume double, n_trades long, synthetic boolean"
STATE_SCHEMA = "bucket long, open double, high double, low double, close double, volume double, n long, booted boolean, received long, late long, invalid long, emitted long, synthetic long, boot long, large_gaps long"
COUNTERS = ("received", "late", "invalid", "emitted", "synthetic", "boot", "large_gaps")


def _aggregate(interval_s: int, fill_gaps: bool, max_gap: int, discard_boot: bool, counters: bool = False):
    step = interval_s * 1_000_000

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        trades = pd.concat(list(frames)).sort_values("seq", kind="stable")
        bucket, o, h, low, c, v, n, booted, received, late, invalid, *made_of = state.get if state.exists else (None, *[0.0] * 5, 0, False, *[0] * 7)
        good = trades.ok.to_numpy(dtype=bool)
        received, invalid = received + int(good.sum()), invalid + int((~good).sum())
        t, price, size = (trades[x].to_numpy()[good] for x in ("timestamp_us", "price", "size"))
        t = t.astype(np.int64)
        at = t - t % step
        reached = np.maximum.accumulate(np.append(at[:1] if bucket is None else bucket, at))[:-1]
        kept = at >= reached
        late += int((~kept).sum())
        at, price, size = at[kept], price[kept].astype(float), size[kept].astype(float)
        if not len(at):
            state.update((bucket, o, h, low, c, v, n, booted, received, late, invalid, *made_of))
            if counters:
                yield pd.DataFrame([(key[0], received, late, invalid, *made_of)], columns=["ticker", *COUNTERS])
            return
        # what is kept is in order of buckets: one bar for each, the open one first
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(begin[1:], len(at)) - 1
        bars = {
            "bucket_us": at[begin], "open": price[begin], "high": np.fmax.reduceat(price, begin), "low": np.fmin.reduceat(price, begin), "close": price[last],
            "volume": np.add.reduceat(size, begin), "n_trades": last - begin + 1,
        }
        if bucket is not None:
            held = {"bucket_us": bucket, "open": o, "high": h, "low": low, "close": c, "volume": v, "n_trades": n}
            if at[0] == bucket:
                bars["open"][0], bars["high"][0], bars["low"][0] = o, np.fmax(h, bars["high"][0]), np.fmin(low, bars["low"][0])
                bars["volume"][0] += v
                bars["n_trades"][0] += n
            else:
                bars = {k: np.append(held[k], x) for k, x in bars.items()}
        out = pd.DataFrame(bars)
        open_bar, closed = out.iloc[-1], out.iloc[:-1].assign(synthetic=False)
        missing = np.diff(out.bucket_us.to_numpy()) // step - 1
        filled = np.where((missing >= 1) & (missing <= max_gap) & fill_gaps, missing, 0)
        if len(closed):
            own = closed if booted or not discard_boot else closed.iloc[1:]
            gaps = closed.loc[np.repeat(closed.index.to_numpy(), filled)]
            nth = np.arange(len(gaps)) - np.repeat(np.cumsum(filled) - filled, filled) + 1
            gaps = gaps.assign(bucket_us=gaps.bucket_us + nth * step, open=gaps.close, high=gaps.close, low=gaps.close, volume=0.0, n_trades=0, synthetic=True)
            made = pd.concat([own, gaps]).sort_values("bucket_us", kind="stable")
            booted = True
            new = (len(made), int(filled.sum()), len(closed) - len(own), int((missing > max_gap).sum()) if fill_gaps else 0)
            made_of = [a + b for a, b in zip(made_of, new, strict=True)]
        state.update((int(open_bar.bucket_us), *(float(open_bar[k]) for k in ("open", "high", "low", "close", "volume")), int(open_bar.n_trades), booted, received, late, invalid, *made_of))
        if counters:
            yield pd.DataFrame([(key[0], received, late, invalid, *made_of)], columns=["ticker", *COUNTERS])
        elif len(closed) and len(made):
            made.insert(0, "ticker", key[0])
            yield made

    return update


def stream_bars(trades: DataFrame, interval_s: int = 60, fill_gaps: bool = True, max_gap: int = 120, discard_boot: bool = True) -> DataFrame:
    """Bars from a stream of trades (ticker, seq, timestamp_us, price, size), by the rules of ``live_bars``.

    The clock is the trades' own time: a bar is emitted when a trade of a later bucket
    arrives, and a trade of an earlier bucket is late. State is one open bar per ticker.
    Within a micro-batch trades are taken by ``seq``, and reduced to bars at once; batches
    must arrive in its order. As in batch, a null price or size is invalid and a NaN one is
    not, but has no part in high and low.
    """
    fn = _aggregate(interval_s, fill_gaps, max_gap, discard_boot)
    bars = _checked(trades).groupBy("ticker").applyInPandasWithState(fn, BAR_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    # pandas has one sign for NaN and null: an open, close or volume of a bar is never missing
    nan = F.lit(float("nan"))
    whole = {c: F.coalesce(c, nan) for c in ("open", "close", "volume")}
    return bars.withColumns(whole | {c: F.when(F.col("synthetic"), F.coalesce(c, nan)).otherwise(F.col(c)) for c in ("high", "low")})


def _checked(trades: DataFrame) -> DataFrame:
    ok = F.coalesce((F.col("price") > 0) & (F.col("size") > 0) & F.col("timestamp_us").isNotNull() & F.col("seq").isNotNull(), F.lit(False))
    return trades.select("ticker", "seq", F.coalesce("timestamp_us", F.lit(0)).alias("timestamp_us"), "price", "size", ok.alias("ok"))


def stream_counters(trades: DataFrame, interval_s: int = 60, fill_gaps: bool = True, max_gap: int = 120, discard_boot: bool = True) -> DataFrame:
    """What ``stream_bars`` counts, a row for each ticker of a micro-batch with its counters so far; the streaming twin of ``live_counters``. Output mode 'update'."""
    fn = _aggregate(interval_s, fill_gaps, max_gap, discard_boot, counters=True)
    schema = "ticker string, " + ", ".join(f"{c} long" for c in COUNTERS)
    return _checked(trades).groupBy("ticker").applyInPandasWithState(fn, schema, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)


def _cross(fast: int, slow: int):
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(frames)).sort_values("bucket_us", kind="stable")
        before = np.array(state.get[0] if state.exists else [], dtype=float)
        closes = np.append(before, bars.close.to_numpy(dtype=float))
        out = None
        if len(closes) >= slow:
            means = {n: np.lib.stride_tricks.sliding_window_view(closes, n).mean(axis=1)[-(len(closes) - slow + 1) :] for n in (fast, slow)}
            target = np.where(means[fast] > means[slow], 1, -1)[-len(bars) :]
            out = pd.DataFrame({"ticker": key[0], "bucket_us": bars.bucket_us.to_numpy()[-len(target) :], "target": target})
        closes = closes[-(slow - 1) :].tolist() if slow > 1 else []
        state.update((closes,))
        if out is not None:
            yield out

    return update


def stream_sma_cross(bars: DataFrame, fast: int = 10, slow: int = 40) -> DataFrame:
    """Target +1 or -1 for each bar of a stream once ``slow`` closes are known; a tie is -1. State is those closes."""
    slim = bars.select("ticker", "bucket_us", "close")
    return slim.groupBy("ticker").applyInPandasWithState(_cross(fast, slow), "ticker string, bucket_us long, target int", "closes array<double>", "append", GroupStateTimeout.NoTimeout)


def watermarked_bars(trades: DataFrame, interval: str = "1 minute", lateness: str = "2 minutes") -> DataFrame:
    """Bars by watermark: what arrives within ``lateness`` still counts, and a bar is emitted when the watermark passes it; no Python."""
    timed = trades.where("price > 0 AND size > 0").withColumn("time", F.timestamp_micros("timestamp_us")).withWatermark("time", lateness)
    return timed.groupBy("ticker", F.window("time", interval).alias("w")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n_trades"),
    ).select("ticker", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume", "n_trades")


def write_ticks(ticks: DataFrame, path: str, checkpoint: str):
    """Starts the tick sink: a stream of ticks appended to Parquet files by ``ticker`` and ``kind``; a restart goes on from the checkpoint."""
    writer = ticks.writeStream.format("parquet").partitionBy("ticker", "kind").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def read_ticks(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """A stream of the ticks (or book updates) that appear as Parquet files under ``path``, with the ``ticker`` and ``kind`` of their folders if the schema names them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "false").parquet(path)
