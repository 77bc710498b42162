"""Seeded synthetic bars and trades for benchmarks and demonstrations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def synthetic_bars(spark: SparkSession, n: int, seed: int = 0, symbols: int = 1) -> DataFrame:
    """One-minute random-walk bars; each symbol is drawn in its own task from ``seed`` plus its number."""

    def draw(batches):
        for batch in batches:
            for k in batch["id"]:
                rng = np.random.default_rng(seed + int(k))
                close = 100 + np.cumsum(rng.normal(0, 0.05, n))
                opened = np.concatenate([[100.0], close[:-1]])
                wick = np.abs(rng.normal(0, 0.02, (2, n)))
                yield pd.DataFrame(
                    {
                        "symbol": f"S{k:04d}", "ts": pd.date_range("2024-01-01", periods=n, freq="min"), "seq": np.arange(n), "open": opened,
                        "high": np.maximum(opened, close) + wick[0], "low": np.minimum(opened, close) - wick[1], "close": close,
                        "volume": rng.integers(100, 10_000, n).astype(float),
                    }
                )

    ids = spark.range(0, symbols, 1, min(symbols, 200))
    return ids.mapInPandas(draw, "symbol string, ts timestamp_ntz, seq long, open double, high double, low double, close double, volume double")


def synthetic_trades(spark: SparkSession, minutes: int = 2000, per_minute: int = 5, seed: int = 7) -> DataFrame:
    """A seeded walk of trades, evenly spread over each minute from 2024-01-01."""
    rng = np.random.default_rng(seed)
    n = minutes * per_minute
    price = np.maximum(100 + np.cumsum(rng.normal(0, 0.02, n)), 0.01)
    start = 1_704_067_200_000_000
    times = start + np.arange(n) * (60_000_000 // per_minute)
    return spark.createDataFrame(pd.DataFrame({"ticker": "DEMO", "seq": np.arange(n), "timestamp_us": times, "price": price, "size": rng.integers(1, 10, n).astype(float)}))
