"""Readers and writers for bar and tick tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ("ts", "open", "high", "low", "close", "volume")
TIME_NAMES = ("date", "timestamp", "time", "datetime", "ts")


@dataclass(frozen=True)
class ObjectStore:
    """Connection settings of an S3-style store; credentials have no default."""

    endpoint: str
    access_key: str
    secret_key: str

    def options(self) -> dict[str, str]:
        local = any(h in self.endpoint for h in ("localhost", "127.0.0.1"))
        return {
            "fs.s3a.endpoint": self.endpoint, "fs.s3a.access.key": self.access_key, "fs.s3a.secret.key": self.secret_key,
            "fs.s3a.path.style.access": "true", "fs.s3a.connection.ssl.enabled": str(not local).lower(),
        }

    def apply(self, spark: SparkSession) -> None:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for key, value in self.options().items():
            conf.set(key, value)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A file or folder by its suffix: parquet, pq, orc, csv (with header), json (a row a line), xlsx and xls.

    CSV without a schema has its types inferred. Excel files are read whole by pandas, on
    the driver, and need its reader for them; they are small by their format.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if suffix in ("parquet", "pq"):
        return reader.parquet(path)
    if suffix == "orc":
        return reader.orc(path)
    if suffix == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None)
    if suffix == "json":
        return reader.json(path)
    if suffix in ("xlsx", "xls"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path.removeprefix("file://")), schema)
    raise ValueError(f"no reader for .{suffix}")


def read_indexed_json(spark: SparkSession, path: str, columns: str, index: str = "index") -> DataFrame:
    """A JSON object of rows by their index, ``{"0": {"open": 1, ...}, ...}``, one document a file: ``index`` (a string) and the ``columns`` of a schema like 'open double, close double'."""
    text = spark.read.text(path, wholetext=True)
    rows = F.explode(F.from_json("value", f"map<string, struct<{columns.replace(' ', ': ').replace(',:', ',')}>>"))
    return text.select(rows.alias(index, "__tm_row")).select(index, "__tm_row.*")


def ticker_ids(symbols: Sequence[str], spark: SparkSession) -> DataFrame:
    """(``ticker_id`` from 1, ``symbol``) in the order of a configuration."""
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(symbols)], "ticker_id int, symbol string")


def counted(df: DataFrame, name: str, **columns) -> tuple[DataFrame, Observation]:
    """``df`` with counters that are filled while any job runs over it, without a pass of their own: rows, and an aggregate for each of ``columns``."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in columns.items())), seen


def between(df: DataFrame, time: str, start=None, end=None) -> DataFrame:
    """Rows of [start, end); either bound may be missing. On a bare column this reaches the scan."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(time) < F.lit(end))
    return df


def in_years(df: DataFrame, time: str, first: int, last: int) -> DataFrame:
    """Rows of the years ``first`` to ``last``, both included, as a range that files and partitions can be pruned by."""
    kind = df.schema[time].dataType.simpleString()
    return df.where((F.col(time) >= F.lit(f"{first}-01-01").cast(kind)) & (F.col(time) < F.lit(f"{last + 1}-01-01").cast(kind)))


def load_bars(spark: SparkSession, root: str, symbols: Sequence[str] | None = None, interval: str | None = None, start=None, end=None) -> DataFrame:
    """Bars of a folder laid out as ``interval=/symbol=``; the partition columns prune folders, the range prunes row groups.

    Names are taken in any case; the first time column found becomes ``ts``, cut to
    seconds. A missing price column is an error.
    """
    df = spark.read.parquet(root)
    df = df.toDF(*(c.lower() for c in df.columns))
    if interval is not None:
        df = df.where(F.col("interval") == interval)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(*symbols))
    time = next((c for c in TIME_NAMES if c in df.columns), None)
    missing = [c for c in BAR_COLUMNS[1:5] if c not in df.columns]
    if time is None or missing:
        raise ValueError(f"bars lack columns: {missing or ['ts']}")
    df = between(df, time, start, end)
    return df.withColumn("ts", F.date_trunc("second", time).cast("timestamp_ntz")).drop(*([time] if time != "ts" else []))


def write_bars(bars: DataFrame, root: str, mode: str = "append") -> None:
    """Bars as Parquet by interval and symbol; a hot symbol is several files, not one task."""
    bars.write.mode(mode).option("maxRecordsPerFile", 5_000_000).partitionBy("interval", "symbol").parquet(root)


def append_fills(fills: DataFrame, path: str) -> None:
    """Journal of fills (ts, side, price, target_position), appended."""
    fills.select("ts", "side", "price", "target_position").write.mode("append").parquet(path)
