"""Session factory and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}


def get_spark(app: str = "tidemark", **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC, AQE, Arrow."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Where the setting is absent a folder of this machine is used, but only when
    the driver and its executors are one process; a cluster without the setting
    is refused rather than given a folder that its executors cannot see.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL[app]


_WRITTEN: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, its rows are fixed.

    Unlike a cached frame the table outlives any executor. ``release`` removes it when
    the results that read it are no longer needed; at the latest it goes when the
    session's file system closes.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_apart(df: DataFrame, name: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """As ``written``, but the rows whose column ``kind`` is 0 and 1 as two tables, so that the few of one kind are read without the many of the other."""
    spark = df.sparkSession
    path = new_path(spark, name)
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "4")  # two open files a task, and rows stay in order
    try:
        df.write.partitionBy(kind).parquet(path)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    schema = T.StructType([f for f in df.schema.fields if f.name != kind])
    reader = spark.read.schema(schema).option("pathGlobFilter", "*.parquet")
    return tuple(reader.parquet(f"{path}/{kind}={k}") if _exists(spark, f"{path}/{kind}={k}") else spark.createDataFrame([], schema) for k in (0, 1))


def release(spark: SparkSession) -> None:
    """Removes the tables written for queries of this session so far; frames made before that read them can no longer be run."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables that ``df`` reads, by the planner; None if it cannot tell for one of them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(s >= 1 << 60 for s in sizes) else sum(sizes)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as there are cores, if it comes in fewer; for heavy work on single rows.

    A table of few files of one row group each is few tasks, however many cores are
    idle. One that comes in parts enough is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def task_count(spark: SparkSession) -> int:
    """Partitions for work that costs far more than its bytes, so that it is not packed into few tasks by size."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
