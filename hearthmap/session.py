"""Session helpers: defaults for local runs, durable materialisation, sizing."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "hearthmap", **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Durable folder every executor can read: the session's checkpoint folder, else its warehouse.

    This application's tables lie in a folder of their own below it, which Spark's file system drops
    when the application ends.
    """
    context = spark.sparkContext
    if context.applicationId not in _folders:
        base = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        base = base or spark.conf.get("spark.sql.warehouse.dir")
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/hearthmap-{uuid.uuid4().hex}")
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
        _folders[context.applicationId] = folder.toString()
    return _folders[context.applicationId]


# By application: the folder of its written tables.
_folders: dict[str, str] = {}


def new_shared_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder for a table written by a job."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Cuts lineage durably (an executor can be lost at any time) and computes the input exactly once;
    unlike an RDD checkpoint the table keeps column pruning, filter pushdown and size statistics.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_all(*frames: DataFrame) -> list[DataFrame]:
    """Write independent inputs at the same time."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(materialise, frames))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def size_in_bytes(table: DataFrame) -> int:
    """Size of a written table's files, from the planner's statistics."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
