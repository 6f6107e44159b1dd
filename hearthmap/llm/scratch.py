"""Tables that a job writes to the cluster's shared folder and drops when it no longer reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthmap.session import new_shared_path


# Bytes of a batch of rows on its way to a Python worker; two of them wait on either side of each task.
BATCH_BYTES = 4_000_000


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of a few MB (its default is 64 MB).

    Workers cut batches to steps anyhow; larger ones only fill memory beside the heap.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))


def drop_shuffles(spark: SparkSession) -> None:
    """From now on the session's shuffle files go when their query has ended.

    Else they stay until the driver happens to collect its garbage.  What is read again is written.
    """
    for key in ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled"):
        spark.conf.set(key, "true")


class Scratch:
    """Written intermediate tables of one operator call.

    Writing cuts lineage durably: an executor can be lost at any time, and nothing is computed twice.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, str] = {}
        drop_shuffles(spark)

    def write(self, df: DataFrame, **options: str) -> DataFrame:
        path = new_shared_path(self.spark, "llm")
        df.write.options(**options).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no plan reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(table)))
            path.getFileSystem(conf).delete(path, True)

    def keep(self, *tables: DataFrame) -> None:
        """Delete every table written so far but these, which the caller still holds."""
        kept = {id(t) for t in tables}
        paths = [p for key, p in self._paths.items() if key not in kept]
        self._paths = {key: p for key, p in self._paths.items() if key in kept}
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in map(jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(conf).delete(path, True)
