"""Where operators cut lineage: tables and files in the cluster's shared folder.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset
(tests on one machine) a temporary folder is chosen and set.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    option = spark.sparkContext._jsc.sc().getCheckpointDir()
    if option.isDefined():
        return option.get().rstrip("/")
    base = "file://" + tempfile.mkdtemp(prefix="tidemill-")
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


_made: list[str] = []
_tables: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; nothing exists there yet."""
    _made.append(f"{shared_folder(spark)}/tidemill/{name}-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files: once it is in the shared folder, nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back with the same schema."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.mode("overwrite")
    with _shuffles_removed(spark):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, rows: int = 0, target_bytes: int = 64 << 20, target_rows: int = 4 << 20) -> int:
    """How many partitions to deal df's rows to: the session's number, or more if that many would be too large.

    rows: how many rows will be dealt, if that does not follow from df's size.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = -(-size // target_bytes) if size < 1 << 60 else 0  # Spark's word for "unknown" is larger
    return max(n, by_size, -(-rows // target_rows))


def sorted_run(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """Writes df in the shared folder as a table in ``buckets`` by the keys, each sorted by them.

    Joins on the keys with another such table, or with rows dealt to as many
    partitions by the keys, read it without a shuffle.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    table = "tidemill_" + path.rsplit("/", 1)[1].replace("-", "_")
    with _shuffles_removed(spark):
        df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    _tables.append(table)
    return spark.table(table)


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that this process has made in the shared folder. DataFrames that read from it can't be used any more."""
    while _tables:
        spark.sql(f"drop table if exists {_tables.pop()}")
    while _made:
        remove(spark, _made.pop())
