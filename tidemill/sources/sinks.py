"""Sinks for stored and streaming tables. Every streaming query needs a checkpoint folder of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.routing import latest
from ..schemas import SUMMARIES, struct_of


def kafka_sink(rows: DataFrame, servers: str, checkpoint: str, topic: str | None = None) -> StreamingQuery:
    """JSON text (value) to one topic, or to the topic that each row names."""
    writer = rows.select(*(["topic"] if topic is None else []), "value").writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return (writer.option("topic", topic) if topic else writer).option("checkpointLocation", checkpoint).outputMode("append").start()


def in_sink_order(rows: DataFrame, table: str) -> DataFrame:
    """The columns of a summary table in the sink's order, cast to its types; columns it lacks are left out, missing ones are null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct_of(table)])


def append_summary(rows: DataFrame, table: str, path: str, batch: int | None = None) -> None:
    """Adds rows to a summary table, partitioned by the day of their window's start.

    With a batch number, the rows that the batch wrote before are replaced, so
    that a repeated batch adds nothing twice.
    """
    if table not in SUMMARIES:
        raise KeyError(table)
    out = in_sink_order(rows, table).withColumn("day", F.substring("stt", 1, 10))
    if batch is None:
        out.write.mode("append").partitionBy("day").parquet(path)
    else:
        put_batch(out, path, batch, ["day"])


def put_batch(rows: DataFrame, path: str, batch: int, by: list[str]) -> None:
    """Writes a micro-batch's rows in partitions of their own; a repeated batch replaces them."""
    writer = rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by, "batch").parquet(path)


def jdbc_summary(rows: DataFrame, table: str, url: str, batch_rows: int = 10_000, **options: str) -> None:
    """Inserts rows in a database's summary table, in the sink's order and in batches of statements."""
    if table not in SUMMARIES:
        raise KeyError(table)
    in_sink_order(rows, table).write.mode("append").jdbc(url, table, properties={"batchsize": str(batch_rows), **options})


def upsert_dimension(changes: DataFrame, path: str, key: str = "id", order: list[str] | None = None) -> None:
    """Merges changes into a dimension kept as versioned folders under path; readers take ``current``.

    A table cannot be overwritten while it is read, so the new version is
    written beside it; of older versions one is kept for those who still read
    it. Changes with a null key carry nothing and are left out.
    """
    spark = changes.sparkSession
    before = current(spark, path)
    new = latest(changes.where(F.col(key).isNotNull()), [key], order or [key])
    if before is None:
        version, out = 0, new
    else:
        version, held = before
        out = held.join(new.select(key), key, "left_anti").select(*held.columns).unionByName(new.select(*held.columns))
        version += 1
    out.write.mode("overwrite").parquet(f"{path}/v{version:09d}")
    if version > 1:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{version - 2:09d}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


def current(spark, path: str) -> tuple[int, DataFrame] | None:
    """The last whole version of a dimension and its number."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    whole = [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return (int(max(whole)[1:]), spark.read.parquet(f"{path}/{max(whole)}")) if whole else None


def console(rows: DataFrame, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("console").option("checkpointLocation", checkpoint).start()


def daily_log(rows: DataFrame, path: str) -> None:
    """Raw text by day, one line a row; rows: day, value."""
    rows.select("day", "value").write.mode("append").partitionBy("day").text(path)
