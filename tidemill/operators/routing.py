"""Change records: envelopes, routing by configuration, column whitelists, dimension upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import SINK_DIMENSION, SINK_FACT


def operation(op: Column | str, read_as_insert: bool = False) -> Column:
    """create is called insert, other operations by their lower-case names; a snapshot's read can pass as insert."""
    name = F.lower(F.col(op) if isinstance(op, str) else op)
    inserts = ["create", "read"] if read_as_insert else ["create"]
    return F.when(name.isin(inserts), "insert").otherwise(name)


def envelope(records: DataFrame, topic: str = "topic", op: str = "op", before: str = "before", after: str = "after", read_as_insert: bool = False) -> DataFrame:
    """Change records as {database, table, type, data, before-data}; topic: server.database.table; images are maps, {} where missing."""
    parts = F.split(topic, r"\.")
    empty = F.expr("cast(map() as map<string,string>)")
    return records.select(
        F.get(parts, F.lit(1)).alias("database"), F.get(parts, F.lit(2)).alias("table"), operation(op, read_as_insert).alias("type"),
        F.coalesce(after, empty).alias("data"), F.coalesce(before, empty).alias("before-data"),
    )


def nonempty(rows: DataFrame, payload: str = "data") -> DataFrame:
    """Rows whose payload, as text, has a length; ``{}`` passes."""
    return rows.where(F.length(payload) > 0)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; combined before the shuffle."""
    last = F.max_by(F.struct("*"), F.struct(*order)).alias("_row")
    return rows.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(last).select("_row.*")


def whitelist(data: Column | str, columns: Column | str) -> Column:
    """The entries of a map whose keys the comma-divided list names, to the letter."""
    names = F.split(columns, ",")
    return F.map_filter(data, lambda k, _: F.array_contains(names, k))


def routed(changes: DataFrame, config: DataFrame) -> DataFrame:
    """Changes with sink_type, sink_table and sink_pk, payload cut to the configured columns; those without a route are dropped.

    The configuration has a row for each (source_table, operate_type); Spark
    broadcasts it if its size allows.
    """
    own = config.select("source_table", "operate_type", "sink_type", "sink_table", "sink_columns", "sink_pk")
    hit = changes.join(own, (F.col("table") == F.col("source_table")) & (F.col("type") == F.col("operate_type")))
    return hit.withColumn("data", whitelist("data", "sink_columns")).drop("source_table", "operate_type", "sink_columns")


def facts(routes: DataFrame) -> DataFrame:
    return routes.where(F.col("sink_type") == SINK_FACT)


def dimensions(routes: DataFrame) -> DataFrame:
    return routes.where(F.col("sink_type") == SINK_DIMENSION)


def config_conflicts(config: DataFrame) -> DataFrame:
    """Keys that the configuration holds more than once."""
    return config.groupBy("source_table", "operate_type").count().where("count > 1")


def checked(config: DataFrame) -> DataFrame:
    """The configuration, if its key (source_table, operate_type) is one."""
    if conflicts := config_conflicts(config).select("source_table", "operate_type").limit(5).collect():
        raise ValueError(f"routes given more than once: {[tuple(r) for r in conflicts]}")
    return config


def replayed(snapshot: DataFrame, changes: DataFrame, keys: list[str], order: list[str], kind: str = "type") -> DataFrame:
    """A table as it is after its changes: rows of the snapshot, replaced or removed by the last change of their key."""
    last = latest(changes, keys, order)
    rest = snapshot.join(last.select(*keys), keys, "left_anti").select(*snapshot.columns)
    return rest.unionByName(last.where(F.col(kind) != "delete").select(*snapshot.columns))


def dimension_schema(sink_columns: str, sink_pk: str | None = None) -> StructType:
    """All columns are strings; the primary key, ``id`` by default, may not be null."""
    key = sink_pk or "id"
    return StructType([StructField(c, StringType(), c != key) for c in sink_columns.split(",")])


def create_dimension(spark: SparkSession, table: str, sink_columns: str, sink_pk: str | None = None, sink_extend: str | None = None) -> None:
    columns = ", ".join(f"`{f.name}` STRING{'' if f.nullable else ' NOT NULL'}" for f in dimension_schema(sink_columns, sink_pk))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet {sink_extend or ''}")


def upserted(dimension: DataFrame, changes: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """The dimension after the changes: the last change of a key replaces its row. Changes without a payload are left out."""
    new = latest(changes.where(F.col(key).isNotNull()), [key], order or [key]).select(*dimension.columns)
    return dimension.join(new.select(key), key, "left_anti").select(*dimension.columns).unionByName(new)
