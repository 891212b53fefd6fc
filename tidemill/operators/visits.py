"""Daily unique visits and bounces, over stored logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_visits(logs: DataFrame, key: str, ts: str, order: list[str]) -> DataFrame:
    """The first row of each key and day; combined before the shuffle."""
    first = F.min_by(F.struct("*"), F.struct(*order)).alias("_row")
    return logs.groupBy(F.col(key).alias("_key"), F.to_date(ts).alias("_day")).agg(first).select("_row.*")


def jumps(logs: DataFrame, key: str, ts: str, entry: Column, within: int, order: list[str], span: int | None = None) -> DataFrame:
    """Entry rows of a key that no other page follows within ``within`` seconds.

    An entry row stands if no row follows it in time, or if the next row is an
    entry too. Only rows closer than ``within`` matter, so keys are cut into
    spans of time no shorter than that, and the last row of a span looks at
    the first of the next one: a key of very many rows is many groups.
    """
    span = max(span or 0, 24 * within)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = logs.withColumn("_entry", entry).withColumn("_us", micros).withColumn("_span", F.floor(F.col("_us") / F.lit(span * 1_000_000)))
    at = F.struct("_us", *order).alias("at")
    heads = rows.groupBy(F.col(key).alias("_k"), (F.col("_span") - 1).alias("_s")).agg(F.min_by(F.struct("_us", "_entry"), at).alias("_later"))
    own = Window.partitionBy(key, "_span").orderBy("_us", *order)
    rows = rows.withColumn("_next", F.lead(F.struct("_us", "_entry")).over(own))
    rows = rows.join(heads, (F.col(key) == F.col("_k")) & (F.col("_span") == F.col("_s")), "left").withColumn("_next", F.coalesce("_next", "_later"))
    far = F.col("_next").isNull() | (F.col("_next._us") - F.col("_us") >= within * 1_000_000) | F.col("_next._entry")
    return rows.where(F.col("_entry") & far).select(*logs.columns)
