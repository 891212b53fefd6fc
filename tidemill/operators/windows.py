"""Tumbling-window summaries. Names come after aggregation, one lookup for each key and window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import processing_millis, window_bounds
from .joins import enrich
from .measures import ORDERS, PRODUCT, VISITOR, VISITOR_KEYS
from .wide import product_names


def visitor_window(rows: DataFrame, length: str = "10 seconds") -> DataFrame:
    agg = rows.groupBy(F.window("event_time", length), *VISITOR_KEYS).agg(*[F.sum(m).alias(m) for m in VISITOR], F.min("event_time").alias("_first"))
    return agg.select(*window_bounds(), *VISITOR_KEYS, *VISITOR, F.unix_millis(F.col("_first").cast("timestamp")).alias("ts"))


def product_window(rows: DataFrame, length: str = "10 seconds") -> DataFrame:
    """Sums, and orders of each kind counted once a product and window.

    Stored tables are summed by (product, window, kind, order) first and by
    (product, window) then, so that exact counts need neither sets nor
    repeated rows. Streams, which allow one aggregation, gather sets.
    """
    first = F.min("event_time").alias("_first")
    if rows.isStreaming:
        sets = [F.size(F.collect_set(F.when(F.col("order_kind") == k, F.col("order_id")))).cast("bigint").alias(n) for k, n in ORDERS.items()]
        agg = rows.groupBy(F.window("event_time", length), "sku_id").agg(*[F.sum(m).alias(m) for m in PRODUCT], *sets, first)
    else:
        inner = rows.groupBy(F.window("event_time", length), "sku_id", "order_kind", "order_id").agg(*[F.sum(m).alias(m) for m in PRODUCT], first)
        counts = [F.count(F.when(F.col("order_kind") == k, F.col("order_id"))).alias(n) for k, n in ORDERS.items()]
        agg = inner.groupBy("window", "sku_id").agg(*[F.sum(m).alias(m) for m in PRODUCT], *counts, F.min("_first").alias("_first"))
    return agg.select(*window_bounds(), "sku_id", *PRODUCT, *ORDERS.values(), F.unix_millis(F.col("_first").cast("timestamp")).alias("ts"))


def product_stats(rows: DataFrame, dims: dict[str, DataFrame], length: str = "10 seconds", how: str = "inner") -> DataFrame:
    sku = {"sku_name": "sku_name", "sku_price": "price", "spu_id": "spu_id", "tm_id": "tm_id", "category3_id": "category3_id"}
    out = enrich(product_window(rows, length), dims["dim_sku_info"], "sku_id", sku, how=how)
    return product_names(out, dims, how)


PROVINCE_KEYS = ["province_id", "province_name", "province_area_code", "province_iso_code", "province_3166_2_code"]


def province_window(wide: DataFrame, length: str = "10 seconds", amount: str = "total_amount", strict_decimal: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Amounts and orders of provinces. strict_decimal rounds each amount to a whole number first."""
    keys = keys or PROVINCE_KEYS
    value = F.col(amount).cast("decimal(10,0)") if strict_decimal else F.col(amount)
    rows = wide.withColumn("_amount", value)
    if wide.isStreaming:
        agg = rows.groupBy(F.window("event_time", length), *keys).agg(F.sum("_amount").alias("order_amount"), F.size(F.collect_set("order_id")).cast("bigint").alias("order_count"))
    else:
        inner = rows.groupBy(F.window("event_time", length), *keys, "order_id").agg(F.sum("_amount").alias("_amount"))
        agg = inner.groupBy("window", *keys).agg(F.sum("_amount").alias("order_amount"), F.count("order_id").alias("order_count"))
    return agg.select(*window_bounds(), *keys, "order_amount", "order_count")


def province_rows(wide: DataFrame) -> DataFrame:
    """A row for each detail of a wide order: its own amount, and 1 as the count."""
    return wide.select(*PROVINCE_KEYS, "event_time", F.col("split_total_amount").alias("order_amount"), F.lit(1).cast("bigint").alias("order_count"))


def stamped(rows: DataFrame) -> DataFrame:
    """rows with ``ts``, the time of processing, if they have none."""
    return rows if "ts" in rows.columns else rows.withColumn("ts", processing_millis())


def keyword_window(words: DataFrame, source: str, length: str = "10 seconds", word: str = "word") -> DataFrame:
    agg = words.groupBy(F.window("event_time", length), F.col(word).alias("keyword")).agg(F.count(F.lit(1)).alias("ct"))
    return agg.select("keyword", "ct", F.lit(source).alias("source"), *window_bounds())


def searches(page_logs: DataFrame, page: str = "page") -> DataFrame:
    """Pages that a search led to; page is a struct or a map."""
    p = F.col(page)
    return page_logs.where((p["item_type"] == "keyword") & (p["last_page_id"] == "search") & p["item"].isNotNull())
