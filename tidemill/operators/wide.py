"""Wide tables: orders with details and dimensions, payments with wide orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import time as t
from .joins import enrich, interval_join

FROM_ORDER = [
    "province_id", "order_status", "user_id", "total_amount", "activity_reduce_amount", "coupon_reduce_amount",
    "original_total_amount", "feight_fee", "create_time", "create_date", "create_hour",
]
FROM_DETAIL = ["sku_id", "order_price", "sku_num", "sku_name", "split_activity_amount", "split_coupon_amount", "split_total_amount"]
#: Columns of a wide order that no input fills.
UNFILLED = {"split_feight_fee": "decimal(16,2)", "expire_time": "string", "operate_time": "string"}


def timed(facts: DataFrame, text: str = "create_time", watermark: str | None = None) -> DataFrame:
    """facts with ``event_time`` and the parts of their creation time; on streams with a watermark."""
    out = facts.withColumns(t.create_parts(text)).withColumn("event_time", F.try_to_timestamp(text, F.lit(t.SECONDS)))
    return out.withWatermark("event_time", watermark) if watermark else out


def order_detail(orders: DataFrame, details: DataFrame, low: str = "-5 seconds", high: str = "5 seconds") -> DataFrame:
    """Orders joined with their details of nearly the same time, before the dimensions."""
    o = orders.select(F.col("id").alias("order_id"), *FROM_ORDER, F.col("event_time").alias("order_time"))
    d = details.select(F.col("id").alias("detail_id"), F.col("order_id").alias("_order"), *FROM_DETAIL, F.col("event_time").alias("detail_time"))
    joined = interval_join(o, d, F.col("order_id") == F.col("_order"), "order_time", "detail_time", low, high)
    return joined.drop("_order").withColumns({n: F.lit(None).cast(kind) for n, kind in UNFILLED.items()})


def with_dimensions(wide: DataFrame, dims: dict[str, DataFrame], as_of, how: str = "inner") -> DataFrame:
    """The six lookups of a wide order; spu, trademark and category hang on the sku's row. A sku's name is the dimension's."""
    out = enrich(wide, dims["dim_user_info"], "user_id", {"_birthday": "birthday", "user_gender": "gender"}, how=how)
    out = out.withColumn("user_age", t.age("_birthday", as_of)).drop("_birthday")
    province = {"province_name": "name", "province_area_code": "area_code", "province_iso_code": "iso_code", "province_3166_2_code": "iso_3166_2"}
    out = enrich(out, dims["dim_base_province"], "province_id", province, how=how)
    sku = {"sku_name": "sku_name", "category3_id": "category3_id", "spu_id": "spu_id", "tm_id": "tm_id"}
    out = enrich(out, dims["dim_sku_info"], "sku_id", sku, how=how)
    return product_names(out, dims, how)


def product_names(rows: DataFrame, dims: dict[str, DataFrame], how: str = "inner") -> DataFrame:
    out = enrich(rows, dims["dim_spu_info"], "spu_id", {"spu_name": "spu_name"}, how=how)
    out = enrich(out, dims["dim_base_trademark"], "tm_id", {"tm_name": "tm_name"}, how=how)
    return enrich(out, dims["dim_base_category3"], "category3_id", {"category3_name": "name"}, how=how)


def payment_wide(payments: DataFrame, wide: DataFrame, low: str = "-15 minutes", high: str = "0 seconds") -> DataFrame:
    """Payments with the wide orders of the time before them; where names meet, the payment's value holds."""
    p = payments.select(
        F.col("id").alias("payment_id"), F.col("order_id").alias("_paid"), F.col("user_id").alias("_user"), F.col("total_amount").alias("_amount"),
        "subject", "payment_type", F.col("create_time").alias("payment_create_time"), "callback_time", F.col("event_time").alias("payment_time"),
    )
    dropped = ["create_date", "create_hour", "expire_time", "operate_time", "user_id", "total_amount"]
    joined = interval_join(p, wide.withColumnRenamed("create_time", "order_create_time"), F.col("_paid") == F.col("order_id"), "payment_time", "order_time", low, high)
    return joined.drop(*dropped).withColumnsRenamed({"_user": "user_id", "_amount": "total_amount"}).drop("_paid")


def first_filled(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Wide rows of two tables merged by key: each column's first value that is not null, a's before b's."""
    b = b.select(*[F.col(c).alias(f"_b_{c}") for c in b.columns])
    joined = a.join(b, F.col(key) == F.col(f"_b_{key}"), "full")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_b_{c}")).alias(c) for c in a.columns])
