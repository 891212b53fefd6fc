"""The driver's tables in the roles of the warehouse's: orders, details, payments, dimensions, page logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time as t

MONEY = "decimal(16,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _no(*names: str, kind: str = MONEY) -> list:
    return [F.lit(None).cast(kind).alias(n) for n in names]


def order_info(spark: SparkSession, sf_dir: str, day: str | None = None) -> DataFrame:
    """Orders; a customer's nation is the order's province. day: only that day's, picked by the scan."""
    orders = table(spark, sf_dir, "orders")
    if day:
        low = F.to_timestamp_ntz(F.lit(day))
        orders = orders.where((F.col("o_orderdate") >= low) & (F.col("o_orderdate") < low + F.expr("interval 1 day")))
    own = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return own.select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("province_id"), F.col("o_orderstatus").alias("order_status"), F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"), *_no("activity_reduce_amount", "coupon_reduce_amount", "original_total_amount", "feight_fee"),
        t.shown("o_orderdate").alias("create_time"), t.shown("o_orderdate").substr(1, 10).alias("create_date"), t.shown("o_orderdate").substr(12, 2).alias("create_hour"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"),
    )


def order_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("id"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku_id"), F.col("l_extendedprice").cast(MONEY).alias("order_price"),
        F.col("l_quantity").cast("bigint").alias("sku_num"), F.lit(None).cast("string").alias("sku_name"), *_no("split_activity_amount", "split_coupon_amount"),
        F.col("l_extendedprice").cast(MONEY).alias("split_total_amount"), F.col("l_shipdate").cast("timestamp").alias("event_time"),
    )


def payment_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as payments of their order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("id"), F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("user_id"), F.col("l_extendedprice").cast(MONEY).alias("total_amount"),
        F.col("l_linestatus").alias("subject"), F.col("l_returnflag").alias("payment_type"), t.shown("l_shipdate").alias("create_time"), F.lit(None).cast("string").alias("callback_time"),
        F.col("l_shipdate").cast("timestamp").alias("event_time"),
    )


def dimensions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part, nation, customer = (table(spark, sf_dir, x) for x in ("part", "nation", "customer"))
    brands, types = part.select("p_brand").distinct(), part.select("p_type").distinct()
    return {
        "dim_user_info": customer.select(F.col("c_custkey").alias("id"), F.date_add(F.lit("1960-01-01").cast("date"), (F.col("c_custkey") % 12000).cast("int")).alias("birthday"), F.col("c_mktsegment").alias("gender")),
        "dim_base_province": nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("area_code"), F.substring("n_name", 1, 2).alias("iso_code"), F.substring("n_name", 1, 3).alias("iso_3166_2")),
        "dim_sku_info": part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("sku_name"), F.col("p_retailprice").cast(MONEY).alias("price"), F.col("p_partkey").alias("spu_id"), F.col("p_brand").alias("tm_id"), F.col("p_type").alias("category3_id")),
        "dim_spu_info": part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("spu "), "p_name").alias("spu_name")),
        "dim_base_trademark": brands.select(F.col("p_brand").alias("id"), F.upper("p_brand").alias("tm_name")),
        "dim_base_category3": types.select(F.col("p_type").alias("id"), F.upper("p_type").alias("name")),
    }


def page_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logs: signups are start logs; views are pages without a predecessor; clicks show a product."""
    e = table(spark, sf_dir, "events")
    item = F.get_json_object("props", "$.k")
    last = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.lit("home"))
    page = F.struct(
        F.when(F.col("event_type") == "click", "good_detail").otherwise(F.col("event_type")).alias("page_id"), last.alias("last_page_id"), item.alias("item"),
        F.lit("sku_id").alias("item_type"), F.col("value").cast("bigint").alias("during_time"),
    )
    common = F.struct(
        F.col("user_id").cast("string").alias("mid"), F.concat(F.lit("v"), F.col("user_id") % 3).alias("vc"), F.concat(F.lit("ch"), F.col("user_id") % 2).alias("ch"),
        F.col("event_type").alias("ar"), F.when(F.col("event_type").isin("signup", "view"), "1").otherwise("0").alias("is_new"),
    )
    shown = F.when(item.cast("int") % 4 == 0, F.transform(F.sequence(F.lit(1), F.lit(2)), lambda i: F.struct((item.cast("int") + i).cast("string").alias("item"), F.when(i == 1, "sku_id").otherwise("activity_id").alias("item_type"))))
    return e.select("event_id", common.alias("common"), page.alias("page"), shown.alias("displays"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("ts").cast("timestamp").alias("event_time"), (F.col("event_type") == "signup").alias("is_start"))
