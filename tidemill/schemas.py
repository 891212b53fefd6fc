"""Schemas of the warehouse's tables, as Spark DDL. Column order is the order of the sinks."""

from __future__ import annotations

from pyspark.sql.types import DecimalType, StructField, StructType, _parse_datatype_string

MONEY = "decimal(16,2)"

LOG = """common struct<mid: string, vc: string, ch: string, ar: string, is_new: string>, start map<string, string>,
page struct<page_id: string, last_page_id: string, item: string, item_type: string, during_time: bigint>,
displays array<struct<item: string, item_type: string>>, ts bigint"""

ENVELOPE = "database string, `table` string, type string, data string, `before-data` string"
CONFIG = "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string, sink_extend string"

FACTS = {
    "dwd_order_info": f"id bigint, province_id bigint, order_status string, user_id bigint, total_amount {MONEY}, activity_reduce_amount {MONEY}, coupon_reduce_amount {MONEY}, original_total_amount {MONEY}, feight_fee {MONEY}, expire_time string, create_time string, operate_time string",
    "dwd_order_detail": f"id bigint, order_id bigint, sku_id bigint, order_price {MONEY}, sku_num bigint, sku_name string, create_time string, split_total_amount {MONEY}, split_activity_amount {MONEY}, split_coupon_amount {MONEY}",
    "dwd_payment_info": f"id bigint, order_id bigint, user_id bigint, total_amount {MONEY}, subject string, payment_type string, create_time string, callback_time string",
    "dwd_favor_info": "sku_id bigint, create_time string",
    "dwd_cart_info": "sku_id bigint, sku_num bigint, create_time string",
    "dwd_order_refund_info": f"order_id bigint, sku_id bigint, refund_amount {MONEY}, create_time string",
    "dwd_comment_info": "sku_id bigint, appraise string, create_time string",
}

DIMENSIONS = {
    "dim_user_info": "id string, birthday string, gender string",
    "dim_base_province": "id string, name string, area_code string, iso_code string, iso_3166_2 string",
    "dim_sku_info": "id string, sku_name string, price string, spu_id string, tm_id string, category3_id string",
    "dim_spu_info": "id string, spu_name string",
    "dim_base_trademark": "id string, tm_name string",
    "dim_base_category3": "id string, name string",
}

SUMMARIES = {
    "visitor_stats": "stt string, edt string, vc string, ch string, ar string, is_new string, uv_ct bigint, pv_ct bigint, sv_ct bigint, uj_ct bigint, dur_sum bigint, ts bigint",
    "product_stats": "stt string, edt string, sku_id bigint, sku_name string, sku_price decimal(16,2), spu_id bigint, spu_name string, tm_id bigint, tm_name string, category3_id bigint, category3_name string, display_ct bigint, click_ct bigint, favor_ct bigint, cart_ct bigint, order_sku_num bigint, order_amount decimal(26,2), order_ct bigint, payment_amount decimal(26,2), paid_order_ct bigint, refund_order_ct bigint, refund_amount decimal(26,2), comment_ct bigint, good_comment_ct bigint, ts bigint",
    "province_stats": "stt string, edt string, province_id bigint, province_name string, province_area_code string, province_iso_code string, province_3166_2_code string, order_amount decimal(26,2), order_count bigint, ts bigint",
    "keyword_stats": "keyword string, ct bigint, source string, stt string, edt string, ts bigint",
}

ALL = {"ods_base_log": LOG, "ods_base_db": ENVELOPE, "table_process": CONFIG} | FACTS | DIMENSIONS | SUMMARIES

# Codes of the business tables.
APPRAISE_GOOD = "1201"
SINK_FACT, SINK_DIMENSION = "kafka", "hbase"
KEYWORD_SOURCE = "search"
KEYWORD_WEIGHTS = {"SEARCH": 10, "ORDER": 3, "CART": 2, "CLICK": 1}


def struct_of(name: str) -> StructType:
    return _parse_datatype_string(ALL[name])


def strict(schema: StructType) -> StructType:
    """The schema with decimals declared without precision: ten digits, no fraction."""
    return StructType([StructField(f.name, DecimalType(10, 0) if isinstance(f.dataType, DecimalType) else f.dataType, f.nullable) for f in schema])
