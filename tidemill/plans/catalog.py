"""Every query of the engine on the driver's tables, and its SQL.

Names follow the operators they show. Amounts are decimals before they are
summed, times are projected as text or whole timestamps, and every top list
has a tie-break, so that both sides agree to the digit.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text
from ..functions import time as t
from ..operators import joins, logs, measures, routing, serving, visits, wide, windows
from ..schemas import KEYWORD_SOURCE
from ..sources import streams
from ..streaming import stateful
from . import standins as s

AS_OF = "2024-06-30"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


M = "DECIMAL(16,2)"
SHOWN = "'%Y-%m-%d %H:%M:%S'"
_O = f"o AS (SELECT o_orderkey, o_custkey, c_nationkey, o_orderstatus, CAST(o_totalprice AS {M}) AS total, o_orderdate, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey)"
_WIDE = f"""{_O}, wide AS (
  SELECT o_orderkey AS order_id, c_nationkey AS province_id, o_orderstatus AS order_status, o_custkey AS user_id, total AS total_amount, o_orderdate,
         strftime(o_orderdate, {SHOWN}) AS create_time, l_linenumber AS detail_id, l_partkey AS sku_id, CAST(l_extendedprice AS {M}) AS order_price, CAST(l_quantity AS BIGINT) AS sku_num,
         c_mktsegment AS user_gender, CAST(floor(date_diff('millisecond', CAST(DATE '1960-01-01' + CAST(o_custkey % 12000 AS INTEGER) AS TIMESTAMP), TIMESTAMP '{AS_OF}') / 31536000000.0) AS INTEGER) AS user_age,
         n_name AS province_name, CAST(n_regionkey AS VARCHAR) AS province_area_code, substr(n_name, 1, 2) AS province_iso_code, substr(n_name, 1, 3) AS province_3166_2_code,
         p_name AS sku_name, p_partkey AS spu_id, p_brand AS tm_id, p_type AS category3_id, concat('spu ', p_name) AS spu_name, upper(p_brand) AS tm_name, upper(p_type) AS category3_name
  FROM o JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate - INTERVAL 5 DAY AND o_orderdate + INTERVAL 5 DAY
  JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = l_partkey)"""
WIDE_COLUMNS = [
    "order_id", "detail_id", "province_id", "order_status", "user_id", "total_amount", "create_time", "sku_id", "order_price", "sku_num", "user_gender", "user_age", "province_name",
    "province_area_code", "province_iso_code", "province_3166_2_code", "sku_name", "spu_id", "tm_id", "category3_id", "spu_name", "tm_name", "category3_name",
]


def _order_detail(spark, sf, low="-5 days", high="5 days") -> DataFrame:
    return wide.order_detail(s.order_info(spark, sf), s.order_detail(spark, sf), low, high)


def _wide(spark, sf) -> DataFrame:
    return wide.with_dimensions(_order_detail(spark, sf), s.dimensions(spark, sf), AS_OF)


# Joins.


@query(f"WITH {_O} SELECT o_orderkey AS order_id, l_linenumber AS detail_id, l_partkey AS sku_id, CAST(l_quantity AS BIGINT) AS sku_num, total AS total_amount, strftime(o_orderdate, {SHOWN}) AS order_time, strftime(l_shipdate, {SHOWN}) AS detail_time FROM o JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate - INTERVAL 5 DAY AND l_shipdate <= o_orderdate + INTERVAL 5 DAY")
def interval_join_order_detail(spark: SparkSession, sf: str) -> DataFrame:
    times = [t.shown(c).alias(c) for c in ("order_time", "detail_time")]
    return _order_detail(spark, sf).select("order_id", "detail_id", "sku_id", "sku_num", "total_amount", *times)


@query(f"SELECT o_orderkey AS order_id, l_linenumber AS payment_id, l_suppkey AS user_id, strftime(o_orderdate, {SHOWN}) AS order_time, strftime(l_shipdate, {SHOWN}) AS payment_time FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND o_orderdate BETWEEN l_shipdate - INTERVAL 30 DAY AND l_shipdate")
def interval_join_payment(spark: SparkSession, sf: str) -> DataFrame:
    o = s.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("order_time"))
    p = s.payment_info(spark, sf).withColumnsRenamed({"id": "payment_id", "event_time": "payment_time"})
    out = joins.interval_join(p, o, F.col("order_id") == F.col("o_orderkey"), "payment_time", "order_time", "-30 days", "0 seconds")
    return out.select("order_id", "payment_id", "user_id", *[t.shown(c).alias(c) for c in ("order_time", "payment_time")])


@query(f"WITH {_WIDE} SELECT {', '.join(WIDE_COLUMNS)} FROM wide")
def order_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf).select(*WIDE_COLUMNS)


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def dim_join_inner(spark: SparkSession, sf: str) -> DataFrame:
    return _dim_join(spark, sf, "inner")


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def dim_join_left(spark: SparkSession, sf: str) -> DataFrame:
    return _dim_join(spark, sf, "left")


def _dim_join(spark, sf, how):
    dim = s.table(spark, sf, "customer").where("c_acctbal > 0")
    out = joins.enrich(s.table(spark, sf, "orders"), dim, "o_custkey", {"c_name": "c_name", "c_mktsegment": "c_mktsegment"}, dim_key="c_custkey", how=how)
    return out.select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query(f"SELECT o_orderkey, CAST(floor(date_diff('millisecond', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP), TIMESTAMP '{AS_OF}') / 31536000000.0) AS INTEGER) AS age FROM orders")
def user_age(spark: SparkSession, sf: str) -> DataFrame:
    rows = s.table(spark, sf, "orders").withColumn("birthday", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return rows.select("o_orderkey", t.age("birthday", AS_OF).alias("age"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS create_date, strftime(o_orderdate, '%H') AS create_hour, epoch_ms(date_trunc('second', o_orderdate)) AS create_ts FROM orders")
def order_date_hour(spark: SparkSession, sf: str) -> DataFrame:
    return s.table(spark, sf, "orders").withColumn("create_time", t.shown("o_orderdate")).withColumns(t.create_parts()).select("o_orderkey", "create_date", "create_hour", "create_ts")


_PAID = f"""{_WIDE}, paid AS (
  SELECT l_linenumber AS payment_id, wide.order_id, l_suppkey AS user_id, CAST(l_extendedprice AS {M}) AS total_amount, l_linestatus AS subject, l_returnflag AS payment_type,
         strftime(l_shipdate, {SHOWN}) AS payment_create_time, create_time AS order_create_time, detail_id, sku_id, sku_num, tm_name, province_name, l_shipdate
  FROM lineitem JOIN wide ON l_orderkey = order_id AND o_orderdate BETWEEN l_shipdate - INTERVAL 30 DAY AND l_shipdate)"""
PAID_COLUMNS = ["payment_id", "order_id", "user_id", "total_amount", "subject", "payment_type", "payment_create_time", "order_create_time", "detail_id", "sku_id", "sku_num", "tm_name", "province_name"]


@query(f"WITH {_PAID} SELECT {', '.join(PAID_COLUMNS)} FROM paid")
def payment_wide(spark: SparkSession, sf: str) -> DataFrame:
    return wide.payment_wide(s.payment_info(spark, sf), _wide(spark, sf), "-30 days").select(*PAID_COLUMNS)


@query(f"WITH {_WIDE}, a AS (SELECT * FROM wide WHERE detail_id = 1), f AS (SELECT order_id, min(tm_name) AS tm_name, min(sku_num) AS sku_num FROM a GROUP BY order_id), g AS (SELECT o_orderkey AS order_id, o_orderstatus AS tm_name, CAST(-1 AS BIGINT) AS sku_num FROM orders WHERE o_orderkey % 3 = 0) SELECT coalesce(f.order_id, g.order_id) AS order_id, coalesce(f.tm_name, g.tm_name) AS tm_name, coalesce(f.sku_num, g.sku_num) AS sku_num FROM f FULL JOIN g ON f.order_id = g.order_id")
def order_wide_merge(spark: SparkSession, sf: str) -> DataFrame:
    a = _wide(spark, sf).where("detail_id = 1").groupBy("order_id").agg(F.min("tm_name").alias("tm_name"), F.min("sku_num").alias("sku_num"))
    b = s.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("tm_name"), F.lit(-1).cast("bigint").alias("sku_num"))
    return wide.first_filled(a, b, "order_id")


# Product statistics.


def _product_rows(spark, sf) -> DataFrame:
    e = s.page_logs(spark, sf)
    pages = e.where(~F.col("is_start"))
    item = F.col("page.item").cast("bigint")
    facts = pages.select(item.alias("sku_id"), F.lit(3).cast("bigint").alias("sku_num"), F.col("event_id").alias("order_id"), F.col("page.during_time").cast("decimal(16,2)").alias("refund_amount"), F.when(item % 2 == 0, "1201").otherwise("1204").alias("appraise"), "event_time", F.col("common.ar").alias("kind"))
    # names are looked up after aggregation, so neither needs the dimensions of a wide order
    details = _order_detail(spark, sf)
    w = details.withColumn("event_time", F.col("detail_time"))
    p = wide.payment_wide(s.payment_info(spark, sf), details, "-30 days").withColumn("event_time", F.col("payment_time"))
    return measures.united(
        measures.clicks(pages), measures.display_rows(pages), measures.favors(facts.where("kind = 'view'")), measures.carts(facts.where("kind = 'purchase'")),
        measures.ordered(w), measures.paid(p), measures.refunds(facts.where("kind = 'error'")), measures.comments(facts.where("kind = 'view'")),
    )


_MEASURES = f"""{_PAID}, e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), rows_ AS (
  SELECT k AS sku_id, ts AS at_, NULL AS kind, NULL AS oid, 0 AS display_ct, 1 AS click_ct, 0 AS favor_ct, 0 AS cart_ct, 0 AS order_sku_num, CAST(0 AS {M}) AS order_amount, CAST(0 AS {M}) AS payment_amount, CAST(0 AS {M}) AS refund_amount, 0 AS comment_ct, 0 AS good_comment_ct FROM e WHERE event_type = 'click'
  UNION ALL SELECT k + 1, ts, NULL, NULL, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM e WHERE event_type <> 'signup' AND k % 4 = 0
  UNION ALL SELECT k, ts, NULL, NULL, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0 FROM e WHERE event_type = 'view'
  UNION ALL SELECT k, ts, NULL, NULL, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0 FROM e WHERE event_type = 'purchase'
  UNION ALL SELECT sku_id, l_shipdate, 'order', order_id, 0, 0, 0, 0, sku_num, total_amount, 0, 0, 0, 0 FROM (
    SELECT w.*, l.l_shipdate FROM (SELECT DISTINCT order_id, o_orderdate, total_amount FROM wide) w0
    JOIN lineitem l ON l.l_orderkey = w0.order_id AND l.l_shipdate BETWEEN o_orderdate - INTERVAL 5 DAY AND o_orderdate + INTERVAL 5 DAY
    CROSS JOIN LATERAL (SELECT w0.order_id, w0.total_amount, l.l_partkey AS sku_id, CAST(l.l_quantity AS BIGINT) AS sku_num) w)
  UNION ALL SELECT sku_id, l_shipdate, 'paid', order_id, 0, 0, 0, 0, 0, 0, total_amount, 0, 0, 0 FROM paid
  UNION ALL SELECT k, ts, 'refund', event_id, 0, 0, 0, 0, 0, 0, 0, CAST(trunc(value) AS {M}), 0, 0 FROM e WHERE event_type = 'error'
  UNION ALL SELECT k, ts, NULL, NULL, 0, 0, 0, 0, 0, 0, 0, 0, 1, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END FROM e WHERE event_type = 'view'
)"""
_SUMS = ", ".join(f"CAST(sum({m}) AS {'DECIMAL(26,2)' if 'amount' in m else 'BIGINT'}) AS {m}" for m in measures.PRODUCT)


@query(f"WITH {_MEASURES} SELECT sku_id, kind AS order_kind, count(*) AS n, {_SUMS} FROM rows_ GROUP BY sku_id, kind")
def union_measures(spark: SparkSession, sf: str) -> DataFrame:
    return _product_rows(spark, sf).groupBy("sku_id", "order_kind").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in measures.PRODUCT])


_STATS = f"""{_MEASURES}, stats AS (
  SELECT strftime(d, {SHOWN}) AS stt, strftime(d + INTERVAL 1 DAY, {SHOWN}) AS edt, sku_id, p_name AS sku_name, CAST(p_retailprice AS {M}) AS sku_price, p_partkey AS spu_id, concat('spu ', p_name) AS spu_name,
         p_brand AS tm_id, upper(p_brand) AS tm_name, p_type AS category3_id, upper(p_type) AS category3_name, {", ".join(measures.PRODUCT)}, order_ct, paid_order_ct, refund_order_ct, ts
  FROM (SELECT date_trunc('day', at_) AS d, sku_id, {_SUMS}, count(DISTINCT oid) FILTER (WHERE kind = 'order') AS order_ct, count(DISTINCT oid) FILTER (WHERE kind = 'paid') AS paid_order_ct,
               count(DISTINCT oid) FILTER (WHERE kind = 'refund') AS refund_order_ct, epoch_us(min(at_)) // 1000 AS ts FROM rows_ GROUP BY ALL) JOIN part ON p_partkey = sku_id)"""


@query(f"WITH {_STATS} SELECT * FROM stats")
def product_stats(spark: SparkSession, sf: str) -> DataFrame:
    return windows.product_stats(_product_rows(spark, sf), s.dimensions(spark, sf), "1 day")


# The sales tables of the dashboard come from all details, each a product's window of one day.
_SALES = f"""{_O}, sales AS (
  SELECT strftime(date_trunc('day', o_orderdate), {SHOWN}) AS stt, p_partkey AS sku_id, p_brand AS tm_id, upper(p_brand) AS tm_name, p_type AS category3_id, upper(p_type) AS category3_name, p_partkey AS spu_id,
         concat('spu ', p_name) AS spu_name, sum(total) AS order_amount, count(DISTINCT o_orderkey) AS order_ct, c_nationkey AS province_id
  FROM o JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""
DAY = 19950617


_kept: dict[tuple, DataFrame] = {}


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the cluster's shared one; of this machine only where none is named."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}" if base else f"file://{tempfile.mkdtemp()}/{name}"


def _stored(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A summary as the dashboard finds it: stored whole, once a session and input, in the order of time, so that a day is a few row groups."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _kept:
        path = _folder(spark, name)
        build(spark, sf).repartitionByRange("stt").sortWithinPartitions("stt").write.parquet(path)
        _kept[key] = spark.read.parquet(path)
    return _kept[key]


def _sales(spark, sf) -> DataFrame:
    """product_stats of all orders, each detail at its order's time, stored."""
    return _stored(spark, sf, "sales", _all_sales)


def _all_sales(spark, sf) -> DataFrame:
    o, d = s.order_info(spark, sf), s.order_detail(spark, sf).drop("event_time")
    rows = o.select(F.col("id").alias("_order"), "total_amount", "event_time").join(d, F.col("_order") == F.col("order_id"))
    return windows.product_stats(measures.ordered(rows), s.dimensions(spark, sf), "1 day")


_DAY_SQL = "stt = '1995-06-17 00:00:00'"


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Brands by sales, from the interval join of orders and details to the ranking; over all days."""
    rows = measures.ordered(_order_detail(spark, sf, "0 days", "30 days").withColumn("event_time", F.col("order_time")))
    stats = windows.product_stats(rows, s.dimensions(spark, sf), "1 day")
    return stats.groupBy("tm_id", "tm_name").agg(F.sum("order_amount").alias("order_amount"), F.sum("order_ct").alias("order_ct")).where("order_amount > 0").orderBy(F.desc("order_amount"), "tm_id").limit(10)


@query(f"WITH {_O}, w AS (SELECT l_partkey, o_orderdate, o_orderkey, total FROM o JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY), g AS (SELECT l_partkey, CAST(o_orderdate AS DATE) AS d, sum(total) AS a, count(DISTINCT o_orderkey) AS c FROM w GROUP BY ALL) SELECT p_brand AS tm_id, upper(p_brand) AS tm_name, CAST(sum(a) AS DECIMAL(36,2)) AS order_amount, CAST(sum(c) AS BIGINT) AS order_ct FROM g JOIN part ON p_partkey = l_partkey GROUP BY ALL HAVING sum(a) > 0 ORDER BY order_amount DESC, tm_id LIMIT 10")
def trademark_flagship(spark: SparkSession, sf: str) -> DataFrame:
    return flagship(spark, sf)


@query(f"WITH {_SALES} SELECT CAST(coalesce(sum(order_amount), 0) AS DECIMAL(36,2)) AS order_amount FROM sales WHERE {_DAY_SQL}")
def gmv(spark: SparkSession, sf: str) -> DataFrame:
    return serving.gmv(_sales(spark, sf), DAY)


@query("SELECT CAST(0 AS DECIMAL(36,2)) AS order_amount")
def gmv_empty(spark: SparkSession, sf: str) -> DataFrame:
    return serving.gmv(_sales(spark, sf), 19010101)


def _top_sql(keys: str, more: str = "") -> str:
    return f"WITH {_SALES} SELECT {keys}, CAST(sum(order_amount) AS DECIMAL(36,2)) AS order_amount{more} FROM sales WHERE {_DAY_SQL} GROUP BY {keys} HAVING sum(order_amount) > 0 ORDER BY order_amount DESC, {keys} LIMIT 10"


@query(_top_sql("tm_id, tm_name"))
def top_trademark(spark: SparkSession, sf: str) -> DataFrame:
    return serving.top_trademarks(_sales(spark, sf), DAY)


@query(_top_sql("category3_id, category3_name"))
def top_category3(spark: SparkSession, sf: str) -> DataFrame:
    return serving.top_categories(_sales(spark, sf), DAY)


@query(_top_sql("spu_id, spu_name", ", CAST(sum(order_ct) AS BIGINT) AS order_ct"))
def top_spu(spark: SparkSession, sf: str) -> DataFrame:
    return serving.top_spus(_sales(spark, sf), DAY)


# Provinces.


def _province_rows(spark, sf) -> DataFrame:
    o = s.order_info(spark, sf).withColumnRenamed("id", "order_id")
    province = {"province_name": "name", "province_area_code": "area_code", "province_iso_code": "iso_code", "province_3166_2_code": "iso_3166_2"}
    return joins.enrich(o, s.dimensions(spark, sf)["dim_base_province"], "province_id", province)


def _province_sql(amount: str) -> str:
    return f"""WITH {_O} SELECT strftime(d, {SHOWN}) AS stt, strftime(d + INTERVAL 1 DAY, {SHOWN}) AS edt, c_nationkey AS province_id, n_name AS province_name, CAST(n_regionkey AS VARCHAR) AS province_area_code,
      substr(n_name, 1, 2) AS province_iso_code, substr(n_name, 1, 3) AS province_3166_2_code, order_amount, order_count FROM (SELECT date_trunc('day', o_orderdate) AS d, c_nationkey, sum({amount}) AS order_amount, count(DISTINCT o_orderkey) AS order_count FROM o GROUP BY ALL)
      JOIN nation ON n_nationkey = c_nationkey"""


@query(_province_sql("total"))
def province_stats(spark: SparkSession, sf: str) -> DataFrame:
    return windows.province_window(_province_rows(spark, sf), "1 day")


@query(_province_sql("CAST(total AS DECIMAL(10,0))"))
def province_stats_strict_decimal(spark: SparkSession, sf: str) -> DataFrame:
    return windows.province_window(_province_rows(spark, sf), "1 day", strict_decimal=True)


@query(f"WITH {_O} SELECT n_name AS province_name, sum(total) AS order_amount FROM o JOIN nation ON n_nationkey = c_nationkey WHERE CAST(o_orderdate AS DATE) = DATE '1995-06-17' GROUP BY n_nationkey, n_name")
def province_totals(spark: SparkSession, sf: str) -> DataFrame:
    return serving.province_totals(windows.province_window(_province_rows(spark, sf), "1 day"), DAY)


@query(f"WITH {_O} SELECT strftime(time_bucket(INTERVAL 1 DAY, o_orderdate), {SHOWN}) AS stt, n_name AS province_name, sum(total) AS order_amount, count(DISTINCT o_orderkey) AS order_count FROM o JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL")
def province_stats_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The same job as SQL over a view: tumbling windows, sums and exact counts."""
    _province_rows(spark, sf).createOrReplaceTempView("tidemill_order_wide")
    return spark.sql("""
        select date_format(window.start, 'yyyy-MM-dd HH:mm:ss') as stt, province_name, sum(total_amount) as order_amount, count(distinct order_id) as order_count
        from tidemill_order_wide group by window(event_time, '1 day'), province_name""")


# Visitors.

_LOG = """e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS mid, concat('v', user_id % 3) AS vc, concat('ch', user_id % 2) AS ch, event_type AS ar, CASE WHEN event_type IN ('signup', 'view') THEN '1' ELSE '0' END AS is_new,
  event_type, ts, CAST(trunc(value) AS BIGINT) AS during, json_extract_string(props, '$.k') AS item FROM events)"""
_UV = "uv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mid, CAST(ts AS DATE) ORDER BY ts, event_id) AS r FROM e WHERE event_type <> 'signup') WHERE r = 1)"
_UJ = """uj AS (SELECT * FROM (SELECT *, event_type = 'view' AS entry, lead(ts) OVER w AS next_ts, lead(event_type) OVER w = 'view' AS next_entry FROM e WHERE event_type <> 'signup'
  WINDOW w AS (PARTITION BY mid ORDER BY ts, event_id)) WHERE entry AND (next_ts IS NULL OR next_ts - ts >= INTERVAL 1 HOUR OR next_entry))"""
_VISITORS = f"""{_LOG}, {_UV}, {_UJ}, v AS (
  SELECT vc, ch, ar, is_new, ts, 0 AS uv_ct, 1 AS pv_ct, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS sv_ct, 0 AS uj_ct, during AS dur_sum FROM e WHERE event_type <> 'signup'
  UNION ALL SELECT vc, ch, ar, is_new, ts, 1, 0, 0, 0, 0 FROM uv UNION ALL SELECT vc, ch, ar, is_new, ts, 0, 0, 0, 1, 0 FROM uj
), vs AS (
  SELECT strftime(date_trunc('hour', ts), {SHOWN}) AS stt, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, {SHOWN}) AS edt, vc, ch, ar, is_new, CAST(sum(uv_ct) AS BIGINT) AS uv_ct, CAST(sum(pv_ct) AS BIGINT) AS pv_ct,
         CAST(sum(sv_ct) AS BIGINT) AS sv_ct, CAST(sum(uj_ct) AS BIGINT) AS uj_ct, CAST(sum(dur_sum) AS BIGINT) AS dur_sum, epoch_us(min(ts)) // 1000 AS ts FROM v GROUP BY ALL)"""


def _pages(spark, sf) -> DataFrame:
    e = s.page_logs(spark, sf)
    return logs.pages(e, F.col("is_start"))


def _unique(spark, sf) -> DataFrame:
    return visits.unique_visits(_pages(spark, sf).withColumn("mid", F.col("common.mid")), "mid", "event_time", ["event_time", "event_id"])


def _jumps(spark, sf) -> DataFrame:
    rows = _pages(spark, sf).withColumn("mid", F.col("common.mid"))
    return visits.jumps(rows, "mid", "event_time", logs.entry_page(), 3600, ["event_id"])


def _visitor_stats(spark, sf) -> DataFrame:
    rows = measures.united(measures.page_views(_pages(spark, sf)), measures.visits(_unique(spark, sf)), measures.bounces(_jumps(spark, sf)))
    return windows.visitor_window(rows, "1 hour")


def _stored_visitors(spark, sf) -> DataFrame:
    return _stored(spark, sf, "visitors", _visitor_stats)


@query(f"WITH {_LOG}, {_UV} SELECT event_id, mid, strftime(ts, '%Y-%m-%d') AS day FROM uv")
def unique_visit_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _unique(spark, sf).select("event_id", "mid", F.date_format("event_time", "yyyy-MM-dd").alias("day"))


@query(f"WITH {_LOG}, {_UJ} SELECT event_id, mid FROM uj")
def user_jump(spark: SparkSession, sf: str) -> DataFrame:
    return _jumps(spark, sf).select("event_id", "mid")


@query(f"WITH {_VISITORS} SELECT * FROM vs")
def visitor_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _visitor_stats(spark, sf)


VISIT_DAY = 20240110
_VISIT_SQL = "stt >= '2024-01-10' AND stt < '2024-01-11'"
_BY_NEW = f"WITH {_VISITORS}, n AS (SELECT is_new, CAST(sum(uv_ct) AS BIGINT) AS uv_ct, CAST(sum(pv_ct) AS BIGINT) AS pv_ct, CAST(sum(sv_ct) AS BIGINT) AS sv_ct, CAST(sum(uj_ct) AS BIGINT) AS uj_ct, CAST(sum(dur_sum) AS BIGINT) AS dur_sum FROM vs WHERE {_VISIT_SQL} GROUP BY is_new)"


@query(f"{_BY_NEW} SELECT * FROM n")
def visitor_by_new(spark: SparkSession, sf: str) -> DataFrame:
    return serving.visitors_by_new(_stored_visitors(spark, sf), VISIT_DAY)


def _half_up(top: str, digits: int) -> str:
    """Whole-number division rounded half up, exactly."""
    scale = 10**digits
    return f"CASE WHEN sv_ct = 0 THEN 0 ELSE ((2 * ({top}) * {scale} + sv_ct) // (2 * sv_ct)) END"


@query(f"{_BY_NEW} SELECT *, CAST(CAST({_half_up('uj_ct * 100', 2)} AS DECIMAL(20,2)) / 100 AS DECIMAL(20,2)) AS uj_rate, CAST(CAST((({_half_up('dur_sum', 0)}) + 50) // 100 AS DECIMAL(20,1)) / 10 AS DECIMAL(20,1)) AS dur_per_sv, CAST(CAST({_half_up('pv_ct', 2)} AS DECIMAL(20,2)) / 100 AS DECIMAL(20,2)) AS pv_per_sv FROM n")
def visitor_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return serving.visitor_ratios(_stored_visitors(spark, sf), VISIT_DAY)


_HOURS = f"WITH {_VISITORS}, h AS (SELECT CAST(substr(stt, 12, 2) AS INTEGER) AS hr, CAST(sum(uv_ct) AS BIGINT) AS uv_ct, CAST(sum(pv_ct) AS BIGINT) AS pv_ct, CAST(sum(CASE WHEN is_new = '1' THEN uv_ct ELSE 0 END) AS BIGINT) AS new_uv FROM vs WHERE {_VISIT_SQL} GROUP BY 1)"


@query(f"{_HOURS} SELECT * FROM h ORDER BY hr")
def visitor_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    return serving.visitors_by_hour(_stored_visitors(spark, sf), VISIT_DAY)


@query(f"{_HOURS} SELECT lpad(CAST(i AS VARCHAR), 2, '0') AS hr, coalesce(uv_ct, 0) AS uv_ct, coalesce(pv_ct, 0) AS pv_ct, coalesce(new_uv, 0) AS new_uv FROM range(24) t(i) LEFT JOIN h ON hr = i")
def hour_dense(spark: SparkSession, sf: str) -> DataFrame:
    return serving.visitors_by_hour(_stored_visitors(spark, sf), VISIT_DAY, dense=True)


# Logs.


@query(f"WITH {_LOG} SELECT event_id, mid, is_new, CASE WHEN is_new = '1' AND row_number() OVER (PARTITION BY mid, is_new ORDER BY ts, event_id) > 1 THEN '0' ELSE is_new END AS is_new_fixed FROM e")
def is_new_fix(spark: SparkSession, sf: str) -> DataFrame:
    out = logs.repair_is_new(s.page_logs(spark, sf), "common.mid", "common.is_new", ["ts", "event_id"])
    return out.select("event_id", "common.mid", "common.is_new", "is_new_fixed")


@query(f"WITH {_LOG} SELECT event_id, mid FROM e WHERE event_type = 'signup'")
def log_split_start(spark: SparkSession, sf: str) -> DataFrame:
    return logs.starts(s.page_logs(spark, sf), F.col("is_start")).select("event_id", "common.mid")


@query(f"WITH {_LOG} SELECT event_id, mid, CASE WHEN event_type = 'click' THEN 'good_detail' ELSE event_type END AS page_id, item, during AS during_time FROM e WHERE event_type <> 'signup'")
def log_split_page(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("event_id", "common.mid", "page.page_id", "page.item", "page.during_time")


@query(f"WITH {_LOG} SELECT event_id, CAST(CAST(item AS INTEGER) + i AS VARCHAR) AS item, CASE WHEN i = 1 THEN 'sku_id' ELSE 'activity_id' END AS item_type FROM e, (VALUES (1), (2)) t(i) WHERE event_type <> 'signup' AND CAST(item AS INTEGER) % 4 = 0")
def display_explode(spark: SparkSession, sf: str) -> DataFrame:
    return logs.displays(_pages(spark, sf), ["event_id"]).select("event_id", "display.item", "display.item_type")


@query("SELECT event_id % 10 = 0 AS dirty, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def dirty_split(spark: SparkSession, sf: str) -> DataFrame:
    e = s.table(spark, sf, "events")
    doc = F.to_json(F.struct(F.struct(F.col("user_id").cast("string").alias("mid")).alias("common"), F.struct(F.col("event_type").alias("page_id")).alias("page"), F.col("event_id").alias("ts")))
    broken = F.when(F.col("event_id") % 20 == 0, F.col("event_type")).otherwise(F.concat(F.lit("{"), doc))
    split = logs.split_dirty(e.select("event_id", F.when(F.col("event_id") % 10 == 0, broken).otherwise(doc).alias("value")))
    parts = [rows.agg(F.lit(d).alias("dirty"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")) for d, rows in ((False, split.clean), (True, split.dirty))]
    return parts[0].unionByName(parts[1]).where("n > 0")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.from_json("props", "map<string,string>")
    return s.table(spark, sf, "events").select("event_id", doc["k"].cast("bigint").alias("k"))


@query("SELECT event_id, json_object('event_id', event_id, 'event_type', event_type, 'user_id', user_id) AS value FROM events")
def to_json_text(spark: SparkSession, sf: str) -> DataFrame:
    own = s.table(spark, sf, "events").select("event_id", "event_type", "user_id")
    return own.select("event_id", F.to_json(F.struct("event_id", "event_type", "user_id")).alias("value"))


@query(f"SELECT event_id, strftime(time_bucket(INTERVAL 10 SECOND, ts), {SHOWN}) AS stt, strftime(time_bucket(INTERVAL 10 SECOND, ts) + INTERVAL 10 SECOND, {SHOWN}) AS edt FROM events")
def tumble_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return s.table(spark, sf, "events").select("event_id", F.window("ts", "10 seconds").alias("window")).select("event_id", *t.window_bounds())


# Keywords.

_WORDS = f"w AS (SELECT lang, source, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS keyword FROM documents WHERE lang = 'en')"


def _keyword_rows(spark, sf) -> DataFrame:
    docs = s.table(spark, sf, "documents").select(F.create_map(F.lit("item"), "text", F.lit("item_type"), F.lit("keyword"), F.lit("last_page_id"), F.when(F.col("lang") == "en", "search").otherwise("home")).alias("page"), "doc_id")
    found = windows.searches(docs)
    own = found.select(F.explode(text.latin_words(F.translate(F.col("page")["item"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).alias("word"), F.timestamp_seconds((F.col("doc_id") % 7) * 86400).alias("event_time"))
    return own


@query(f"{_WORDS.replace('w AS (SELECT lang, source,', 'WITH w AS (SELECT doc_id,')} SELECT keyword, count(*) AS ct, 'search' AS source, strftime(TIMESTAMP '1970-01-01' + to_days(CAST(doc_id % 7 AS INTEGER)), {SHOWN}) AS stt, strftime(TIMESTAMP '1970-01-02' + to_days(CAST(doc_id % 7 AS INTEGER)), {SHOWN}) AS edt FROM w GROUP BY ALL")
def keyword_stats(spark: SparkSession, sf: str) -> DataFrame:
    return windows.keyword_window(_keyword_rows(spark, sf), KEYWORD_SOURCE, "1 day")


@query("WITH w AS (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS word FROM part) SELECT word, count(*) AS ct FROM w GROUP BY word")
def keyword_split_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The table function in a lateral join of SQL."""
    text.register_splitter(spark)
    s.table(spark, sf, "part").createOrReplaceTempView("tidemill_part")
    return spark.sql("select word, count(*) as ct from tidemill_part, lateral split_kw(p_name) group by word")


_WEIGHED = "SELECT p_brand AS keyword, CASE p_size % 5 WHEN 0 THEN 'SEARCH' WHEN 1 THEN 'ORDER' WHEN 2 THEN 'CART' WHEN 3 THEN 'CLICK' ELSE 'search' END AS source, p_size AS ct FROM part"


@query(f"SELECT keyword, CAST(sum(w.ct * CASE source WHEN 'SEARCH' THEN 10 WHEN 'ORDER' THEN 3 WHEN 'CART' THEN 2 WHEN 'CLICK' THEN 1 ELSE 0 END) AS BIGINT) AS ct FROM ({_WEIGHED}) w GROUP BY keyword ORDER BY sum(w.ct) DESC, keyword LIMIT 20")
def keyword_weighted(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_size") % 5
    source = F.when(kind == 0, "SEARCH").when(kind == 1, "ORDER").when(kind == 2, "CART").when(kind == 3, "CLICK").otherwise("search")
    rows = s.table(spark, sf, "part").select(F.col("p_brand").alias("keyword"), source.alias("source"), F.col("p_size").cast("bigint").alias("ct"), F.lit("2024-01-01 00:00:00").alias("stt"))
    return serving.keywords(rows, 20240101)


# Change records.

_CONFIG = [
    ("click", "insert", "kafka", "dwd_click", "id,user", "id", None), ("view", "insert", "hbase", "dim_view", "id,k", "id", None), ("view", "update", "hbase", "dim_view", "id,k", "id", None),
    ("signup", "insert", "clickhouse", "nowhere", "id", None, None), ("purchase", "delete", "kafka", "dwd_purchase", "id", None, None),
]


def _changes(spark, sf) -> DataFrame:
    e = s.table(spark, sf, "events")
    data = F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))
    op = F.when(F.col("event_id") % 3 == 0, "UPDATE").when(F.col("event_id") % 3 == 1, "CREATE").otherwise("read")
    records = e.select(F.concat(F.lit("server.shop."), "event_type").alias("topic"), op.alias("op"), F.when(F.col("event_id") % 3 == 0, data).alias("before"), data.alias("after"))
    return routing.envelope(records)


def _routed(spark, sf) -> DataFrame:
    config = spark.createDataFrame(_CONFIG, "source_table string, operate_type string, sink_type string, sink_table string, sink_columns string, sink_pk string, sink_extend string")
    return routing.routed(_changes(spark, sf), config)


_TYPE = "CASE event_id % 3 WHEN 0 THEN 'update' WHEN 1 THEN 'insert' ELSE 'read' END"


@query(f"SELECT 'shop' AS database, event_type AS \"table\", {_TYPE} AS type, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 0 END AS before_size FROM events")
def cdc_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).select("database", "table", "type", F.col("data")["id"].alias("id"), F.size("before-data").alias("before_size"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_, 'dwd_click' AS sink_table FROM events WHERE event_type = 'click' AND event_id % 3 = 1")
def config_route_fact(spark: SparkSession, sf: str) -> DataFrame:
    return routing.facts(_routed(spark, sf)).select(F.col("data")["id"].alias("id"), F.col("data")["user"].alias("user_"), "sink_table")


@query("SELECT CAST(event_id AS VARCHAR) AS id, json_extract_string(props, '$.k') AS k, 2 AS columns, 'dim_view' AS sink_table FROM events WHERE event_type = 'view' AND event_id % 3 <> 2")
def config_route_dim(spark: SparkSession, sf: str) -> DataFrame:
    return routing.dimensions(_routed(spark, sf)).select(F.col("data")["id"].alias("id"), F.col("data")["k"].alias("k"), F.size("data").alias("columns"), "sink_table")


@query("SELECT event_id, 'id,k' AS names, CAST(event_id AS VARCHAR) AS id, json_extract_string(props, '$.k') AS k FROM events")
def column_whitelist(spark: SparkSession, sf: str) -> DataFrame:
    e = s.table(spark, sf, "events").withColumn("list", F.lit("id,k, user,ID"))
    data = F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))
    kept = e.withColumn("data", routing.whitelist(data, F.col("list")))
    return kept.select("event_id", F.array_join(F.map_keys("data"), ",").alias("names"), F.col("data")["id"].alias("id"), F.col("data")["k"].alias("k"))


@query("SELECT event_id FROM events WHERE event_id % 4 IN (1, 2)")
def nonempty_payload(spark: SparkSession, sf: str) -> DataFrame:
    e = s.table(spark, sf, "events")
    data = F.when(F.col("event_id") % 4 == 1, "{}").when(F.col("event_id") % 4 == 2, F.col("props")).when(F.col("event_id") % 4 == 3, "")
    return routing.nonempty(e.select("event_id", data.alias("data"))).select("event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 UNION ALL SELECT -1, -1, 'old'")
def dim_latest_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A dimension of old rows after all events as changes; one old row has no change."""
    e = s.table(spark, sf, "events")
    old = e.select("user_id").distinct().select("user_id", F.lit(-1).cast("bigint").alias("event_id"), F.lit("old").alias("event_type"))
    old = old.unionByName(spark.createDataFrame([(-1, -1, "old")], "user_id long, event_id long, event_type string"))
    return routing.upserted(old, e, "user_id", ["ts", "event_id"])


# Streams over the same tables; each answer is a stored copy of what the stream gave.


def _run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is and hands back its result, kept as files; of complete results, the last one."""
    spark = stream.sparkSession
    folder = _folder(spark, "stream")
    numbers_: list[int] = []

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        numbers_.append(number)

    writer = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    if not numbers_:
        return spark.createDataFrame([], stream.schema)
    done = numbers_ if mode == "append" else numbers_[-1:]
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/out/batch={n}" for n in done])


def _stream(spark, sf, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return streams.table_files(spark, sf, schema, f"{name}.parquet")


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS stt, count(*) AS pv_ct, CAST(sum(trunc(value)) AS BIGINT) AS dur_sum FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 SECOND FROM events) GROUP BY ALL")
def stream_visitor_window(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that the watermark has closed; their state is given up and later rows of theirs would be dropped."""
    e = _stream(spark, sf, "events").withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", "10 seconds")
    agg = e.groupBy(F.window("event_time", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("pv_ct"), F.sum(F.col("value").cast("bigint")).alias("dur_sum"))
    return _run(agg.select("event_type", t.shown(F.col("window.start")).alias("stt"), "pv_ct", "dur_sum"))


@query(f"SELECT o_orderkey AS order_id, l_linenumber AS detail_id, l_partkey AS sku_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate - INTERVAL 5 DAY AND l_shipdate <= o_orderdate + INTERVAL 5 DAY")
def stream_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    o = _stream(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("timestamp").alias("order_time")).withWatermark("order_time", "1 second")
    d = _stream(spark, sf, "lineitem").select(F.col("l_orderkey").alias("_order"), F.col("l_linenumber").alias("detail_id"), F.col("l_partkey").alias("sku_id"), F.col("l_shipdate").cast("timestamp").alias("detail_time")).withWatermark("detail_time", "1 second")
    out = joins.interval_join(o, d, F.col("order_id") == F.col("_order"), "order_time", "detail_time", "-5 days", "5 days")
    return _run(out.select("order_id", "detail_id", "sku_id"))


@query("SELECT CAST(user_id AS VARCHAR) AS mid, strftime(ts, '%Y-%m-%d') AS day, count(*) > 0 AS seen FROM events GROUP BY 1, 2")
def stream_unique_visit(spark: SparkSession, sf: str) -> DataFrame:
    e = _stream(spark, sf, "events").select(F.col("user_id").cast("string").alias("mid"), F.col("ts").cast("timestamp").alias("event_time"))
    return _run(stateful.unique_visits(e, "mid", "event_time")).select("mid", F.date_format("event_time", "yyyy-MM-dd").alias("day"), F.lit(True).alias("seen"))


@query(f"WITH {_LOG} SELECT event_id, mid, CASE WHEN is_new = '1' AND row_number() OVER (PARTITION BY mid, is_new ORDER BY ts, event_id) > 1 THEN '0' ELSE is_new END AS is_new_fixed FROM e")
def stream_is_new_fix(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = _stream(spark, sf, "events")
    flag = F.when(F.col("event_type").isin("signup", "view"), "1").otherwise("0")
    out = stateful.repair_is_new(e, F.col("user_id"), flag, F.unix_micros(F.col("ts").cast("timestamp")), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    return _run(out).select(F.col("value").cast("bigint").alias("event_id"), F.col("key").alias("mid"), "is_new_fixed")


_MARK = "(SELECT max(ts) - INTERVAL 1 SECOND FROM e WHERE event_type <> 'signup')"


@query(f"WITH {_LOG}, {_UJ} SELECT event_id, mid FROM uj WHERE next_ts <= {_MARK} OR ts + INTERVAL 1 HOUR <= {_MARK}")
def stream_user_jump(spark: SparkSession, sf: str) -> DataFrame:
    """Bounces that the watermark has decided."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = _stream(spark, sf, "events").where("event_type <> 'signup'").withColumn("event_time", F.col("ts").cast("timestamp"))
    out = stateful.jumps(e, F.col("user_id"), "event_time", F.col("event_type") == "view", F.lpad(F.col("event_id").cast("string"), 20, "0"), 3600)
    return _run(out).select(F.col("value").cast("bigint").alias("event_id"), F.col("key").alias("mid"))


# Names, tables and answers.


@query('SELECT n_nationkey AS "nNationkey", n_name AS "nName", n_regionkey AS "nRegionkey" FROM nation')
def camel_names(spark: SparkSession, sf: str) -> DataFrame:
    return names.camel_columns(s.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("SELECT p_brand AS keyword, CAST(sum(p_size) AS BIGINT) AS ct FROM part GROUP BY p_brand")
def json_view_sql(spark: SparkSession, sf: str) -> DataFrame:
    """SQL over JSON text that is registered as a view with an event time."""
    rows = s.table(spark, sf, "part").select(F.col("p_brand").alias("keyword"), F.col("p_size").alias("ct"), F.lit("2024-01-01 00:00:03").alias("stt"))
    streams.json_view(streams.as_json(rows), "keyword_stats", "tidemill_keywords", F.to_timestamp("stt"))
    return spark.sql("select keyword, sum(ct) as ct from tidemill_keywords group by keyword, window(rowtime, '10 seconds')")


@query("SELECT CAST(sum(CAST(p_retailprice AS DECIMAL(16,2))) AS DECIMAL(36,2)) AS order_amount FROM part")
def gmv_of_today(spark: SparkSession, sf: str) -> DataFrame:
    """Without a date the dashboard asks for today."""
    part = s.table(spark, sf, "part")
    return serving.gmv(part.select(F.date_format(F.current_date(), "yyyy-MM-dd 00:00:00").alias("stt"), F.col("p_retailprice").cast("decimal(16,2)").alias("order_amount")))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def dimension_table(spark: SparkSession, sf: str) -> DataFrame:
    """A dimension's table, made from its configured columns and filled with text."""
    table = f"tidemill_dim_{uuid.uuid4().hex}"
    routing.create_dimension(spark, table, "id,name", None, f"LOCATION '{_folder(spark, 'dimension')}'")
    s.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")).write.insertInto(table)
    return spark.table(table)


@query("SELECT CASE WHEN event_id % 3 = 2 THEN 'read' WHEN event_id % 3 = 1 THEN 'insert' ELSE 'delete' END AS type, event_type AS \"table\", CAST(event_id AS VARCHAR) AS id FROM events")
def change_records_json(spark: SparkSession, sf: str) -> DataFrame:
    """Change records as JSON text, bare and in a payload, as envelopes."""
    e = s.table(spark, sf, "events")
    op = F.when(F.col("event_id") % 3 == 0, "d").when(F.col("event_id") % 3 == 1, "c").otherwise("r")
    image = F.struct(F.col("event_id").alias("id"), "user_id")
    record = F.struct(F.when(op == "d", image).alias("before"), F.when(op != "d", image).alias("after"), F.struct(F.lit("shop").alias("db"), F.col("event_type").alias("table")).alias("source"), op.alias("op"))
    text_ = F.when(F.col("event_id") % 2 == 0, F.to_json(record)).otherwise(F.to_json(F.struct(record.alias("payload"))))
    rows = routing.envelope(streams.change_records(e.select(text_.alias("value")).unionByName(e.limit(1).select(F.lit("{}").alias("value")))))
    return rows.select("type", "table", F.coalesce(F.col("data")["id"], F.col("before-data")["id"]).alias("id"))


@query(f"WITH {_SALES} SELECT 0 AS status, CAST(sum(order_amount) AS DOUBLE) AS data FROM sales WHERE {_DAY_SQL}")
def answer_gmv(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([serving.gmv_answer(serving.gmv(_sales(spark, sf), DAY))], "status int, data double")


def _top_answer_sql(keys: str, name: str) -> str:
    return f"SELECT {name} AS name, CAST(order_amount AS DOUBLE) AS value FROM ({_top_sql(keys)})"


@query(_top_answer_sql("tm_id, tm_name", "tm_name"))
def answer_trademark(spark: SparkSession, sf: str) -> DataFrame:
    data = serving.bar_answer(serving.top_trademarks(_sales(spark, sf), DAY))["data"]
    return spark.createDataFrame(list(zip(data["categories"], data["series"][0]["data"], strict=True)), "name string, value double")


@query(_top_answer_sql("category3_id, category3_name", "category3_name"))
def answer_category3(spark: SparkSession, sf: str) -> DataFrame:
    data = serving.pairs_answer(serving.top_categories(_sales(spark, sf), DAY), "category3_name", "order_amount")["data"]
    return spark.createDataFrame([(x["name"], x["value"]) for x in data], "name string, value double")


@query(f"{_HOURS} SELECT lpad(CAST(i AS VARCHAR), 2, '0') AS hr, CAST(coalesce(uv_ct, 0) AS DOUBLE) AS uv, CAST(coalesce(pv_ct, 0) AS DOUBLE) AS pv FROM range(24) t(i) LEFT JOIN h ON hr = i")
def answer_hours(spark: SparkSession, sf: str) -> DataFrame:
    data = serving.hours_answer(serving.visitors_by_hour(_stored_visitors(spark, sf), VISIT_DAY, dense=True))["data"]
    uv, pv = (x["data"] for x in data["series"][:2])
    return spark.createDataFrame([(h, float(a), float(b)) for h, a, b in zip(data["categories"], uv, pv, strict=True)], "hr string, uv double, pv double")
