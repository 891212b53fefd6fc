"""One row of measures for each business event, in one shape, so that streams of them can be united."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import APPRAISE_GOOD
from .logs import displays, entry_page

MONEY = "decimal(16,2)"
#: Summed measures of a product, and the orders counted once each.
PRODUCT = {
    "display_ct": "bigint", "click_ct": "bigint", "favor_ct": "bigint", "cart_ct": "bigint", "order_sku_num": "bigint", "order_amount": MONEY,
    "payment_amount": MONEY, "refund_amount": MONEY, "comment_ct": "bigint", "good_comment_ct": "bigint",
}
ORDERS = {"order": "order_ct", "paid": "paid_order_ct", "refund": "refund_order_ct"}
VISITOR = ["uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"]
VISITOR_KEYS = ["vc", "ch", "ar", "is_new"]


def product_row(rows: DataFrame, sku, ts, kind: str | None = None, order_id=None, **measures) -> DataFrame:
    """(sku_id, event_time, order_kind, order_id, measures); measures that are not given are 0."""
    as_col = lambda x: F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
    own = [F.coalesce(as_col(measures.get(m, 0)), F.lit(0)).cast(t).alias(m) for m, t in PRODUCT.items()]
    return rows.select(
        as_col(sku).try_cast("bigint").alias("sku_id"), as_col(ts).alias("event_time"), F.lit(kind).cast("string").alias("order_kind"),
        (as_col(order_id) if order_id is not None else F.lit(None)).try_cast("bigint").alias("order_id"), *own,
    )


def clicks(page_logs: DataFrame, ts="event_time") -> DataFrame:
    hit = (F.col("page.page_id") == "good_detail") & (F.col("page.item_type") == "sku_id")
    return product_row(page_logs.where(hit), "page.item", ts, click_ct=1)


def display_rows(page_logs: DataFrame, ts: str = "event_time") -> DataFrame:
    shown = displays(page_logs, [ts]).where(F.col("display.item_type") == "sku_id")
    return product_row(shown, "display.item", ts, display_ct=1)


def favors(rows: DataFrame, ts="event_time") -> DataFrame:
    return product_row(rows, "sku_id", ts, favor_ct=1)


def carts(rows: DataFrame, ts="event_time") -> DataFrame:
    """A cart counts its quantity."""
    return product_row(rows, "sku_id", ts, cart_ct="sku_num")


def ordered(wide: DataFrame, ts="event_time", amount: str = "total_amount") -> DataFrame:
    """By default each detail row counts its whole order's amount."""
    return product_row(wide, "sku_id", ts, "order", "order_id", order_sku_num="sku_num", order_amount=amount)


def paid(wide: DataFrame, ts="event_time", amount: str = "total_amount") -> DataFrame:
    return product_row(wide, "sku_id", ts, "paid", "order_id", payment_amount=amount)


def refunds(rows: DataFrame, ts="event_time") -> DataFrame:
    return product_row(rows, "sku_id", ts, "refund", "order_id", refund_amount="refund_amount")


def comments(rows: DataFrame, ts="event_time") -> DataFrame:
    good = F.when(F.col("appraise") == APPRAISE_GOOD, 1).otherwise(0)
    return product_row(rows, "sku_id", ts, comment_ct=1, good_comment_ct=good)


def visitor_row(logs: DataFrame, ts="event_time", common: str = "common", **measures) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    keys = [F.col(f"{common}.{k}" if common else k).alias(k) for k in VISITOR_KEYS]
    return logs.select(*keys, F.col(ts).alias("event_time"), *[F.coalesce(as_col(measures.get(m, 0)), F.lit(0)).cast("bigint").alias(m) for m in VISITOR])


def page_views(page_logs: DataFrame, ts="event_time", last_page="page.last_page_id", during="page.during_time", common: str = "common") -> DataFrame:
    """A page view; a session too if it is an entry page."""
    return visitor_row(page_logs, ts, common, pv_ct=1, sv_ct=F.when(entry_page(last_page), 1).otherwise(0), dur_sum=F.col(during))


def visits(unique: DataFrame, ts="event_time", common: str = "common") -> DataFrame:
    return visitor_row(unique, ts, common, uv_ct=1)


def bounces(jumps: DataFrame, ts="event_time", common: str = "common") -> DataFrame:
    return visitor_row(jumps, ts, common, uj_ct=1)


def united(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, repeats included."""
    return reduce(DataFrame.unionByName, parts)
