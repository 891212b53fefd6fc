"""The dashboard's questions, asked of the summary tables, and the shapes of their answers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import bounce_rate, pages_per_session, seconds_per_session
from ..functions.time import SECONDS
from ..schemas import KEYWORD_WEIGHTS


def on_date(stats: DataFrame, date: int | None = None, stt: str = "stt") -> DataFrame:
    """Rows of a day, yyyymmdd; 0 or None is today. A range on stt, and the day of tables that are partitioned by it."""
    day = dt.datetime.strptime(str(date), "%Y%m%d") if date else dt.datetime.combine(dt.date.today(), dt.time())
    if "day" in stats.columns:  # the table's partitions
        stats = stats.where(F.col("day") == F.lit(day.strftime("%Y-%m-%d")).cast(dict(stats.dtypes)["day"]))
    low, high = (d.strftime("%Y-%m-%d %H:%M:%S") for d in (day, day + dt.timedelta(days=1)))
    if dict(stats.dtypes)[stt] == "string":
        return stats.where((F.col(stt) >= low) & (F.col(stt) < high))
    return stats.where((F.col(stt) >= F.lit(low).cast("timestamp")) & (F.col(stt) < F.lit(high).cast("timestamp")))


def gmv(product_stats: DataFrame, date: int | None = None) -> DataFrame:
    """One row; 0 for a day without sales."""
    return on_date(product_stats, date).agg(F.coalesce(F.sum("order_amount"), F.lit(0)).cast("decimal(36,2)").alias("order_amount"))


def _ranked(stats: DataFrame, keys: list[str], limit: int, *more: Column) -> DataFrame:
    sums = stats.groupBy(*keys).agg(F.sum("order_amount").alias("order_amount"), *more).where(F.col("order_amount") > 0)
    return sums.orderBy(F.desc("order_amount"), *keys).limit(limit)


def top_trademarks(product_stats: DataFrame, date: int | None = None, limit: int = 10) -> DataFrame:
    return _ranked(on_date(product_stats, date), ["tm_id", "tm_name"], limit)


def top_categories(product_stats: DataFrame, date: int | None = None, limit: int = 10) -> DataFrame:
    return _ranked(on_date(product_stats, date), ["category3_id", "category3_name"], limit)


def top_spus(product_stats: DataFrame, date: int | None = None, limit: int = 10) -> DataFrame:
    return _ranked(on_date(product_stats, date), ["spu_id", "spu_name"], limit, F.sum("order_ct").alias("order_ct"))


def province_totals(province_stats: DataFrame, date: int | None = None) -> DataFrame:
    own = on_date(province_stats, date).groupBy("province_id", "province_name").agg(F.sum("order_amount").alias("order_amount"))
    return own.select("province_name", "order_amount")


def visitors_by_new(visitor_stats: DataFrame, date: int | None = None) -> DataFrame:
    return on_date(visitor_stats, date).groupBy("is_new").agg(*[F.sum(m).alias(m) for m in ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum")])


def visitor_ratios(visitor_stats: DataFrame, date: int | None = None) -> DataFrame:
    ratios = {"uj_rate": bounce_rate(), "dur_per_sv": seconds_per_session(), "pv_per_sv": pages_per_session()}
    return visitors_by_new(visitor_stats, date).withColumns(ratios)


def visitors_by_hour(visitor_stats: DataFrame, date: int | None = None, dense: bool = False) -> DataFrame:
    """uv_ct, pv_ct and new_uv of each hour; dense: all 24 hours, labelled 00 to 23."""
    hour = F.hour(F.to_timestamp("stt", SECONDS)) if dict(visitor_stats.dtypes)["stt"] == "string" else F.hour("stt")
    new = F.when(F.col("is_new") == "1", F.col("uv_ct")).otherwise(0)
    own = on_date(visitor_stats, date).groupBy(hour.alias("hr")).agg(F.sum("uv_ct").alias("uv_ct"), F.sum("pv_ct").alias("pv_ct"), F.sum(new).alias("new_uv"))
    if not dense:
        return own.orderBy("hr")
    hours = visitor_stats.sparkSession.range(24).select(F.col("id").cast("int").alias("hr"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("uv_ct", "pv_ct", "new_uv")]
    return hours.join(own, "hr", "left").select(F.lpad(F.col("hr").cast("string"), 2, "0").alias("hr"), *filled).orderBy("hr")


def keywords(keyword_stats: DataFrame, date: int | None = None, limit: int = 20, normalize_source: bool = False) -> DataFrame:
    """Words by weighted count, in order of the count without weights. Sources are matched to the letter unless normalised."""
    source = F.upper("source") if normalize_source else F.col("source")
    weight = F.lit(0)
    for name, w in KEYWORD_WEIGHTS.items():
        weight = F.when(source == name, w).otherwise(weight)
    own = on_date(keyword_stats, date).groupBy("keyword").agg(F.sum(F.col("ct") * weight).alias("ct"), F.sum("ct").alias("_plain"))
    return own.orderBy(F.desc("_plain"), "keyword").limit(limit).drop("_plain")


# Answers. These collect what a chart shows: one row, a top list, or a row an hour, a province or a visitor kind.


def _answer(data) -> dict:
    return {"status": 0, "data": data}


def _number(x):
    return float(x) if x is not None else 0


def gmv_answer(rows: DataFrame) -> dict:
    return _answer(_number(rows.first()["order_amount"]))


def bar_answer(rows: DataFrame, name: str = "tm_name", value: str = "order_amount", series: str = "sales") -> dict:
    got = rows.collect()
    return _answer({"categories": [r[name] for r in got], "series": [{"name": series, "data": [_number(r[value]) for r in got]}]})


def pairs_answer(rows: DataFrame, name: str, value: str) -> dict:
    return _answer([{"name": r[name], "value": _number(r[value])} for r in rows.collect()])


def table_answer(rows: DataFrame, columns: dict[str, str]) -> dict:
    """columns: {id: title}."""
    got = [{c: _number(r[c]) if not isinstance(r[c], str | None) else r[c] for c in columns} for r in rows.collect()]
    return _answer({"columns": [{"name": title, "id": c} for c, title in columns.items()], "rows": got})


def map_answer(rows: DataFrame) -> dict:
    return _answer({"mapData": [{"name": r["province_name"], "value": _number(r["order_amount"])} for r in rows.collect()]})


def visitor_answer(ratios: DataFrame) -> dict:
    kinds = {"new": {}, "old": {}}
    for r in ratios.collect():
        kinds["new" if r["is_new"] == "1" else "old"] = r.asDict()
    titles = {"uv_ct": "users", "pv_ct": "pages", "uj_rate": "bounce rate (%)", "dur_per_sv": "seconds per session", "pv_per_sv": "pages per session"}
    rows = [{"type": title, **{k: _number(v.get(m)) for k, v in kinds.items()}} for m, title in titles.items()]
    return _answer({"columns": [{"name": c, "id": c} for c in ("type", "new", "old")], "rows": rows})


def hours_answer(dense: DataFrame) -> dict:
    got = dense.collect()
    series = {"uv": "uv_ct", "pv": "pv_ct", "new": "new_uv"}
    return _answer({"categories": [r["hr"] for r in got], "series": [{"name": n, "data": [_number(r[c]) for r in got]} for n, c in series.items()]})
