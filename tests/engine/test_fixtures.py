"""Hand-computed cases at the edges of each operator."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemill.functions import names, numbers, text
from tidemill.functions import time as t
from tidemill.operators import joins, logs, measures, routing, serving, visits, wide, windows
from tidemill.schemas import ALL, CONFIG, struct_of
from tidemill.sources import sinks, streams

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


LOGS = [
    '{"common":{"mid":"m1","vc":"v2","ch":"web","ar":"110000","is_new":"1"},"start":{"entry":"icon"},"ts":1704067200000}',
    '{"common":{"mid":"m1","vc":"v2","ch":"web","ar":"110000","is_new":"1"},"page":{"page_id":"good_detail","last_page_id":"","item":"7","item_type":"sku_id","during_time":1200},'
    '"displays":[{"item":"3","item_type":"sku_id"},{"item":"9","item_type":"activity_id"}],"ts":1704067201000}',
    "not-json",
]


def test_logs_from_text_to_product_rows(spark):
    raw = spark.createDataFrame([(x,) for x in LOGS], "value string")
    split = logs.split_dirty(raw)
    assert [r["value"] for r in split.dirty.collect()] == ["not-json"]
    fixed = logs.repair_is_new(split.clean, "common.mid", "common.is_new", ["ts"])
    assert [r[0] for r in fixed.orderBy("ts").select("is_new_fixed").collect()] == ["1", "0"]
    assert logs.starts(fixed).count() == 1
    pages = logs.pages(fixed).withColumn("event_time", t.exact_millis("ts"))
    assert logs.displays(pages).count() == 2
    rows = measures.united(measures.clicks(pages), measures.display_rows(pages))
    assert sorted((r["sku_id"], r["click_ct"], r["display_ct"]) for r in rows.collect()) == [(3, 0, 1), (7, 1, 0)]


WHOLE = ["{}", '{"common":null,"page":{}}', '{"common":{"mid":"m"}}', '{"page":{"page_id":"x"}}']


@pytest.mark.parametrize("text_", ["", "[]", "7", '{"common":{"mid":"m"},"page":{"page_id"', None])
def test_what_is_no_document_is_dirty(spark, text_):
    split = logs.split_dirty(spark.createDataFrame([(text_,)], "value string"))
    assert (split.clean.count(), split.dirty.count()) == (0, 1)


@pytest.mark.parametrize("text_", WHOLE)
def test_documents_without_their_parts_are_dirty_if_parts_are_required(spark, text_):
    raw = spark.createDataFrame([(text_,)], "value string")
    split, strict = logs.split_dirty(raw), logs.split_dirty(raw, required=logs.complete())
    assert (split.clean.count(), split.dirty.count(), strict.clean.count(), strict.dirty.count()) == (1, 0, 0, 1)


def test_logs_keep_fields_that_no_schema_names(spark):
    full = {"common": {"mid": "m", "uid": "9", "os": "x", "is_new": "1"}, "err": {"code": 3}, "actions": [{"a": 1}], "page": {"page_id": "p", "source_type": "q"}, "displays": [{"item": "1", "order": 2}, {"item": "2", "pos_id": 5}], "ts": 1}
    split = logs.split_dirty(spark.createDataFrame([(json.dumps(full),)], "value string"))
    assert json.loads(logs.pages(split.clean).first()["value"]) == full
    fixed = json.loads(split.clean.select(logs.fixed_text("value", F.lit("0")).alias("v")).first()["v"])
    assert fixed == {**full, "common": {**full["common"], "is_new": "0"}}
    shown = [json.loads(r["value"]) for r in logs.display_texts(split.clean).collect()]
    assert shown == [{"common": full["common"], "page": full["page"], "ts": 1, "display": d} for d in full["displays"]]


def test_change_records_and_replay(spark):
    record = lambda op, i, n, wrap=False: json.dumps({"payload": x} if wrap else x) if (x := {"before": None, "after": {"id": i, "n": n}, "source": {"db": "d", "table": "t"}, "op": op, "ts_ms": 5}) else None
    text_ = [record("c", 1, "a"), record("u", 2, "b", True), record("d", 3, "x"), "{}", "junk", None]
    rows = streams.change_records(spark.createDataFrame([(x, k) for k, x in enumerate(text_)], "value string, offset long"))
    assert sorted((r["offset"], r["topic"], r["op"], r["after"]["id"]) for r in rows.collect()) == [(0, "server.d.t", "create", "1"), (1, "server.d.t", "update", "2"), (2, "server.d.t", "delete", "3")]
    snapshot = spark.createDataFrame([(2, "old"), (3, "gone"), (4, None)], "id int, n string")
    read = streams.snapshot_records(snapshot, "d", "t")
    assert {(r["op"], r["after"]["id"], r["after"].get("n")) for r in read.collect()} == {("read", "2", "old"), ("read", "3", "gone"), ("read", "4", None)}
    plain = rows.select(F.col("after")["id"].cast("int").alias("id"), F.col("after")["n"].alias("n"), routing.operation("op").alias("type"), "offset")
    now = routing.replayed(snapshot, plain, ["id"], ["offset"])
    assert sorted(map(tuple, now.collect())) == [(1, "a"), (2, "b"), (4, None)]


def test_configuration_key_is_enforced(spark):
    with pytest.raises(ValueError, match="more than once"):
        routing.checked(spark.createDataFrame([ROUTES[0], ROUTES[0]], CONFIG))
    assert routing.checked(spark.createDataFrame(ROUTES, CONFIG)).count() == 3


def test_summaries_to_a_database_and_repeated_batches(spark, tmp_path):
    rows = spark.createDataFrame([("w", 1, "search", "2024-01-01 00:00:00", "e")], "keyword string, ct long, source string, stt string, edt string")
    url = "jdbc:derby:memory:tidemill_sums;create=true"
    for _ in range(2):
        sinks.jdbc_summary(windows.stamped(rows), "keyword_stats", url)
    got = spark.read.jdbc(url, "keyword_stats").collect()
    assert len(got) == 2 and all(r["ts"] > 1_700_000_000_000 for r in got)
    path = str(tmp_path / "k")
    for batch in (0, 1, 1, 0):
        sinks.append_summary(windows.stamped(rows), "keyword_stats", path, batch)
    assert spark.read.parquet(path).count() == 2


def test_fixed_offset_and_province_rows(spark):
    df = spark.createDataFrame([("2024-01-02 08:00:00",), ("x",)], "t string")
    assert [r[0] for r in df.select(t.to_millis_at("t")).collect()] == [1704153600000, None]
    row = spark.createDataFrame([("1", "n", "a", "i", "j", at(0), 7)], "province_id string, province_name string, province_area_code string, province_iso_code string, province_3166_2_code string, event_time timestamp, split_total_amount int")
    assert (lambda r: (r["order_amount"], r["order_count"]))(windows.province_rows(row).first()) == (7, 1)


def test_collector_answers_requests(tmp_path):
    import threading
    from urllib.parse import quote
    from urllib.request import urlopen

    sent = []
    server = streams.collector(str(tmp_path), forward=sent.append)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/applog"
    try:
        assert urlopen(f"{base}?param={quote(LOGS[0])}").read() == b"success"
        assert urlopen(base, data=f"param={quote(LOGS[1])}".encode()).read() == b"success"
    finally:
        server.shutdown()
    landed = [json.loads(x) for f in tmp_path.rglob("app.log") for x in f.read_text().splitlines()]
    assert landed == [json.loads(x) for x in LOGS[:2]] and sent == LOGS[:2]


def test_interval_join_edges(spark):
    o = spark.createDataFrame([(1, at(10))], "id long, a timestamp")
    d = spark.createDataFrame([(1, at(x)) for x in (4, 5, 15, 16)], "order_id long, b timestamp")
    got = joins.interval_join(o, d, F.col("id") == F.col("order_id"), "a", "b", "-5 seconds", "5 seconds")
    assert sorted(r["b"] for r in got.collect()) == [at(5), at(15)]
    p = spark.createDataFrame([(1, at(1200))], "id long, a timestamp")
    w = spark.createDataFrame([(1, at(x)) for x in (299, 300, 1200, 1201)], "order_id long, b timestamp")
    got = joins.interval_join(p, w, F.col("id") == F.col("order_id"), "a", "b", "-15 minutes", "0 seconds")
    assert sorted(r["b"] for r in got.collect()) == [at(300), at(1200)]


def test_bounces(spark):
    rows = [("m", at(0), True, 1), ("m", at(4), True, 2), ("m", at(6), False, 3), ("m", at(20), True, 4), ("m", at(30), False, 5), ("n", at(0), True, 6), ("n", at(9.999), False, 7)]
    df = spark.createDataFrame(rows, "mid string, at timestamp, entry boolean, id long")
    for span in (None, 10, 7):
        got = visits.jumps(df, "mid", "at", F.col("entry"), 10, ["id"], span)
        assert sorted(r["id"] for r in got.collect()) == [1, 4]


def test_bounces_over_span_borders(spark):
    rows = [("m", at(86400 * 0 + 239), True, 1), ("m", at(241), False, 2), ("m", at(479), True, 3), ("m", at(481), True, 4)]
    got = visits.jumps(spark.createDataFrame(rows, "mid string, at timestamp, entry boolean, id long"), "mid", "at", F.col("entry"), 10, ["id"])
    assert sorted(r["id"] for r in got.collect()) == [3, 4]


def test_daily_visits_over_midnight(spark):
    rows = [("m1", at(-1), 1), ("m1", at(1), 2), ("m1", at(43200), 3)]
    got = visits.unique_visits(spark.createDataFrame(rows, "mid string, at timestamp, id long"), "mid", "at", ["at", "id"])
    assert sorted(r["id"] for r in got.collect()) == [1, 2]


def test_new_flags_in_order(spark):
    df = spark.createDataFrame([("m1", f, i) for i, f in enumerate("0110")], "mid string, is_new string, i long")
    got = logs.repair_is_new(df, "mid", "is_new", ["i"]).orderBy("i").collect()
    assert [r["is_new_fixed"] for r in got] == ["0", "1", "0", "0"]


def test_window_edges_and_order_counts(spark):
    rows = spark.createDataFrame([(5, at(9.999), "order", 1, 100), (5, at(10), "order", 1, 100), (5, at(10.5), "order", 1, 100), (5, at(11), "paid", 2, 7)], "sku long, at timestamp, kind string, o long, a int")
    parts = [measures.product_row(rows.where(f"kind = '{k}'"), "sku", "at", k, "o", **{m: "a"}) for k, m in (("order", "order_amount"), ("paid", "payment_amount"))]
    got = windows.product_window(measures.united(*parts)).orderBy("stt").collect()
    assert [(r["stt"][-2:], r["edt"][-2:], int(r["order_amount"]), r["order_ct"], r["paid_order_ct"], r["refund_order_ct"]) for r in got] == [("00", "10", 100, 1, 0, 0), ("10", "20", 200, 1, 1, 0)]


def test_missing_dimension(spark):
    f = spark.createDataFrame([(1, "old"), (2, "old"), (None, "old")], "sku_id long, sku_name string")
    d = spark.createDataFrame([("1", "new")], "id string, sku_name string")
    assert [r["sku_name"] for r in joins.enrich(f, d, "sku_id", {"sku_name": "sku_name"}).collect()] == ["new"]
    assert joins.enrich(f, d, "sku_id", {"sku_name": "sku_name"}, how="left").count() == 3


def test_ratios(spark):
    row = spark.createDataFrame([(3, 7, 2, 10, 12345), (1, 0, 0, 0, 0)], "uv_ct long, sv_ct long, uj_ct long, pv_ct long, dur_sum long")
    got = row.select(numbers.bounce_rate(), numbers.seconds_per_session(), numbers.pages_per_session()).collect()
    assert [tuple(map(str, r)) for r in got] == [("28.57", "1.8", "1.43"), ("0.00", "0.0", "0.00")]


def stats(spark):
    rows = [("2024-01-02 05:00:00", f"{i}", f"b{i}", a) for i, a in enumerate((0, 5, 9))]
    return spark.createDataFrame(rows, "stt string, tm_id string, tm_name string, order_amount int").withColumn("order_amount", F.col("order_amount").cast("decimal(16,2)"))


def test_having_and_limit(spark):
    got = serving.top_trademarks(stats(spark), 20240102, 1)
    assert [(r["tm_name"], int(r["order_amount"])) for r in got.collect()] == [("b2", 9)]
    assert serving.top_trademarks(stats(spark), 20240103, 5).count() == 0
    assert serving.gmv_answer(serving.gmv(stats(spark), 20240103)) == {"status": 0, "data": 0.0}
    bars = serving.bar_answer(serving.top_trademarks(stats(spark), 20240102))
    assert bars["data"]["categories"] == ["b2", "b1"] and bars["data"]["series"][0]["data"] == [9.0, 5.0]


def test_today_by_default(spark):
    now = dt.date.today().strftime("%Y-%m-%d 00:00:00")
    df = stats(spark).withColumn("stt", F.lit(now))
    assert int(serving.gmv(df).first()[0]) == 14 and int(serving.gmv(df, 0).first()[0]) == 14


def test_dense_hours_and_answers(spark):
    v = spark.createDataFrame([("2024-01-02 05:10:00", "1", 2, 3, 1, 0, 10), ("2024-01-02 05:20:00", "0", 1, 1, 1, 1, 10)], "stt string, is_new string, uv_ct long, pv_ct long, sv_ct long, uj_ct long, dur_sum long")
    got = serving.visitors_by_hour(v, 20240102, dense=True).collect()
    assert len(got) == 24 and tuple(got[5]) == ("05", 3, 4, 2) and all(tuple(r)[1:] == (0, 0, 0) for r in got if r["hr"] != "05")
    answer = serving.hours_answer(serving.visitors_by_hour(v, 20240102, dense=True))
    assert len(answer["data"]["categories"]) == 24 and answer["data"]["series"][0]["data"][5] == 3
    table = serving.visitor_answer(serving.visitor_ratios(v, 20240102))["data"]
    assert [r["type"] for r in table["rows"]] == ["users", "pages", "bounce rate (%)", "seconds per session", "pages per session"]
    assert table["rows"][0] == {"type": "users", "new": 2.0, "old": 1.0}


def test_keyword_weights_and_order(spark):
    k = spark.createDataFrame([("a", "SEARCH", 1), ("b", "search", 5)], "keyword string, source string, ct long").withColumn("stt", F.lit("2024-01-02 00:00:00"))
    assert [tuple(r) for r in serving.keywords(k, 20240102).collect()] == [("b", 0), ("a", 10)]
    assert [tuple(r) for r in serving.keywords(k, 20240102, normalize_source=True).collect()] == [("b", 50), ("a", 10)]


CHANGES = [
    ("base_trademark", "insert", {"id": "13", "tm_name": "sh", "logo": "x"}),
    ("base_trademark", "update", {"id": "13", "tm_name": "sh2", "logo": "x"}),
    ("unknown", "insert", {"id": "1"}),
]
ROUTES = [
    ("base_trademark", "insert", "hbase", "dim_base_trademark", "id,tm_name", "id", None),
    ("base_trademark", "update", "hbase", "dim_base_trademark", "id,tm_name", "id", None),
    ("order_info", "insert", "kafka", "dwd_order_info", "id,user_id", None, None),
]


def test_routing_and_upsert(spark, tmp_path):
    changes = spark.createDataFrame([(a, b, c, i) for i, (a, b, c) in enumerate(CHANGES)], "`table` string, type string, data map<string,string>, offset long")
    config = spark.createDataFrame(ROUTES, CONFIG)
    routed = routing.routed(changes, config)
    assert routing.facts(routed).count() == 0 and routing.config_conflicts(config).count() == 0
    dims = routing.dimensions(routed)
    assert all(set(r["data"]) == {"id", "tm_name"} for r in dims.collect())
    rows = dims.select(F.col("data")["id"].alias("id"), F.col("data")["tm_name"].alias("tm_name"), "offset")
    path = str(tmp_path / "dim")
    sinks.upsert_dimension(routing.latest(rows, ["id"], ["offset"]).drop("offset"), path)
    assert [tuple(r) for r in sinks.current(spark, path)[1].collect()] == [("13", "sh2")]
    sinks.upsert_dimension(spark.createDataFrame([("13", "sh3"), ("14", "n")], "id string, tm_name string"), path)
    version, held = sinks.current(spark, path)
    assert version == 1 and sorted(map(tuple, held.collect())) == [("13", "sh3"), ("14", "n")]


def test_operations_and_payloads(spark):
    df = spark.createDataFrame([("create",), ("READ",), ("Update",), ("delete",)], "op string")
    assert [r[0] for r in df.select(routing.operation("op")).collect()] == ["insert", "read", "update", "delete"]
    assert [r[0] for r in df.select(routing.operation("op", read_as_insert=True)).collect()][1] == "insert"
    data = spark.createDataFrame([("",), ("{}",), (None,), ('{"a":1}',)], "data string")
    assert routing.nonempty(data).count() == 2


def test_dimension_tables(spark, tmp_path):
    assert [(f.name, f.nullable) for f in routing.dimension_schema("id,tm_name")] == [("id", False), ("tm_name", True)]
    assert [(f.name, f.nullable) for f in routing.dimension_schema("a,b", "b")] == [("a", True), ("b", False)]
    for _ in range(2):
        routing.create_dimension(spark, "tidemill_dim_test", "id,tm_name", None, f"LOCATION '{tmp_path}/t'")
    assert spark.table("tidemill_dim_test").columns == ["id", "tm_name"]
    spark.sql("drop table tidemill_dim_test")


def test_payment_wide_overwrites(spark):
    o = wide.timed(spark.createDataFrame([(1, 2, "s", 3, "2024-01-01 00:00:00")], "id long, province_id long, order_status string, user_id long, create_time string"))
    o = o.withColumns({c: F.lit(5).cast("decimal(16,2)") for c in ("total_amount", "activity_reduce_amount", "coupon_reduce_amount", "original_total_amount", "feight_fee")})
    d = wide.timed(spark.createDataFrame([(9, 1, 7, 2, "n", "2024-01-01 00:00:04")], "id long, order_id long, sku_id long, sku_num long, sku_name string, create_time string"))
    d = d.withColumns({c: F.lit(5).cast("decimal(16,2)") for c in ("order_price", "split_activity_amount", "split_coupon_amount", "split_total_amount")})
    p = wide.timed(spark.createDataFrame([(77, 1, 33, "sub", "pay", "2024-01-01 00:10:00", "cb")], "id long, order_id long, user_id long, subject string, payment_type string, create_time string, callback_time string")).withColumn("total_amount", F.lit(99).cast("decimal(16,2)"))
    w = wide.order_detail(o, d)
    assert len(w.collect()) == 1 and w.first()["split_feight_fee"] is None
    r = wide.payment_wide(p, w).first()
    assert (r["payment_id"], r["user_id"], int(r["total_amount"]), r["order_create_time"], r["payment_create_time"]) == (77, 33, 99, "2024-01-01 00:00:00", "2024-01-01 00:10:00")
    assert not {"create_date", "create_hour", "expire_time", "operate_time"} & set(wide.payment_wide(p, w).columns)


def test_time_functions(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05", "1990-01-01", 1704164645999), ("x", "nonsense", 0)], "create_time string, b string, ms long")
    got = df.limit(1).withColumns(t.create_parts()).select("create_date", "create_hour", "create_ts", t.age("b", "2024-01-01"), t.shown(t.from_millis("ms"))).first()
    assert tuple(got) == ("2024-01-02", "03", 1704164645000, 34, "2024-01-02 03:04:05")
    assert df.select(t.age("b", "2024-01-01")).collect()[1][0] == 0
    assert df.select(t.date_number(F.to_timestamp(F.lit("2024-01-02 03:04:05")))).first()[0] == 20240102


def test_words():
    assert text.segmented("Apple iPhone13 手机壳", frozenset({"手机", "手机壳"})) == ["apple", "iphone13", "手机壳", "手机"]
    assert text.segmented("好的 x", frozenset()) == ["好", "的", "x"]
    assert text.segmented(None) == [] and text.segmented("--") == []


def test_names_and_schemas(spark):
    assert names.camel("TM_NAME_X") == "tmNameX"
    assert names.camel_columns(spark.range(1).toDF("sku_id")).columns == ["skuId"]
    assert len(struct_of("product_stats")) == 25 and len(struct_of("visitor_stats")) == 12 and len(struct_of("province_stats")) == 10 and len(struct_of("keyword_stats")) == 6
    assert all(struct_of(n) for n in ALL)


def test_typed_json_and_sink_order(spark):
    rows = spark.createDataFrame([('{"sku_id": 7, "sku_num": 3, "create_time": "x", "more": 1}',)], "value string")
    assert tuple(streams.typed(rows, "dwd_cart_info").first()) == (7, 3, "x")
    out = sinks.in_sink_order(spark.createDataFrame([(1, "w")], "ct int, keyword string"), "keyword_stats")
    assert out.columns == [f.name for f in struct_of("keyword_stats")] and tuple(out.first())[:2] == ("w", 1)


def test_summary_table_is_read_by_day(spark, tmp_path):
    rows = spark.createDataFrame([("w", 1, "search", f"2024-01-0{d} 00:00:00", "e", 0) for d in (1, 2)], "keyword string, ct long, source string, stt string, edt string, ts long")
    sinks.append_summary(rows, "keyword_stats", str(tmp_path / "k"))
    got = serving.keywords(spark.read.parquet(str(tmp_path / "k")), 20240102)
    assert got.count() == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PartitionFilters: []" not in plan


def test_collector(tmp_path, spark):
    assert streams.collect_log(str(tmp_path), LOGS[0], "2024-01-01") == "success"
    streams.collect_log(str(tmp_path), "not-json", "2024-01-01")
    raw = spark.read.text(str(tmp_path)).select("value")
    split = logs.split_dirty(raw)
    assert (split.clean.count(), split.dirty.count()) == (1, 1)
    assert json.loads(raw.where("value like '{%'").first()[0])["ts"] == 1704067200000


def test_database_rows_in_either_case(spark):
    url = "jdbc:derby:memory:tidemill;create=true"
    spark.createDataFrame([(1, "x"), (2, "y")], "SKU_ID int, TM_NAME string").write.jdbc(url, "dims", mode="overwrite")
    got = streams.jdbc_table(spark, url, "select SKU_ID, TM_NAME from dims")
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, "y")] and got.columns == ["sku_id", "tm_name"]
    assert streams.jdbc_table(spark, url, "select SKU_ID, TM_NAME from dims", camel=True).columns == ["skuId", "tmName"]
    parts = streams.jdbc_table(spark, url, "select SKU_ID, TM_NAME from dims", partitionColumn="SKU_ID", lowerBound="1", upperBound="2", numPartitions="2")
    assert parts.count() == 2
    with pytest.raises(Exception, match="NOWHERE|nowhere"):
        streams.jdbc_table(spark, url, "select * from nowhere").collect()
