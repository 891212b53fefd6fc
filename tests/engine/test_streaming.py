"""Streams give what the stored forms give, late and disordered rows included."""

import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import time as t
from tidemill.operators import joins, logs, measures, visits, windows
from tidemill.schemas import CONFIG
from tidemill.sources import sinks, streams
from tidemill.streaming import jobs, stateful

T0 = dt.datetime(2024, 1, 1)
NAMES = itertools.count()


@pytest.fixture(autouse=True)
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def replay(spark, tmp_path, rows, schema, build, mode="append"):
    """Files of rows, one a batch, through a stream; the result's rows."""
    folder = tmp_path / f"in{next(NAMES)}"
    folder.mkdir()
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
        for f in (folder / f"{i:03d}").glob("*.parquet"):
            f.rename(folder / f"{i:03d}.parquet")
    # a file's time decides its turn
    import os

    for i, f in enumerate(sorted(folder.glob("*.parquet"))):
        os.utime(f, (1_000_000 + i, 1_000_000 + i))
    stream = streams.table_files(spark, str(folder), schema, "*.parquet", 1)
    name = f"out{next(NAMES)}"
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_bounces_out_of_order(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for k in range(12):
        s = 0.0
        for _ in range(rng.randrange(1, 12)):
            s += rng.choice([1, 3, 9, 9.999, 10, 11, 40])
            rows.append((f"m{k}", at(s), rng.random() < 0.6, f"{k}-{s}"))
    flush = [("zz", at(100_000), False, "flush")], [("zz", at(200_000), False, "flush2")]
    rows.sort(key=lambda r: (r[1].timestamp() + rng.uniform(-4, 4)))
    parts = [rows[i : i + 15] for i in range(0, len(rows), 15)]
    schema = "mid string, at timestamp, entry boolean, value string"
    got = replay(spark, tmp_path, [*parts, *flush], schema, lambda s: stateful.jumps(s, F.col("mid"), "at", F.col("entry"), F.col("value"), 10, "10 seconds"))
    want = visits.jumps(spark.createDataFrame(rows, schema), "mid", "at", F.col("entry"), 10, ["value"])
    assert sorted(r["value"] for r in got) == sorted(r["value"] for r in want.collect())


def test_new_flags_by_arrival(spark, tmp_path):
    rows = [[("m", "0", 5, "a"), ("m", "1", 6, "b")], [("m", "1", 1, "c"), ("n", "1", 9, "d")], [("n", "1", 2, "e"), ("n", "0", 3, "f")]]
    got = replay(spark, tmp_path, rows, "mid string, f string, ts long, v string", lambda s: stateful.repair_is_new(s, F.col("mid"), F.col("f"), F.col("ts"), F.col("v")))
    assert {r["value"]: r["is_new_fixed"] for r in got} == {"a": "0", "b": "1", "c": "0", "d": "1", "e": "0", "f": "0"}


def test_daily_visits(spark, tmp_path):
    rows = [[("m", at(5)), ("n", at(6))], [("m", at(50)), ("m", at(86400 + 5))], [("n", at(7))]]
    got = replay(spark, tmp_path, rows, "mid string, at timestamp", lambda s: stateful.unique_visits(s, "mid", "at"))
    assert sorted((r["mid"], r["at"]) for r in got) == [("m", at(5)), ("m", at(86405)), ("n", at(6))]


def test_windows_close_and_drop_late_rows(spark, tmp_path):
    rows = [[(5, at(1), 1), (5, at(2), 1), (5, at(12), 2)], [(5, at(30), 3)], [(5, at(3), 4)], [(5, at(100), 9)]]

    def build(s):
        s = measures.product_row(s.withWatermark("at", "1 second"), "sku", "at", "order", "o", order_amount=10)
        return windows.product_window(s)

    got = replay(spark, tmp_path, rows, "sku long, at timestamp, o long", build)
    assert sorted((r["stt"][-5:], int(r["order_amount"]), r["order_ct"]) for r in got) == [("00:00", 20, 1), ("00:10", 10, 1), ("00:30", 10, 1)]


def test_join_then_window(spark, tmp_path):
    rows = [[("o", 1, at(10)), ("d", 1, at(5)), ("d", 1, at(15)), ("d", 1, at(16))], [("o", 2, at(500)), ("d", 2, at(500))], [("o", 9, at(900)), ("d", 9, at(900))]]

    def build(s):
        s = s.withWatermark("at", "1 second")
        o = s.where("kind = 'o'").select(F.col("id").alias("a"), F.col("at").alias("oat"))
        d = s.where("kind = 'd'").select(F.col("id").alias("b"), F.col("at").alias("dat"))
        both = joins.interval_join(o, d, F.col("a") == F.col("b"), "oat", "dat", "-5 seconds", "5 seconds")
        return both.groupBy(F.window("dat", "10 seconds")).count().select(*t.window_bounds(), "count")

    got = replay(spark, tmp_path, rows, "kind string, id long, at timestamp", build)
    assert {("00:00:00", 1), ("00:00:10", 1)} <= {(r["stt"][-8:], r["count"]) for r in got}


def test_log_job(spark, tmp_path):
    folder, out = tmp_path / "raw", str(tmp_path / "out")
    folder.mkdir()
    page = {"common": {"mid": "m", "is_new": "1"}, "page": {"page_id": "p"}, "displays": [{"item": "1", "item_type": "sku_id"}, {"item": "2", "item_type": "sku_id"}], "ts": 1}
    (folder / "a.log").write_text("\n".join([json.dumps(page), json.dumps({"common": {"mid": "m"}, "start": {"entry": "x"}, "ts": 2}), "junk"]))
    jobs.log_job(streams.text_files(spark, str(folder)), out, str(tmp_path / "cp")).awaitTermination()
    counts = {n: spark.read.parquet(f"{out}/{n}").count() for n in ("dirty", "dwd_start_log", "dwd_page_log", "dwd_display_log")}
    assert counts == {"dirty": 1, "dwd_start_log": 1, "dwd_page_log": 1, "dwd_display_log": 2}
    assert logs.entry_page("page.last_page_id") is not None


def test_change_job_follows_its_configuration(spark, tmp_path):
    schema = "`table` string, type string, data map<string,string>, offset long"
    folder, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    routes = [[("t", "insert", "hbase", "dim_t", "id,n", "id", None), ("f", "insert", "kafka", "dwd_f", "id", None, None)]]
    config = lambda: spark.createDataFrame(routes[0], CONFIG)
    stream = lambda: streams.table_files(spark, str(folder), schema)
    spark.createDataFrame([("t", "insert", {"id": "1", "n": "a", "x": "-"}, 1), ("t", "insert", {"id": "1", "n": "b"}, 2), ("f", "insert", {"id": "7", "y": "-"}, 3), ("f", "insert", {}, 4)], schema).write.parquet(str(folder))
    jobs.change_job(stream(), config, out, cp).awaitTermination()
    assert [tuple(r) for r in sinks.current(spark, f"{out}/dim_t")[1].collect()] == [("1", "b")]
    assert [(r["sink_table"], r["value"]) for r in spark.read.parquet(f"{out}/facts").collect()] == [("dwd_f", '{"id":"7"}')]
    with pytest.raises(ValueError, match="orders them"):
        jobs.change_job(stream().drop("offset"), config, out, cp)
    routes[0] = routes[0][:1]
    spark.createDataFrame([("t", "insert", {"id": "2", "n": "c"}, 5), ("f", "insert", {"id": "8"}, 6)], schema).write.mode("append").parquet(str(folder))
    jobs.change_job(stream(), config, out, cp).awaitTermination()
    assert sorted(tuple(r) for r in sinks.current(spark, f"{out}/dim_t")[1].collect()) == [("1", "b"), ("2", "c")]
    assert spark.read.parquet(f"{out}/facts").count() == 1


def test_summary_job(spark, tmp_path):
    folder = tmp_path / "in"
    schema = "word string, event_time timestamp"
    spark.createDataFrame([("w", at(1)), ("w", at(2)), ("x", at(50))], schema).coalesce(1).write.parquet(str(folder))
    s = streams.table_files(spark, str(folder), schema).withWatermark("event_time", "1 second")
    q = jobs.summary_job(windows.keyword_window(s, "search"), "keyword_stats", str(tmp_path / "k"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "k")).collect()
    assert [(r["keyword"], r["ct"], str(r["day"])) for r in got] == [("w", 2, "2024-01-01")] and got[0]["ts"] > 0


def test_json_view_in_sql(spark):
    rows = spark.createDataFrame([('{"keyword":"a","ct":2,"stt":"2024-01-01 00:00:03"}',)], "value string")
    streams.json_view(rows, "keyword_stats", "tidemill_view", F.to_timestamp("stt"))
    assert spark.sql("select sum(ct) s, window(rowtime, '10 seconds').start w from tidemill_view group by window(rowtime, '10 seconds')").first()["s"] == 2
