"""Where streams come from and go to. Kafka and JDBC need their connector on the class path; files need nothing."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import camel_columns, lower_columns
from ..schemas import struct_of


def kafka_text(spark: SparkSession, servers: str, topic: str, group: str | None = None, starting: str = "latest") -> DataFrame:
    """A topic's values as text, with topic, partition, offset and time. The position is kept in the query's checkpoint."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    rows = (reader.option("groupIdPrefix", group) if group else reader).load()
    return rows.select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset", "timestamp")


def text_files(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of files that arrive in a folder, as a stream of ``value``."""
    reader = spark.readStream.format("text")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(folder)


def table_files(spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files that arrive in a folder."""
    reader = spark.readStream.format("parquet").schema(schema)
    for key, value in (("pathGlobFilter", pattern), ("maxFilesPerTrigger", files_per_batch)):
        if value:
            reader = reader.option(key, value)
    return reader.load(folder)


def socket_text(spark: SparkSession, host: str, port: int) -> DataFrame:
    """For trying things out."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def typed(rows: DataFrame, table: str, value: str = "value") -> DataFrame:
    """JSON text as the columns of a known table; other columns are kept."""
    doc = F.from_json(F.col(value), struct_of(table))
    return rows.select(*[c for c in rows.columns if c != value], doc.alias("_doc")).select(*[c for c in rows.columns if c != value], "_doc.*")


def json_view(rows: DataFrame, table: str, name: str, rowtime, delay: str = "1 second", value: str = "value") -> DataFrame:
    """Registers JSON text as a view with a computed ``rowtime`` and its watermark; for SQL over streams."""
    view = typed(rows, table, value).withColumn("rowtime", rowtime)
    view = view.withWatermark("rowtime", delay) if view.isStreaming else view
    view.createOrReplaceTempView(name)
    return view


#: Operations of change records by their letters.
OPERATIONS = {"c": "create", "u": "update", "d": "delete", "r": "read"}


def change_records(rows: DataFrame, server: str = "server", value: str = "value") -> DataFrame:
    """Change records in Debezium's JSON, bare or in a ``payload``: (topic, op, before, after, ts_ms), other columns kept.

    topic is server.database.table, images are maps of text; what is no change
    record (a tombstone, a heartbeat) is left out. ``envelope`` takes it from here.
    """
    image = "map<string,string>"
    record = f"before {image}, after {image}, source struct<db: string, `table`: string>, op string, ts_ms bigint"
    doc = F.from_json(value, f"{record}, payload struct<before: {image}, after: {image}, source: struct<db: string, `table`: string>, op: string, ts_ms: bigint>")
    rows = rows.withColumn("_doc", doc)
    own = {c: F.coalesce(f"_doc.payload.{c}", f"_doc.{c}") for c in ("before", "after", "source", "op", "ts_ms")}
    kept = [c for c in rows.columns if c not in (value, "_doc", "topic", "op", "before", "after", "ts_ms")]
    rows = rows.select(*kept, *[x.alias(c) for c, x in own.items()]).where("op is not null and source is not null")
    name = F.coalesce(*[F.when(F.col("op") == k, F.lit(v)) for k, v in OPERATIONS.items()], F.col("op"))
    return rows.select(*kept, F.concat_ws(".", F.lit(server), "source.db", "source.table").alias("topic"), name.alias("op"), "before", "after", "ts_ms")


def snapshot_records(rows: DataFrame, database: str, table: str, server: str = "server") -> DataFrame:
    """A table's rows as a snapshot's records (op read), to go before its changes."""
    image = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in rows.columns]), lambda x: x["v"].isNotNull()))
    none = F.lit(None).cast("map<string,string>")
    return rows.select(F.lit(f"{server}.{database}.{table}").alias("topic"), F.lit("read").alias("op"), none.alias("before"), image.alias("after"), F.lit(None).cast("bigint").alias("ts_ms"))


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls left out."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def jdbc_table(spark: SparkSession, url: str, query: str, camel: bool = False, **options: str) -> DataFrame:
    """A query's rows from a database, names in lower case or camel case. Errors reach the caller.

    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``
    read it in parallel.
    """
    rows = spark.read.format("jdbc").options(url=url, **({"dbtable": f"({query}) q"} if "partitionColumn" in options else {"query": query}), **options).load()
    return camel_columns(rows) if camel else lower_columns(rows)


def collector(folder: str, port: int = 0, forward: Callable[[str], None] | None = None) -> HTTPServer:
    """A server for ``/applog?param=<json>`` (GET or POST): each document goes to today's landing file and to ``forward``.

    ``serve_forever`` runs it; port 0 picks a free one.
    """

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlsplit(self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode() if self.command == "POST" else ""
            text = (parse_qs(url.query).get("param") or parse_qs(body).get("param") or [None])[0]
            if url.path != "/applog" or text is None:
                self.send_error(404)
                return
            answer = collect_log(folder, text, dt.date.today().isoformat())
            if forward:
                forward(text)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer.encode())

        do_POST = do_GET

        def log_message(self, *_):
            pass

    return HTTPServer(("127.0.0.1", port), Handler)


def collect_log(folder: str, text: str, day: str) -> str:
    """A collector's action for one request: appends the document to the day's landing file and answers."""
    target = Path(folder) / f"day={day}"
    target.mkdir(parents=True, exist_ok=True)
    with (target / "app.log").open("a", encoding="utf-8") as out:
        out.write(json.dumps(json.loads(text), ensure_ascii=False) + "\n" if text.lstrip().startswith("{") else text + "\n")
    return "success"
