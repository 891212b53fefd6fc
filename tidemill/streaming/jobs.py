"""Jobs with several outputs: each micro-batch is held once, divided, and written with its batch id, so that a repeated batch replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import logs, routing, windows
from ..sources import sinks


def _put(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def log_job(raw: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Raw behaviour logs to dirty, start, page and display tables under ``out``; each row has its whole document as ``value``."""

    def step(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            split = logs.split_dirty(held)
            pages = logs.pages(split.clean)
            _put(split.dirty, f"{out}/dirty", number)
            _put(logs.starts(split.clean), f"{out}/dwd_start_log", number)
            _put(pages, f"{out}/dwd_page_log", number)
            _put(logs.display_texts(pages), f"{out}/dwd_display_log", number)
        finally:
            held.unpersist()

    return raw.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_job(
    envelopes: DataFrame, config: Callable[[], DataFrame], out: str, checkpoint: str, order: str = "offset", fact_sink: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Change envelopes (data: map) to fact tables and dimensions, by the configuration as it is when a batch starts.

    A route that was deleted stops routing, one that was added starts with the
    next batch. Facts, rows of (sink_table, value), go to a folder a table under
    ``facts``, or to ``fact_sink``, which may write each to its topic. ``order``
    is the column that tells which of a key's changes is the last.
    """
    if order not in envelopes.columns:
        raise ValueError(f"changes need a column {order!r} that orders them")

    def step(batch: DataFrame, number: int) -> None:
        routes = routing.routed(batch.where(F.size("data") > 0), routing.checked(config())).persist()
        try:
            facts = routing.facts(routes).select("sink_table", F.to_json("data").alias("value"))
            fact_sink(facts, number) if fact_sink else sinks.put_batch(facts, f"{out}/facts", number, ["sink_table"])
            dims = routing.dimensions(routes)
            for row in dims.select("sink_table", "sink_pk").distinct().collect():  # one row a configured dimension
                own = dims.where(F.col("sink_table") == row["sink_table"])
                names = sorted({c for r in config().where(F.col("sink_table") == row["sink_table"]).select("sink_columns").collect() for c in r[0].split(",")})
                own = own.withColumn("_order", F.col(order))
                rows = own.select(*[F.col("data")[c].alias(c) for c in names], "_order")
                key = row["sink_pk"] or "id"
                sinks.upsert_dimension(routing.latest(rows, [key], ["_order"]).drop("_order"), f"{out}/{row['sink_table']}", key)
        finally:
            routes.unpersist()

    return envelopes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary_job(rows: DataFrame, table: str, path: str, checkpoint: str) -> StreamingQuery:
    """Finished windows to a summary table, with the time of processing where they have no time of their own; a repeated batch replaces itself."""
    step = lambda batch, number: sinks.append_summary(windows.stamped(batch), table, path, number)
    return rows.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint).start()
