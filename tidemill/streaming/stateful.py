"""Operators that keep state for each key of a stream. Their stored forms are in ``operators``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

PAYLOAD = StructType([StructField("ts", LongType()), StructField("entry", LongType()), StructField("value", StringType())])


class FirstClaim(StatefulProcessor):
    """Of a key's rows that claim to be new, the first to arrive stays so. Rows of one batch come in order of (ts, value)."""

    def init(self, handle) -> None:
        self.claimed = handle.getValueState("claimed", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r["ts"], r["value"])):
            flag = r["is_new"]
            if flag == "1":
                if self.claimed.exists():
                    flag = "0"
                else:
                    self.claimed.update((r["ts"],))
            yield Row(key=key[0], ts=r["ts"], is_new=r["is_new"], is_new_fixed=flag, value=r["value"])

    def close(self) -> None:
        pass


def repair_is_new(logs: DataFrame, key: Column, flag: Column, ts_ms: Column, value: Column) -> DataFrame:
    """(key, ts, is_new, is_new_fixed, value) for each log."""
    rows = logs.select(key.alias("key"), ts_ms.cast("bigint").alias("ts"), flag.alias("is_new"), value.alias("value"))
    out = "key string, ts bigint, is_new string, is_new_fixed string, value string"
    return rows.withColumn("key", F.col("key").cast("string")).groupBy("key").transformWithState(FirstClaim(), out, "append", "none")


class Jumps(StatefulProcessor):
    """Entry pages that no other page follows in time.

    Rows wait until the watermark has passed them and are then taken in order
    of (ts, value), so that the order of arrival does not matter. An entry row
    is pending until the next row, or until the watermark leaves it behind.
    """

    def __init__(self, within_ms: int):
        self.within = within_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PAYLOAD)
        self.pending = handle.getValueState("pending", PAYLOAD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        for r in rows:
            if r["ts"] > passed:  # later ones than that are late
                self.waiting.appendValue((r["ts"], int(r["entry"]), r["value"]))
                self.handle.registerTimer(r["ts"])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: (x[0], x[2]))
        ready, rest = [x for x in held if x[0] <= now], [x for x in held if x[0] > now]
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        pending = tuple(self.pending.get()) if self.pending.exists() else None
        out = []
        for ts, entry, value in ready:
            if pending and (ts - pending[0] >= self.within or entry):
                out.append(pending)
            pending = (ts, entry, value) if entry else None
        if pending and now >= pending[0] + self.within:
            out.append(pending)
            pending = None
        if pending:
            self.pending.update(pending)
            self.handle.registerTimer(pending[0] + self.within)
        else:
            self.pending.clear()
        for ts, _, value in out:
            yield Row(key=key[0], ts=ts, value=value)

    def close(self) -> None:
        pass


def jumps(logs: DataFrame, key: Column, ts: str, entry: Column, value: Column, within_seconds: int, watermark: str = "1 second") -> DataFrame:
    """(key, ts, value) of each bounce; ts is a timestamp column of a stream without a watermark yet."""
    rows = logs.withWatermark(ts, watermark).select(
        key.cast("string").alias("key"), F.unix_millis(ts).alias("ts"), F.coalesce(entry, F.lit(False)).alias("entry"), value.alias("value"), F.col(ts).alias("at")
    )
    return rows.groupBy("key").transformWithState(Jumps(1000 * within_seconds), "key string, ts bigint, value string", "append", "eventTime")


def unique_visits(logs: DataFrame, key: str, ts: str, keep: str = "1 day") -> DataFrame:
    """The first row to arrive of each key and day; state is kept for ``keep`` behind the watermark."""
    rows = logs.withWatermark(ts, keep).withColumn("_day", F.to_date(ts))
    return rows.dropDuplicatesWithinWatermark([key, "_day"]).drop("_day")
