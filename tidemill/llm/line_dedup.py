"""Line dedup over levelled sorted runs of line hashes.

A ledger of line keys is kept as sorted runs: tables in buckets by the key,
each bucket sorted by it. Every batch of documents is reduced to one row a
key, dealt to the same buckets, merge-anti-joined with the runs there are, and
added as a run of its own; only the batch moves, the runs are read as they
lie. Keys that no run holds become *owned* rows with the batch's largest
document; keys that one does hold add only to its count. When a level has
``fanout`` runs they are merged, bucket by bucket, into one of the next level.
Batches come in descending order of document id, so an owner is the largest
document that holds the key.

Defined results: a null or empty text is one empty line; a null id's lines are
neither counted nor dropped; rows that repeat an id are one document, whose
lines are counted once and lost from all its rows or none; rows that tie in id
and text are all kept; very long texts are read whole; other columns, whatever
their names, are not looked at; ids must be whole numbers or null; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtext import as_binary, batch_of, map_slices
from .store import sorted_run, written

#: White space stripped from both ends of a line.
STRIPPED = b"\x20\x09\x0a\x0b\x0c\x0d"
KEYS = ["h1", "h2"]


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit key of a line; None if the line is too short to have one."""
    key = line.strip(STRIPPED)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.lower())


def line_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(h1, h2, id): one row for each key of each document."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64())])

    def step():
        def apply(batch):
            digests, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), as_binary(batch.column(1)).to_pylist(), strict=True):
                if doc is None:
                    continue
                own = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
                digests += own
                ids += [doc] * len(own)
            pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            return batch_of(schema, pairs[:, 0].copy(), pairs[:, 1].copy(), ids)

        return apply

    return map_slices(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), step, "h1 long, h2 long, id long")


class RunLedger:
    """Levelled runs of (h1, h2, n, owner), each in sorted buckets by key."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout, self.levels = spark, fanout, {}
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels.values() for run in level]

    def batch(self, lines: DataFrame) -> DataFrame:
        """What ``add`` writes of a batch of (h1, h2, id) rows: (h1, h2, n, owner); rows with an owner are the keys no run holds."""
        own = lines.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("owner"))
        for run in self.runs():
            held = run.where("owner is not null").select(F.col("h1").alias("r1"), F.col("h2").alias("r2"))
            met = own.join(held.hint("merge"), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left")
            own = met.withColumn("owner", F.expr("if(r1 is null, owner, null)")).drop("r1", "r2")
        return own

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch as a run and returns that run."""
        run = self._written(self.batch(lines))
        self._put(0, run)
        return run

    def compacted(self) -> DataFrame | None:
        """One row a key: (h1, h2, n, owner) over all batches."""
        runs = self.runs()
        return self._merged(runs) if runs else None

    def _put(self, level: int, run: DataFrame) -> None:
        own = self.levels.setdefault(level, [])
        own.append(run)
        if len(own) >= self.fanout:
            self.levels[level] = []
            self._put(level + 1, self._written(self._merged(own)))

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """A merge of sorted runs: full joins on the key, which move nothing."""
        out = runs[0].select(*KEYS, "n", "owner")
        for run in runs[1:]:
            other = run.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("n").alias("rn"), F.col("owner").alias("rowner"))
            both = out.join(other.hint("merge"), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "full")
            n = F.coalesce("n", F.lit(0)) + F.coalesce("rn", F.lit(0))
            out = both.select(F.coalesce("h1", "r1").alias("h1"), F.coalesce("h2", "r2").alias("h2"), n.alias("n"), F.greatest("owner", "rowner").alias("owner"))
        return out

    def _written(self, run: DataFrame) -> DataFrame:
        # a bucket that is one file is sorted as a whole, which Spark makes use of only if told so
        order, parts = "spark.sql.legacy.bucketedTableScan.outputOrdering", "spark.sql.shuffle.partitions"
        before = {c: self.spark.conf.get(c, None) for c in (order, parts)}
        try:
            self.spark.conf.set(order, "true")
            self.spark.conf.set(parts, str(self.buckets))
            return sorted_run(run.select(*KEYS, "n", "owner"), "line-run", KEYS, self.buckets)
        finally:
            for c, x in before.items():
                self.spark.conf.unset(c) if x is None else self.spark.conf.set(c, x)


def by_document(lines: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """(h1, h2, id) rows with each key of an id once, where rows of the table repeat ids."""
    again = docs.groupBy(F.col(id_col).cast("long").alias("again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and again is not null").select("again")
    again = written(again, "repeated-ids")
    if again.isEmpty():
        return lines
    on = F.col("id") == F.col("again")
    return written(lines.join(again, on, "left_anti").unionByName(lines.join(again, on, "left_semi").distinct()), "lines")


def dropped_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(id, drop): for each document that loses lines, the keys it loses."""
    spark = docs.sparkSession
    lines = written(line_keys(docs, id_col, text_col, min_chars), "lines")
    lines = by_document(lines, docs, id_col)
    if lines.isEmpty():
        return lines.groupBy("id").agg(F.collect_list(F.struct(*KEYS)).alias("drop"))
    cuts = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    ledger = RunLedger(spark, fanout)
    for low, high in zip([*cuts, None], [None, *cuts], strict=True):
        batch = lines
        if low is not None:
            batch = batch.where(F.col("id") >= low)
        if high is not None:
            batch = batch.where(F.col("id") < high)
        ledger.add(batch)
    # a table of its own, so that a key with very many lines can be split where it meets them
    heavy = written(ledger.compacted().where(F.col("n") >= min_docs).select(*KEYS, "owner"), "heavy-lines")
    return lines.join(heavy.hint("merge"), KEYS).where("id < owner").groupBy("id").agg(F.collect_list(F.struct(*KEYS)).alias("drop"))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """(id_col, n_lines, n_dropped, text): every document without the lines that are kept elsewhere."""
    drops = dropped_keys(docs, id_col, text_col, min_chars, min_docs, batches, fanout)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(drops.hint("merge"), "id", "left").select(
        "id", "text", F.expr("transform(drop, x -> x.h1)").alias("d1"), F.expr("transform(drop, x -> x.h2)").alias("d2")
    )
    schema = pa.schema([("id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])

    def step():
        def apply(batch):
            out_n, out_d, out_t = [], [], []
            for text, a, b in zip(as_binary(batch.column(1)).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                lines = text.split(b"\n")
                kept = lines
                if a:
                    gone = {x.tobytes() for x in np.array([a, b], "<i8").T.copy()}
                    kept = [x for x in lines if line_key(x, min_chars) not in gone]
                out_n.append(len(lines))
                out_d.append(len(lines) - len(kept))
                out_t.append(b"\n".join(kept).decode("utf-8", "replace"))
            return batch_of(schema, batch.column(0), out_n, out_d, out_t)

        return apply

    out = map_slices(rows, step, "id long, n_lines long, n_dropped long, text string")
    return out.withColumnsRenamed({"id": id_col, "text": text_col} if id_col != "id" or text_col != "text" else {})


