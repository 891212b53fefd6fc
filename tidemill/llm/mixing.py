"""Mixing sources to target weights.

Every document gets a hash-random key; documents are range-sorted by (source,
key); prefix sums of sizes run inside the sorted partitions and are lifted by
the totals of the partitions before; each source is cut where its budget ends.
A budget above a source's size repeats whole epochs first. The document on
the cut is taken if at least half of it fits, so a source misses its budget
by half a document at most. No source is gathered into one task.

Defined results: a null text has size 0; null sources are one source, last in
order; equal keys go by id, then size; rows that repeat an id are documents
of their own; sources without words get target 0; an empty table gives an
empty result. Only the one row a source is held by the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import as_binary, batch_of, map_batches, map_slices
from .store import partitions_for, written


def word_sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size): words are runs of anything but ASCII white space."""
    schema = pa.schema([("id", pa.int64()), ("source", pa.string()), ("size", pa.int64())])

    def step():
        # bytes.split() parts at exactly 0x20 and 0x09-0x0D
        return lambda b: batch_of(schema, b.column(0), b.column(1), [len(x.split()) for x in as_binary(b.column(2)).to_pylist()])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return map_slices(rows, step, "id long, source string, size long")


def targets(sizes: list[int], weights: list[float], max_epochs: int = 3) -> list[float]:
    """Shares of sum(sizes) by weight, none above max_epochs times its size; what is cut off is shared again."""
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: max_epochs * sizes[i] / weights[i])
    rest, weight = sum(sizes), sum(weights)
    for k, i in enumerate(order):
        if max_epochs * sizes[i] * weight >= rest * weights[i]:
            for j in order[k:]:
                out[j] = weights[j] * (rest / weight) if weight else 0.0
            break
        out[i] = float(max_epochs * sizes[i])
        rest -= max_epochs * sizes[i]
        weight -= weights[i]
    return out


def cycled(names: list, cycle: tuple = (1, 2, 3)) -> list[int]:
    return [cycle[i % len(cycle)] for i in range(len(names))]


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    cycle: tuple = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 17,
    partitions: int | None = None,
) -> DataFrame:
    """(id_col, size, source_size, target, copies, taken) for every document."""
    spark = docs.sparkSession
    key = F.substring(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 16)
    sizes = written(word_sizes(docs, id_col, source_col, text_col).withColumn("key", key), "mix-sizes")
    totals = sorted(((r["source"], r["s"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("s")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    budget = targets([s for _, s in totals], cycled(totals, cycle), max_epochs)
    book = spark.createDataFrame(
        [(i, name, s, t) for i, ((name, s), t) in enumerate(zip(totals, budget, strict=True))], "src int, name string, source_size long, target double"
    )
    n = partitions or partitions_for(sizes)
    dealt = sizes.join(book.select("src", "name"), F.col("source").eqNullSafe(F.col("name"))).select("src", "key", "id", "size")
    dealt = dealt.repartitionByRange(n, "src", "key", "id").sortWithinPartitions("src", "key", "id", "size")
    schema = pa.schema([("pid", pa.int32()), ("src", pa.int32()), ("id", pa.int64()), ("size", pa.int64()), ("before", pa.int64())])

    def prefix(batches):
        pid, last, total = TaskContext.get().partitionId(), -1, 0
        for b in batches:
            if not b.num_rows:
                continue
            src, size = b.column(0).to_numpy(), b.column(3).to_numpy()
            run = np.cumsum(size) - size
            heads = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
            lift = -run[heads]
            if src[0] == last:
                lift[0] += total
            before = run + np.repeat(lift, np.diff(np.append(heads, len(src))))
            last, total = src[-1], int(before[-1] + size[-1])
            yield batch_of(schema, np.full(len(src), pid, np.int32), b.column(0), b.column(2), b.column(3), before)

    runs = written(map_batches(dealt, prefix, "pid int, src int, id long, size long, before long"), "mix-runs")
    sums = runs.groupBy("pid", "src").agg(F.max(F.col("before") + F.col("size")).alias("own"))
    earlier = F.expr("coalesce(sum(own) over (partition by src order by pid rows between unbounded preceding and 1 preceding), 0)")
    lifts = sums.withColumn("lift", earlier).join(book, "src").select("pid", "src", "lift", "source_size", "target")
    epochs = F.expr("if(source_size = 0, 0L, cast(floor(target / source_size) as bigint))")
    return (
        runs.join(lifts, ["pid", "src"])
        .withColumn("epochs", epochs)
        .withColumn("copies", F.expr(f"least({max_epochs}L, epochs + if(before + lift + size / 2.0 <= target - epochs * source_size, 1L, 0L))"))
        .select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken. A repeated id is taken as its first row is."""
    copies = mix(docs, id_col=id_col, **options).groupBy(F.col(id_col).alias("_mix_id")).agg(F.max("copies").alias("_mix_copies"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own = F.col(f"c{docs.columns.index(id_col)}").cast("long")
    picked = plain.join(copies.where("_mix_copies > 0").hint("merge"), own.eqNullSafe(F.col("_mix_id")))
    copy = F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))
    return picked.withColumn("_mix_copy", copy).select(*plain.columns).toDF(*docs.columns)
