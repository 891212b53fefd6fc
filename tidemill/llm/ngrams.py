"""Hashed character n-grams of whole texts, counted in numpy; TF-IDF statistics over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import LOWER, map_batches, map_slices, slices, translated

#: Odd 32-bit multipliers of a character's place in an n-gram.
_PLACE = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
DIM_BITS = 15


def counts(column: pa.Array, orders: tuple[int, ...], lower: bool = True, bits: int = DIM_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text: the buckets of its character n-grams, ascending, and how often each occurs."""
    texts = translated(column, LOWER if lower else bytes(range(256)))
    sizes = pc.utf8_length(texts).to_numpy()
    ends = np.cumsum(sizes)
    joined = "".join(texts.to_pylist())
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    if not lower:
        chars = chars.copy()
    hashed = []
    for n in orders:
        h = np.full(max(0, len(chars) - n + 1), n, np.uint32)
        for k in range(n):
            h ^= (chars[k : len(chars) - n + 1 + k] + np.uint32(k + 1)) * _PLACE[k]
            h = (h << np.uint32(5)) | (h >> np.uint32(27))
        hashed.append(((h * np.uint32(0x2545F491)) >> np.uint32(32 - bits)).astype(np.uint16 if bits <= 16 else np.uint32))
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        own = np.concatenate([h[a : max(a, b - n + 1)] for n, h in zip(orders, hashed, strict=True)])
        if len(own) < 1 << bits - 1:  # sorting is quicker than a table of all buckets
            own.sort(kind="stable")
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            yield own[first].astype(np.int64), np.diff(np.append(first, len(own)))
        else:
            tally = np.bincount(own, minlength=1 << bits)
            at = np.flatnonzero(tally)
            yield at, tally[at]


def sums(column: pa.Array, orders: tuple[int, ...], idf: np.ndarray, weights: np.ndarray, lower: bool = True, bits: int = DIM_BITS) -> np.ndarray:
    """For each text, its TF-IDF row (as ``tfidf`` has it) times the weights; a row of zeros for a text without n-grams."""
    out, rows, spent = np.zeros((len(column), weights.shape[1]), np.float32), [], 0

    def flush():
        if not rows:
            return
        at, n = (np.concatenate([x[i] for x in rows]) for i in (1, 2))
        sizes = np.array([len(x[1]) for x in rows])
        x = (1 + np.log(n, dtype=np.float32)) * idf[at]
        heads = np.cumsum(sizes) - sizes
        length = np.sqrt(np.add.reduceat(x * x, heads))
        out[[k for k, _, _ in rows]] = np.add.reduceat(x[:, None] * weights[at], heads, axis=0) / np.where(length > 0, length, 1)[:, None]

    for k, (at, n) in enumerate(counts(column, orders, lower, bits)):
        if len(at):
            rows.append((k, at, n))
            spent += len(at)
        if spent > 1 << 18:
            flush()
            rows, spent = [], 0
    flush()
    return out


def tfidf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear term frequency times idf, of unit length."""
    x = (1 + np.log(n)) * idf[at]
    size = np.sqrt((x * x).sum())
    return (x / size if size else x).astype(np.float32)


def document_frequencies(docs: DataFrame, text_col: str, orders: tuple[int, ...], lower: bool = True, bits: int = DIM_BITS) -> tuple[int, np.ndarray]:
    """How many documents there are, and in how many each bucket occurs; over all rows of docs."""

    def run(batches):
        seen, total = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                for at, _ in counts(part.column(0), orders, lower, bits):
                    seen[at] += 1
                total += part.num_rows
        at = np.flatnonzero(seen)
        yield pa.record_batch([np.append(at, -1), np.append(seen[at], total)], ["bucket", "n"])

    rows = map_batches(docs.select(F.col(text_col).alias("text")), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df, total = np.zeros(1 << bits), 0
    for bucket, n in rows.collect():  # a row a bucket, whatever the input
        if bucket < 0:
            total = n
        else:
            df[bucket] = n
    return total, df


def inverse(total: int, df: np.ndarray) -> np.ndarray:
    return (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)


def counted(rows: DataFrame, keep: list[str], text_col: str, orders: tuple[int, ...], lower: bool = True, bits: int = DIM_BITS) -> DataFrame:
    """keep columns and (buckets array<int>, counts array<int>) for each row; for bounded samples that go to the driver."""
    schema = rows.select(*keep).schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", buckets array<int>, counts array<int>"

    def step():
        def apply(batch):
            both = list(counts(batch.column(len(keep)), orders, lower, bits))
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array([a.astype(np.int32) for a, _ in both], pa.list_(pa.int32())), pa.array([n.astype(np.int32) for _, n in both], pa.list_(pa.int32()))]
            return pa.record_batch(columns, names=[*keep, "buckets", "counts"])

        return apply

    return map_slices(rows.select(*keep, F.col(text_col).alias("text")), step, ddl)
