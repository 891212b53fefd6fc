"""Arrow helpers for operators that run over whole texts.

Spark hands tasks batches of up to ``BATCH_ROWS`` rows. ``slices`` cuts them
by bytes so that what an operator derives from a batch stays small; a text
longer than the budget is a slice of its own and is never cut. Workers outlive
tasks and operators: each task gives back the memory it is done with.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: A-Z to a-z; other bytes stay, so valid UTF-8 stays valid and lengths do too.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Limits of a batch between Spark and its workers; set in the session that runs an operator.
BATCH_ROWS, BATCH_BYTES = 2048, 16 << 20

_kept: dict = {}


def kept(key, make: Callable):
    """What ``make()`` gives, kept by the worker from task to task until one asks for something else or for nothing."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def tidy() -> None:
    """Hands unused memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def map_batches(df: DataFrame, run: Callable, schema: StructType | str, keeps: bool = False) -> DataFrame:
    """df.mapInArrow in batches of bounded size; keeps: the task uses what the worker has kept."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def task(batches):
        if not keeps:
            _kept.clear()
        try:
            yield from run(batches)
        finally:
            tidy()

    return df.mapInArrow(task, schema)


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        spent = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, spent + budget, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_slices(
    df: DataFrame,
    step: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
    schema: StructType | str,
    column: str = "text",
    budget: int = 4 << 20,
) -> DataFrame:
    """map_batches with ``step()`` made once a task and called for each slice."""

    def run(batches):
        apply = step()
        for batch in batches:
            for part in slices(batch, column, budget):
                out = apply(part)
                if out is not None:
                    yield out

    return map_batches(df, run, schema)


def as_binary(column: pa.Array) -> pa.Array:
    """A text column's bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.fill_null(column.cast(kind), b"")


def translated(column: pa.Array, table: bytes) -> pa.Array:
    """Bytes of every text put through a 256-byte table; null is empty. All in one pass over the buffer."""
    array = as_binary(column).cast(pa.large_binary())
    n = len(array)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1 + array.offset)[array.offset :]
    raw = memoryview(data)[at[0] : at[n]].tobytes() if data is not None and n else b""
    moved = pa.py_buffer((at - at[0]).tobytes() if n else np.zeros(1, np.int64).tobytes())
    return pa.Array.from_buffers(pa.large_string(), n, [None, moved, pa.py_buffer(raw.translate(table))])


def words(column: pa.Array, table: bytes = LOWER) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in a row, dictionary-encoded, and n+1 offsets of the texts' words.

    A word is a run of bytes that ``table`` does not make ASCII white space.
    """
    lists = pc.ascii_split_whitespace(translated(column, table))
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    flat = flat.filter(pa.array(full)) if not full.all() else flat
    return flat.cast(pa.string()).dictionary_encode(), before[at - at[0]] if len(at) else np.zeros(1, np.int64)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
