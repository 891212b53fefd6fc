"""Benchmark decontamination with suffix arrays over the training texts.

Training documents are taken in shards. A shard's words, in the numbering of
the benchmark's vocabulary, become a suffix array; every suffix of every
benchmark item is binary-searched in it. That gives all places where a
window's length of it occurs; windows that follow each other in item and
document alike make up the longest verbatim matches, which are kept with
their places on both sides. Words that no item
holds are one number that matches nothing, as are ends of documents, so
suffixes that begin with one are left out; groups that no item's suffix can
enter are left unsorted beyond that point. Both change no search.

Shards are made and searched where the documents are: nothing is shuffled.
The benchmark is sent to the tasks in blocks of bounded size, one pass over
the documents a block, and a document's findings are carried from pass to
pass; after a few passes the documents are written down, so that a stage never
holds more blocks than that. Items longer than a block are cut, with a
window's words less one on both sides of the cut, and matches are joined over it.

Defined results: words are runs of a-z, 0-9 and non-ASCII characters after
A-Z is lower-cased; a null text has none; an item of fewer words than a window
is one window, one of none is left out; items that repeat an id count as one;
a null item id is written as an empty string; rows are kept apart even if they
repeat an id or are alike; ids of any type and other columns of any name are
handed on; texts and items may be of any length; an empty benchmark finds
nothing, an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import map_slices, words
from .store import remove, scratch

#: A-Z to a-z; ASCII other than letters and digits to a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Words that one 64-bit key holds, and the bits of each.
STEP, WIDTH = 3, 21


def _keys(ids: np.ndarray) -> np.ndarray:
    """For every position: STEP words from there on, in order of significance."""
    padded = np.concatenate([ids, np.zeros(STEP, np.int64)])
    out = padded[: len(ids)]
    for k in range(1, STEP):
        out = out << WIDTH | padded[k : k + len(ids)]
    return out


def _above(keys: np.ndarray, n: int) -> np.ndarray:
    """keys with the words after the first n at their largest."""
    return keys | ((1 << WIDTH * (STEP - n)) - 1)


@dataclass
class TestSuffixes:
    """The suffixes of some items: their words as numbers above 0, and the length of a window at each."""

    vocabulary: pa.Array
    ids: np.ndarray  # a 0 behind each item
    keys: np.ndarray
    starts: np.ndarray  # one a suffix
    lengths: np.ndarray  # words to the item's end, a window's at most
    windows: np.ndarray  # of a window that begins here; 0: none does
    items: list[str]
    item_of: np.ndarray
    offset: np.ndarray  # of each suffix in its text

    @classmethod
    def of(cls, items: list[str], texts: list[str | None], window: int) -> TestSuffixes:
        coded, at = words(pa.array(texts, pa.string()), WORDS)
        own = coded.indices.to_numpy().astype(np.int64) + 1
        if len(coded.dictionary) >= (1 << WIDTH) - 1:
            raise ValueError("a block of the benchmark has too many words")
        sizes = np.diff(at)
        item_of = np.repeat(np.arange(len(items)), sizes)
        offset = np.arange(len(own)) - np.repeat(at[:-1], sizes)
        lengths = np.minimum(np.repeat(sizes, sizes) - offset, window)  # longer matches are runs of windows
        short = np.repeat(sizes, sizes) < window
        windows = np.where(short, np.where(offset == 0, lengths, 0), np.where(lengths >= window, window, 0))
        ids = np.zeros(len(own) + len(items), np.int64)
        starts = np.arange(len(own)) + item_of
        ids[starts] = own
        return cls(coded.dictionary, ids, _keys(ids), starts, lengths, windows, items, item_of, offset)


class SuffixArray:
    """The suffixes of a shard that begin with a word of the tests, sorted as far as a test's suffix can tell them apart."""

    def __init__(self, ids: np.ndarray, tests: TestSuffixes):
        self.keys = np.concatenate([_keys(ids), np.zeros(1, np.int64)])
        self.n = len(ids)
        order = np.flatnonzero(ids)
        own = self.keys[order]
        by = np.argsort(own, kind="stable")
        self.order, self.first = order[by], own[by]
        self._refine(tests)

    def _refine(self, tests: TestSuffixes) -> None:
        """Sorts groups of equal keys by the words that follow, as deep as tests enter them."""
        # test suffixes and the group of the array each has come to, found key by key
        lo = np.searchsorted(self.first, tests.keys[tests.starts], "left")
        hi = np.searchsorted(self.first, tests.keys[tests.starts], "right")
        live = np.flatnonzero(hi - lo > 1)
        depth = STEP
        while len(live):
            live = live[tests.lengths[live] > depth]
            if not len(live):
                break
            groups, at = np.unique(lo[live], return_index=True)
            ends = hi[live][at]
            sizes = ends - groups
            where = np.repeat(groups, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            nexts = self._at(self.order[where] + depth)
            by = np.lexsort((nexts, np.repeat(np.arange(len(groups)), sizes)))
            self.order[where] = self.order[where][by]
            nexts = nexts[by]
            # narrow each test to its part of the group
            spans = np.concatenate([[0], np.cumsum(sizes)])
            g = np.searchsorted(groups, lo[live])
            wanted = tests.keys[tests.starts[live] + depth]
            for k, (a, b, want) in enumerate(zip(spans[g].tolist(), spans[g + 1].tolist(), wanted.tolist(), strict=True)):
                part = nexts[a:b]
                base = lo[live[k]]
                left, right = np.searchsorted(part, [want, want + 1], "left")
                lo[live[k]], hi[live[k]] = base + left, base + right
            live = live[hi[live] - lo[live] > 1]
            depth += STEP

    def _at(self, positions: np.ndarray) -> np.ndarray:
        return self.keys[np.minimum(positions, self.n)]

    def search(self, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each test suffix: the length of its longest match; one position of it; the bounds in the array of its window's matches."""
        m = len(tests.starts)
        want = tests.keys[tests.starts]
        longest, place = np.zeros(m, np.int64), np.zeros(m, np.int64)
        lows, highs = np.zeros(m, np.int64), np.zeros(m, np.int64)
        left, right = [], []
        for n in range(1, STEP + 1):  # all suffixes at once over the first key
            floor = want >> WIDTH * (STEP - n) << WIDTH * (STEP - n)
            left.append(np.searchsorted(self.first, floor, "left"))
            right.append(np.searchsorted(self.first, _above(floor, n), "right"))
            hit = (right[-1] > left[-1]) & (tests.lengths >= n)
            longest[hit], place[hit] = n, left[-1][hit]
            exact = hit & (tests.windows == n)
            lows[exact], highs[exact] = left[-1][exact], right[-1][exact]
        for k in np.flatnonzero((longest == STEP) & (tests.lengths > STEP)).tolist():
            lo, hi, depth, length, window = int(left[-1][k]), int(right[-1][k]), STEP, int(tests.lengths[k]), int(tests.windows[k])
            while hi > lo and depth < length:
                part = self._at(self.order[lo:hi] + depth)
                key = int(tests.keys[tests.starts[k] + depth])
                for n in range(1, min(STEP, length - depth) + 1):
                    floor = key >> WIDTH * (STEP - n) << WIDTH * (STEP - n)
                    a = lo + int(np.searchsorted(part, floor, "left"))
                    b = lo + int(np.searchsorted(part, floor | (1 << WIDTH * (STEP - n)) - 1, "right"))
                    if a == b:
                        break
                    longest[k], place[k] = depth + n, a
                    if depth + n == window:
                        lows[k], highs[k] = a, b
                if a == b or n < STEP:
                    break
                lo, hi, depth = a, b, depth + STEP
        return longest, place, lows, highs


#: A verbatim match: the item and its row in the benchmark, the first word in item and document, and the number of words.
MATCH = "struct<item: string, row: bigint, offset: bigint, start: bigint, length: bigint>"
_MATCH = pa.struct([("item", pa.string()), *[(c, pa.int64()) for c in ("row", "offset", "start", "length")]])


def _merged(spans: np.ndarray) -> list[int]:
    """Spans [start, end) as a flat sorted list, overlapping or touching ones joined."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    heads = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[heads, 0], reach[np.append(heads[1:], len(spans)) - 1]], axis=1).ravel().tolist()


def _runs(doc: np.ndarray, start: np.ndarray, suffix: np.ndarray, tests: TestSuffixes) -> list[np.ndarray]:
    """Window hits put together where document and item go on alike: document, first suffix, first word in the document, words."""
    by = np.lexsort((suffix, start - suffix, doc))
    doc, start, suffix = doc[by], start[by], suffix[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] - suffix[1:] != start[:-1] - suffix[:-1]) | (suffix[1:] != suffix[:-1] + 1)
    new[1:] |= tests.item_of[suffix[1:]] != tests.item_of[suffix[:-1]]
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(doc)) - 1
    return [doc[heads], suffix[heads], start[heads], suffix[last] - suffix[heads] + tests.windows[suffix[last]]]


def _joined(matches: list[dict]) -> list[dict]:
    """Matches that go on behind each other in the same text, as of an item that was cut, as one."""
    out: list[dict] = []
    for m in sorted(matches, key=lambda m: (m["row"], m["start"] - m["offset"], m["offset"])):
        last = out[-1] if out else None
        if last and (last["row"], last["start"] - last["offset"]) == (m["row"], m["start"] - m["offset"]) and m["offset"] <= last["offset"] + last["length"]:
            out[-1] = {**last, "length": max(last["length"], m["offset"] + m["length"] - last["offset"])}
        else:
            out.append(m)
    return out


def _pass(docs: DataFrame, text_col: str, block: Block, window: int, budget: int) -> DataFrame:
    """Adds to every row's state what the items' suffixes match in it."""
    shared = docs.sparkSession.sparkContext.broadcast((block.items, block.texts, block.rows, block.offsets))
    column = docs.columns.index(text_col)
    state = docs.columns.index("_spans")

    def step():
        items, texts, item_rows, offsets = shared.value
        tests = TestSuffixes.of(items, texts, window)

        def apply(batch):
            n = batch.num_rows
            coded, at = words(batch.column(column), WORDS)
            number = pc.fill_null(pc.index_in(coded.dictionary, tests.vocabulary), -1).to_numpy().astype(np.int64) + 1
            sizes = np.diff(at)
            ids = np.zeros(at[-1] + n, np.int64)
            doc_of = np.repeat(np.arange(n), sizes)
            if len(coded):
                ids[np.arange(at[-1]) + doc_of] = number[coded.indices.to_numpy()]
            begins = at[:-1] + np.arange(n)
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[state + 3] = pa.array(sizes, pa.int64())
            if len(tests.starts) and len(ids):
                array = SuffixArray(ids, tests)
                _, _, lows, highs = array.search(tests)
                hit = np.flatnonzero(highs > lows)
                counts = (highs - lows)[hit]
                rows = np.repeat(lows[hit], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                position = array.order[rows]
                doc = np.searchsorted(begins, position, "right") - 1
                if len(doc):
                    found = _runs(doc, position - begins[doc], np.repeat(hit, counts), tests)
                    spans, names, matches = (batch.column(state + k).to_pylist() for k in range(3))
                    cuts = np.flatnonzero(np.diff(found[0])) + 1
                    for d, suffix, start, length in zip(*(np.split(x, cuts) for x in found), strict=True):
                        d = int(d[0])
                        own = tests.item_of[suffix]
                        more = zip(own.tolist(), tests.offset[suffix].tolist(), start.tolist(), length.tolist(), strict=True)
                        matches[d] = _joined(matches[d] + [{"item": items[i], "row": item_rows[i], "offset": offsets[i] + o, "start": s, "length": k} for i, o, s, k in more])
                        spans[d] = _merged(np.concatenate([np.array(spans[d], np.int64).reshape(-1, 2), np.stack([start, start + length], axis=1)]))
                        names[d] = sorted({*names[d], *(items[i] for i in np.unique(own).tolist())})
                    columns[state : state + 3] = [pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string())), pa.array(matches, pa.list_(_MATCH))]
            return pa.record_batch(columns, names=batch.schema.names)

        return apply

    return map_slices(docs, step, docs.schema, text_col, budget)


@dataclass
class Block:
    """Items, or parts of long ones, that are sent together: ids, texts, rows in the benchmark, and words before the part."""

    items: list[str]
    texts: list[str | None]
    rows: list[int]
    offsets: list[int]


def item_parts(text: str | None, window: int, most: int) -> list[tuple[str | None, int]]:
    """A text in parts of about ``most`` bytes and the words before each; every window lies in exactly one part."""
    size = len((text or "").encode())
    if size <= most:
        return [(text, 0)]
    coded, _ = words(pa.array([text]), WORDS)
    own = coded.cast(pa.string()).to_pylist() if len(coded) else []
    step = max(window, len(own) * most // (2 * size))
    return [(" ".join(own[k : k + step + window - 1]), k) for k in range(0, max(1, len(own) - window + 1), step)] if len(own) >= window else [(" ".join(own), 0)]


def blocks(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, most: int):
    """The benchmark in blocks of about ``most`` bytes, one at a time."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(item_text_col))
    own, spent = Block([], [], [], []), 0
    for number, (item, text) in enumerate(rows.toLocalIterator()):
        for part, offset in item_parts(text, window, most):
            size = len((part or "").encode())
            if spent and spent + size > most:
                yield own
                own, spent = Block([], [], [], []), 0
            for x, y in ((own.items, item), (own.texts, part), (own.rows, number), (own.offsets, offset)):
                x.append(y)
            spent += size
    if own.items:
        yield own


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 6 << 20,
    shard_bytes: int = 8 << 20,
    passes: int = 4,
) -> DataFrame:
    """docs with _words, _spans (flat start, end pairs of hit words), _items (ids found, sorted), _matches and _longest.

    _matches are the longest verbatim matches of at least a window (of all
    words of a shorter item): item, its row, and first words and length on
    both sides; _longest is the length of the longest. Benchmark texts come to
    the driver a block of about ``block_bytes`` at a time; a block of up to
    6 MB can't have more different words than a key has room for.
    """
    spark = docs.sparkSession
    kinds = (("_spans", "array<bigint>"), ("_items", "array<string>"), ("_matches", f"array<{MATCH}>"))
    out = docs.select("*", *[F.expr(f"cast(array() as {t})").alias(c) for c, t in kinds], F.lit(0).cast("long").alias("_words"))
    done, kept = 0, []
    for block in blocks(benchmark, item_col, item_text_col, window, block_bytes):
        if done and not done % passes:  # a stage of its own for every few blocks
            path = scratch(spark, "decontamination")
            out.write.parquet(path)
            out = spark.read.schema(out.schema).parquet(path)
            kept.append(path)
            if len(kept) > 1:
                remove(spark, kept.pop(0))
        out, done = _pass(out, text_col, block, window, shard_bytes), done + 1
    if not done:
        out = _pass(out, text_col, Block([], [], [], []), window, shard_bytes)
    return out.withColumn("_longest", F.coalesce(F.array_max(F.transform("_matches", lambda m: m["length"])), F.lit(0).cast("long")))


def hit_words(column: str = "_spans"):
    """How many words the spans cover."""
    return F.expr(f"aggregate(transform({column}, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (a, x) -> a + x)")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs. Its columns may have any names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = matches(plain, benchmark, text_col=f"c{docs.columns.index(text_col)}", **options)
    return found.where(F.size("_spans") == 0).select(*plain.columns).toDF(*docs.columns)
