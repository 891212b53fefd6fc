"""Substring dedup: MinHash banding over paragraphs small enough to lie within a repeated passage.

Lines are divided into paragraphs where the hash of a word pair is the least
within ``radius`` words. That depends on nothing further away, so a passage
that recurs inside other text brings the same paragraphs with it, but for its
edges. A line or block of lines that is divided is a paragraph of its own as
well, before its parts, so that near-copies of it meet as a whole; what its
component says holds for all its parts. Lines and blocks, divided or not, are
MinHashed over shingles of five words; the number of bands is tuned for recall
at the threshold, at a width that few pairs below it collide in. Colliding
paragraphs are verified by the exact Jaccard similarity of their shingle sets,
and the links found make components, of which those that span documents count.
Parts of lines, of few words, are compared by equality. Of each component the
first paragraph (least document, then place) stays; the others are removed
where they are part of a run of repeated paragraphs of at least ``min_run``
words. A run goes on behind up to
two paragraphs that are not repeated, if what is repeated around them goes on
in the same first document.

Paragraphs of equal words are one node (a 64-bit key) and are reduced to one
row a band, batch by batch, before they are shuffled. Buckets of many distinct
paragraphs are cut into blocks and dealt out as pairs of blocks; tasks hand on
spanning forests of the links they find. Nothing is capped.

Defined results: words are runs of anything but ASCII white space with A-Z
lower-cased; lines of fewer than ``min_line`` words make a block with the
short lines next to them, up to a blank line, and are divided together; texts
of fewer than five words have no paragraphs; null ids are compared as the least id;
rows that repeat an id are the same document, so that places meet; other
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import as_binary, map_batches, map_slices, words
from .components import components, forest
from .store import partitions_for, written

SHINGLE = 5
NO_ID = -(1 << 63)


def tuned(threshold: float, recall: float, most: int = 8, least: int = 1) -> tuple[int, int]:
    """(bands, rows): the fewest bands, then the most rows, that find pairs at the threshold with the recall."""
    for bands in range(1, 200):
        for rows in range(most, least - 1, -1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding has that recall")


@dataclass(frozen=True)
class Settings:
    radius: int = 4
    min_line: int = 12
    min_run: int = 25
    threshold: float = 0.8
    recall: float = 0.99
    block: int = 256


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; x is not changed."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Paragraphs:
    """The compared paragraphs of a batch of texts, in order: text, number among the text's, words, and shingles."""

    text: np.ndarray
    number: np.ndarray
    words: np.ndarray
    start: np.ndarray  # places of the first word in the text
    content: np.ndarray
    shingles: np.ndarray  # hashes of all shingles of all paragraphs
    first: np.ndarray  # where each paragraph's shingles begin
    per_text: np.ndarray
    part: np.ndarray  # number among the undivided paragraphs of the text; of a divided one, its first part's
    parts: np.ndarray  # 0 if undivided
    natural: np.ndarray  # whether it is a line or block, divided or not


def paragraphs(column: pa.Array, s: Settings) -> Paragraphs:
    lists = pc.split_pattern(as_binary(column).cast(pa.large_string()), "\n")
    line_at = lists.offsets.to_numpy().astype(np.int64)
    line_at -= line_at[0]
    coded, at = words(lists.flatten())
    sizes = np.diff(at)
    n_texts = len(column)
    text_of_line = np.repeat(np.arange(n_texts), np.diff(line_at))
    if len(sizes):  # from here on, short lines next to each other are one line
        alone = (sizes >= s.min_line) | (sizes == 0)
        joins = np.zeros(len(sizes), bool)
        joins[1:] = ~alone[1:] & ~alone[:-1] & (text_of_line[1:] == text_of_line[:-1])
        heads = np.flatnonzero(~joins)
        line_at = np.append((np.cumsum(~joins) - 1)[line_at[:-1]], len(heads))
        sizes, at, text_of_line = np.add.reduceat(sizes, heads), np.append(at[heads], at[-1]), text_of_line[heads]
    own = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    h = own[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    # lines with radius empty places between them, which no word pair is less than
    line_of = np.repeat(np.arange(len(sizes)), sizes)
    where = np.arange(len(h)) + line_of * s.radius + s.radius
    pair = _mixed(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x9E3779B97F4A7C15), 7) if len(h) > 1 else np.zeros(0, np.uint64)
    ends = np.zeros(len(h), bool)
    ends[at[1:][sizes > 0] - 1] = True
    spread = np.full(len(h) + (len(sizes) + 1) * s.radius, ~np.uint64(0), np.uint64)
    inner = np.flatnonzero(~ends)
    spread[where[inner]] = pair[inner]
    least = spread[s.radius : len(spread) - s.radius].copy()
    anchor = least != ~np.uint64(0)
    for k in range(1, s.radius + 1):
        anchor &= least < spread[s.radius - k : len(spread) - s.radius - k]
        anchor &= least < spread[s.radius + k : len(spread) - s.radius + k]
    offset = np.arange(len(h)) - np.repeat(at[:-1], sizes)
    starts = anchor[where - s.radius] if len(h) else np.zeros(0, bool)
    to_end = np.repeat(sizes, sizes) - offset
    starts &= (offset >= s.radius) & (to_end >= s.radius)
    starts |= offset == 0
    begin = np.flatnonzero(starts)
    begin = begin[np.bincount(text_of_line, sizes, n_texts)[text_of_line[line_of[begin]]] >= SHINGLE] if len(begin) else begin
    line = line_of[begin]
    stop = np.append(begin[1:], 0)
    last = np.ones(len(begin), bool)
    last[:-1] = line[1:] != line[:-1]
    stop = np.where(last, at[1:][line], stop) if len(begin) else begin
    # divided lines stand as a whole before their parts
    turn = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else line
    k = np.diff(np.append(turn, len(line)))
    single = np.zeros(len(begin), bool)
    single[turn[k == 1]] = True
    turn, k = turn[k > 1], k[k > 1]
    ordinal = np.arange(len(begin))
    parts = np.concatenate([np.zeros(len(begin), np.int64), k])
    place = np.concatenate([ordinal, turn])
    stop = np.concatenate([stop, stop[turn + k - 1]])
    order = np.lexsort((parts == 0, place))
    place, parts, stop = place[order], parts[order], stop[order]
    begin, line, natural = begin[place], line[place], (parts > 0) | single[place]
    text = text_of_line[line]
    heads = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
    number = np.arange(len(text)) - np.maximum.accumulate(np.where(heads, np.arange(len(text)), 0)) if len(text) else text
    part = place - place[np.arange(len(text)) - number]
    size = stop - begin
    text_first = at[line_at[:-1]] if n_texts else np.zeros(0, np.int64)
    # shingles of SHINGLE words that lie within a paragraph; of fewer words, the paragraph is one
    if len(h):
        padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
        acc = np.zeros(len(h), np.uint64)
        for k in range(SHINGLE):
            acc = (acc ^ padded[k : k + len(h)]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k)
        acc = _mixed(acc, 11)
    else:
        acc = np.zeros(0, np.uint64)
    count = np.maximum(1, size - SHINGLE + 1)
    first = np.cumsum(count) - count
    places = np.repeat(begin - first, count) + np.arange(count.sum())
    shingles = acc[places]
    content = np.zeros(len(begin), np.uint64)
    if len(begin):
        flat_first = np.cumsum(size) - size
        flat = np.repeat(begin - flat_first, size) + np.arange(size.sum())
        position = (flat - np.repeat(begin, size)).astype(np.uint64)
        content = _mixed(np.add.reduceat(_mixed(h[flat] + position * np.uint64(0xA24BAED4963EE407), 3), flat_first) + size.astype(np.uint64), 5)
    return Paragraphs(text, number, size, begin - text_first[text] if len(begin) else begin, content, shingles, first, np.bincount(text, minlength=n_texts), part, parts, natural)


def _doc_ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, NO_ID).to_numpy()


def banded(docs: DataFrame, s: Settings) -> DataFrame:
    """(band, c, doc, unit, last, n, main, links): for each distinct paragraph of a batch and each band, its key, first place, last document and number.

    Every paragraph has a row by its content, where all are counted (main). Lines and blocks, divided or not, have
    rows by their MinHash bands as well, where they meet others (links); parts of a line are compared by content alone.
    """
    bands, rows = tuned(s.threshold, s.recall, 3, 3)
    rng = np.random.default_rng(17)
    factors = rng.integers(0, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)

    def step():
        def apply(batch):
            p = paragraphs(batch.column(1), s)
            if not len(p.content):
                return None
            doc = _doc_ids(batch.column(0))[p.text]
            order = np.lexsort((p.number, doc, p.content))
            heads = np.flatnonzero(np.concatenate([[True], np.diff(p.content[order]) != 0]))
            pick, n = order[heads], np.diff(np.append(heads, len(order)))
            last = np.maximum.reduceat(doc[order], heads)
            whole = np.flatnonzero(np.logical_or.reduceat(p.natural[order], heads))
            everything = np.arange(len(pick))
            out = [(_mixed(p.content[pick], 23), everything, True)]
            # the shingles, well mixed already, of lines and blocks
            sizes = np.diff(np.append(p.first, len(p.shingles)))[pick[whole]]
            starts = np.cumsum(sizes) - sizes
            own = p.shingles[np.repeat(p.first[pick[whole]] - starts, sizes) + np.arange(sizes.sum())]
            for b in range(bands if len(whole) else 0):
                key = np.full(len(whole), 31 + b, np.uint64)
                for factor in factors[b]:
                    key = _mixed(key ^ np.minimum.reduceat(own * factor, starts), 1)
                out.append((key, whole, False))
            key = np.concatenate([k for k, _, _ in out]).view(np.int64)
            at = np.concatenate([x for _, x, _ in out])
            main = np.concatenate([np.full(len(x), m) for _, x, m in out])
            first = pick[at]
            return pa.record_batch(
                [key, p.content[first].view(np.int64), doc[first], p.number[first].astype(np.int32), last[at], n[at].astype(np.int32), main, ~main],
                ["band", "c", "doc", "unit", "last", "n", "main", "links"],
            )

        return apply

    return map_slices(docs, step, "band long, c long, doc long, unit int, last long, n int, main boolean, links boolean", budget=8 << 20)


def collided(rows: DataFrame, partitions: int) -> DataFrame:
    """From banded rows: (band, c, doc, unit, last): contents that occur more than once (band null), and contents that share a band with another."""
    dealt = rows.repartition(partitions, "band").sortWithinPartitions("band", "c", "doc", "unit")

    def reduced(parts):
        """One row a band and content."""
        band, c, doc, unit, last, n, main, links = (np.concatenate(x) for x in zip(*parts, strict=True))
        heads = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (c[1:] != c[:-1])]))
        total, last, links = np.add.reduceat(n.astype(np.int64), heads), np.maximum.reduceat(last, heads), np.logical_or.reduceat(links, heads)
        return [*(x[heads] for x in (band, c, doc, unit)), last, total, main[heads], links]

    def found(parts):
        band, c, doc, unit, last, total, main, links = reduced(parts)
        groups = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
        shared = links & np.repeat(np.add.reduceat(links.astype(np.int64), groups) > 1, np.diff(np.append(groups, len(band))))
        again = main & (total > 1)
        for keep, key in ((shared, pa.array(band[shared], pa.int64())), (again, pa.nulls(int(again.sum()), pa.int64()))):
            if keep.any():
                yield pa.record_batch([key, c[keep], doc[keep], unit[keep], last[keep]], ["band", "c", "doc", "unit", "last"])

    def run(batches):
        open_, size = [], 0  # rows of the band that may go on; of very many, one a content
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if cut or (open_ and open_[-1][0][-1] != cols[0][0]):
                before = [*open_, [x[:cut] for x in cols]] if cut else open_
                yield from found(before)
                open_, size = [], 0
            open_.append([x[cut:] for x in cols])
            size += len(cols[0]) - cut
            if size > 1 << 20:
                open_ = [reduced(open_)]
                size = len(open_[0][0])
        if open_:
            yield from found(open_)

    return map_batches(dealt, run, "band long, c long, doc long, unit int, last long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """(c, shingles) of wanted (doc, unit, c) paragraphs, from the documents that hold them."""
    asked = wanted.groupBy("doc").agg(F.collect_list(F.struct("unit", "c")).alias("asked"))
    rows = docs.join(asked.hint("merge"), F.coalesce(docs["id"], F.lit(NO_ID)) == asked["doc"]).select("id", "text", F.expr("transform(asked, x -> x.unit)").alias("units"))

    def step():
        def apply(batch):
            p = paragraphs(batch.column(1), s)
            base = np.cumsum(p.per_text) - p.per_text
            lists = batch.column(2).to_pylist()
            at = np.concatenate([base[i] + np.array([u for u in x if u < p.per_text[i]], np.int64) for i, x in enumerate(lists)])
            ends = np.append(p.first[1:], len(p.shingles))
            sets = [np.unique(p.shingles[p.first[k] : ends[k]]).view(np.int64) for k in at.tolist()]
            return pa.record_batch([pa.array(p.content[at].view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], ["c", "shingles"])

        return apply

    return map_slices(rows, step, "c long, shingles array<bigint>").dropDuplicates(["c"])


def verified(shared: DataFrame, sets: DataFrame, s: Settings, partitions: int) -> DataFrame:
    """(a, b): links between contents of one band whose shingle sets have the Jaccard similarity, thinned to forests."""
    sizes = shared.groupBy("band").agg(F.count(F.lit(1)).alias("k"))
    large = sizes.where(F.col("k") > s.block).select("band", F.ceil(F.col("k") / s.block).cast("int").alias("blocks"))
    rows = shared.select("band", "c").join(large, "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    # a block stands on the left of its row of the grid and on the right of its column
    cells = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("band", "c", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"))
    dealt = cells.join(sets.hint("merge"), "c").repartition(partitions, "band", "i", "j").sortWithinPartitions("band", "i", "j")

    def pairs(c, sets_, left, twice):
        where, which = np.unique(np.concatenate(sets_), return_inverse=True)
        sizes_ = np.array([len(x) for x in sets_])
        hit = np.zeros((len(c), len(where)), np.float32)
        hit[np.repeat(np.arange(len(c)), sizes_), which] = 1
        a = np.flatnonzero(left)
        b = np.flatnonzero(~left) if twice else a
        if not len(a) or not len(b):
            return None
        both = hit[a] @ hit[b].T
        i, j = np.nonzero(both >= s.threshold * (sizes_[a][:, None] + sizes_[b][None, :] - both) - 1e-4)
        x, y = c[a[i]], c[b[j]]
        return x[x != y], y[x != y]

    def run(batches):
        key, c, sets_, left, out = None, [], [], [], []

        def close():
            if len(c) > 1 and (found := pairs(np.array(c), sets_, np.array(left), key[1] != key[2])) is not None and len(found[0]):
                out.append(forest(*found))

        for batch in batches:
            band, content, i, j, side = (batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("band", "c", "i", "j", "left"))
            lists = batch.column(batch.schema.get_field_index("shingles"))
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for k in range(len(band)):
                if (band[k], i[k], j[k]) != key:
                    close()
                    key, c, sets_, left = (band[k], i[k], j[k]), [], [], []
                c.append(content[k])
                sets_.append(flat[offsets[k] : offsets[k + 1]])
                left.append(side[k])
            if out:
                x, y = forest(np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]))
                yield pa.record_batch([x, y], ["a", "b"])
                out = []
        close()
        if out:
            yield pa.record_batch(list(forest(np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]))), ["a", "b"])

    return map_batches(dealt, run, "a long, b long")


def classes(docs: DataFrame, s: Settings) -> DataFrame:
    """(c, root, doc, unit): contents that have a twin, the first of their component's contents, and its first place."""
    n = partitions_for(docs)
    met = written(collided(banded(docs, s), n), "collided")
    shared = met.where("band is not null")
    place = F.min(F.struct("doc", "unit")).alias("at")
    wanted = shared.groupBy("c").agg(place).select("c", "at.doc", "at.unit")
    sets = written(shingle_sets(docs, wanted, s), "shingles")
    roots = written(components(verified(shared, sets, s, n), thin=False), "roots")
    nodes = met.groupBy("c").agg(place, F.max("last").alias("last"), F.max(F.when(F.col("band").isNull(), True)).alias("again"))
    joined = nodes.join(roots, F.col("c") == F.col("node"), "left").where("again or root is not null").select("c", "at", "last", F.coalesce("root", "c").alias("root"))
    joined = written(joined, "classes")
    firsts = joined.groupBy("root").agg(F.min("at").alias("first"), F.max("last").alias("last")).where("first.doc < last").drop("last")
    return joined.join(firsts, "root").select("c", "root", "first.doc", "first.unit")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """(id, unit, start, words, class_doc, class_unit, removed): the repeated paragraphs that are part of a long enough run."""
    s = settings or Settings()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = written(classes(rows, s), "repeated")

    def step():
        def apply(batch):
            p = paragraphs(batch.column(1), s)
            if not len(p.content):
                return None
            # of each paragraph, the places and words of its undivided parts
            whole = np.flatnonzero(p.parts == 0)
            before = np.cumsum(p.parts == 0) - (p.parts == 0)
            count = np.maximum(1, p.parts)
            cuts = np.append(0, np.cumsum(count))
            own = whole[np.repeat(before - cuts[:-1], count) + np.arange(cuts[-1])]
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x[own], pa.int32())) for x in (p.start, p.words)]
            columns = [_doc_ids(batch.column(0))[p.text], p.number.astype(np.int32), p.part.astype(np.int32), *lists, p.content.view(np.int64)]
            return pa.record_batch([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], ["doc_", "place", "part", "starts", "sizes", "c"])

        return apply

    units = map_slices(rows, step, "doc_ long, place int, part int, starts array<int>, sizes array<int>, c long")
    hits = units.join(known.hint("merge"), "c").select("doc_", "place", "part", "doc", "unit", F.posexplode(F.arrays_zip("starts", "sizes")).alias("i", "x"))
    keeps = ~((F.col("doc") < F.col("doc_")) | ((F.col("doc") == F.col("doc_")) & (F.col("unit") < F.col("place"))))
    hits = hits.select("doc_", (F.col("part") + F.col("i")).alias("unit_"), F.col("x.starts").alias("start"), F.col("x.sizes").alias("words"), F.struct(keeps.alias("keeps"), "doc", "unit").alias("at"))
    # what a part and the line that it is of say: it goes if either goes
    hits = hits.repartition(partitions_for(docs), "doc_").groupBy("doc_", "unit_", "start", "words").agg(F.min("at").alias("at"))
    hits = hits.select("doc_", "unit_", "start", "words", "at.doc", "at.unit", (~F.col("at.keeps")).alias("removed"))
    by_doc = "partition by doc_ order by unit_, start"
    last = lambda x: f"lag({x}) over ({by_doc})"
    on = f"{last('unit_')} >= unit_ - 1 or ({last('unit_')} >= unit_ - 3 and {last('doc')} = doc and unit - {last('unit')} between 1 and 6)"
    runs = hits.withColumn("opens", F.expr(f"if(coalesce({on}, false), 0, 1)"))
    runs = runs.withColumn("run", F.expr(f"sum(opens) over ({by_doc})")).withColumn("length", F.expr("sum(words) over (partition by doc_, run)"))
    return runs.where(F.col("length") >= s.min_run).select(F.col("doc_").alias("id"), F.col("unit_").alias("unit"), "start", "words", F.col("doc").alias("class_doc"), F.col("unit").alias("class_unit"), "removed")


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """A row for each id: (id_col, n_repeated, n_removed, removed_words, classes): classes: the least documents of its repeated paragraphs' components."""
    found = repeats(docs, id_col, text_col, settings).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_repeated"), F.sum(F.col("removed").cast("long")).alias("n_removed"),
        F.sum(F.when(F.col("removed"), F.col("words")).otherwise(0)).cast("long").alias("removed_words"), F.sort_array(F.collect_set("class_doc")).alias("classes"),
    )
    ids = docs.select(F.col(id_col).cast("long").alias("doc"))
    zero = F.lit(0).cast("long")
    return ids.join(found, F.coalesce("doc", F.lit(NO_ID)) == F.col("id"), "left").select(
        F.col("doc").alias(id_col), F.coalesce("n_repeated", zero).alias("n_repeated"), F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("removed_words", zero).alias("removed_words"), F.coalesce("classes", F.expr("cast(array() as array<bigint>)")).alias("classes"),
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """(id_col, text_col): every text without the words of its removed paragraphs."""
    found = repeats(docs, id_col, text_col, settings).where("removed").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "words"))).alias("cuts"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    rows = rows.join(found.hint("merge"), F.coalesce("doc", F.lit(NO_ID)) == F.col("id"), "left").select(
        "doc", "text", F.expr("transform(cuts, x -> x.start)").alias("at"), F.expr("transform(cuts, x -> x.words)").alias("n")
    )

    def step():
        import re

        word = re.compile(rb"[^\x20\x09-\x0d]+[\x20\x09\x0b-\x0d]*")

        def apply(batch):
            out = []
            for text, at, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not at:
                    out.append(text)
                    continue
                spans = [m.span() for m in word.finditer(text.encode())]
                raw, parts, done = text.encode(), [], 0
                for a, k in zip(at, n, strict=True):
                    parts.append(raw[done : spans[a][0]])
                    done = spans[a + k - 1][1]
                out.append(b"".join([*parts, raw[done:]]).decode())
            return pa.record_batch([batch.column(0), pa.array(out, pa.string())], ["doc", "text"])

        return apply

    return map_slices(rows, step, "doc long, text string").select(F.col("doc").alias(id_col), F.col("text").alias(text_col))
