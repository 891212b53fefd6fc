"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints of 64 bits link at up to ``radius`` differing bits. The search
runs over distinct fingerprints. Bits are grouped, correlated ones together,
into m partitions; if the partitions' thresholds t sum to radius - m + 1, two
linked fingerprints are within t bits on at least one of them. Partitions and
thresholds come from a dynamic programme over the costs that a bounded sample
of fingerprints predicts; the sample decides the cost of the search, never its
result. Every fingerprint is indexed by its bits on each partition and probes
all values within the threshold; colliding pairs are verified on 64 bits.
Buckets above a size are cut into blocks and dealt out as pairs of blocks, and
tasks hand on spanning forests of the links they find, not the links. A search
that would deal out more rows than the disk should hold at once is done in
passes over parts of the keys, each written before the next one starts.

Defined results: a null or blank text has fingerprint 0, linked like any
other; equal texts share a fingerprint; rows that repeat an id stay rows of
their own; null ids form components like others and are never their smallest
id unless alone; other columns are not looked at; an empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import as_binary, batch_of, map_batches, map_slices
from .components import components, forest
from .store import partitions_for, written

BITS = 64
#: Rows of a bucket that are compared within one task; larger buckets are cut into blocks, MOST_BLOCKS at most, as each row is dealt to as many cells.
BLOCK, MOST_BLOCKS = 2048, 16
#: What dealing out a row costs, in pairs that are verified (6.7 microseconds, and up to 10 nanoseconds).
ROW = 700
#: Rows that a pass of a search deals out: so many for each fingerprint (of some 60 bytes each), and so many at least.
ROWS_EACH, PASS_ROWS = 32, 4 << 20
#: Keys of large buckets that are broadcast at most (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 50_000
#: 64-bit words of a parity sketch, and the columns that hold one, after the number of shingles.
SKETCH = 4
SKETCHED = ["n", *[f"p{k}" for k in range(SKETCH)]]


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Other 64-bit hashes of what h are hashes of."""
    h = (h ^ np.uint64(0x9E3779B97F4A7C15 * salt & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is in over half the hashes of the text's shingles."""
    return all_fingerprints(text, shingle, seed)[0]


def all_fingerprints(text: bytes, shingle: int = 3, seed: int = 42, more: int = 0) -> tuple[int, ...]:
    """The text's fingerprint, and ``more`` others over other hashes: bit i is set if it is in over half the hashes of the text's shingles."""
    own = text.lower().split()  # white space: 0x20, 0x09-0x0D
    if not own:
        return (0,) * (more + 1)
    if len(own) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(own), seed)], np.uint64)
        return int(h[0]), *[int(_mixed(h, k)[0]) for k in range(1, more + 1)]
    joined = b" ".join(own)
    digest, k = xxhash.xxh64_intdigest, shingle - 1
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
    starts = np.concatenate([[0], ends[: -k - 1]]).tolist()
    ends = (ends[k:] - 1).tolist()
    counts, n = np.zeros((more + 1, BITS), np.int64), len(starts)
    for at in range(0, n, 65536):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536], strict=True)], np.uint64)
        for i in range(more + 1):
            own_ = _mixed(h, i) if i else h
            counts[i] += np.unpackbits(own_.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return tuple(np.packbits(2 * counts > n, axis=1, bitorder="little").view(np.uint64).ravel().tolist())


def parity(own: np.ndarray) -> np.ndarray:
    """How many hashes a set has, and for each of 64 * SKETCH buckets whether it holds an odd number of them.

    Sets that differ in m hashes differ in m of these bits at most, whatever their sizes.
    """
    odd = np.bincount((own.view(np.uint64) >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH).astype(np.uint8) & 1
    return np.concatenate([[len(own)], np.packbits(odd, bitorder="little").view(np.int64)])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, more: int = 0, sketch: int = 0) -> DataFrame:
    """(id, key, fp, fp1, ...): fp and ``more`` others as signed 64-bit integers; key is a hash of the text, which tells rows of one id apart.

    sketch: adds the parity sketch of the text's shingles of that many words.
    """
    names = ["fp", *[f"fp{k}" for k in range(1, more + 1)]]
    drawn = SKETCHED if sketch else []
    schema = pa.schema([(c, pa.int64()) for c in ("id", "key", *names, *drawn)])

    def step():
        def apply(batch):
            texts = as_binary(batch.column(2)).to_pylist()
            fps = np.array([all_fingerprints(t, shingle, seed, more) for t in texts], np.uint64).reshape(-1, more + 1)
            sketches = np.array([parity(shingle_set(t, sketch)) for t in texts], np.int64).reshape(-1, len(drawn)) if sketch else fps
            return batch_of(schema, batch.column(0), batch.column(1), *[fps[:, k].copy().view(np.int64) for k in range(more + 1)], *[sketches[:, k].copy() for k in range(len(drawn))])

        return apply

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    return map_slices(rows, step, ", ".join(f"{f.name} long" for f in schema))


def text_key(text_col: str | Column = "text") -> Column:
    """The hash of a text that keeps rows apart that share an id or have none."""
    return F.xxhash64(text_col)


# The plan of a search.


def grouped_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """The 64 bits in m partitions of equal size (but for rounding), bits that vary together in the same one."""
    bits = np.unpackbits(sample.astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    spread = bits.std(axis=0)
    centred = (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1)
    like = np.abs(centred.T @ centred) / max(1, len(sample))
    left, out = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        # from the bit that is most correlated with what is left, add the bit most correlated with the group
        own = [max(left, key=lambda b: (like[b, left].sum(), -b))]
        while len(own) < size:
            own.append(max((b for b in left if b not in own), key=lambda b: (like[b, own].sum(), -b)))
        left = [b for b in left if b not in own]
        out.append(sorted(own))
    return out


def costs(sample: np.ndarray, bits: list[int], most: int, total: int) -> list[float]:
    """For thresholds -1..most: rows dealt out and pairs verified, as predicted for ``total`` fingerprints."""
    key = key_of(sample.astype(np.uint64), bits)
    pairs = np.bitwise_count(key[:, None] ^ key[None, :]).ravel()
    n = len(sample)
    near = np.bincount(pairs, minlength=most + 1)[: most + 1].astype(float)
    near[0] -= n
    uniform = np.array([comb(len(bits), d) / 2.0 ** len(bits) for d in range(most + 1)])
    share = np.maximum(near / max(1, n * (n - 1)), uniform)  # a small sample may see no near pair at all
    out, rows, blocks = [0.0], 0, 1 + min(MOST_BLOCKS, share[0] * total / BLOCK)
    for t in range(most + 1):
        rows += comb(len(bits), t)
        out.append((rows + (t > 0)) * blocks * total * ROW + share[: t + 1].sum() * float(total) ** 2)
    return out


def plan(sample: np.ndarray, total: int, radius: int = 3) -> list[tuple[list[int], int]]:
    """The cheapest partitions and thresholds: [(bits, threshold)], those with threshold -1 left out."""
    best = None
    for m in range(1, radius + 2):
        parts = grouped_bits(sample, m)
        tables = [costs(sample, bits, radius, total) for bits in parts]
        # state: thresholds + 1 spent so far, of radius + 1 in all
        state = {0: (0.0, [])}
        for table in tables:
            new: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, chosen) in state.items():
                for t1 in range(radius + 2 - spent):
                    c = (cost + table[t1], [*chosen, t1 - 1])
                    if spent + t1 not in new or c < new[spent + t1]:
                        new[spent + t1] = c
            state = new
        cost, chosen = state[radius + 1]
        if best is None or cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(parts, chosen, strict=True) if t >= 0])
    return best[1]


def key_of(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= (fps >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


def masks(width: int, threshold: int) -> np.ndarray:
    """All differences of up to ``threshold`` bits on a partition."""
    return np.array([sum(1 << b for b in c) for t in range(threshold + 1) for c in combinations(range(width), t)], np.uint64)


# The search.


def signatures(fps: DataFrame, parts: list[tuple[list[int], int]], probes: bool, carried: list[str] = (), part: int = 0, of: int = 1) -> DataFrame:
    """(slot, sig, fp, probe, carried...): keys that are indexed, or those that are probed; of all keys, those of one part."""
    schema = pa.schema([("slot", pa.int32()), ("sig", pa.int64()), ("fp", pa.int64()), ("probe", pa.bool_()), *[(c, pa.int64()) for c in carried]])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own, *others = (c.slice(at, 4096).to_numpy() for c in batch.columns)
                own = own.view(np.uint64)
                for slot, (bits, threshold) in enumerate(parts):
                    if probes and not threshold:
                        continue
                    key = key_of(own, bits)
                    near = masks(len(bits), threshold) if probes else np.zeros(1, np.uint64)
                    sig = (key[:, None] ^ near[None, :]).ravel()
                    at_ = np.arange(len(sig)) if of == 1 else np.flatnonzero((_mixed(sig, slot + 1) >> np.uint64(33)) % np.uint64(of) == part)
                    sig, row, n = sig[at_], at_ // len(near), len(at_)
                    yield batch_of(schema, np.full(n, slot, np.int32), sig.view(np.int64), own[row].view(np.int64), np.full(n, probes), *[c[row] for c in others])

    return map_batches(fps.select("fp", *carried), run, ", ".join(["slot int, sig long, fp long, probe boolean", *[f"{c} long" for c in carried]]))


def _dealt(rows: DataFrame, large: DataFrame | None, joined: bool, carried: list[str] = ()) -> DataFrame:
    """Adds the cells of a bucket's rows: one, or for large buckets a row of the grid of blocks."""
    if large is None:
        return rows.select("slot", "sig", F.lit(0).alias("ia"), F.lit(0).alias("pb"), "fp", "probe", *carried)
    hit = rows.join(large if joined else F.broadcast(large), ["slot", "sig"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64(carried[0] if carried else "fp"), blocks).cast("int")
    cells = hit.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # where a slot has no probe rows, its indexed rows stand on both sides: on each, against every block
    pick = F.when(F.col("probe"), F.array(F.struct(F.col("other").alias("ia"), F.col("own").alias("pb"))))
    pick = pick.otherwise(F.array(F.struct(F.col("own").alias("ia"), F.col("other").alias("pb"))))
    return cells.withColumn("cell", F.explode(pick)).select("slot", "sig", F.col("cell.ia"), F.col("cell.pb"), "fp", "probe", *carried)


def links(fps: DataFrame, parts: list[tuple[list[int], int]], radius: int = 3, block: int = BLOCK, similarity: float | None = None, pass_rows: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints that have the components of all links within the radius.

    similarity: rows have a ``root`` and a parity sketch too; (a, b) are then all roots within the radius whose sketches
    leave it open that the sets' Jaccard similarity is at least that, some of them more than once.
    pass_rows: rows that are dealt out at once; a search of more goes through its keys in as many parts, so that the
    shuffle of one is gone before the next one's. A key's rows are never parted.
    """
    carried = ["root", *SKETCHED] if similarity is not None else []
    sizes = signatures(fps, parts, False).groupBy("slot", "sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    large = written(sizes.select("slot", "sig", F.least(F.ceil(F.col("n") / block), F.lit(MOST_BLOCKS)).cast("int").alias("blocks"), "n"), "large-buckets")
    found = large.groupBy("slot").agg(F.count(F.lit(1)).alias("keys"), F.sum(F.col("n") * F.col("blocks")).alias("rows")).collect()
    large, held = large.drop("n"), sum(r["keys"] for r in found)
    exact = [slot for slot, (_, t) in enumerate(parts) if t == 0]
    probes = [len(masks(len(bits), t)) if t else 0 for bits, t in parts]
    nodes = fps.count()
    dealt = nodes * (len(parts) + sum(probes)) + sum(r["rows"] * (1 + max(1, probes[r["slot"]])) for r in found)
    passes = -(-dealt // (pass_rows or max(PASS_ROWS, ROWS_EACH * nodes))) or 1
    n = partitions_for(fps, rows=dealt // passes)

    def cells(part: int) -> DataFrame:
        index = signatures(fps, parts, False, carried, part, passes)
        rows = index if len(exact) == len(parts) else index.unionByName(signatures(fps, parts, True, carried, part, passes))
        if held and exact:  # in cut buckets of exact slots, a block meets the others as probes
            twins = index.where(F.col("slot").isin(exact)).join(F.broadcast(large) if held <= BROADCAST_KEYS else large, ["slot", "sig"], "left_semi")
            rows = rows.unionByName(twins.withColumn("probe", F.lit(True)))
        out = _dealt(rows, large if held else None, held > BROADCAST_KEYS, carried)
        if held and exact:  # once a pair of blocks
            out = out.where(~F.col("slot").isin(exact) | (F.col("ia") <= F.col("pb")))
        return out.repartition(n, "slot", "sig", "ia", "pb").sortWithinPartitions("slot", "sig", "ia", "pb", "probe")

    def run(batches):
        held = []  # of one cell that has not ended yet
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            if not len(cols[0]):
                continue
            new = np.zeros(len(cols[0]), bool)
            new[0] = bool(held) and any(c[0] != h[-1] for c, h in zip(cols[:4], held[-1][:4], strict=True))
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            heads = np.flatnonzero(new)
            if len(heads):
                before = sum(len(h[0]) for h in held)
                whole = [np.concatenate(c) for c in zip(*held, [c[: heads[-1]] for c in cols], strict=True)]
                yield from _verified(whole, np.concatenate([[0], before + heads]), radius, similarity)
                held, cols = [], [c[heads[-1] :] for c in cols]
            held.append(cols)
        if held:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield from _verified(whole, np.array([0, len(whole[0])]), radius, similarity)

    if passes == 1:
        return map_batches(cells(0), run, "a long, b long")
    out = [written(map_batches(cells(part), run, "a long, b long").distinct(), "pass") for part in range(passes)]
    return reduce(DataFrame.unionByName, out)


def _verified(cols: list[np.ndarray], heads: np.ndarray, radius: int, similarity: float | None, budget: int = 1 << 18):
    """Links of the buckets that begin at heads (the last one ends them): forests of fingerprints, or all of the roots that may be similar. Indexed rows come first in each."""
    fp, probe = cols[4].view(np.uint64), cols[5].astype(np.int64)
    node = cols[4] if similarity is None else cols[6]
    sizes = np.diff(heads)
    many = np.flatnonzero(sizes > 1)
    if not len(many):
        return
    probes = np.add.reduceat(probe, heads[:-1])[many]
    held = sizes[many] - probes
    first = heads[:-1][many]
    other = np.where(probes > 0, first + held, first)  # without probes, the indexed rows meet each other
    others = np.where(probes > 0, probes, held)
    pairs = held * others
    found_a, found_b = [], []

    def keep(i, j):
        """i, j: rows within the radius."""
        good = node[i] != node[j]
        if not good.any():
            return
        i, j = i[good], j[good]
        if similarity is not None:
            # sets of a Jaccard similarity s differ in (1 - s) / (1 + s) of their sizes' sum
            apart = sum(np.bitwise_count((c[i] ^ c[j]).view(np.uint64)).astype(np.int64) for c in cols[8:])
            good = apart <= (cols[7][i] + cols[7][j]) * (1 - similarity) / (1 + similarity) + 1e-6
            i, j = i[good], j[good]
        a, b = node[i], node[j]
        a, b = forest(a, b) if similarity is None else np.unique(np.sort(np.stack([a, b], axis=1), axis=1), axis=0).T
        found_a.append(a)
        found_b.append(b)

    small = np.flatnonzero((pairs > 0) & (pairs <= 4096))
    group = np.cumsum(pairs[small]) // budget
    for own in np.split(small, np.flatnonzero(np.diff(group)) + 1):
        n = pairs[own]
        q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = np.repeat(others[own], n)
        i, j = np.repeat(first[own], n) + q // width, np.repeat(other[own], n) + q % width
        near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        keep(i[near], j[near])
    for k in np.flatnonzero(pairs > 4096).tolist():  # a table of each is several times faster than pairs of row numbers
        right = fp[other[k] : other[k] + others[k]]
        step = max(1, budget // len(right))
        for at in range(int(first[k]), int(first[k] + held[k]), step):
            left = fp[at : min(at + step, int(first[k] + held[k]))]
            i, j = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)
            keep(i + at, j + other[k])
    if found_a:
        x, y = np.concatenate(found_a), np.concatenate(found_b)
        yield pa.record_batch(list(forest(x, y)) if similarity is None else [x, y], ["a", "b"])


def planned(nodes: DataFrame, radius: int, sample: int = 2048) -> list[tuple[list[int], int]]:
    """A plan for the fingerprints of nodes, from a sample of about ``sample``; empty if there are none."""
    total = nodes.count()
    share = min(1.0, sample / max(1, total))
    drawn = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_003)) < int(np.ceil(share * 1_000_003))).select("fp").limit(4 * sample)
    drawn = np.array([r["fp"] for r in drawn.collect()], np.int64).view(np.uint64)
    return plan(drawn, total, radius) if total else []


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 3,
    shingle: int = 3,
    seed: int = 42,
    sample: int = 2048,
    block: int = BLOCK,
) -> DataFrame:
    """(id_col, fp, component_id): component_id is the smallest id among the documents that links reach."""
    found = _classed(docs, id_col, text_col, radius, shingle, seed, sample, block)
    return found.select(F.col("id").alias(id_col), "fp", "component_id")


def _classed(docs: DataFrame, id_col: str, text_col: str, radius: int = 3, shingle: int = 3, seed: int = 42, sample: int = 2048, block: int = BLOCK, more: int = 0, sketch: int = 0) -> DataFrame:
    """(id, key, fp, fp1, ..., root, component_id) for every row: root is a fingerprint that stands for the component."""
    fps = written(fingerprints(docs, id_col, text_col, shingle, seed, more, sketch), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    parts = planned(nodes, radius, sample)
    if parts:
        roots = components(links(nodes, parts, radius, block), thin=False)
    else:
        roots = nodes.select(F.col("fp").alias("node"), F.col("fp").alias("root"))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(firsts, "root").select("fp", "root", "component_id")
    return fps.join(classes.hint("merge"), "fp").select(*fps.columns, "root", "component_id")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    own = text.lower().split()
    grams = [b" ".join(own[i : i + shingle]) for i in range(len(own) - shingle + 1)] or [b" ".join(own)]
    return np.unique(np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64)).view(np.int64)


def _similar(docs: DataFrame, id_col: str, text_col: str, radius: int, wide: int, similarity: float, words: int, looks: int, **options) -> tuple[DataFrame, DataFrame]:
    """Rows as ``_classed`` gives them, and for each class (root, at, group): its first row and a root of the classes put together."""
    base = written(_classed(docs, id_col, text_col, radius, more=looks - 1, sketch=words, **options), "classes")
    names = ["fp", *[f"fp{k}" for k in range(1, looks)]]
    # rows without an id come last, rows that share one in the order of their texts' hashes
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", *names, *SKETCHED)).alias("at")
    firsts = written(base.groupBy("root").agg(first).select("root", "at", *[f"at.{c}" for c in (*names, *SKETCHED)]), "firsts")
    found = None
    for c in names:
        own = firsts.select(F.col(c).alias("fp"), "root", *SKETCHED)
        parts = planned(own, wide)
        if not parts:
            return base, firsts.select("root", "at", F.col("root").alias("group"))
        # written by themselves, so that the shuffle of one look is gone before the next one's
        met = links(own, parts, wide, similarity=similarity).select(F.col("a").alias("root_a"), F.col("b").alias("root_b"))
        met = written(met.distinct(), "met")
        found = met if found is None else found.unionByName(met)
    pairs = written(found.distinct(), "alike")
    asked = pairs.select(F.explode(F.array("root_a", "root_b")).alias("root")).distinct()
    asked = firsts.join(asked.hint("merge"), "root").select("root", F.col("at.id").alias("id_"), F.col("at.key").alias("key_"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    rows = rows.join(asked.hint("merge"), (F.col("key") == F.col("key_")) & F.col("id").eqNullSafe(F.col("id_"))).select("root", "text")

    def step():
        return lambda batch: pa.record_batch([batch.column(0), pa.array([shingle_set(t, words) for t in as_binary(batch.column(1)).to_pylist()], pa.list_(pa.int64()))], ["root", "own"])

    sets = written(map_slices(rows, step, "root long, own array<bigint>").dropDuplicates(["root"]), "sets")
    sa, sb = (sets.select(F.col("root").alias(f"root_{c}"), F.col("own").alias(f"own_{c}")) for c in "ab")
    both = pairs.join(sa.hint("merge"), "root_a").join(sb.hint("merge"), "root_b")

    def compare(batches):
        for batch in batches:
            own = [(batch.column(i).offsets.to_numpy(), batch.column(i).values.to_numpy()) for i in (2, 3)]
            good = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = (flat[at[k] : at[k + 1]] for at, flat in own)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good[k] = shared >= similarity * (len(x) + len(y) - shared)
            yield pa.record_batch([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], ["a", "b"])

    alike = map_batches(both.select("root_a", "root_b", "own_a", "own_b"), compare, "a long, b long")
    roots = components(alike, thin=False).select("node", F.col("root").alias("group"))
    return base, written(firsts.join(roots, F.col("root") == F.col("node"), "left").select("root", "at", F.coalesce("group", "root").alias("group")), "groups")


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 3,
    wide: int = 9,
    similarity: float = 0.8,
    words: int = 5,
    looks: int = 2,
    **options,
) -> DataFrame:
    """(id_col, fp, component_id) as near_duplicates gives it, and classes whose first documents are alike put together.

    First documents of classes are searched within ``wide`` bits of any of
    ``looks`` fingerprints over different hashes, and joined if the Jaccard
    similarity of their shingle sets, of ``words`` words, is at least
    ``similarity``. Pairs whose parity sketches show that they are less alike
    are dropped where they meet. Two fingerprints miss a pair independently, so each look
    more misses a part of what is left. Classes are known by fingerprints, so
    rows that have no id, or share one, are compared like others; the first
    row of a class is that of the least id, then of the least text hash, with
    null ids last.
    """
    base, classes = _similar(docs, id_col, text_col, radius, wide, similarity, words, looks, **options)
    tops = classes.groupBy("group").agg(F.min("at.id").alias("component_id"))
    named = classes.join(tops, "group").select("root", "component_id")
    return base.drop("component_id").join(named.hint("merge"), "root").select(F.col("id").alias(id_col), "fp", "component_id")  # of the classes put together


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, wide: int = 9, similarity: float = 0.8, words: int = 5, looks: int = 2, **options) -> DataFrame:
    """(id, key, n): the first row of each of similar_documents' components, by id (none is last), then ``text_key``; n: rows that have both."""
    base, classes = _similar(docs, id_col, text_col, radius, wide, similarity, words, looks, **options)
    tops = classes.groupBy("group").agg(F.min("at").alias("at")).select("at.id", "at.key")
    counts = base.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).select(F.col("id").alias("id_"), F.col("key").alias("key_"), "n")
    return tops.join(counts.hint("merge"), (F.col("key") == F.col("key_")) & F.col("id").eqNullSafe(F.col("id_"))).select("id", "key", "n")
