import random

import numpy as np
import pytest
import xxhash

from tidemill.llm import components, simhash

SCHEMA = "doc_id long, text string, fp string"


def remixed(h, salt):
    m = (1 << 64) - 1
    h = (h ^ (0x9E3779B97F4A7C15 * salt & m)) * 0xBF58476D1CE4E5B9 & m
    h ^= h >> 29
    h = h * 0x94D049BB133111EB & m
    return h ^ h >> 32


def brute_fingerprint(text, salt=0):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        h = remixed(h, salt) if salt else h
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_components(pairs_of):
    ids, fps = zip(*pairs_of)
    label = list(range(len(ids)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                label[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: min(groups[find(i)]) for i in range(len(ids))}


def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeÉß") for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    out = ["", None, " \n", "one", "One", "two words", "two  words\t"]
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 400))]
        out.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            near = list(words)
            near[rng.randrange(len(near))] = "changed"
            out.append(" ".join(near))
    return out


def test_fingerprint_is_brute_force():
    for t in texts():
        assert simhash.fingerprint((t or "").encode()) == brute_fingerprint(t)
        words = (t or "").split()
        want = tuple(brute_fingerprint(t, k) for k in (0, 1, 2)) if words else (0, 0, 0)
        assert simhash.all_fingerprints((t or "").encode(), more=2) == want


@pytest.mark.parametrize("block", [2, 512])
def test_near_duplicates_match_brute_force(spark, block):
    rows = [(i * 7 % 1009, t, "clash") for i, t in enumerate(texts())]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    fps = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in got}
    assert fps == {i: brute_fingerprint(t) for i, t, _ in rows}
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components([(i, brute_fingerprint(t)) for i, t, _ in rows])


def test_search_finds_all_links_with_any_plan(spark):
    rng = np.random.default_rng(3)
    fps = list(rng.integers(0, 1 << 63, 150, dtype=np.uint64))
    for f in list(fps):
        for flips in (1, 2, 3, 4):
            fps.append(np.uint64(int(f) ^ sum(1 << int(b) for b in rng.choice(64, flips, replace=False))))
    fps = np.unique(np.array(fps, np.uint64))
    want = brute_components([(int(f), int(f)) for f in fps])
    df = spark.createDataFrame([(int(np.int64(np.uint64(f).view(np.int64))),) for f in fps], "fp long")
    for total in (100, 10**6, 10**9):
        parts = simhash.plan(fps, total)
        assert sum(t for _, t in parts) - (4 - len(parts)) * 0 >= 0 or len(parts) == 4
        assert sorted(b for bits, _ in parts for b in bits) == sorted(set(b for bits, _ in parts for b in bits))
        for block in (3, 512):
            roots = {r["node"]: r["root"] for r in components.components(simhash.links(df, parts, block=block)).collect()}
            groups = {}
            for f in fps:
                s = int(f.view(np.int64))
                groups.setdefault(roots.get(s, s), set()).add(int(f))
            assert {f: min(g) for g in groups.values() for f in g} == want


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, i) for i in range(1001, 1100)]
    loops = [(5000, 5000), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(path + star + loops, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1100)}


def test_empty_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(4, "a b c d", ""), (4, "a b c d", ""), (None, "a b c d", ""), (2, None, "")], SCHEMA)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == [(-1, 4), (2, 2), (4, 4), (4, 4)]


def test_parity_sketches_drop_no_pair_that_is_alike():
    rng = np.random.default_rng(8)
    for n in (1, 2, 9, 60, 300, 5000):
        for share in (0.0, 0.02, 0.05, 0.1, 0.11, 0.12, 0.3, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[int(n * share) :], rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            sketches = [simhash.parity(x.view(np.int64)) for x in (a, b)]
            assert [x[0] for x in sketches] == [len(a), len(b)]
            # one bucket of one slot: both rows as the search deals them
            cols = [np.zeros(2, np.int32), np.zeros(2, np.int64), *[np.zeros(2, np.int32)] * 2, np.zeros(2, np.int64), np.zeros(2, bool), np.array([3, 4]), *np.stack(sketches, axis=1)]
            got = sum(x.num_rows for x in simhash._verified(cols, np.array([0, 2]), 9, 0.8))
            assert got or shared < 0.8 * (len(a) + len(b) - shared)
            if 9 <= n <= 300 and share >= 0.3:
                assert not got


@pytest.mark.parametrize(("block", "total"), [(3, 100), (512, 10**8)])
def test_search_in_passes_finds_the_same_links(spark, monkeypatch, block, total):
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    fps = np.unique([np.uint64(int(f) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for f in fps for k in (0, 2, 5, 9)])
    apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
    # two kinds of sets: alike are those of one kind
    sketches = [simhash.parity(np.arange(k * 1000, k * 1000 + 200) << 20) for k in (0, 1)]
    rows = [(int(f.view(np.int64)), i, *map(int, sketches[i % 2])) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "fp long, root long, " + ", ".join(f"{c} long" for c in simhash.SKETCHED))
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if apart[i, j] <= 9 and i % 2 == j % 2}
    names, kept = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda table, name: names.append(name) or kept(table, name))
    parts = simhash.plan(fps, total, 9)
    once = {tuple(sorted(r)) for r in simhash.links(df, parts, 9, block, 0.8).collect()}
    assert once == want and "pass" not in names
    parted = {tuple(sorted(r)) for r in simhash.links(df, parts, 9, block, 0.8, pass_rows=8000).collect()}
    assert parted == want and names.count("pass") > 1


def test_plan_of_a_large_table_deals_out_few_rows():
    import pyarrow.dataset as ds

    texts = ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["text"])["text"].to_pylist()
    fps = np.unique(np.array([simhash.fingerprint((t or "").encode()) for t in texts], np.uint64))
    rows = [sum(1 + (len(simhash.masks(len(bits), t)) if t else 0) for bits, t in simhash.plan(fps, total, 9)) for total in (200_000, 3_000_000, 15_000_000)]
    assert max(rows) <= 100, rows  # 312 rows of 60 bytes were ten times a document's share of the input
