import random
import re

import numpy as np

from tidemill.llm import decontamination as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def brute(text, items, window=10):
    words = WORD.findall(lowered(text))
    hit, found = set(), set()
    for item, t in items:
        own = WORD.findall(lowered(t))
        size = min(window, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def case(seed, n=40):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c1", "é", "Zß", "d"][: rng.randrange(2, 7)]
    make = lambda k: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, make(rng.randrange(0, 30))) for i in range(8)] + [(3, "x y"), (None, "q"), (9, None), (10, ""), (11, "--")]
    docs = [(i, make(rng.randrange(0, 80)) + " " + " ".join((t or "")[: rng.randrange(1, 60)] for _, t in rng.sample(items, 2)), "en") for i in range(n)]
    docs += [(n, None, "x"), (n + 1, "", "x"), (2, "x Y q", "x"), (n + 2, "zz " * 5000 + "x y " + docs[0][1], "x")]
    return docs, items


def test_matches_brute_force(spark):
    for seed in range(4):
        docs, items = case(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string, _clash string").repartition(3)
        bench = spark.createDataFrame(items, "item_id long, text string")
        for block, shard in ((8 << 20, 8 << 20), (60, 500)):
            got = d.matches(df, bench, block_bytes=block, shard_bytes=shard).withColumn("n", d.hit_words()).collect()
            have = sorted((r["doc_id"], r["_words"], r["n"], list(r["_items"])) for r in got)
            assert have == sorted((i, *brute(t, items)) for i, t, _ in docs), (seed, block)


def brute_matches(text, items, window=10):
    """Longest verbatim matches: (row, offset, start, length), none inside a longer one on the same diagonal."""
    words, out = WORD.findall(lowered(text)), set()
    for row, (_, t) in enumerate(items):
        own = WORD.findall(lowered(t))
        size = min(window, len(own))
        for i in range(len(own)):
            for p in range(len(words)):
                if own[i] == words[p] and (not i or not p or own[i - 1] != words[p - 1]):
                    n = 0
                    while i + n < len(own) and p + n < len(words) and own[i + n] == words[p + n]:
                        n += 1
                    if n >= size:
                        out.add((row, i, p, n))
    return out


def test_longest_matches_and_their_places(spark):
    docs, items = case(11, 12)
    docs = [x for x in docs if len(x[1] or "") < 2000]
    df = spark.createDataFrame(docs, "doc_id long, text string, _clash string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    for block, shard, passes in ((6 << 20, 8 << 20, 4), (40, 500, 2)):
        got = d.matches(df, bench, block_bytes=block, shard_bytes=shard, passes=passes).collect()
        have = sorted((r["doc_id"], r["_longest"], sorted((m["row"], m["offset"], m["start"], m["length"]) for m in r["_matches"])) for r in got)
        want = [(i, brute_matches(t, items)) for i, t, _ in docs]
        assert have == sorted((i, max([m[3] for m in x], default=0), sorted(x)) for i, x in want), block


def test_long_items_are_cut(spark):
    rng = random.Random(3)
    long = [f"{rng.randrange(10**12):x}" for _ in range(1_300_000)]  # 15 MB, nearly all words different
    docs = [(1, " ".join(long[700_000:700_040])), (2, " ".join(long[5:14])), (3, " ".join(long[-10:])), (4, "x " + " ".join(long[450_000:480_000]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: [(m["offset"], m["start"], m["length"]) for m in r["_matches"]] for r in d.matches(df, spark.createDataFrame([("a", " ".join(long))], "item_id string, text string")).collect()}
    assert got == {1: [(700_000, 0, 40)], 2: [], 3: [(1_299_990, 0, 10)], 4: [(450_000, 1, 30_000)]}


def test_plan_holds_few_blocks(spark):
    docs, items = case(2)
    df = spark.createDataFrame(docs, "doc_id long, text string, _clash string")
    plan = d.matches(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=20, passes=2)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("MapInArrow") <= 2


def test_longest_match_of_every_suffix():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcd"), 30)) for _ in range(5)]
    tests = d.TestSuffixes.of(["0", "1"], [texts[0], " ".join(rng.choice(list("abc"), 25))], 10)
    coded, at = d.words(__import__("pyarrow").array(texts), d.WORDS)
    words = np.array(coded.to_pylist())
    number = {w: i + 1 for i, w in enumerate(tests.vocabulary.to_pylist())}
    ids = np.concatenate([[*(number.get(w, 0) for w in words[a:b]), 0] for a, b in zip(at[:-1], at[1:])]).astype(np.int64)
    longest, place, lows, highs = d.SuffixArray(ids, tests).search(tests)
    array = d.SuffixArray(ids, tests)
    for k, s in enumerate(tests.starts):
        want = 0
        suffix = tests.ids[s : s + tests.lengths[k]]
        for p in range(len(ids)):
            n = 0
            while n < len(suffix) and p + n < len(ids) and ids[p + n] == suffix[n]:
                n += 1
            want = max(want, n)
        assert longest[k] == want
        if want:
            p = array.order[place[k]]
            assert (ids[p : p + want] == suffix[:want]).all()
        w = tests.windows[k]
        if w:
            there = sorted(p for p in range(len(ids) - w + 1) if (ids[p : p + w] == suffix[:w]).all())
            assert sorted(array.order[lows[k] : highs[k]]) == there


def test_empty_tables_and_removal(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "one two")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminated(docs, none).count() == 3
    assert d.decontaminated(docs.limit(0), none).count() == 0
    bench = spark.createDataFrame([(1, "TWO")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in d.decontaminated(docs, bench).collect()) == [1, 2]
