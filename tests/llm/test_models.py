import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tidemill.llm import ftrl, language_id, lm_scoring, ngrams, quality
from tidemill.llm import queries as q

SF = "/root/testdata/sf0.01"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_ngram_counts_are_plain_counts():
    texts = pa.array(["abcab", "", None, "ÀbÀb" * 3, "a"])
    for lower in (True, False):
        got = list(ngrams.counts(texts, (1, 2, 3), lower))
        for t, (at, n) in zip(texts.to_pylist(), got, strict=True):
            t = t or ""
            grams = [t[i : i + k] for k in (1, 2, 3) for i in range(len(t) - k + 1)]
            assert n.sum() == len(grams) and (np.diff(at) > 0).all()
            assert sorted(n.tolist()) == sorted(Counter(grams).values())
    together = list(ngrams.counts(texts, (2,)))
    alone = [next(ngrams.counts(pa.array([t]), (2,))) for t in texts.to_pylist()]
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(together, alone, strict=True))


def test_ftrl_is_sparse_and_calibrated():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(600):
        y = int(rng.integers(3))
        at = np.unique(np.concatenate([rng.integers(10 * y, 10 * y + 10, 4), rng.integers(30, 500, 10)]))
        rows.append((at, np.ones(len(at), np.float32) / np.sqrt(len(at))))
        labels.append(y if rng.random() < 0.9 else int(rng.integers(3)))
    labels = np.array(labels)
    model = ftrl.FtrlClassifier(500, 3, l1=0.6).fit(rows[:400], labels[:400]).calibrate(rows[400:500], labels[400:500])
    w, b = model.freeze()
    p = ftrl.softmax(np.array([x @ w[at] + b for at, x in rows[500:]]))
    assert (p.argmax(1) == labels[500:]).mean() > 0.8
    assert (w == 0).mean() > 0.3 and 0.02 <= model.temperature <= 50
    assert abs(p.max(1).mean() - (p.argmax(1) == labels[500:]).mean()) < 0.1


def test_languages_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in q.op5_language_id(spark, SF).collect()}
    lang = {r["doc_id"]: r["lang"] for r in table(spark, "documents").collect()}
    held = [i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in held]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score int"
    rows = [(i, "der die das und nicht " * 3 if i % 2 else "the and of with this ", "de" if i % 2 else "en", 0) for i in range(40)]
    rows += [(100, None, "en", 0), (101, "12 !! \n", "de", 0), (102, "", None, 0), (None, "the and of", None, 0), (103, "die und " * 100_000, None, 0)]
    df = spark.createDataFrame(rows, schema)
    model = language_id.train(df, ~q._held_out(4))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(df, model).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[None][0] == "en" and got[103][0] == "de"
    empty = language_id.train(df.limit(0), ~q._held_out(4))
    assert {r["lang_pred"] for r in language_id.predict(df, empty).collect()} == {"und"}


def plain_buckets(text, orders):
    """Buckets of all character n-grams, by their definition, with counts."""
    place, out = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], Counter()
    for n in orders:
        for i in range(len(text) - n + 1):
            h = n
            for k, c in enumerate(text[i : i + n]):
                h ^= (ord(c) + k + 1) * place[k] % 2**32
                h = (h << 5 | h >> 27) % 2**32
            out[h * 0x2545F491 % 2**32 >> 17] += 1
    return out


def plain_odds(text, orders, idf, weights, bias):
    x = {b: (1 + math.log(n)) * idf[b] for b, n in plain_buckets(text, orders).items()}
    size = math.sqrt(sum(v * v for v in x.values())) or 1
    return [sum(v / size * float(weights[b][c]) for b, v in x.items()) + float(bias[c]) for c in range(len(bias))]


def test_predictions_are_those_of_plain_sums(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in table(spark, "documents", "/root/testdata/sf0.001").collect()]
    docs += [(9001, "²½ 12", "en"), (9002, "ª", "en"), (9003, "", None), (9004, None, "de"), (9005, "Ǆ", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language_id.train(df, ~q._held_out(4))
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    own = [lower(t) for i, t, lang in docs if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    df_ = Counter(b for t in own for b in plain_buckets(t, language_id.ORDERS))
    idf = [math.log((1 + len(own)) / (1 + df_[b])) + 1 for b in range(1 << 15)]
    assert np.allclose(model.idf, idf, atol=1e-5)
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    for i, t, _ in docs:
        if not any(__import__("unicodedata").category(c)[0] == "L" for c in t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        z = np.array(plain_odds(lower(t), language_id.ORDERS, idf, model.weights, model.bias))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(got[i]["score"] - p.max()) < 1e-3 and p[model.languages.index(got[i]["lang_pred"])] > p.max() - 1e-3


def test_quality_scores_are_those_of_plain_sums(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, "documents", sf), table(spark, "labels", sf)
    model = quality.train(docs, labels)
    rows = docs.collect()
    df_ = Counter(b for r in rows for b in plain_buckets(r["text"] or "", quality.ORDERS))
    assert np.allclose(model.idf, [math.log((1 + len(rows)) / (1 + df_[b])) + 1 for b in range(1 << 15)], atol=1e-5)
    got = {r["doc_id"]: r for r in quality.scored(docs, model).collect()}
    for r in rows:
        a = plain_odds(r["text"] or "", quality.ORDERS, model.idf, *model.content)
        at, x = quality.meta_row((r["text"] or "").encode(), r["source"], r["lang"], r["n_chars"])
        b = [float(sum(x[k] * model.meta[0][at[k]][c] for k in range(len(at))) + model.meta[1][c]) for c in (0, 1)]
        odds = model.combination[0] * (a[1] - a[0]) + model.combination[1] * (b[1] - b[0]) + model.combination[2]
        assert abs(got[r["doc_id"]]["_score"] - 1 / (1 + math.exp(-odds))) < 1e-3


def test_quality_sample_is_bounded_by_ids(spark):
    rows = [(i % 20, f"row {j} of {i}" + " ##" * (i % 2), "s", "en", j) for i in range(20) for j in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    sizes, plain = [], quality._rounds
    quality._rounds = lambda views, y, *more: sizes.append(len(y)) or plain(views, y, *more)
    try:
        quality.train(docs, labels)
    finally:
        quality._rounds = plain
    assert sizes[0] <= 20


def test_quality_of_labelled_documents(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    seen = labels.where("doc_id % 3 <> 0")
    got = {r["doc_id"]: r["_score"] for r in quality.scored(docs, quality.train(docs, seen)).collect()}
    held = [(got[r["doc_id"]], r["quality"]) for r in labels.where("doc_id % 3 = 0").collect()]
    assert len(got) == docs.count() and np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.93
    good = [s >= 0.5 for s, y in held if y]
    assert np.mean(good) > 0.97


def test_views_teach_each_other():
    rng = np.random.default_rng(1)
    def row(y, k):
        at = np.unique(rng.integers(20 * y + k, 20 * y + k + 15, 5))
        return at, np.full(len(at), 1 / np.sqrt(len(at)), np.float32)
    y = np.array([0, 1] * 3)
    pool_y = rng.integers(0, 2, 300)
    views = [[row(c, 0) for c in y], [row(c, 3) for c in y]]
    pools = [[row(c, 0) for c in pool_y], [row(c, 3) for c in pool_y]]
    test_y = rng.integers(0, 2, 300)
    test = [[row(c, 0) for c in test_y], [row(c, 3) for c in test_y]]
    right = lambda m, v: ((m.logits(v)[:, 1] > m.logits(v)[:, 0]) == test_y).mean()
    alone = quality.co_train(views, y, pools, [60, 60], rounds=0)
    taught = quality.co_train(views, y, pools, [60, 60], rounds=4)
    assert all(right(b, v) > max(0.95, right(a, v) - 1e-9) for a, b, v in zip(alone, taught, test, strict=True))


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "x", "s", "en", 1), (2, "", "s", "en", -5), (2, "y " * 100_000, "s", "en", 7)], "doc_id long, text string, source string, lang string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels, score in ((none, 1.0), (spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, quality int"), 0.0)):
        assert {r["_score"] for r in quality.scored(docs, quality.train(docs, labels)).collect()} == {score}
    both = spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "doc_id long, quality int")
    assert all(0 <= r["_score"] <= 1 for r in quality.scored(docs, quality.train(docs, both)).collect())
    assert quality.kept(docs.limit(0), both).count() == 0 and quality.kept(docs, none).columns == docs.columns


def test_pseudo_labels_come_from_all_unlabelled_documents(spark):
    odds = [(i if i % 5 else None, i, i / 100 - 20.0, 15.0 - i / 200) for i in range(5000)]
    found = quality.confident(spark.createDataFrame(odds, "id long, key long, odds0 double, odds1 double").repartition(4), 0.1, 0.6, 40)
    by = {(k, y): [key for _, key, kk, yy in found if (kk, yy) == (k, y)] for k in (0, 1) for y in (0, 1)}
    assert [len(by[x]) for x in ((0, 1), (0, 0), (1, 1), (1, 0))] == [24, 16, 24, 16]
    assert min(by[0, 1]) >= 4698 and max(by[0, 0]) <= 201 and max(by[1, 1]) <= 301 and min(by[1, 0]) >= 4798
    # a pool of one document used to teach from one document in expectation, or none; all are looked at whatever the pool
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    rows = [(i, ("clear prose here " if i % 2 else "$$ 99 ## ") * (3 + i % 7), "a" if i % 2 else "b", "en", 40 + i) for i in range(200)]
    seen, plain = [], quality._rounds

    def spied(views, labels, dims, rounds, exchange):
        return plain(views, labels, dims, rounds, lambda models: seen.append(exchange(models)) or seen[-1])

    quality._rounds = spied
    try:
        quality.train(spark.createDataFrame(rows, schema), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"), pool=1)
    finally:
        quality._rounds = plain
    assert len(seen) == 3 and all(seen)


def test_few_unlabelled_documents_still_teach():
    def row(k):
        at = np.arange(10 * k, 10 * k + 4)
        return at, np.full(4, 0.5, np.float32)

    views = [[row(0), row(1)] * 3] * 2
    n = []
    plain = quality._fitted
    quality._fitted = lambda rows, labels, dim: n.append(len(rows)) or plain(rows, labels, dim)
    try:
        quality.co_train(views, np.array([0, 1] * 3), [[row(0), row(1)]] * 2, [60, 60], rounds=1)
    finally:
        quality._fitted = plain
    assert n[-1] > n[0]


WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return [*WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)})), None]


def lm_case():
    rng = random.Random(6)
    words = ["the", "The", "of", "tion", "é", " x", "w" * 80] + [f"r{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 60), weights=[20, 5, 10, 5, 5, 2, 2] + [0.3] * 60)) for _ in range(120)]
    return [(i, t, 1) for i, t in enumerate(texts)] + [(500, None, 1), (501, "", 1), (502, "unseen words here", 1), (503, "the of " * 30_000, 1), (503, "the of " * 30_000, 1), (None, "the", 1)]


def test_base_scores_and_known_tokens(spark):
    rows = lm_case()
    df = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(4)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t, _ in rows)
    for head, singles, endings in ((65_023, 511, 512), (10, 4, 3), (0, 0, 1)):
        model = lm_scoring.train(df, ~q._held_out(7), head=head, singles=singles, endings=endings)
        assert (model.total, model.distinct) == (n, v)
        got = lm_scoring.score(df, model).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
        assert all(r["score"] < 0 for r in got)


def plain_probabilities(model, context, words_):
    """ln of each word's probability behind two words, factor by factor, with sums over all kinds and members."""
    p, coder, first = model.lbl.params, model.coder, model.coder.first
    head = {w: i for i, w in enumerate(coder.head.to_pylist())}
    counts = {r["word"]: r["n"] for r in model.vocabulary.collect()}
    ending = lambda w: zlib.crc32(w.encode()[-3:]) % coder.endings

    def kind(w):
        return 0 if w is None else 1 + head[w] if head.get(w, 1 << 60) < coder.singles else first + ending(w)

    members = {c: sorted((i, w) for w, i in head.items() if i >= coder.singles and ending(w) == c) for c in range(coder.endings)}
    one, two = (kind(w) for w in context)
    kinds = [float(np.float64(p["R1"][one] + p["R2"][two]) @ np.float64(p["Q"][k]) + p["b"][k]) for k in range(coder.kinds)]
    out = []
    for w in words_:
        k = kind(w)
        x = kinds[k] - math.log(sum(map(math.exp, kinds)))
        if k >= first:
            own = [m for _, m in members[k - first]]
            start = int(coder.starts[k - first])
            scores = [float(np.float64(p["S"][one]) @ np.float64(p["M"][u, :-1]) + p["M"][u, -1]) for u in range(start, start + len(own) + 1)]
            x += scores[own.index(w) if w in own else len(own)] - math.log(sum(map(math.exp, scores)))
            if w not in own:
                others = [n for v, n in counts.items() if v not in head and ending(v) == k - first]
                x += math.log((counts.get(w, 0) + 1) / (sum(others) + len(others) + 1))
        out.append(x)
    return out


def test_scores_are_sums_of_plain_probabilities(spark):
    df = spark.createDataFrame(lm_case(), "doc_id long, text string, score int")
    model = lm_scoring.train(df, ~q._held_out(7), head=30, singles=5, endings=7)
    texts = {i: t for i, t, _ in lm_case()}
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(df, model).collect()}
    for i in (0, 1, 2, 3, 500, 501, 502, None):
        own = [None, None, *tokens(texts[i])]
        want = sum(plain_probabilities(model, (own[k + 1], own[k]), [own[k + 2]])[0] for k in range(len(own) - 2)) / math.log(10)
        assert abs(got[i] - want) < 1e-3 * max(1, abs(want))


def test_probabilities_are_normalised(spark):
    df = spark.createDataFrame(lm_case(), "doc_id long, text string, score int")
    model = lm_scoring.train(df, ~q._held_out(7), head=30, singles=5, endings=7)
    all_words = [None, *[r["word"] for r in model.vocabulary.collect()]]
    # a word never met for each class stands for all of its class
    new = {}
    for i in range(1000):
        new.setdefault(zlib.crc32(f"_{i}".encode()[-3:]) % 7, f"_{i}")
    for context in ((None, None), ("the", None), ("of", "r5"), ("never", "met")):
        assert abs(sum(map(math.exp, plain_probabilities(model, context, [*all_words, *new.values()]))) - 1) < 1e-4


def chained(n):
    rng = random.Random(1)
    texts = []
    for _ in range(n):
        t, w = [], rng.choice("abcdefgh")
        for _ in range(60):
            t.append(w)
            w = "abcdefgh"[("abcdefgh".index(w) + (1 if rng.random() < 0.9 else rng.randrange(8))) % 8]
        texts.append(" ".join(t))
    return texts


def test_model_learns_order_at_any_layout(spark):
    df = spark.createDataFrame(list(enumerate(chained(400) * 8)), "doc_id long, text string")
    found = []
    for parts, options in ((1, {}), (64, {}), (64, {"shard_tokens": 40_000}), (3, {"shard_tokens": 40_000})):
        own = df.repartition(parts)
        model = lm_scoring.train(own, ~q._held_out(7), **options)
        r = lm_scoring.score(own.where(q._held_out(7)), model).selectExpr("sum(score) / sum(n_tokens) s", "sum(base_score) / sum(n_tokens) b").first()
        found.append((r["s"], r["s"] - r["b"]))
    assert abs(found[0][0] - found[1][0]) < 1e-6 and abs(found[2][0] - found[3][0]) < 1e-4
    assert all(gain > 0.4 for _, gain in found) and found[3][1] > 0.9 * found[0][1]


def test_members_of_a_class_follow_their_context(spark):
    rng = random.Random(2)
    left, right = [f"l{i}xyz" for i in range(20)], [f"r{i}xyz" for i in range(20)]  # one ending, so one class
    texts = [" ".join(x for _ in range(30) for x in (("in", rng.choice(left)) if rng.random() < 0.5 else ("out", rng.choice(right)))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm_scoring.train(df, ~q._held_out(7), singles=2)
    near, far = plain_probabilities(model, ("in", None), [left[0], right[0]])
    assert near > far + 1 and sum(plain_probabilities(model, ("out", None), [right[0], left[0]])) != near + far


def test_head_takes_the_most_frequent_words(spark):
    counts = {f"w{i}": 1 + i // 50 for i in range(1000)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    for most in (0, 1, 37, 120, 975, 2000):
        names, n = lm_scoring.frequent(df, most)
        assert sorted(n.tolist(), reverse=True) == n.tolist() == sorted(counts.values(), reverse=True)[:most] and len(set(names)) == len(names)


def test_repeated_rows_are_weights(spark):
    df = spark.createDataFrame([(3, "a b c d")] * 5000 + [(2, "b a")] * 3, "doc_id long, text string")
    a, b = (lm_scoring.train(df.repartition(n), ~q._held_out(7)) for n in (1, 7))
    assert np.allclose(a.lbl.state(), b.lbl.state(), atol=1e-6) and a.total == 5000 * 5 + 3 * 3


def test_empty_training_set(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = lm_scoring.train(df.limit(0), ~q._held_out(7))
    got = {r["doc_id"]: r for r in lm_scoring.score(df, model).collect()}
    assert got[1]["base_score"] == 0 and got[1]["n_known"] == 0 and got[1]["n_tokens"] == 3
    assert lm_scoring.score(df.limit(0), model).count() == 0
