import random

import numpy as np
import pyarrow as pa

from tidemill.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, c string"


def corpus(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    fresh = lambda n: [word() for _ in range(n)]
    passage = fresh(60)
    docs = {}
    for i in range(30):
        docs[i] = " ".join(fresh(40)) + "\n" + " ".join(fresh(rng.randrange(20, 90)))
    for i in (3, 8, 21):
        own = fresh(rng.randrange(5, 40)) + [w.upper() if i == 8 else w for w in passage] + fresh(rng.randrange(5, 40))
        docs[i] = docs[i] + "\n" + " ".join(own)
    copy = fresh(120)
    docs[40], docs[41] = " ".join(copy), "\n".join([" ".join(copy), " ".join(fresh(30))])
    return docs, passage


def rows(docs):
    return [(i, t, "clash") for i, t in docs.items()]


def test_planted_passages_are_found_and_others_left_alone(spark):
    docs, _ = corpus()
    got = {r["doc_id"]: r for r in sd.summary(spark.createDataFrame(rows(docs), SCHEMA).repartition(3)).collect()}
    assert {i: r["classes"] for i, r in got.items() if r["classes"]} == {3: [3], 8: [3], 21: [3], 40: [40], 41: [40]}
    assert all(r["n_removed"] == 0 for i, r in got.items() if i in (3, 40)) and all(got[i]["removed_words"] >= 25 for i in (8, 21, 41))


def test_texts_without_repeats(spark):
    docs, passage = corpus()
    kept = {r["doc_id"]: r["text"] for r in sd.without_repeats(spark.createDataFrame(rows(docs), SCHEMA)).collect()}
    assert all(kept[i] == docs[i] for i in docs if i not in (8, 21, 41))
    for i in (8, 21, 41):
        assert len(kept[i].split()) < len(docs[i].split()) and set(kept[i].split()) <= set(docs[i].split())
    again = sd.summary(spark.createDataFrame([(i, t, "") for i, t in kept.items()], SCHEMA)).where("n_removed > 0").count()
    assert again == 0


def test_paragraphs_depend_on_their_surroundings_only():
    docs, passage = corpus()
    p = sd.paragraphs(pa.array(["x y z " * 9 + " ".join(passage), " ".join(passage) + " q r s" * 5, None, "", "a\nb"]), sd.Settings())
    assert len(set(p.content[p.text == 0]) & set(p.content[p.text == 1])) >= 2
    assert p.per_text.tolist()[2:] == [0, 0, 0]


def test_links_match_brute_force_jaccard(spark):
    rng = random.Random(9)
    s = sd.Settings(radius=6, block=3, threshold=0.5, recall=0.999999)
    base = [[rng.choice("abcdefghijklmnop") * rng.randrange(1, 4) for _ in range(12)] for _ in range(4)]
    texts = []
    for b in base:
        for _ in range(8):
            t = list(b)
            if rng.random() < 0.7:
                t[rng.choice([0, 1, 10, 11])] = "new" + str(rng.randrange(3))
            texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    own = {}
    for t in set(texts):
        p = sd.paragraphs(pa.array([t]), s)
        ends = [*p.first[1:].tolist(), len(p.shingles)]
        for k in range(len(p.content)):
            own[int(p.content[k : k + 1].view("int64")[0])] = set(p.shingles[p.first[k] : ends[k]].tolist())
    met = sd.collided(sd.banded(df, s), 4).where("band is not null")
    sets = sd.shingle_sets(df, met.groupBy("c").agg(sd.F.min(sd.F.struct("doc", "unit")).alias("at")).select("c", "at.doc", "at.unit"), s)
    roots = {r["node"]: r["root"] for r in sd.components(sd.verified(met, sets, s, 4)).collect()}
    parent = {c: c for c in own}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for a in own:
        for b in own:
            if len(own[a] & own[b]) >= 0.5 * len(own[a] | own[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {c: roots.get(c, c) for c in own} == {c: find(c) for c in own}


def test_tuning_and_empty_table(spark):
    bands, width = sd.tuned(0.8, 0.99)
    assert 1 - (1 - 0.8**width) ** bands >= 0.99
    assert sd.summary(spark.createDataFrame([], SCHEMA)).count() == 0
    got = sd.summary(spark.createDataFrame([(1, None, ""), (None, "a b " * 30, ""), (1, "", "")], SCHEMA)).collect()
    assert len(got) == 3 and not any(r["classes"] for r in got)


def test_passages_of_short_lines_are_found(spark):
    rng = random.Random(4)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    verse = "\n".join(" ".join(fresh(9)) for _ in range(12))
    spaced = "\n\n".join(" ".join(fresh(7)) for _ in range(12))
    mixed = "\n".join(" ".join(fresh(n)) for n in (22, 8, 22))
    docs = {10 * k + i: " ".join(fresh(30)) + "\n" + x + "\n" + " ".join(fresh(40)) for k, x in enumerate((verse, spaced, mixed)) for i in (1, 2)}
    got = {r["doc_id"]: r for r in sd.summary(spark.createDataFrame(rows(docs), SCHEMA)).collect()}
    assert {i: r["classes"] for i, r in got.items()} == {1: [1], 2: [1], 11: [11], 12: [11], 21: [21], 22: [21]}
    assert got[2]["removed_words"] >= 80 and got[12]["removed_words"] == 84 and got[22]["removed_words"] == 52
    p = sd.paragraphs(pa.array([verse, spaced, mixed, "a b\n\nc d e"]), sd.Settings())
    assert [int(p.words[(p.text == k) & (p.parts == 0)].sum()) for k in range(4)] == [108, 84, 52, 5]


def test_paragraphs_with_a_changed_word_are_near_duplicates(spark):
    rng = random.Random(12)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    docs = {}
    for k in range(40):  # 51 of 61 shingles are the same
        line = fresh(60)
        for i, w in enumerate((line, line[:30] + ["other"] + line[31:])):
            docs[2 * k + i] = " ".join(fresh(20)) + "\n" + " ".join(w) + "\n" + " ".join(fresh(20))
    got = {r["doc_id"]: r for r in sd.summary(spark.createDataFrame(rows(docs), SCHEMA)).collect()}
    # bands find at least 0.99 of the pairs, not all
    whole = [i for i in docs if got[i]["removed_words"] == (60 if i % 2 else 0) and got[i]["classes"] == [i // 2 * 2]]
    assert len(whole) >= 78 and {i for i in docs if i % 2 == 0} <= set(whole)
    kept = {r["doc_id"]: r["text"] for r in sd.without_repeats(spark.createDataFrame(rows(docs), SCHEMA)).collect()}
    assert all(len(kept[i].split()) == (40 if i % 2 else 100) for i in whole)


def test_a_line_stands_before_its_parts():
    rng = random.Random(3)
    line = " ".join(str(rng.random()) for _ in range(90))
    p = sd.paragraphs(pa.array(["x y z a b c d e f g h i\n" + line, "", line]), sd.Settings())
    for t in (0, 2):
        own = np.flatnonzero(p.text == t)
        assert p.number[own].tolist() == list(range(len(own))) and p.words[own][p.parts[own] == 0].sum() == (102, 0, 90)[t]
        assert p.part[own][p.parts[own] == 0].tolist() == list(range((p.parts[own] == 0).sum()))
        (k,) = own[p.parts[own] > 0]
        assert p.words[k] == 90 and p.part[k] == p.part[k + 1] and p.words[k + 1 : k + 1 + p.parts[k]].sum() == 90


def test_recall_of_passages_inside_other_text():
    """Of exact passages of 51 to 60 words between other words of one line, nearly all leave a run that is long enough."""
    rng, s, lost = random.Random(1), sd.Settings(), 0
    some = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    for i in range(400):
        passage = some(51 + i % 10)
        p = sd.paragraphs(pa.array([" ".join(some(60) + passage + some(20)), " ".join(some(37) + passage + some(80))]), s)
        plain = p.parts == 0
        first, run, best = set(p.content[plain & (p.text == 0)].tolist()), 0, 0
        for c, k in zip(p.content[plain & (p.text == 1)].tolist(), p.words[plain & (p.text == 1)].tolist(), strict=True):
            run = run + k if c in first else 0
            best = max(best, run)
        lost += best < s.min_run
    assert lost <= 0.02 * 400
