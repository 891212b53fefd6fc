import zlib
from collections import Counter

from pyspark.sql import functions as F
from tests.llm.test_decontamination import brute as brute_hits
from tests.llm.test_simhash import brute_components, brute_fingerprint

import corpus_pipeline
from tidemill.llm import mixing, quality
from tidemill.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def brute_similar(texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    groups = brute_components(list(fps.items()))
    firsts = sorted(set(groups.values()))
    other = {i: brute_fingerprint(texts[i], 1) if (texts[i] or "").split() else 0 for i in firsts}
    words = {i: (texts[i] or "").lower().split() for i in firsts}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    up = {i: i for i in firsts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in firsts:
        for b in firsts:
            near = a < b and any(bin(x[a] ^ x[b]).count("1") <= 9 for x in (fps, other))
            if near and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(g) for i, g in groups.items()}


def test_similar_documents_match_brute_force(spark):
    from tidemill.llm import simhash

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 500")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute_similar(texts)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    assert got == want
    # nearly all pairs that are alike by their shingles are put together
    firsts = sorted(set(brute_components([(i, brute_fingerprint(t)) for i, t in texts.items()]).values()))
    words = {i: (texts[i] or "").lower().split() for i in firsts}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    alike = [(a, b) for a in firsts for b in firsts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert alike and sum(got[a] == got[b] for a, b in alike) >= 0.9 * len(alike)
    fewer = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert len(set(want.values())) < len(set(fewer.values()))


def test_pipeline_matches_brute_force(spark):
    from hashlib import md5

    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality.scored(docs, quality.train(docs, labels)).collect() if r["_score"] >= 0.5}
    groups = brute_similar({i: r["text"] for i, r in rows.items()})
    rows = {i: r for i, r in rows.items() if groups[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {i: r for i, r in rows.items() if not brute_hits(r["text"], items)[1]}
    sizes = Counter()
    for r in rows.values():
        sizes[r["source"]] += len(r["text"].split())
    sources = sorted(sizes)
    target = dict(zip(sources, mixing.targets([sizes[s] for s in sources], mixing.cycled(sources)), strict=True))
    taken = []
    for s in sources:
        before, epochs = 0, int(target[s] // sizes[s])
        for _, i in sorted((md5(f"{i}:17".encode()).hexdigest()[:16], i) for i, r in rows.items() if r["source"] == s):
            n = len(rows[i]["text"].split())
            taken += [i] * min(3, epochs + (before + n / 2 <= target[s] - epochs * sizes[s]))
            before += n
    tokenizer, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for i in sorted(taken):
        ids = [*tokenizer.encode(rows[i]["text"], add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())
    assert want and got == sorted(want)


def test_stages_handle_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_stages_handle_nulls_repeats_and_extra_columns(spark):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "a", 0, "x"), (1, "", "en", "a", 0, "x"), (2, "good words here " * 9, None, None, 5, "y"), (3, "é" * 3000, "fr", "b", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string").withColumns({c: F.lit(c) for c in ("_score", "_spans", "_items", "size", "fp", "key", "component_id", "_kept", "_n", "_mix_id", "start", "words")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 5


def test_rows_without_an_id_or_sharing_one_are_kept_by_their_texts(spark):
    word = lambda k, i: zlib.crc32(f"{k}:{i}".encode()).to_bytes(4, "big").hex()
    text = [" ".join(word(k, i) for i in range(60)) for k in range(8)]
    near = text[0].rsplit(" ", 1)[0] + " other"
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (5, text[2]), (5, text[3]), (5, text[3]), (6, text[4]), (None, text[4]), (7, text[5]), (3, text[5]), (3, text[6]), (None, near), (9, text[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect())
    first = [x for x in got if x[1] in (text[0], near)]
    assert len(first) == 1 and first[0][0] is None
    want = {(None, text[1]), (5, text[2]), (5, text[3]), (6, text[4]), (3, text[5]), (3, text[6])}
    assert set(got) - set(first) == want and set(got.values()) == {1}
