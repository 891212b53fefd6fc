import hashlib
import random
from collections import defaultdict

import pytest

from tidemill.llm import line_dedup as ld

WHITE = "\t\n\x0b\x0c\r "


def key(line):
    return line.strip(WHITE).translate({c: c + 32 for c in range(65, 91)})


def brute(docs):
    holders = defaultdict(set)
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i < max(holders[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def corpus(seed):
    rng = random.Random(seed)
    pool = ["short", "", "x" * 19, "y" * 20, "É" * 19, "é" * 20, "É" * 20, " \tA Line Of Twenty And More\r", "a line of twenty and more", "z" * 50, "\x1c" + "q" * 25, "q" * 25, " " + "w" * 30]
    return {i * 3: "\n".join(rng.choice([*pool, f"unique line number {i} {rng.random()}"]) for _ in range(rng.randrange(0, 12))) for i in range(40)} | {1: None, 2: "", 1000: "\n" * 5}


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_matches_brute_force(spark, batches):
    docs = corpus(batches)
    df = spark.createDataFrame([(i, t, 5) for i, t in docs.items()], "doc_id long, text string, n_lines int").repartition(3)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in ld.dedup_lines(df, batches=batches).collect()}
    assert got == brute(docs)


def test_ledger_compacts_levels_and_tells_new_keys(spark):
    ledger = ld.RunLedger(spark, fanout=2)
    new = []
    for batch in ([(1, 1, 90), (2, 2, 91)], [(1, 1, 50), (3, 3, 51)], [(1, 1, 20), (4, 4, 21)], [(2, 2, 10), (4, 4, 10)]):
        run = ledger.add(spark.createDataFrame(batch, "h1 long, h2 long, id long"))
        new.append(sorted(r["h1"] for r in run.where("owner is not null").collect()))
    assert new == [[1, 2], [3], [4], []]
    assert {level: len(runs) for level, runs in ledger.levels.items() if runs} == {2: 1}
    assert sorted(map(tuple, ledger.compacted().collect())) == [(1, 1, 3, 90), (2, 2, 2, 91), (3, 3, 1, 51), (4, 4, 2, 21)]


def test_runs_are_read_as_they_lie(spark):
    """Of a batch only its own rows are shuffled; merging runs moves and sorts nothing."""
    ledger = ld.RunLedger(spark, fanout=3, buckets=4)
    rows = spark.range(3000).selectExpr("xxhash64(id % 1000) as h1", "id % 7 as h2", "id")
    for k in (2, 1):
        ledger.add(rows.where(f"id % 3 = {k}"))
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    try:
        for df, exchanges, sorts in ((ledger.batch(rows.where("id % 3 = 0")), 1, 1), (ledger.compacted(), 0, 0)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert (plan.count("Exchange hashpartitioning"), plan.count("Sort [")) == (exchanges, sorts), plan
    finally:
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")


def test_null_ids_repeats_and_empty_table(spark):
    line = "the very same line again"
    rows = [(None, line), (1, line), (2, line), (2, line)]
    got = sorted((r["doc_id"] or 0, r["n_dropped"], hashlib.md5(r["text"].encode()).hexdigest()) for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [x[:2] for x in got] == [(0, 0), (1, 0), (2, 0), (2, 0)]  # two documents by id
    rows += [(3, line), (1, "another line of the text\n" + line)]
    got = sorted((r["doc_id"] or 0, r["n_dropped"]) for r in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (2, 1), (3, 0)]
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_text(spark):
    text = "\n".join(f"line number {i % 5000} of a long text" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, text), (3, text)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in ld.dedup_lines(df).collect()}
    assert got == {1: (60_000, 60_000), 2: (60_000, 60_000), 3: (60_000, 0)}
