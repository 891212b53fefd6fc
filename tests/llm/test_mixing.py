from collections import defaultdict

import pytest

from tidemill.llm import mixing


def brute_targets(sizes, weights, most=3):
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        out = [most * s if i in capped else weights[i] * rest / weight for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in capped and out[i] > most * sizes[i] + 1e-9}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 1, 1], [5, 0, 700, 3, 3], [1], [0, 0, 7], [3, 900, 2, 1, 1, 1, 800]])
def test_targets(sizes):
    got = mixing.targets(sizes, mixing.cycled(sizes))
    assert got == pytest.approx(brute_targets(sizes, mixing.cycled(sizes)))
    assert sum(got) == pytest.approx(sum(sizes))


def rows():
    out = []
    for i in range(600):
        source = ["hot", "hot", "b", "Z", "é", None, "tiny"][i % 7] if i % 40 else "tiny"
        out.append((i, source, "w " * (i * 13 % 50) if i % 11 else None, i))
    return out


@pytest.mark.parametrize("partitions", [1, 9])
def test_mix_meets_targets(spark, partitions):
    df = spark.createDataFrame(rows(), "doc_id long, source string, text string, size int")
    got = mixing.mix(df, partitions=partitions).collect()
    again = mixing.mix(df.repartition(13), partitions=4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {r[0]: r[1] for r in rows()}
    size, taken, target, most = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        most[s] = max(most[s], r["size"])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == pytest.approx(brute_targets([size[s] for s in order], mixing.cycled(order)))
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6 for s in order)


def test_mixed_rows(spark):
    df = spark.createDataFrame(rows(), "doc_id long, source string, text string, size int")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    seen = defaultdict(int)
    for r in out.collect():
        seen[r["doc_id"]] += 1
    assert dict(seen) == {i: c for i, c in copies.items() if c}


def test_edges(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None), (1, None, None), (None, "a", "")], schema)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 3
