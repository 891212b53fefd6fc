"""Quality classification by co-training on two views of a document.

The content view is the text's hashed, cased character n-grams, TF-IDF
weighted with document frequencies over all documents. The metadata view is
what a page record tells without its wording: source, language, length, and
layout (lines, their lengths, shares of kinds of characters, repetition);
page tables that name no document can add nothing to it.
Both views start from a sample of labelled documents. In each round, all
unlabelled documents are scored where they lie, and each view hands those it
is most confident about, by quantiles over all that are left, to the other
view; classes are added in the proportions of the labels.
Held-back labels then calibrate both views (temperature) and fit the
logistic combination of their log-odds that scores all documents.

Bounded: ``labelled`` (documents of the labelled sample, drawn by hash) and
``pool``: a view is taught at most ``share`` of so many documents a round,
drawn by hash from all confident ones. All else covers every document.

Defined results: a null text is an empty one and its score is the views' own;
null metadata are a value of their own; labels that repeat are averaged, ties
and null labels teach nothing; without labels of both classes every document
scores the mean label (1 if there is none); rows that repeat an id are scored
each, and of a labelled id's rows the one of the least hash teaches; the
sample is taught in the order of a hash of the id, and documents of equal odds
are drawn in that of a hash of id and row; null ids are scored and may be
drawn as unlabelled; very long texts are read whole; other columns, whatever
their names, are handed on; ids must be whole numbers or null; an empty table
gives an empty result.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .arrowtext import as_binary, map_batches, map_slices
from .ftrl import FtrlClassifier, Row
from .store import written

ORDERS = (1, 2)
META_BITS = 12
META = ["source", "lang", "n_chars"]
#: Kinds of bytes whose shares the metadata view knows.
KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "mark": [33, *range(35, 39), 42, 43, 60, 61, 62, 64, 94, 96, 124, 126], "stop": [44, 46, 58, 59, 63], "beyond": range(128, 256)}
_KIND_OF = np.full(256, len(KINDS), np.uint8)
for _i, _k in enumerate(KINDS.values()):
    _KIND_OF[list(_k)] = _i


def layout(text: bytes) -> list[str]:
    """What the text's layout says, each finding as a name and a coarse value."""
    n = max(1, len(text))
    lines = text.split(b"\n")
    own = text.split()
    shares = np.bincount(_KIND_OF[np.frombuffer(text, np.uint8)], minlength=len(KINDS) + 1)[: len(KINDS)] / n
    level = lambda x: int(np.log2(1 + x))
    out = [f"{name}:{min(20, int(share * 40))}" for name, share in zip(KINDS, shares, strict=True)]
    out += [f"lines:{level(len(lines))}", f"line:{level(n / len(lines))}", f"words:{level(len(own))}", f"word:{int(n / max(1, len(own)))}"]
    out.append(f"run:{int(10 * sum(map(operator.eq, own, own[1:])) / max(1, len(own)))}")
    out.append(f"again:{int(10 * len(set(own)) / max(1, len(own)))}:{min(8, level(len(own)))}")
    out.append(f"lineagain:{int(4 * len(set(lines)) / len(lines))}")
    return out


def meta_row(text: bytes, source: str | None, lang: str | None, n_chars: int | None) -> Row:
    names = [f"source={source}", f"lang={lang}", "chars=none" if n_chars is None else f"chars={int(np.log2(1 + max(0, n_chars)))}", *layout(text)]
    at = np.unique([xxhash.xxh32_intdigest(x) >> (32 - META_BITS) for x in names])
    return at, np.full(len(at), 1 / np.sqrt(len(at)), np.float32)


@dataclass
class QualityModel:
    idf: np.ndarray
    content: tuple[np.ndarray, np.ndarray]
    meta: tuple[np.ndarray, np.ndarray]
    combination: np.ndarray  # weights of the two log-odds, and a constant
    constant: float | None  # the score of all documents if nothing could be learned

    def scores(self, texts: pa.Array, metadata: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's probability of quality, and the two views' log-odds."""
        if self.constant is not None:
            n = len(texts)
            return np.full(n, self.constant), np.zeros(n), np.zeros(n)
        a = content_odds(texts, self.idf, self.content)
        rows = [meta_row(text, *record) for text, record in zip(as_binary(texts).to_pylist(), zip(*metadata, strict=True), strict=True)]
        b = meta_odds([at for at, _ in rows], self.meta)
        return _sigmoid(self.combination[0] * a + self.combination[1] * b + self.combination[2]), a, b


def content_odds(texts: pa.Array, idf: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The content view's log-odds of each text."""
    weights, bias = model
    z = ngrams.sums(texts, ORDERS, idf, weights[:, 1:] - weights[:, :1], lower=False)
    return z[:, 0].astype(np.float64) + float(bias[1] - bias[0])


def meta_odds(rows: list[np.ndarray], model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The metadata view's log-odds of rows of features."""
    weights, bias = model
    way = (weights[:, 1] - weights[:, 0]).astype(np.float64)
    return np.array([way[at].sum() / np.sqrt(max(1, len(at))) for at in rows], np.float64) + float(bias[1] - bias[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _odds(model: FtrlClassifier, rows: list[Row]) -> np.ndarray:
    z = model.logits(rows) / model.temperature
    return z[:, 1] - z[:, 0]


def _fitted(rows: list[Row], labels: np.ndarray, dim: int, epochs: int = 4) -> FtrlClassifier:
    return FtrlClassifier(dim, 2).fit(rows, labels, epochs)


def _rounds(views: list[list[Row]], labels: np.ndarray, dims: list[int], rounds: int, exchange) -> list[FtrlClassifier]:
    """Two classifiers that teach each other: ``exchange(models)`` gives (view, row of that view, label) to learn, or nothing."""
    taught = [(list(v), list(labels)) for v in views]
    models = [_fitted(v, np.array(y), d) for (v, y), d in zip(taught, dims, strict=True)]
    for _ in range(rounds):
        found = exchange(models)
        if not found:
            break
        for other, row, y in found:
            taught[other][0].append(row)
            taught[other][1].append(y)
        models = [_fitted(v, np.array(y), d) for (v, y), d in zip(taught, dims, strict=True)]
    return models


def co_train(views: list[list[Row]], labels: np.ndarray, pools: list[list[Row]], dims: list[int], rounds: int = 3, share: float = 0.1) -> list[FtrlClassifier]:
    """Co-training in memory; views and pools: rows of the labelled and unlabelled documents, by view."""
    left = np.arange(len(pools[0]))
    good = labels.mean()
    n = max(1, int(share * len(pools[0])))

    def exchange(models):
        nonlocal left
        found, used = [], set()
        for k, other in ((0, 1), (1, 0)):
            if not len(left):
                break
            odds = _odds(models[k], [pools[k][i] for i in left])
            order = np.argsort(odds, kind="stable")
            best = order[::-1][: max(1, round(n * good))]
            worst = order[: max(1, round(n * (1 - good)))]
            for picks, y in ((best[odds[best] > 0], 1), (worst[odds[worst] < 0], 0)):
                found += [(other, pools[other][i], y) for i in left[picks].tolist()]
                used.update(left[picks].tolist())
        left = np.array([i for i in left if i not in used], np.int64)
        return found

    return _rounds(views, labels, dims, rounds, exchange)


KEY = ["id", "key"]


def keyed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, key, text, source, lang, n_chars): key is a hash of all but the id; rows that have both alike are copies."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), "text", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))
    return rows.withColumn("key", F.xxhash64("text", *META))


def content_view(rows: DataFrame, idf: np.ndarray, model: FtrlClassifier) -> DataFrame:
    """(id, key, odds) of every keyed row, by its text."""
    shared = rows.sparkSession.sparkContext.broadcast((idf, model.freeze()))

    def step():
        return lambda batch: pa.record_batch([batch.column(0), batch.column(1), pa.array(content_odds(batch.column(2), *shared.value))], ["id", "key", "odds"])

    return map_slices(rows.select(*KEY, "text"), step, "id long, key long, odds double")


def meta_rows(rows: DataFrame) -> DataFrame:
    """(id, key, meta) of every keyed row: the features of its metadata view, which no round changes."""

    def step():
        def apply(batch):
            text, source, lang, chars = (batch.column(i) for i in range(2, 6))
            meta = [meta_row(*r)[0].astype(np.int16) for r in zip(as_binary(text).to_pylist(), source.to_pylist(), lang.to_pylist(), chars.to_pylist(), strict=True)]
            return pa.record_batch([batch.column(0), batch.column(1), pa.array(meta, pa.list_(pa.int16()))], ["id", "key", "meta"])

        return apply

    return map_slices(rows.select(*KEY, "text", *META), step, "id long, key long, meta array<smallint>")


def meta_view(metas: DataFrame, model: FtrlClassifier) -> DataFrame:
    """(id, key, odds) of rows of ``meta_rows``."""
    shared = metas.sparkSession.sparkContext.broadcast(model.freeze())

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(meta_odds([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], shared.value))], ["id", "key", "odds"])

    return map_batches(metas, run, "id long, key long, odds double")


def beyond(odds: DataFrame, view: int, share: float, good: float, most: int) -> list[tuple[int | None, int, int, int]]:
    """(id, key, view, label): for each label, rows of (id, key, odds) beyond a quantile of all odds, at most about ``most``.

    The quantiles leave ``share`` of the rows, split as the labels are; of more rows than ``most`` hashes decide.
    """
    cuts = [share * (1 - good), 1 - share * good]
    row = odds.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("odds", cuts, 10_000).alias("q")).first()
    if not row["n"]:
        return []
    size, (low, high), x = min(most, max(1, int(share * row["n"]))), row["q"], F.col("odds")
    found = []
    for y, far, part in ((1, (x > 0) & (x >= high), good), (0, (x < 0) & (x <= low), 1 - good)):
        # copies are one, and a quantile that ties take in is drawn from like any other
        drawn = odds.where(far).select(*KEY).distinct().orderBy(F.xxhash64(*KEY, F.lit(view)), *KEY).limit(max(1, round(size * part)))
        found += [(r["id"], r["key"], view, y) for r in drawn.collect()]
    return found


def confident(odds: DataFrame, share: float, good: float, most: int) -> list[tuple[int | None, int, int, int]]:
    """``beyond`` for both views of a table that has odds0 and odds1."""
    return [x for k in (0, 1) for x in beyond(odds.select(*KEY, F.col(f"odds{k}").alias("odds")), k, share, good, most)]


def _combined(a: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method for a logistic regression on two log-odds, lightly penalised towards their mean."""
    x = np.stack([a, b, np.ones(len(a))], axis=1)
    start = np.array([0.5, 0.5, 0.0])
    w = start.copy()
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1.0, 1.0, 0.1])
        step = np.linalg.solve(h, x.T @ (p - y) + np.array([1.0, 1.0, 0.1]) * (w - start))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return np.maximum(w, [0, 0, -np.inf])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", labelled: int = 4000, pool: int = 2000, rounds: int = 3, share: float = 0.1) -> QualityModel:
    spark = docs.sparkSession
    known = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(label_col).alias("y")).where("id is not null and y is not null and y <> 0.5")
    known = known.select("id", (F.col("y") > 0.5).cast("int").alias("y"))
    tally = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, df = ngrams.document_frequencies(docs, "text", ORDERS, lower=False)
    idf = ngrams.inverse(total, df)
    if len(tally) < 2:
        n = sum(tally.values())
        return QualityModel(idf, (None, None), (None, None), None, tally.get(1, 0) / n if n else 1.0)
    # About half of the sample from each class, if there are as many; drawn by a hash of the id.
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    quota = {y: min(1.0, labelled / 2 / n) for y, n in tally.items()}
    chosen = known.where(draw < F.when(F.col("y") == 1, int(quota[1] * (1 << 30))).otherwise(int(quota[0] * (1 << 30))))
    rows = keyed(docs, id_col)
    chosen = spark.createDataFrame(chosen.collect(), "id long, y int")  # about ``labelled`` rows of 12 bytes
    # of the rows that share a drawn id, the one of the least key: as many rows as ids, however often ids repeat
    drawn = rows.select("id", "key").join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("key").alias("key"))
    drawn = spark.createDataFrame(drawn.collect(), "id long, y int, key long")
    sample = _viewed(rows.join(F.broadcast(drawn), KEY).dropDuplicates(KEY)).collect()
    sample.sort(key=lambda r: (xxhash.xxh32_intdigest(str(r["id"])), r["id"]))
    as_rows = lambda found: [  # noqa: E731  the rows of both views
        [(np.array(r["buckets"], np.int64), ngrams.tfidf(np.array(r["buckets"], np.int64), np.array(r["counts"]), idf)) for r in found],
        [(np.array(r["meta"], np.int64), np.full(len(r["meta"]), 1 / np.sqrt(max(1, len(r["meta"]))), np.float32)) for r in found],
    ]
    content, meta = as_rows(sample)
    own = np.arange(len(sample))
    if len({r["y"] for r in sample}) < 2:
        return QualityModel(idf, (None, None), (None, None), None, tally.get(1, 0) / sum(tally.values()))
    held = own[np.arange(len(own)) % 4 == 3]
    taught = own[np.arange(len(own)) % 4 != 3]
    y = np.array([r["y"] for r in sample])
    pick = lambda view, at: [view[i] for i in at]
    dims = [len(idf), 1 << META_BITS]
    free = rows.join(F.broadcast(chosen.select("id")), "id", "left_anti")
    used = set()

    metas = written(meta_rows(free), "metas")

    def exchange(models):
        found = []
        for k, view in enumerate((content_view(free, idf, models[0]), meta_view(metas, models[1]))):
            odds = written(view, "odds")
            if used:
                odds = odds.join(F.broadcast(_keys(spark, used)), [odds[c].eqNullSafe(F.col(c + "_")) for c in KEY], "left_anti")
            found += beyond(odds, k, share, float(y[taught].mean()), max(1, int(share * pool)))
        if not found:
            return []
        keys = {f[:2] for f in found}
        used.update(keys)
        asked = free.join(F.broadcast(_keys(spark, keys)), [free[c].eqNullSafe(F.col(c + "_")) for c in KEY], "left_semi").dropDuplicates(KEY)
        got = sorted(_viewed(asked.withColumn("y", F.lit(None).cast("int"))).collect(), key=lambda r: (r["id"] is None, r["id"] or 0, r["key"]))
        at = {(r["id"], r["key"]): i for i, r in enumerate(got)}
        views = as_rows(got)
        return [(1 - k, views[1 - k][at[i, key]], label) for i, key, k, label in found]

    models = _rounds([pick(content, taught), pick(meta, taught)], y[taught], dims, rounds, exchange)
    for model, view in zip(models, (content, meta), strict=True):
        model.calibrate(pick(view, held), y[held])
    combination = _combined(_odds(models[0], pick(content, held)), _odds(models[1], pick(meta, held)), y[held])
    # The sample has the classes in other proportions than the labels.
    prior = np.log(tally[1] / tally[0]) - np.log((tally[1] * quota[1]) / (tally[0] * quota[0]))
    combination[2] += prior
    return QualityModel(idf, models[0].freeze(), models[1].freeze(), combination, None)


def _keys(spark, keys: set) -> DataFrame:
    return spark.createDataFrame(sorted(keys, key=lambda x: (x[0] is None, x[0] or 0, x[1])), "id_ long, key_ long")


def _viewed(rows: DataFrame) -> DataFrame:
    """(id, key, y, buckets, counts, meta): both views of sampled rows."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("y", pa.int32()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("meta", pa.list_(pa.int32()))])

    def step():
        def apply(batch):
            ids, key, text, source, lang, chars, y = (batch.column(i) for i in range(7))
            both = list(ngrams.counts(text, ORDERS, lower=False))
            meta = [meta_row(*r)[0].astype(np.int32) for r in zip(as_binary(text).to_pylist(), source.to_pylist(), lang.to_pylist(), chars.to_pylist(), strict=True)]
            lists = [pa.array(x, pa.list_(pa.int32())) for x in ([a.astype(np.int32) for a, _ in both], [n.astype(np.int32) for _, n in both], meta)]
            return pa.record_batch([ids, key, y.cast(pa.int32()), *lists], schema=schema)

        return apply

    return map_slices(rows.select("id", "key", "text", "source", "lang", "n_chars", "y"), step, "id long, key long, y int, buckets array<int>, counts array<int>, meta array<int>")


def scored(docs: DataFrame, model: QualityModel, columns: list[str] | None = None) -> DataFrame:
    """docs with _score, _content_odds and _meta_odds; no row moves. columns: what docs' columns are, if not their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = {c: (columns or docs.columns).index(c) for c in ("text", *META)}

    def step():
        def apply(batch):
            record = [batch.column(at["source"]).cast(pa.string()).to_pylist(), batch.column(at["lang"]).cast(pa.string()).to_pylist(), batch.column(at["n_chars"]).to_pylist()]
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns += [pa.array(x, pa.float64()) for x in shared.value.scores(batch.column(at["text"]), record)]
            return pa.record_batch(columns, names=[*batch.schema.names, "_score", "_content_odds", "_meta_odds"])

        return apply

    ddl = docs.select("*", *[F.lit(0.0).alias(c) for c in ("_score", "_content_odds", "_meta_odds")]).schema
    return map_slices(docs, step, ddl, docs.columns[at["text"]])


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs that score at least the threshold. Its columns may have any names beside the known ones."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = scored(plain, train(docs, labels, **options), docs.columns)
    return found.where(F.col("_score") >= threshold).select(*plain.columns).toDF(*docs.columns)
