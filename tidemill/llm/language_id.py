"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover all learning rows. The classifier is trained with
FTRL-proximal and elastic-net penalties on a sample of labelled rows, about
``per_language`` for each language, drawn by a hash of the text and id; a
fifth of the sample sets the temperature. Prediction covers every whole text.

Defined results: `und` with score 0 if a text is null or has no letter
(Unicode's categories L*), or if there is nothing to learn from; of languages
of equal probability the first by code point; rows with a null label teach
nothing; rows that repeat an id are predicted each, null ids too (they draw as
one id of their text); very long texts are read whole; other columns, whatever
their names, are not looked at; ids must be whole numbers or null; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .arrowtext import batch_of, map_slices
from .ftrl import FtrlClassifier, softmax

ORDERS = (1, 2, 3)
UNKNOWN = "und"
_ASCII_LETTER, _BEYOND = re.compile("[A-Za-z]"), re.compile("[^\x00-\x7f]")


def has_letter(text: str) -> bool:
    """Whether a character of the text is of one of Unicode's letter categories."""
    return bool(_ASCII_LETTER.search(text)) or any(unicodedata.category(c)[0] == "L" for c in set(_BEYOND.findall(text)))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        n = len(column)
        names, scores = [UNKNOWN] * n, [0.0] * n
        known = [k for k, text in enumerate(column.to_pylist()) if self.languages and text is not None and has_letter(text)]
        if known:
            p = softmax(ngrams.sums(column.take(pa.array(known)), ORDERS, self.idf, self.weights) + self.bias)
            for k, best, score in zip(known, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                names[k], scores[k] = self.languages[best], min(1.0, score)
        return names, scores


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 400, epochs: int = 3) -> LanguageModel:
    """Learns from the rows of docs for which ``learn`` holds."""
    own = docs.where(learn & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    tally = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(tally)
    total, df = ngrams.document_frequencies(own, "text", ORDERS)
    idf = ngrams.inverse(total, df)
    if not languages:
        return LanguageModel([], idf, np.zeros((len(idf), 0), np.float32), np.zeros(0, np.float32))
    # a hash of id and text below a language's share: about per_language rows of each, no shuffle
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, int(min(1.0, per_language / tally[name]) * (1 << 30)))])
    sample = ngrams.counted(own.where(drawn < share[F.col("label")]).select("label", "text", drawn.alias("h")), ["label", "h"], "text", ORDERS).collect()
    sample.sort(key=lambda r: (r["h"], r["label"]))
    rows = [(np.array(r["buckets"], np.int64), ngrams.tfidf(np.array(r["buckets"], np.int64), np.array(r["counts"]), idf)) for r in sample]
    labels = np.array([languages.index(r["label"]) for r in sample])
    back = np.arange(len(rows)) % 5 == 4
    kept = np.flatnonzero(~back)
    model = FtrlClassifier(len(idf), len(languages)).fit([rows[i] for i in kept], labels[kept], epochs)
    held = np.flatnonzero(back)
    model.calibrate([rows[i] for i in held], labels[held])
    weights, bias = model.freeze()
    return LanguageModel(languages, idf, weights, bias)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([(id_col, pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def step():
        return lambda batch: batch_of(schema, batch.column(0), *shared.value.predict(batch.column(1)))

    return map_slices(docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")), step, f"{id_col} long, lang_pred string, score double")
