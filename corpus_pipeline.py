"""From raw documents to token files: quality, near-duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontamination, mixing, quality, simhash, token_files
from tidemill.llm.queries import table, tokenizer_path
from tidemill.llm.store import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the co-trained views reject go."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each component of near-duplicates, the document of the smallest id stays.

    Fingerprints within 3 bits are linked; first documents of what that gives are linked within 8 bits if at least 0.8
    of their five-word shingles are the same. Rows are known by id and text, so that distinct texts without an id, or of
    one id, are kept or go on their own; a document with an id goes before one without.
    """
    kept = written(simhash.one_of_each(docs).select(F.col("id").alias("_kept"), F.col("key").alias("_key"), F.col("n").alias("_n")), "kept-ids")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    same = (simhash.text_key(text) == F.col("_key")) & F.col(own).cast("long").eqNullSafe(F.col("_kept"))
    rows = plain.join(kept.drop("_n").hint("merge"), same, "left_semi")
    return (rows if kept.where("_n > 1").isEmpty() else rows.dropDuplicates([own, text])).toDF(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents with a window of the benchmark go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: sources cut or repeated to their targets; a document comes as often as it is taken."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token files in ascending order of id, and what they hold of each document."""
    return token_files.token_table(docs, tokenizer_path(), table_words=120_000, slice_bytes=1 << 20)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", to_target_weights),
    ("token-ID / binary output", token_ids),
]

#: Classifier, hash components and tokenizer have no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
