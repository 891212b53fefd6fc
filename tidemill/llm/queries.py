"""One query an operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, gif_media, language_id, line_dedup, lm_scoring, mixing, quality, simhash, substring_dedup, token_files
from .store import written

#: Tokenizer of op3; any other file of the folder works too.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(divisor: int):
    """crc32 of the id as text leaves 2; a null id is held out of nothing."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == 2, F.lit(False))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.matches(docs, table(spark, sf_dir, "benchmark"))
    hits = decontamination.hit_words()
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), hits.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = gif_media.store_media(table(spark, sf_dir, "documents"))
    stored = gif_media.read_media(written(media, "media"))
    parts = [F.lit("frames="), F.col("n_frames"), F.lit(";ms="), F.col("shown_ms")]
    for c in ("red", "green", "blue"):
        parts += [F.lit(f";{c}="), F.concat_ws(",", F.col(c).cast("array<string>"))]
    feature = F.concat(*parts)
    return stored.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, ~_held_out(4))
    return language_id.predict(docs, model).select("doc_id", _held_out(4).alias("held_out"), "lang_pred", "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm_scoring.train(docs, ~_held_out(7))
    out = lm_scoring.score(docs, model).withColumn("held_out", _held_out(7)).withColumn("train_tokens", F.lit(model.total).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.col("_score").alias("score"), (F.col("_score") >= 0.5).alias("keep"), F.col("_content_odds").alias("content_log_odds"), F.col("_meta_odds").alias("metadata_log_odds"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.summary(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_line_dedup, op3_token_files, op4_gif_media, op5_language_id, op6_lm_scoring, op7_quality, op8_source_mix, op9_simhash, op10_substring_dedup)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES = {
    "op1_decontamination": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, least(10, len(w)) AS size
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM benchmark) WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM b)
), o AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT d.*, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM g) WHERE len(w) >= size)
), h AS (
  SELECT doc_id, size, i, item FROM o JOIN g USING (size, gram)
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op2_line_dedup": f"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], {_WHITE}), '{_UPPER}', '{_LOWER}') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), heavy AS (
  SELECT k, max(doc_id) AS owner FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT l.*, coalesce(doc_id < owner, false) AS gone FROM l LEFT JOIN heavy USING (k))
GROUP BY doc_id""",
    "op8_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':17')), 1, 16) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT *, i % 3 + 1 AS weight FROM s
), o AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest_weight, row_number() OVER (ORDER BY 3 * source_size / weight, i) AS r
  FROM w WINDOW before AS (ORDER BY 3 * source_size / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT coalesce(min(r) FILTER (WHERE 3 * source_size * rest_weight >= rest * weight), 1000000000) AS cut FROM o
), t AS (
  SELECT source, source_size, CASE WHEN r < cut THEN CAST(3 * source_size AS DOUBLE) ELSE
         weight * (SELECT CAST(rest AS DOUBLE) / CAST(rest_weight AS DOUBLE) FROM o WHERE r = cut) END AS target FROM o, f
), p AS (
  SELECT d.*, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS epochs,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS earlier
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(least(3, epochs + CASE WHEN earlier + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM p""",
}
