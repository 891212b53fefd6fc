"""Registered queries against DuckDB, and their columns."""

import duckdb
import pytest

from tidemill.llm import queries as q

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op2_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op3_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op4_gif_media": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op5_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op6_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op7_quality": {"doc_id", "score", "keep"},
    "op8_source_mix": {"doc_id", "size", "source_size", "target", "taken"},
    "op9_simhash": {"doc_id", "fingerprint", "component_id"},
    "op10_substring_dedup": {"doc_id", "n_repeated", "n_removed", "classes"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_a_row_a_document(spark, name):
    df = q.QUERIES[name](spark, SF)
    assert COLUMNS[name] <= set(df.columns)
    kinds = dict(df.dtypes)
    assert all(kinds[c] == "bigint" for c in kinds if c.startswith("n_") or c in ("doc_id", "start", "ids_crc32", "taken", "size", "source_size", "component_id", "train_tokens"))
    ids = [r["doc_id"] for r in df.collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = q.QUERIES[name](spark, SF)
    r = c.execute(q.ORACLES[name])
    names = [d[0] for d in r.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    got = sorted(tuple(show(x[k]) for k in cols) for x in df.collect())
    assert got == sorted(tuple(show(x[names.index(k)]) for k in cols) for x in r.fetchall())
