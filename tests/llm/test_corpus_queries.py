"""Every corpus query with SQL gives DuckDB's rows on the small test tables."""

import zlib

import duckdb
import pandas as pd
import pytest

from armwise.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(ORACLES[name]).fetch_df()
    got = QUERIES[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got)
    plain = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) else x  # noqa: E731  whole numbers with nulls
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False, name=None)), key=str)
    assert rows(got) == rows(want)


# Columns that each query promises, with their types.
COLUMNS = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op3_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_token_output": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op8_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op9_class_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op12_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op13_token_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
}


@pytest.mark.parametrize("name", [n for n in COLUMNS if n not in ORACLES])
def test_columns_and_folds(spark, name):
    """Promised names and types, one row per document, folds by crc32 of the id, values in their ranges."""
    found = QUERIES[name](spark, DATA)
    kinds = dict(found.dtypes)
    assert [f"{c.split()[0]} {kinds[c.split()[0]]}" for c in COLUMNS[name].split(", ")] == COLUMNS[name].split(", ")
    rows = {r.doc_id: r for r in found.collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        if "held_out" in kinds:
            assert r.held_out == (zlib.crc32(str(i).encode()) % (7 if name.startswith("op9") else 4) == 2)
        if name.startswith(("op4", "op10")):
            assert 0 <= r.score <= 1
        if "predicted" in kinds:
            assert r.predicted == int(r.score >= 0.3)
        if "lang_pred" in kinds:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[i] or ""))
        if "taken" in kinds:
            assert 0 <= r.taken <= 3 * r.size and r.size == len((texts[i] or "").encode().split())
        if "n_known" in kinds:
            assert 0 <= r.n_known <= r.n_tokens == len((texts[i] or "").encode().split()) + 1 and r.score < 0 and r.base_score < 0


@pytest.mark.parametrize("name", sorted(set(COLUMNS) & set(ORACLES)))
def test_columns(spark, name):
    kinds = dict(QUERIES[name](spark, DATA).dtypes)
    assert [f"{c.split()[0]} {kinds[c.split()[0]]}" for c in COLUMNS[name].split(", ")] == COLUMNS[name].split(", ")
