"""The registered queries at the smallest scale: contract columns, a row for each document, oracles."""

import os

import pytest

from paralex.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op2_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3_jaccard_join": "doc_id n_shingles component_id",
    "op5_mix_sources": "doc_id size source_size target taken",
    "op9_phrase_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op10_language_id": "doc_id held_out lang_pred score",
    "op12_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_rows_and_columns(spark, name):
    got = QUERIES[name](spark, SF).collect()
    want = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    assert set(COLUMNS[name].split()) <= set(got[0].asDict())
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in want)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want)
