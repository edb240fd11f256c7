"""The registered queries: names, columns, SQL twins."""

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_line_dedup": ["doc_id", "n_lines", "n_removed", "text"],
    "op2_benchmark_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op3_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op4_bpe_encoding": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5_license_scan": ["doc_id", "n_paragraphs", "n_notices", "licenses"],
    "op6_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_minhash_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op10_embedding_near_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op12_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op13_importance_resampling": ["doc_id", "n_features", "weight", "score", "rank"],
}


def test_registered():
    import __spark_entry__ as E
    assert {*COLUMNS, "op11_hard_negatives", "pipeline"} <= {*E.queries()}
    assert {"op1_line_dedup", "op3_url_filter", "op11_hard_negatives", "op13_importance_resampling"} <= {*E.oracle_sql()}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    from txnwatch.llm.queries import QUERIES
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    source = "pages" if df.columns[0] == "page_id" else "embeddings" if df.columns[0] == "vec_id" else "documents"
    rows = df.collect()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(df.columns[0]).collect())


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_url_filter", "op11_hard_negatives", "op13_importance_resampling"])
def test_sql(spark, name):
    from tools.oracle_check import TABLES, _rows
    from txnwatch.llm.queries import QUERIES, SQL
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert _rows(QUERIES[name](spark, SF).toPandas()) == _rows(con.sql(SQL[name]).df())
