import duckdb
import pytest

from sparrowdex.plans import catalog

TABLES = "documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["bm25_sum", "bm25_sdm", "near_bm25", "window_unordered", "bool_nested_fields", "prf_rm3_terms", "ltr_features", "fusion_interleave", "rerank_tail_merge", "dense_topk", "passage_windows", "eval_metrics", "qa_em_f1", "run_file_format"]


@pytest.mark.parametrize("name", SAMPLE)
def test_spark_and_sql_agree(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    ours, theirs = catalog.QUERIES[name](spark, sf), con.sql(catalog.SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    pick = lambda names, rows: sorted(str([r[names.index(c)] for c in columns]) for r in rows)
    assert pick(ours.columns, ours.collect()) == pick(theirs.columns, theirs.fetchall())


def test_every_query_has_columns(spark, sf):
    for name in catalog.QUERIES:
        if not name.startswith(("prf", "ltr_train")):
            assert catalog.QUERIES[name](spark, sf).columns, name
