"""Registered queries and their SQL over the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
#: The slow ones are left to the driver's own comparison.
CHOSEN = ["tokenize_documents", "noun_phrases", "chunk_documents", "concept_nodes", "bm25_topk", "vector_topk", "torus_distance", "evidence_rank", "answer_rows", "eval_rows", "uri_matches", "op10_mixing_sources"]


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    if name not in queries:
        pytest.skip("not registered")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want, got = con.execute(sql[name]).df(), queries[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    order = sorted(got.columns)
    rows = lambda df: df[order].astype(str).sort_values(order).reset_index(drop=True)
    assert rows(got).equals(rows(want))


def test_every_sql_has_a_query(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert entry_module.entry(spark).count() == 40
