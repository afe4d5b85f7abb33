"""The registered queries: their SQL on the smallest data, and the pipeline against its parts."""

import duckdb
import pytest

import corpus_pipeline
from termindex.llm.registered import QUERIES, SQL
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(SQL[name])
    assert ours == rows_of([d[0] for d in result.description], result.fetchall()) and ours


def test_pipeline(spark):
    from test_operators import LAST, grouped  # the brute-force forms

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, held = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in held.collect()}
        held = stage(spark, held, SF)
        assert held.columns == columns and held.schema["text"].dataType == docs.schema["text"].dataType
        after = {r.doc_id: r.text for r in held.collect()}
        assert set(after) <= set(before)
        if name == "line_dedup":
            assert set(after) == set(before)
        else:
            assert all(before[k] == t for k, t in after.items())
        if name == "ngram_jaccard":
            rows = list(before.items())
            assert set(after) == {k for (k, _), (c, n) in zip(rows, grouped(rows), strict=True) if n == 0 or c in (k, LAST)}
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(after)
