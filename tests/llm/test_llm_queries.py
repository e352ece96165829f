"""The opN queries against their SQL twins, and the pipeline's stages."""

import os

import pytest

import corpus_pipeline
from folioscope.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = {r["doc_id"] for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA)
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= seen, name
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        seen = kept
    assert seen == {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).select("doc_id").collect()}
