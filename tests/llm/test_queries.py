"""The queries and the pipeline over the smallest tables, against SQL and brute force."""

import duckdb
import pytest

import corpus_pipeline
from tidewell.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(columns).collect()))) == sorted(map(str, want))


def test_pipeline_keeps_what_each_stage_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = docs
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF)
        assert step.columns == docs.columns, name
        step = spark.createDataFrame(step.collect(), docs.schema)
        seen.append(step.count())
        if name == "quality":
            rated = step.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
            assert rated.where("toxic = 1").count() <= 0.1 * rated.count()
        if name == "exact":
            best = docs.groupBy("text").agg({"doc_id": "max"})
            assert step.select("text").distinct().count() == step.count() and best.count() >= step.count()
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    last = corpus_pipeline.STAGES[-1][1](spark, step, SF)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(last.columns) and last.count() == seen[-1]
