"""Heavy keys, named indexes, and columns of any name."""

import os
import subprocess
import sys
import uuid
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F
from tidewell.llm import decontaminate, exact_dedup, near, quality, queries, shared


def test_join_heavy_is_an_inner_join(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(600)] + [(None, 1), ("alone", 2), ("alone", 2)], "key string, v int").repartition(4)
    right = shared.keep(left.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("v").alias("most")).where("key is null or key != 'alone'"), "right")
    got = sorted(map(tuple, shared.join_heavy(left, right, "key", "rows").select("key", "v", "most").collect()))
    assert got == sorted(map(tuple, left.join(right, "key").select("key", "v", "most").collect()))
    assert shared.join_heavy(left.limit(0), shared.keep(right.limit(0), "none"), "key", "rows").count() == 0


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def kept(spark, rows, index):
    return {r["doc_id"]: r["kept"] for r in exact_dedup.exact_dedup(docs_of(spark, rows), index).collect()}


def test_index_is_found_again(spark):
    name = f"named_{uuid.uuid4().hex}"
    kept(spark, [(1, "a"), (2, "b")], exact_dedup.DigestIndex(spark, name))
    again = exact_dedup.DigestIndex(spark, name, buckets=9)  # it keeps the buckets that it has
    assert again.buckets == 4 and kept(spark, [(8, "a"), (9, "c")], again) == {8: False, 9: True}
    shared.clear(spark)
    assert kept(spark, [(8, "a"), (10, "c")], exact_dedup.DigestIndex(spark, name)) == {8: False, 10: False}
    spark.sql(f"DROP TABLE {again.name}")  # as in a later session: the folder stays
    later = exact_dedup.DigestIndex(spark, name)
    assert sorted(r["keep_id"] for r in later.rows().collect()) == [1, 2, 9]
    later.compact()
    assert kept(spark, [(7, "b"), (6, "d")], later) == {7: False, 6: True}
    plan = docs_of(spark, [(1, "x")]).select(F.col("text").alias("digest")).join(later.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan


def test_query_goes_by_the_table_as_it_stands(spark, tmp_path):
    """The same folder with other rows, and again after the shared tables have been deleted."""
    for rows in ([(1, "a"), (2, "a"), (3, "b")], [(1, "a"), (2, "b"), (9, "a")]):
        docs_of(spark, rows).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in queries.op6_exact_dedup(spark, str(tmp_path)).collect()}
        last = {t: max(i for i, x in rows if x == t) for _, t in rows}
        assert got == {i: (last[t], i == last[t]) for i, t in rows}
        shared.clear(spark)
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index_") and spark.sql(f"DESCRIBE FORMATTED `{t.name}`").where(F.col("data_type").contains("application") | F.col("data_type").contains("/local-")).count()]


def test_an_index_whose_folder_is_gone_is_new(spark):
    name = f"gone_{uuid.uuid4().hex}"
    index = exact_dedup.DigestIndex(spark, name)
    kept(spark, [(1, "a")], index)
    system, path = shared.folder(spark, index.path)
    system.delete(path, True)
    assert kept(spark, [(2, "a")], exact_dedup.DigestIndex(spark, name)) == {2: True}


def test_a_second_application_finds_the_index(tmp_path):
    """Two sessions of their own, of which neither names a checkpoint folder."""
    code = """
import sys
from pyspark.sql import SparkSession
from tidewell.llm import exact_dedup, shared
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(int(i), t) for i, t in zip(sys.argv[1], sys.argv[2])], "doc_id long, text string")
got = exact_dedup.exact_dedup(docs, exact_dedup.DigestIndex(spark, "across")).where("kept").collect()
print("KEPT", sorted(r["doc_id"] for r in got))
shared.clear(spark)
"""
    environment = os.environ | {"TMPDIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    runs = [subprocess.run([sys.executable, "-c", code, *x], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300) for x in (("123", "aab"), ("456", "acc"))]
    assert [r.stdout.split("KEPT ")[-1].split("\n")[0] for r in runs] == ["[2, 3]", "[6]"], runs[-1].stderr[-2000:]


def test_columns_of_any_name_are_carried(spark):
    """Names that the stages use inside come back as they were."""
    schema = "doc_id long, text string, score string, kept string, __key string, key string, row string, id string, __id string, bad_id string"
    rows = [(i, f"some plain words number {i} of many here", *[f"{c}{i}" for c in "abcdefgh"]) for i in range(6)] + [(9, None, *"abcdefgh"), (None, "x", *"abcdefgh")]
    docs = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([(1, "words number 3 of")], "item_id long, text string")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, grade int"))
    steps = [
        (quality.drop_poor(docs, model), 8), (exact_dedup.drop_duplicates(docs, exact_dedup.DigestIndex(spark)), 8), (near.drop_near_duplicates(docs), 8),
        (decontaminate.drop_contaminated(docs, bench), 7),
    ]
    for out, n in steps:
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert set(got) <= set(rows) and len(got) == n
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "benchmark", "tokens"]
