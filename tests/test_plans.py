"""Plans: what reaches the scan, and what is shuffled."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import bm25, fusion, state
from corpuscle.plans import registry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(registry.QUERIES["source_filter"](spark, D))
    assert "StringContains(source,-notes)" in p and "text" not in p.split("ReadSchema")[-1]
    p = plan(registry.QUERIES["vector_norms"](spark, D))
    assert "Exchange" not in p and "label" not in p.split("ReadSchema")[-1]


def test_top_k_is_limited_before_the_shuffle(spark):
    p = plan(registry.QUERIES["vector_batch_topk"](spark, D))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_current_files_shuffle_once(spark):
    from corpuscle.operators import incremental
    from corpuscle.session import table

    p = plan(incremental.current_files(table(spark, D, "scan_runs"), table(spark, D, "scan_entries")))
    final = p.split("== Physical Plan ==")[1]
    assert final.count("Exchange hashpartitioning(source_path") == 1 and "hashpartitioning(scope_key#" not in final.split("hashpartitioning(source_path")[0].split("scan_runs")[0]


def test_no_python_in_core_text_path(spark):
    for q in ("bm25_topk", "chunk_words", "fusion_weighted", "sections", "should_skip"):
        p = plan(registry.QUERIES[q](spark, D))
        assert "Python" not in p and "Pandas" not in p and "CartesianProduct" not in p


def test_skip_is_an_equi_join(spark):
    f = spark.range(10).select(F.col("id").cast("string").alias("source_path"), F.col("id").alias("file_size_bytes"), F.lit(None).cast("timestamp").alias("modified_at"))
    s = f.withColumn("status", F.lit("completed"))
    assert "NestedLoop" not in plan(state.to_process(f, s)) and state.done(f, s).count() == 10


def test_restricted_search(spark):
    i = bm25.build(spark.createDataFrame([("a", "red fox"), ("b", "red dog")], "doc_id string, text string"), "doc_id", "text")
    ok = spark.createDataFrame([("b",)], "doc_id string")
    assert [r.doc_id for r in bm25.search(i, "red", 5, allowed=ok).collect()] == ["b"]
    assert fusion.overlap(ok, ok).head().both == 1
