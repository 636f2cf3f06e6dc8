"""Helpers of the text operators: tables that are released, filters, places of rows."""

import gc
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hopflow.llm import common, exact_dedup, simhash

SF = "/root/testdata/sf0.001"


def _exists(path):
    return os.path.isdir(path.removeprefix("file://"))


def _mine(before):
    return [p for p in common._tables if p not in before]


def test_tables_in_use_stay(spark):
    """Results made before a stage, and by a stage on other documents, can be read after it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = exact_dedup.exact_dedup(docs), simhash.near_duplicates(docs).filter("doc_id > 5").select("fingerprint")
    x1 = corpus_pipeline.exact(spark, docs, SF)
    x2 = corpus_pipeline.exact(spark, docs.filter("doc_id < 50"), SF)
    gc.collect()
    spark._jvm.System.gc()
    corpus_pipeline.near(spark, docs.limit(20), SF)
    assert a.count() == docs.count() and b.count() == docs.filter("doc_id > 5").count() and x1.count() > x2.count() > 0


def test_spent_tables_go(spark):
    before = set(common._tables)
    t = common.written(spark.range(10).toDF("a"), "t")
    u, (path,) = t.filter("a > 3").groupBy("a").count(), _mine(before)
    del t
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        common.release(spark)
    assert _exists(path) and u.count() == 6
    del u
    for _ in range(5):
        spark.range(5).groupBy("id").count().count()  # the session may still hold the plan before
        gc.collect()
        spark._jvm.System.gc()
        common.release(spark)
    assert not _exists(path) and path not in common._tables


@pytest.mark.parametrize("bits", [1 << 15, 1 << 25])
def test_filter_loses_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    rows = spark.range(-3000, 30_000).select(F.col("id").alias("row"), F.lit("x").alias("text"))
    for wanted in ([], [-3000], list(range(0, 30_000, 7))):
        got = {r["row"] for r in common.maybe_in(rows, spark.createDataFrame([(w,) for w in wanted], "row long"), "row").collect()}
        assert set(wanted) <= got and len(got) <= len(wanted) + (33_000 * len(wanted) * 2) // bits + 3


def test_near_groups_do_not_follow_the_splits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = [sorted(r["doc_id"] for r in corpus_pipeline.near(spark, docs.repartition(n), SF).collect()) for n in (3, 17)]
    assert kept[0] == kept[1]
