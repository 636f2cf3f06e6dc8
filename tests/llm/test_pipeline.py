import re

from pyspark.sql import functions as F

import corpus_pipeline as C
from hopflow.llm import mixing, near_texts, packing, quality_classifier
from tests.llm.test_near_texts import similar
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.01"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_each_stage_against_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns = docs.columns
    rows = docs.collect()

    got = C.written(C.quality(spark, docs, SF), "t")
    assert got.columns == columns
    judged = {r["doc_id"]: r["kept"] for r in quality_classifier.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    kept = [r for r in rows if judged[r["doc_id"]]]
    assert sorted(got.collect()) == sorted(kept)
    clean = [r for r in rows if r["doc_id"] in labels and labels[r["doc_id"]]["quality"] == 1]
    assert sum(judged[r["doc_id"]] for r in clean) > 0.99 * len(clean)
    bad = [r for r in rows if r["doc_id"] in labels and labels[r["doc_id"]]["quality"] == 0]
    assert sum(judged[r["doc_id"]] for r in bad) < 0.25 * len(bad)

    got = C.written(C.exact(spark, got, SF), "t")
    best = {}
    for r in kept:
        best[lower(r["text"])] = max(best.get(lower(r["text"]), r["doc_id"]), r["doc_id"])
    kept = [r for r in kept if best[lower(r["text"])] == r["doc_id"]]
    assert got.columns == columns and sorted(got.collect()) == sorted(kept)

    got = C.written(C.near(spark, got, SF), "t")
    stay = similar([(r["doc_id"], r["text"]) for r in kept])
    kept = [r for r in kept if r["doc_id"] in stay]
    assert got.columns == columns and sorted(got.collect()) == sorted(kept)

    mixed = C.written(C.mix(spark, got, SF), "t")
    chosen = {r["doc_id"] for r in mixing.mix(got, spark.read.parquet(f"{SF}/labels.parquet"), C.TARGETS).filter("chosen").collect()}
    assert mixed.columns == columns and sorted(mixed.collect()) == sorted(r for r in kept if r["doc_id"] in chosen)
    left = {r["doc_id"] for r in kept}
    clean = [d for d in left if d in labels and labels[d]["quality"] == 1 and labels[d]["toxic"] == 0]
    assert sum(d in chosen for d in clean) > 0.99 * len(clean)

    assert check(C.pack(spark, mixed, SF).collect(), {r["doc_id"]: r["text"] for r in mixed.collect()}) < 0.01


def test_edge_cases(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (2, "", None, None, 0), (None, "The cat of the dog and " * 30, "en", "a", 1), (5, "x y z " * 30_000, "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES[:-1]:
        assert set(stage(spark, docs, SF).collect()) <= {tuple(r) for r in rows}
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert len(C.exact(spark, docs, SF).collect()) == 3
    assert sorted((r["doc_id"] for r in C.near(spark, docs, SF).collect()), key=str) == [1, 5, None]


def test_clashing_columns_and_other_inputs(spark):
    """Stages give the rows of the plain table for tables that are no plain files, and keep columns of any name."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 400")
    extra = ["_row", "row", "id", "u", "group", "_host", "_path", "_seen", "_evidence", "_quality", "_host_share", "tokens", "posterior"]
    for _, stage in C.STAGES[:-1]:
        want = sorted(r["doc_id"] for r in stage(spark, docs, SF).collect())
        dealt = docs.repartition(7).orderBy(F.rand())
        for e in extra:
            dealt = dealt.withColumn(e, F.col("doc_id") * 3)
        got = stage(spark, dealt, SF)
        rows = got.collect()
        assert got.columns == dealt.columns and sorted(r["doc_id"] for r in rows) == want
        assert all(r[e] == r["doc_id"] * 3 for r in rows for e in extra)


def test_run(spark):
    out = C.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.agg(F.max("length")).first()[0] <= packing.SIZE and (near_texts.WIDTH, near_texts.SIMILARITY) == (5, 0.8)
