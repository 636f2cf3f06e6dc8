"""From raw documents to packed training sequences: five stages, each a function of the table before it.

The result of a stage is written before the next stage is called on it; each stage deletes the tables written on the way
that no DataFrame reads any more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopflow.llm import exact_dedup, mixing, near_texts, packing, quality_classifier
from hopflow.llm.common import fresh, numbered, release, written

#: SQL cannot express the classifiers, the fingerprints or the tokenizer.
ORACLE_SQL: str | None = None
#: The mixture is to hold nothing but clean text, however common the rest is.
TARGETS = {"clean": 1.0, "low": 0.0, "toxic": 0.0}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _without(rows: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """rows, numbered in column `row`, without those that `dropped` names. Written first, so that its size is known:
    Spark sends it to the documents if it is small and shuffles both sides otherwise."""
    return rows.join(written(dropped, "dropped"), row, "left_anti").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are judged by the bins that texts without words have; repeated rows are judged alike and all
    stay or go; null sources and languages are sites of their own. Without labels nothing goes but by an even prior. An
    empty table stays empty; other columns, whatever their names, are kept."""
    release(spark)
    model = quality_classifier.fit(docs, _labels(spark, sf_dir))
    name = fresh(docs, "_quality")
    scored = quality_classifier.score(docs, model, name=name)
    # coalesce: without it Spark also filters for scores that are not null, below the join, and finds each score twice.
    return scored.filter(F.coalesce(F.col(name)["quality_score"], F.lit(0.0)) >= quality_classifier.KEEP_FROM).drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (lower-cased in A-Z) the row with the largest doc_id stays.

    Null counts as empty; a null doc_id is smaller than any other; of rows that repeat a doc_id and text exactly one
    stays. An empty table stays empty; other columns, whatever their names, are kept."""
    release(spark)
    row = fresh(docs, "_row")
    rows = numbered(docs, row)
    found = exact_dedup.exact_dedup(rows.select(F.struct("doc_id", F.col(row).alias("row")).alias("id"), "text"), "id", "text")
    return _without(rows, row, found.filter(~F.col("kept")).select(F.col("id.row").alias(row)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the row with the smallest doc_id stays.

    Texts without words, null among them, are copies of each other; of rows that repeat a doc_id and text exactly one
    stays, and a null doc_id is smaller than any other. An empty table stays empty; other columns are kept."""
    release(spark)
    row = fresh(docs, "_row")
    rows = numbered(docs, row)
    groups = written(near_texts.near_groups(rows.select(F.col(row).alias("row"), "text")), "groups")
    several = groups.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").select("group")
    members = groups.join(several, "group").join(rows.select(F.col(row).alias("row"), "doc_id"), "row")
    first = members.groupBy("group").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("group", F.col("first.row").alias("stays"))
    return _without(rows, row, groups.join(first, "group").filter("row <> stays").select(F.col("row").alias(row)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay at the rates that bring the expected tokens of each domain to the targets.

    Null and empty texts have no tokens and are judged by the bins that texts without words have; rows with one doc_id
    are chosen alike if their texts are. Without labels or tokens every document stays. An empty table stays empty;
    other columns, whatever their names, are kept."""
    release(spark)
    return mixing.mixture(docs, _labels(spark, sf_dir), TARGETS, spare=0.0)  # no clean text is given up


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of at most 4096 tokens.

    A null or empty text is the end id alone; repeated rows are packed each; an empty table gives no rows. Of the columns
    doc_id and text are read."""
    release(spark)
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
