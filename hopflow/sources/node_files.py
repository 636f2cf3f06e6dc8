"""Node tables in text files: features, labels, masks, splits and hot sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopflow.sources.scratch import written

#: The words of a mask file; any other word is 3.
MASKS = {"train": 0, "eval": 1, "val": 1, "test": 2}


def parse_features(lines: DataFrame, width: int) -> DataFrame:
    """(id, features) of lines `id f1 ... fd`; another width is an error."""
    t = lines.filter(F.length(F.trim("value")) > 0).select(F.split(F.trim("value"), r"\s+").alias("t"))
    right = F.when(F.size("t") == width + 1, F.col("t")).otherwise(F.raise_error(F.lit("a line has another number of features")).cast("array<string>"))
    return t.select(right.alias("t")).select(F.get("t", F.lit(0)).cast("long").alias("id"), F.transform(F.slice("t", 2, width), lambda v: v.cast("double")).alias("features"))


def read_features(spark: SparkSession, path: str, width: int) -> DataFrame:
    return parse_features(spark.read.text(path), width)


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, value): the lines of text files with their 0-based number in file order: by file name, then as they stand.

    Lines are written once with the file and the block that a task read them from, and their order in the task. Of each
    block the first order and the count are kept, one row for each; the counts of the blocks before give where it starts.
    So the numbers are the same however files are split, and no line goes through Python."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    kept = written(lines, "lines")
    blocks = kept.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = blocks.select("file", "start", (before - F.col("first")).alias("base"))  # one row for each block of a file
    return kept.join(base, ["file", "start"]).select((F.col("base") + F.col("at")).alias("id"), "value")


def save_numbered(spark: SparkSession, source: str, target: str, sep: str = ",") -> None:
    """Each line of headerless CSV files with its number before it and blanks between: label and feature tables."""
    rows = number_lines(spark, source)
    rows.select(F.concat_ws(" ", F.col("id").cast("string"), F.replace("value", F.lit(sep), F.lit(" "))).alias("value")).write.text(target)


def read_features_csv(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(id, features) of comma lines; the line number is the id."""
    t = number_lines(spark, path).select("id", F.split("value", ",").alias("t"))
    right = F.when(F.size("t") == width, F.col("t")).otherwise(F.raise_error(F.lit("a line has another number of features")).cast("array<string>"))
    return t.select("id", F.transform(right, lambda v: F.trim(v).cast("double")).alias("features"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="id long, label long")


def mask_code(word):
    out = F.lit(3)
    for w, k in MASKS.items():
        out = F.when(word == w, k).otherwise(out)
    return out


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="id long, word string").select("id", mask_code(F.col("word")).alias("mask"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="id long")
