"""Node tables and splits. Masks: 0 train, 1 eval, 2 test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflow.functions.hashing import with_hash


def join_node_tables(features: DataFrame, labels: DataFrame, masks: DataFrame) -> DataFrame:
    """By id; nodes that lack one of the three are left out."""
    return features.join(labels, "id").join(masks, "id")


def split_by_mod(vertices: DataFrame) -> DataFrame:
    return vertices.select("id", (F.col("id") % 3).cast("int").alias("mask"))


def split_by_range(vertices: DataFrame, n: int, train: float = 0.65, eval_: float = 0.10) -> DataFrame:
    a, b = int(n * train), int(n * train) + int(n * eval_)
    return vertices.select("id", F.when(F.col("id") < a, 0).when(F.col("id") < b, 1).otherwise(2).alias("mask"))


def synthetic_nodes(vertices: DataFrame, width: int, classes: int, seed: int = 5) -> DataFrame:
    hashed = with_hash(vertices.select("id"), "h", seed, F.col("id"))
    return hashed.select("id", F.array_repeat(F.lit(1.0), width).alias("features"), (F.col("h") % classes).alias("label"))


def tag_union_splits(train: DataFrame, eval_: DataFrame, test: DataFrame) -> DataFrame:
    tagged = [d.select("id", F.lit(t).alias("split")) for d, t in ((train, "train"), (eval_, "eval"), (test, "test"))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def nodes_of_split(masks: DataFrame, mask: int) -> DataFrame:
    return masks.filter(F.col("mask") == mask).select("id")


def split_codes(train: DataFrame, valid: DataFrame, test: DataFrame, vertices: DataFrame) -> DataFrame:
    """Three id lists to masks; of an id in several the later list wins, an id in none has a null mask."""
    coded = [d.select("id", F.lit(k).alias("mask")) for k, d in enumerate((train, valid, test))]
    best = coded[0].unionByName(coded[1]).unionByName(coded[2]).groupBy("id").agg(F.max("mask").alias("mask"))
    return vertices.select("id").join(best, "id", "left")
