"""Reproducible shuffles and batches of seed vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopflow.functions.hashing import M, with_hash

#: Ranges of hash values that positions are counted in; their counts are all that meets in one task.
RANGES = 1024


def places(rows: DataFrame, key: str, *parts: Column | int) -> DataFrame:
    """(key, pos): pos is the 0-based place of the row in the order of the hash of parts, then of the key.

    Rows are numbered inside equal ranges of hash values and offset by the counts of the ranges before."""
    h = with_hash(rows.select(key), "h", *parts).withColumn("r", F.floor(F.col("h") / (M // RANGES)))
    counts = h.groupBy("r").agg(F.count("*").alias("c"))
    base = counts.select("r", F.coalesce(F.sum("c").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("r").orderBy("h", key)) - 1
    return h.withColumn("k", inside).join(F.broadcast(base), "r").select(key, (F.col("base") + F.col("k")).alias("pos"))  # RANGES rows at most


def shuffle_nodes(seeds: DataFrame, seed: int = 0) -> DataFrame:
    """(id, pos): pos is the 0-based place of the id in the order of its hash."""
    return places(seeds, "id", seed, F.col("id"))


def make_batches(shuffled: DataFrame, batch_size: int, pipeline: int = 1) -> DataFrame:
    """(id, pos, batch, super_batch): consecutive runs of batch_size; the last may be short."""
    batch = F.floor(F.col("pos") / batch_size)
    return shuffled.select("id", "pos", batch.alias("batch"), F.floor(batch / pipeline).alias("super_batch"))


def local_shuffle(shuffled: DataFrame, super_size: int, total: int, seed: int = 0) -> DataFrame:
    """(id, pos): whole super-batches change places and rows change places inside them; a short tail stays last as it is."""
    whole = total // super_size
    sb = F.floor(F.col("pos") / super_size)
    rows = shuffled.withColumn("sb", sb)
    order = _super_places(shuffled.sparkSession, whole, seed)
    inside = F.row_number().over(Window.partitionBy("sb").orderBy("h", "id")) - 1
    moved = with_hash(rows.filter(F.col("sb") < whole), "h", seed, 2, F.col("id")).withColumn("k", inside).join(order, "sb").select("id", (F.col("place") * super_size + F.col("k")).alias("pos"))
    return moved.unionByName(rows.filter(F.col("sb") >= whole).select("id", "pos"))


def _super_places(spark: SparkSession, whole: int, seed: int) -> DataFrame:
    """(sb, place): where each whole super-batch goes."""
    return places(spark.range(whole).withColumnRenamed("id", "sb"), "sb", seed, 1, F.col("sb")).withColumnRenamed("pos", "place")


def move_hot_lists(hot: DataFrame, whole: int, seed: int = 0) -> DataFrame:
    """The hot lists (super_batch, slot, id) after the same change of places; a list beyond the whole ones stays."""
    order = _super_places(hot.sparkSession, whole, seed).withColumnRenamed("sb", "super_batch")
    return hot.join(order, "super_batch", "left").select(F.coalesce("place", "super_batch").cast("long").alias("super_batch"), "slot", "id")


def split_batch_across_workers(batches: DataFrame, batch_size: int, total: int, workers: int) -> DataFrame:
    """(batch, worker, id): equal parts, the last takes the rest; a batch with fewer rows than workers is padded with 0."""
    last = F.greatest(F.lit(0), F.lit(total) - F.col("batch") * batch_size)
    size = F.least(F.lit(batch_size).cast("long"), last)
    padded = F.greatest(size, F.lit(workers))
    per = F.floor(padded / workers)
    at = F.col("pos") - F.col("batch") * batch_size
    own = batches.select("batch", "id", at.alias("at"), per.alias("per"))
    tail = total % batch_size
    missing = workers - tail if 0 < tail < workers else 0
    pad = batches.sparkSession.range(missing).select(F.lit(total // batch_size).cast("long").alias("batch"), F.lit(0).cast("long").alias("id"), (F.col("id") + tail).alias("at"), F.lit(1).cast("long").alias("per"))
    return own.unionByName(pad).select("batch", F.least(F.floor(F.col("at") / F.col("per")), F.lit(workers - 1)).cast("long").alias("worker"), "id")


def strided_batches(shuffled: DataFrame, batch_size: int, stride: int) -> DataFrame:
    return shuffled.filter(F.col("pos") % stride < batch_size)


def hot_slices_per_worker(hot: DataFrame, workers: int) -> DataFrame:
    """(super_batch, slot, id, worker): equal slices of each hot list, the last takes the rest."""
    sizes = hot.groupBy("super_batch").agg(F.count("*").alias("c"))
    per = F.greatest(F.floor(F.col("c") / workers), F.lit(1))
    return hot.join(sizes, "super_batch").select("super_batch", "slot", "id", F.least(F.floor(F.col("slot") / per), F.lit(workers - 1)).cast("long").alias("worker"))
