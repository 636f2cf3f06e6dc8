"""Neighbour sampling without replacement, and the blocks it gives.

A sample is the `fanout` in-edges of a vertex with the smallest hash of (seed, layer, batch, dst, src): uniform, and the
same under any partitioning. Edges are a stored graph or a DataFrame (src, dst) without repeats. Of a stored graph the
frontier goes to the buckets, a hub's to all buckets that have a salt of it, and no edge moves; each task keeps the
`fanout` smallest of a vertex before these meet, so the samples are all that is shuffled. Block edges: (batch, layer,
dst, src)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopflow.functions.hashing import with_hash
from hopflow.operators.layout import StoredGraph, in_edges


def sample_sizes(in_degrees: DataFrame, fanout: int) -> DataFrame:
    size = F.col("degree") if fanout < 0 else F.least("degree", F.lit(fanout).cast("long"))
    return in_degrees.select("id", size.alias("size"))


def sample_neighbors(frontier: DataFrame, edges: DataFrame | StoredGraph, fanout: int, layer: int, seed: int = 0) -> DataFrame:
    """frontier (batch, dst); fanout -1 takes all in-edges, 0 none."""
    both = in_edges(frontier.select("batch", "dst"), edges).withColumn("layer", F.lit(layer))
    if fanout >= 0:
        both = with_hash(both, "h", seed, layer, F.col("batch"), F.col("dst"), F.col("src"))
        rank = F.row_number().over(Window.partitionBy("batch", "dst").orderBy("h", "src"))
        both = both.withColumn("rank", rank).filter(F.col("rank") <= fanout)
    return both.select("batch", "layer", "dst", "src")


def sample_khop(seeds: DataFrame, edges: DataFrame | StoredGraph, fanouts: list[int], seed: int = 0, merge: bool = False, omit: DataFrame | None = None) -> DataFrame:
    """All layers: layer 0 samples for the seeds (batch, id), the next for the distinct sources of the one before.

    merge: the vertices of a layer are in the next one too. omit (batch, id): these get no samples in the last layer."""
    frontier, out = seeds.select("batch", F.col("id").alias("dst")), None
    for layer, fanout in enumerate(fanouts):
        if omit is not None and layer == len(fanouts) - 1:
            frontier = frontier.join(omit.select("batch", F.col("id").alias("dst")), ["batch", "dst"], "left_anti")
        block = sample_neighbors(frontier, edges, fanout, layer, seed)
        out = block if out is None else out.unionByName(block)
        following = block.select("batch", F.col("src").alias("dst"))
        frontier = (following.unionByName(frontier) if merge else following).distinct()
    return out


def relabel_block(block: DataFrame) -> DataFrame:
    """Adds src_local and dst_local: ranks of the ids among the distinct ones of (batch, layer)."""

    def local(end: str) -> DataFrame:
        ids = block.select("batch", "layer", end).distinct()
        return ids.withColumn(f"{end}_local", F.row_number().over(Window.partitionBy("batch", "layer").orderBy(end)).cast("long") - 1)

    return block.join(local("src"), ["batch", "layer", "src"]).join(local("dst"), ["batch", "layer", "dst"])


def block_offsets(block: DataFrame) -> DataFrame:
    """(batch, layer, dst, count, column_offset): where the samples of each dst start, in dst order."""
    counts = block.groupBy("batch", "layer", "dst").agg(F.count("*").alias("count"))
    before = Window.partitionBy("batch", "layer").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("column_offset", F.coalesce(F.sum("count").over(before), F.lit(0)))


def sampled_degrees(block: DataFrame, end: str) -> DataFrame:
    return block.groupBy("batch", "layer", end).agg(F.count("*").alias("degree"))


def sampled_degrees_hot(block: DataFrame, targets: DataFrame, fanout: int) -> DataFrame:
    """In-degrees inside the block of all targets (batch, layer, dst); one without samples counts as fanout."""
    return targets.join(sampled_degrees(block, "dst"), ["batch", "layer", "dst"], "left").withColumn("degree", F.coalesce("degree", F.lit(fanout).cast("long")))


def sampled_weights(block: DataFrame, out_degrees: DataFrame, in_degrees: DataFrame, kind: str = "sum", denominator: str = "sampled") -> DataFrame:
    """(batch, layer, dst, src, weight); kind `sum`, `mean` or `none` (1). A mean is divided by the samples of dst, or by
    its in-edges in the whole graph where denominator is `global`."""
    if kind == "none":
        return block.withColumn("weight", F.lit(1.0))
    both = block.join(out_degrees.select(F.col("id").alias("src"), F.col("degree").alias("_o")), "src").join(in_degrees.select(F.col("id").alias("dst"), F.col("degree").alias("_i")), "dst")
    weight = 1 / (F.sqrt(F.greatest("_o", F.lit(1))) * F.sqrt(F.greatest("_i", F.lit(1))))
    if kind == "mean" and denominator == "global":
        weight = weight / F.greatest("_i", F.lit(1))
    elif kind == "mean":
        both = both.join(sampled_degrees(block, "dst").withColumnRenamed("degree", "_c"), ["batch", "layer", "dst"])
        weight = weight / F.col("_c")
    return both.select("batch", "layer", "dst", "src", weight.alias("weight"))


def block_stats(block: DataFrame) -> DataFrame:
    return block.groupBy("batch", "layer").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))
