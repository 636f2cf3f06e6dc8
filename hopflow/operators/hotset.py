"""Hot vertices, the caches they make, and feature gathering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflow.functions import vectors as V
from hopflow.functions.vectors import weighted_sum
from hopflow.operators import grid, ranking
from hopflow.operators.layout import StoredGraph, in_edges
from hopflow.sources.scratch import written

#: Super-batches that meet a vertex, in the mean, from which on their counts are a vector.
DENSE = 16
#: Counts that a vector has at most.
WIDE = 1024


def hot_by_degree(degrees: DataFrame, n: int, rate: float) -> DataFrame:
    """(id, degree, slot): the int(n * rate) vertices of the largest degree; ties by id."""
    return ranking.top(degrees.select("id", "degree"), "degree", F.lit(int(n * rate))).select("id", "degree", "slot")


def hop_counts(seeds: DataFrame, edges: DataFrame | StoredGraph, hops: int) -> DataFrame:
    """(super_batch, id, count): walks of `hops` steps against the edges from the seeds (super_batch, id) to a vertex.

    The first hop is a join: of a stored graph the edges stay in their buckets, and counts are added up on the map side
    first. Later ones are joins while a vertex is met by few super-batches. Where it is met by over DENSE of them, a join
    would have a row for each edge and each of these; the counts of a vertex are one vector then (`_dense_hop`)."""
    now = seeds.select("super_batch", F.col("id").alias("dst"), F.lit(1).cast("long").alias("count"))
    if not isinstance(edges, StoredGraph):
        edges = edges.select("src", "dst").dropna()
    for hop in range(hops):
        dense = None
        if hop:
            now = written(now, "counts")
            about = now.agg(F.count("super_batch"), F.approx_count_distinct("dst"), F.min("super_batch"), F.max("super_batch")).first()
            if about[0] > DENSE * about[1]:
                dense = _dense_hop(now.dropna(), edges.edges if isinstance(edges, StoredGraph) else edges, about[2], about[3])
                now = now.filter(F.col("super_batch").isNull())
        met = in_edges(now, edges)
        now = met.groupBy("super_batch", F.col("src").alias("dst")).agg(F.sum("count").alias("count"))
        now = now if dense is None else dense.unionByName(now)
    return now.withColumnRenamed("dst", "id")


def _packed_counts(column: pa.Array) -> list[bytes]:
    """For lists of (at, count): the counts as longs, then their places as ints."""
    flat, offsets = column.values, column.offsets.to_numpy()
    at, count = flat.field("at").to_numpy(), flat.field("count").to_numpy()
    return [count[a:b].tobytes() + at[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _dense_hop(counts: DataFrame, edges: DataFrame, first: int, last: int) -> DataFrame:
    """A hop of counts (super_batch, dst, count), super-batches from first to last, with a vector of counts, one for each
    super-batch, in place of rows. Vectors have WIDE numbers at most; more super-batches are cut into tiles of equal width."""
    tiles = (last - first) // WIDE + 1
    width = (last - first) // tiles + 1
    at = F.col("super_batch") - first
    sparse = counts.groupBy(F.col("dst").alias("id"), F.floor(at / width).alias("_tile")).agg(F.collect_list(F.struct((at % width).cast("int").alias("at"), "count")).alias("x"))
    sparse = written(grid.packed(sparse, _packed_counts), "vectors")
    slim = edges.select(F.col("dst").alias("_give"), F.col("src").alias("_take"))
    blocks = grid.shape(sparse, -(-sparse.count() // tiles) * width * 8)
    cells = grid.dealt(slim, sparse, blocks, "_give", "_take", tiles=tiles)
    cells = cells.select("_give", "_take", F.lit(None).alias("_weight"), "x", F.col("_tile") if tiles > 1 else F.lit(0).cast("long").alias("_tile"))

    def dense(column: pa.Array) -> np.ndarray:
        x = np.zeros((len(column), width), np.int64)
        for row, data in zip(x, column.to_pylist(), strict=True):
            n = len(data) // 12
            row[np.frombuffer(data, np.int32, n, 8 * n)] = np.frombuffer(data, np.int64, n)
        return x

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, to, sums in grid.partial_sums(batches, dense):
            tile = pa.array(np.full(len(to), part.column(4)[0].as_py()))
            yield pa.RecordBatch.from_arrays([tile, pa.array(to), V.lists(sums, whole=True)], names=["_tile", "dst", "x"])

    sums = V.merged_sum(cells.mapInArrow(partial, "_tile long, dst long, x array<long>"), ["_tile", "dst"], "x", width)
    rows = sums.select("_tile", "dst", F.posexplode("x").alias("at", "count")).filter(F.col("count") > 0)
    return rows.select((F.col("_tile") * width + F.col("at") + first).cast(counts.schema["super_batch"].dataType).alias("super_batch"), F.col("dst").cast(edges.schema["src"].dataType).alias("dst"), "count")


def presample_hot(counts: DataFrame, rate: float) -> DataFrame:
    """(super_batch, slot, id, count): of each super-batch the int((vertices + 1) * rate) most counted; ties by id."""
    size = F.floor((F.col("_all") + 1) * rate)
    return ranking.top(counts, "count", size, ["super_batch"]).select("super_batch", "slot", "id", "count")


def presample_hot_fixed(counts: DataFrame, k: int) -> DataFrame:
    return ranking.top(counts, "count", F.lit(k), ["super_batch"]).select("super_batch", "slot", "id", "count")


def save_hot_set(hot: DataFrame, path: str) -> None:
    hot.select("super_batch", "slot", "id").write.partitionBy("super_batch").parquet(path)


def load_hot_set(hot: DataFrame, rate: float) -> DataFrame:
    """The first int(size * rate) of each list of a saved table (super_batch, slot, id)."""
    size = hot.groupBy("super_batch").agg(F.floor(F.count("*") * rate).alias("k"))
    return hot.join(size, "super_batch").filter(F.col("slot") < F.col("k")).select("super_batch", "slot", "id")


def split_hits_misses(needed: DataFrame, cache: DataFrame) -> DataFrame:
    """needed (super_batch, id) with a flag `hit`; cache ids do not repeat within a super-batch."""
    return needed.join(cache.select("super_batch", "id", F.lit(True).alias("hit")), ["super_batch", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_hit_rate(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count("*").alias("lookups"), F.sum(F.col("hit").cast("long")).alias("hits"), F.sum((~F.col("hit")).cast("long")).alias("transferred"))


def gather_features(needed: DataFrame, features: DataFrame) -> DataFrame:
    """needed (..., id) with the features of its ids."""
    return needed.join(features, "id")


def gather_features_cached(needed: DataFrame, features: DataFrame, hot_ids: DataFrame) -> DataFrame:
    """The same result; hot ids, which many rows need, are joined to their own small table. Spark broadcasts that only
    if it is below its size threshold, and splits it where it is skewed otherwise."""
    flagged = needed.join(hot_ids.select("id").distinct().withColumn("_hot", F.lit(True)), "id", "left")
    hot = features.join(hot_ids.select("id").distinct(), "id", "left_semi")
    near = flagged.filter(F.col("_hot")).drop("_hot").join(hot, "id")
    return near.unionByName(flagged.filter(F.col("_hot").isNull()).drop("_hot").join(features, "id"))


def override_hot_embeddings(rows: DataFrame, hot: DataFrame, columns: tuple[str, ...] = ("features",)) -> DataFrame:
    """rows (super_batch, id, features): those in hot (super_batch, id, features) take the precomputed vectors. With
    columns ("features", "aggregate") they take the precomputed aggregate of their in-edges as well."""
    ready = hot.select("super_batch", "id", F.lit(True).alias("_hot"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = rows.join(ready, ["super_batch", "id"], "left")
    return both.select("super_batch", "id", *[F.when(F.col("_hot"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def merge_newest(versions: DataFrame) -> DataFrame:
    """(id, version, value): of each id the row with the highest version, compared per id; ties by the larger value."""
    best = versions.groupBy("id").agg(F.max(F.struct("version", "value")).alias("b"))
    return best.select("id", "b.version", "b.value")


def accumulate_hot_gradients(gradients: DataFrame, cache: DataFrame, width: int) -> DataFrame:
    """(super_batch, slot, x): gradient vectors (super_batch, id, x) of cached ids added up by slot."""
    hot = gradients.join(cache.select("super_batch", "id", "slot"), ["super_batch", "id"])
    return weighted_sum(hot, ["super_batch", "slot"], "x", width)


def zero_hot_gradients(gradients: DataFrame, cache: DataFrame, width: int) -> DataFrame:
    """The local rows after that: gradients (super_batch, id, x, ...) with those of cached ids set to zero."""
    flagged = gradients.join(cache.select("super_batch", "id", F.lit(True).alias("_hot")), ["super_batch", "id"], "left")
    return flagged.withColumn("x", F.when(F.col("_hot"), F.array_repeat(F.lit(0.0), width)).otherwise(F.col("x"))).drop("_hot")


def hot_edge_weight_avg(weighted: DataFrame, hot_ids: DataFrame) -> DataFrame:
    into = weighted.join(hot_ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return into.agg(F.count("*").alias("edges"), F.sum("weight").alias("total"), F.avg("weight").alias("mean"))
