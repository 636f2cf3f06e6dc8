"""Message passing: joins from vertices to edges and sums back, forward and backward.

Vertex rows: (id, x) with x an array of doubles of a known width; edge rows: (src, dst, x). Sums are combined on the map
side, by generated aggregates or, from a width of over 128 on, in Arrow batches; a hub never meets as a list of vectors.
Sums of wide vectors over edges, and edge rows of both ends, are made in a grid of blocks, where no edge carries a vector."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopflow.functions.vectors import NARROW, applied, leaky_relu, weighted_sum
from hopflow.operators import grid


def scatter_src(edges: DataFrame, rows: DataFrame) -> DataFrame:
    return edges.join(rows.withColumnRenamed("id", "src"), "src")


def scatter_dst(edges: DataFrame, rows: DataFrame) -> DataFrame:
    return edges.join(rows.withColumnRenamed("id", "dst"), "dst")


def scatter_src_dst(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """x of an edge: that of its src followed by that of its dst."""
    edges = edges.drop("x")
    others = [c for c in edges.columns if c not in ("src", "dst")]
    return grid.joined(edges, rows).select("dst", "src", *others, F.concat("_a", "_b").alias("x"))


def scatter_src_dst_backward(grads: DataFrame, width: int) -> DataFrame:
    """Edge gradients (src, dst, x of 2 * width): the halves are added up at the two ends."""
    halves = F.array(F.struct(F.col("src").alias("id"), F.slice("x", 1, width).alias("x")), F.struct(F.col("dst").alias("id"), F.slice("x", width + 1, width).alias("x")))
    return weighted_sum(grads.select(F.inline(halves)), ["id"], "x", width)


def aggregate_dst_sum(edge_rows: DataFrame, width: int) -> DataFrame:
    return weighted_sum(edge_rows, ["dst"], "x", width)


def aggregate_dst_sum_backward(edges: DataFrame, grads: DataFrame) -> DataFrame:
    """Each in-edge receives the gradient (id, x) of its dst."""
    return scatter_dst(edges, grads)


def aggregate_dst_extreme(edge_rows: DataFrame, width: int, largest: bool = True) -> DataFrame:
    """(dst, pos, value, src): element-wise maximum or minimum over the in-edges, and the edge that gave it.

    Of equal values the smallest src wins. A dst without in-edges has no row."""
    pairs = [F.struct(F.get("x", F.lit(i)).alias("v"), (-F.col("src") if largest else F.col("src")).alias("s")) for i in range(width)]
    best = edge_rows.groupBy("dst").agg(*[(F.max if largest else F.min)(p).alias(f"_{i}") for i, p in enumerate(pairs)])
    rows = best.select("dst", F.posexplode(F.array(*[F.col(f"_{i}") for i in range(width)])).alias("pos", "b"))
    return rows.select("dst", "pos", F.col("b.v").alias("value"), (-F.col("b.s") if largest else F.col("b.s")).alias("src"))


def aggregate_dst_extreme_backward(winners: DataFrame, grads: DataFrame) -> DataFrame:
    """(src, dst, pos, value): the gradient (id, x) of each dimension goes to the recorded edge alone."""
    flat = grads.select(F.col("id").alias("dst"), F.posexplode("x").alias("pos", "value"))
    return winners.select("dst", "pos", "src").join(flat, ["dst", "pos"]).select("src", "dst", "pos", "value")


def gcn_aggregate(weighted: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(id, x): sum of weight * x over the in-edges (src, dst, weight)."""
    if width > NARROW:
        return grid.summed(weighted, rows, width, weight=F.col("weight"))
    return weighted_sum(scatter_src(weighted, rows), ["dst"], "x", width, F.col("weight")).withColumnRenamed("dst", "id")


def gcn_aggregate_backward(weighted: DataFrame, grads: DataFrame, width: int) -> DataFrame:
    """(id, x): sum of weight * gradient over the out-edges; the adjoint of gcn_aggregate."""
    if width > NARROW:
        return grid.summed(weighted, grads, width, "dst", "src", F.col("weight"))
    return weighted_sum(scatter_dst(weighted, grads), ["src"], "x", width, F.col("weight")).withColumnRenamed("src", "id")


def unweighted_aggregate(edges: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    if width > NARROW:
        return grid.summed(edges, rows, width)
    return weighted_sum(scatter_src(edges, rows), ["dst"], "x", width).withColumnRenamed("dst", "id")


def block_aggregate(weighted: DataFrame, rows: DataFrame, width: int, targets: DataFrame | None = None) -> DataFrame:
    """(batch, layer, dst, x) over block edges with weights; targets without samples get zeros."""
    sums = weighted_sum(scatter_src(weighted, rows), ["batch", "layer", "dst"], "x", width, F.col("weight"))
    if targets is None:
        return sums
    return targets.join(sums, ["batch", "layer", "dst"], "left").withColumn("x", F.coalesce("x", F.array_repeat(F.lit(0.0), width)))


def block_aggregate_backward(weighted: DataFrame, grads: DataFrame, width: int) -> DataFrame:
    """(batch, layer, src, x): gradients (batch, layer, dst, x) carried to the sources of a block."""
    return weighted_sum(weighted.join(grads, ["batch", "layer", "dst"]), ["batch", "layer", "src"], "x", width, F.col("weight"))


def aggregate_skip(weighted: DataFrame, rows: DataFrame, width: int, cached: DataFrame) -> DataFrame:
    """gcn_aggregate for the targets that are not in cached (id)."""
    return gcn_aggregate(weighted.join(cached.select(F.col("id").alias("dst")), "dst", "left_anti"), rows, width)


def fetch_dep_neighbors(mirrors: DataFrame, rows: DataFrame) -> DataFrame:
    """(part, id, x): the rows of every mirror that a part needs."""
    return mirrors.select("part", F.col("src").alias("id")).join(rows, "id")


def fetch_dep_neighbors_backward(grads: DataFrame, width: int) -> DataFrame:
    """(id, x): the gradients (part, id, x) of all mirrors added up at the master."""
    return weighted_sum(grads, ["id"], "x", width)


def edge_softmax(scores: DataFrame, score: str = "score", heads: int | None = None) -> DataFrame:
    """Edge scores (src, dst, score) with `a`, their softmax over the in-edges of dst, shifted by the maximum.

    With `heads` a score is an array of so many columns, each with a softmax of its own, and so is `a`. Two aggregates
    and joins rather than a window, so that a hub is not sorted in one task."""
    at = (lambda c, i: F.col(c)) if heads is None else (lambda c, i: F.get(c, F.lit(i)))
    each = range(heads or 1)
    top = scores.groupBy("dst").agg(*[F.max(at(score, i)).alias(f"_top{i}") for i in each])
    raised = scores.join(top, "dst").withColumns({f"_e{i}": F.exp(at(score, i) - F.col(f"_top{i}")) for i in each}).drop(*[f"_top{i}" for i in each])
    total = raised.groupBy("dst").agg(*[F.sum(f"_e{i}").alias(f"_sum{i}") for i in each])
    shares = [F.col(f"_e{i}") / F.col(f"_sum{i}") for i in each]
    return raised.join(total, "dst").withColumn("a", shares[0] if heads is None else F.array(*shares)).drop(*[f"_e{i}" for i in each], *[f"_sum{i}" for i in each])


def edge_softmax_backward(rows: DataFrame, heads: int | None = None) -> DataFrame:
    """Rows (src, dst, a, g) with `gs`, the gradient of the scores: a * g - a * sum over dst of a * g; arrays with `heads`."""
    at = (lambda c, i: F.col(c)) if heads is None else (lambda c, i: F.get(c, F.lit(i)))
    each = range(heads or 1)
    total = rows.groupBy("dst").agg(*[F.sum(at("a", i) * at("g", i)).alias(f"_t{i}") for i in each])
    back = [at("a", i) * (at("g", i) - F.col(f"_t{i}")) for i in each]
    return rows.join(total, "dst").withColumn("gs", back[0] if heads is None else F.array(*back)).drop(*[f"_t{i}" for i in each])


def attention_scores(edges: DataFrame, ends: DataFrame, slope: float = 0.2) -> DataFrame:
    """(src, dst, score): leaky relu of left(src) + right(dst), from ends (id, left, right).

    A score of concatenated ends is the sum of one number for each end, so edges carry two numbers and no vectors."""
    a = ends.select(F.col("id").alias("src"), F.col("left"))
    b = ends.select(F.col("id").alias("dst"), F.col("right"))
    both = edges.join(a, "src").join(b, "dst")
    return both.select("src", "dst", leaky_relu(F.array(F.col("left") + F.col("right")), slope)[0].alias("score"))


def edge_map(edge_rows: DataFrame, value: Column | Callable, name: str = "x", inputs: list[str] | None = None, kind: str = "array<double>") -> DataFrame:
    """Edge rows with a new column: an expression, or a numpy function of a batch of the columns `inputs` with results of
    type `kind`."""
    if isinstance(value, Column):
        return edge_rows.withColumn(name, value)
    return applied(edge_rows, value, inputs or ["x"], name, kind)
