"""Vertex math, layered models, training steps and metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hopflow.functions import vectors as V
from hopflow.functions.hashing import M, continued, with_hash
from hopflow.operators import grid, layout, messages, sampling
from hopflow.operators.layout import StoredGraph
from hopflow.operators.prepare import in_degree, out_degree
from hopflow.sources.scratch import written, written_by


def fixed_weights(rows: int, cols: int, salt: int = 0) -> list[list[float]]:
    """A matrix that any engine can rebuild: sin(31 * i + j + salt) / sqrt(rows)."""
    i, j = np.arange(rows)[:, None], np.arange(cols)[None, :]
    return (np.sin(i * 31.0 + j + salt) / np.sqrt(rows)).tolist()


def vertex_map(rows: DataFrame, value: Column | Callable, name: str = "x", second: DataFrame | None = None, kind: str = "array<double>") -> DataFrame:
    """Vertex rows (id, x) with a new column. value: an expression over x, and over y, the x of the rows of `second` with
    the same id; or a numpy function of a batch of these, whose result has type `kind`."""
    inputs = ["x"]
    if second is not None:
        rows, inputs = rows.join(second.select("id", F.col("x").alias("y")), "id"), ["x", "y"]
    done = rows.withColumn(name, value) if isinstance(value, Column) else V.applied(rows, value, inputs, name, kind)
    return done if second is None else done.drop("y")


def vertex_reduce(rows: DataFrame, active: Column, value: Column, name: str = "total") -> DataFrame:
    return rows.filter(active).agg(F.sum(value).alias(name))


def grouped_dst_map(edge_rows: DataFrame, update: Callable, merge: Callable, finish: Callable, state: str, schema: str, order: str = "src") -> DataFrame:
    """A user's function over each dst and its in-edges in the order of a column, in parts that can be merged.

    update(state or None, rows): the state, a dict of the fields of `state`, after more in-edges, an Arrow batch; merge(a,
    b): the state of the edges of a followed by those of b; finish(dst, state): a dict of the fields of `schema`, or None
    for no row. Edges are dealt by ranges of (dst, order), so a hub lies in as many tasks as its size asks for, and of
    each vertex at most one state a task goes on. Edges without dst are left out."""
    columns = [c for c in edge_rows.columns if c != "dst"]
    ranged = edge_rows.select("dst", *columns).dropna(subset=["dst"]).repartitionByRange("dst", order).sortWithinPartitions("dst", order)
    states = f"dst {edge_rows.schema['dst'].dataType.simpleString()}, _task int, {state}"
    arrow, result = to_arrow_schema(StructType.fromDDL(states)), to_arrow_schema(StructType.fromDDL(schema))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, now, held, out = TaskContext.get().partitionId(), None, None, []
        for batch in batches:
            dst = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, dst[1:] != dst[:-1])) if len(dst) else []
            for s, e in zip(starts, [*starts[1:], len(dst)], strict=True):
                if dst[s] != now:
                    if held is not None:
                        out.append({"dst": now, "_task": task, **held})
                    now, held = dst[s].item(), None
                held = update(held, batch.slice(s, e - s))
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if held is not None:
            out.append({"dst": now, "_task": task, **held})
        yield pa.RecordBatch.from_pylist(out, arrow)

    def folded(parts: pa.Table) -> pa.Table:
        rows = sorted(parts.to_pylist(), key=lambda r: r["_task"])
        held = [{k: v for k, v in r.items() if k not in ("dst", "_task")} for r in rows]
        row = finish(rows[0]["dst"], reduce(merge, held))
        return pa.Table.from_pylist([] if row is None else [row], result)

    return ranged.mapInArrow(partial, states).groupBy("dst").applyInArrow(folded, schema)


def linear(rows: DataFrame, w: list[list[float]], out: str = "x", keep: str = "id") -> DataFrame:
    """x W in Arrow batches, with W broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(np.asarray(w, float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(shared.value))
            y = x @ shared.value
            offsets = pa.array(np.arange(batch.num_rows + 1) * y.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], names=[keep, out])

    return rows.select(keep, "x").mapInArrow(run, f"{keep} {rows.schema[keep].dataType.simpleString()}, {out} array<double>")


def dropout(rows: DataFrame, p: float, seed: int = 0, training: bool = True) -> DataFrame:
    """Elements zeroed by a hash of (id, position), the others scaled by 1 / (1 - p); as is in evaluation."""
    if not training or p <= 0:
        return rows
    kept = lambda v, i: F.when(continued(F.col("_h"), i) >= int(p * M), v / (1 - p)).otherwise(0.0)
    return with_hash(rows, "_h", seed, F.col("id")).withColumn("x", F.transform("x", kept)).drop("_h")


def nll_loss(scored: DataFrame) -> DataFrame:
    """Mean of -log p of the label over rows (logp, label)."""
    return scored.agg(F.avg(-F.get("logp", F.col("label").cast("int"))).alias("loss"))


def predict(rows: DataFrame, scores: str = "x") -> DataFrame:
    return rows.withColumn("predicted", V.argmax(F.col(scores)))


def accuracy_by_mask(predicted: DataFrame, masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(mask, correct, total, accuracy) for the masks 0, 1 and 2; 0 for a mask without rows."""
    right = (F.col("predicted") == F.col("label")).cast("long")
    found = predicted.join(labels, "id").join(masks, "id").groupBy("mask").agg(F.sum(right).alias("correct"), F.count("*").alias("total"))
    all_ = predicted.sparkSession.range(3).select(F.col("id").cast("int").alias("mask"))
    both = all_.join(found, "mask", "left").fillna(0, ["correct", "total"])
    return both.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0))


def accuracy_minibatch(predicted: DataFrame) -> DataFrame:
    """Rows (batch, predicted, label): correct by batch, added up, over the number of seeds."""
    each = predicted.groupBy("batch").agg(F.sum((F.col("predicted") == F.col("label")).cast("long")).alias("c"), F.count("*").alias("n"))
    return each.agg(F.sum("c").alias("correct"), F.sum("n").alias("seeds"), (F.sum("c") / F.sum("n")).alias("accuracy"))


def _layers(sizes: list[int]) -> list[list[list[float]]]:
    return [fixed_weights(a, b, k) for k, (a, b) in enumerate(zip(sizes[:-1], sizes[1:], strict=True))]


def gcn_infer(weighted: DataFrame, features: DataFrame, layers: list[list[list[float]]]) -> DataFrame:
    """(id, logp) of a GCN over the whole graph; weighted has (src, dst, weight).

    Both are linear, so the matrix goes before the sum where it makes rows narrower, and after it otherwise."""
    rows = features.select("id", F.col("features").alias("x"))
    for k, w in enumerate(layers):
        wide, narrow = len(w), len(w[0])
        if narrow < wide:
            rows = messages.gcn_aggregate(weighted, linear(rows, w), narrow)
        else:
            rows = linear(messages.gcn_aggregate(weighted, rows, wide), w)
        rows = rows.select("id", V.relu(F.col("x")).alias("x")) if k < len(layers) - 1 else rows
    return rows.select("id", V.log_softmax(F.col("x")).alias("logp"))


def gat_layer(edges: DataFrame, rows: DataFrame, w: list[list[float]], left: list[float], right: list[float], slope: float = 0.2) -> DataFrame:
    """(id, x): relu of the attention-weighted sum of h = x W over the in-edges; scores from left . h_src + right . h_dst.

    Scores, their softmax and the sum are made in one pass over the edges, in a grid of blocks (`grid.attended`)."""
    h = linear(rows, w)
    numbers = lambda a: F.array(*[F.lit(float(v)) for v in a])
    left_, right_ = V.dot(F.col("x"), numbers(left)), V.dot(F.col("x"), numbers(right))
    given = written(h.select("id", F.concat(F.array(left_, right_), "x").alias("x")), "ends")
    return grid.attended(edges, given, len(w[0]), slope).select("id", V.relu(F.col("x")).alias("x"))


def gat_infer(edges: DataFrame, features: DataFrame, layers: list[tuple[list[list[float]], list[float], list[float]]]) -> DataFrame:
    rows, edges = features.select("id", F.col("features").alias("x")), written(edges.select("src", "dst"), "edges")
    for w, left, right in layers:
        rows = gat_layer(edges, rows, w, left, right)
    return rows.select("id", V.log_softmax(F.col("x")).alias("logp"))


def gradient_sum(rows: DataFrame, x: str = "x", g: str = "g") -> np.ndarray:
    """The matrix of the sum of x^T g over all rows; no rows give an empty one.

    One partial matrix for each partition, added up in a tree: the driver meets a few matrices, whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                a, b = (c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in batch.columns)
                total = a.T @ b if total is None else total + a.T @ b
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([total.shape[1]], pa.int32())], names=["m", "cols"])

    partials = rows.select(x, g).mapInArrow(run, "m binary, cols int").rdd.map(lambda r: np.frombuffer(bytes(r["m"])).reshape(-1, r["cols"]))
    return partials.treeAggregate(np.zeros((0, 0)), _plus, _plus)


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b if a.size and b.size else b if b.size else a


@dataclass
class Adam:
    """State of one matrix."""

    w: np.ndarray
    m: np.ndarray | float = 0.0
    v: np.ndarray | float = 0.0
    step: int = 0

    def update(self, gradient: np.ndarray, rate: float = 0.01, decay: float = 0.0, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-9, bias_correction: bool = True) -> None:
        g = gradient + decay * self.w
        self.step += 1
        self.m = b1 * self.m + (1 - b1) * g
        self.v = b2 * self.v + (1 - b2) * g * g
        m, v = (self.m / (1 - b1**self.step), self.v / (1 - b2**self.step)) if bias_correction else (self.m, self.v)
        self.w = self.w - rate * m / (np.sqrt(v) + eps)


def adam_update(rows: DataFrame, step: int, rate: float = 0.01, decay: float = 0.0, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-9, bias_correction: bool = True) -> DataFrame:
    """The same update for parameters that are rows (..., w, m, v, g), such as vertex embeddings: new w, m and v."""
    g = F.col("g") + decay * F.col("w")
    m, v = b1 * F.col("m") + (1 - b1) * g, b2 * F.col("v") + (1 - b2) * g * g
    fixed_m, fixed_v = (m / (1 - b1**step), v / (1 - b2**step)) if bias_correction else (m, v)
    w = F.col("w") - rate * fixed_m / (F.sqrt(fixed_v) + eps)
    return rows.select(*[c for c in rows.columns if c not in ("w", "m", "v", "g")], w.alias("w"), m.alias("m"), v.alias("v"))


def _matmul(rows: DataFrame, w: np.ndarray, keys: list[str]) -> DataFrame:
    """rows (keys, x) with x W."""
    return linear(rows.select(F.struct(*keys).alias("_k"), "x"), w.tolist(), keep="_k").select("_k.*", "x")


def train_epoch(batches: DataFrame, edges: DataFrame | StoredGraph, n: int, features: DataFrame, labels: DataFrame, layers: list[Adam], fanouts: list[int], rate: float = 0.01, seed: int = 0, drop: float = 0.0) -> list[tuple[int, float]]:
    """An epoch of a GCN of two layers by sampled batches (id, batch, super_batch): (super_batch, mean loss) of each step.

    A step takes the batches of one super-batch: forward over their sampled blocks, loss at the seeds, backward, the sum
    of the gradients, one Adam update of each matrix. Samples, the sums of raw features over the outer layer, and labels
    need no weights, so all batches of the epoch have them made once, in one job each, and written in a folder for each
    super-batch; a step reads its own folders and nothing else. Rows stay distributed; per step the gradients of the small
    matrices come back, and the number of steps is seeds / (batch size * batches of a step). Labels and super-batches
    without rows give no step. `drop`: dropout of hidden values."""
    if not isinstance(edges, StoredGraph):
        edges = layout.stored(edges)
    group = batches.select("batch", "super_batch").distinct()
    degrees = out_degree(edges.edges, n), in_degree(edges.edges, n)
    block = sampling.sampled_weights(sampling.sample_khop(batches.select("batch", "id"), edges, fanouts, seed), *degrees)
    block = written(block.join(group, "batch"), "block")
    raw = features.select("id", F.col("features").alias("x"))
    outer = messages.block_aggregate(block.filter("layer = 1"), raw, layers[0].w.shape[0]).select("batch", F.col("dst").alias("id"), F.col("x").alias("a0"))
    outer = written_by(outer.join(group, "batch"), "outer", "super_batch", "id")
    inner = written_by(block.filter("layer = 0").select("super_batch", "batch", "src", "dst", "weight"), "inner", "super_batch", "dst")
    truth = written_by(batches.select("super_batch", "batch", "id").join(labels, "id"), "truth", "super_batch", "id")
    losses = []
    for k in [r[0] for r in group.select("super_batch").distinct().orderBy("super_batch").collect()]:
        if all(k in t.values for t in (outer, inner, truth)):
            loss, gradients = _step(outer.of(k), inner.of(k), truth.of(k), [a.w for a in layers], drop, seed + k)
            losses.append((k, loss))
            for state, g in zip(layers, gradients, strict=True):
                state.update(g if g.size else np.zeros_like(state.w), rate)
    return losses


def _step(outer: DataFrame, inner: DataFrame, truth: DataFrame, weights: list[np.ndarray], drop: float, seed: int) -> tuple[float, list[np.ndarray]]:
    """The mean loss and the gradients of both matrices. outer (batch, id, a0): the sums of raw features; inner (batch,
    src, dst, weight): the block of the seeds; truth (batch, id, label)."""
    w0, w1 = weights
    z0 = _matmul(outer.select("batch", "id", "a0", F.col("a0").alias("x")), w0, ["batch", "id", "a0"])
    z0 = written(dropout(z0.select("batch", "id", "a0", F.col("x").alias("z"), V.relu(F.col("x")).alias("x")), drop, seed), "hidden")
    hidden = inner.join(z0.select("batch", F.col("id").alias("src"), "x"), ["batch", "src"])
    a1 = V.weighted_sum(hidden, ["batch", "dst"], "x", w0.shape[1], F.col("weight")).withColumnRenamed("dst", "id")
    scored = _matmul(a1.join(truth, ["batch", "id"]).select("batch", "id", "label", F.col("x").alias("a"), "x"), w1, ["batch", "id", "label", "a"])
    scored = written(scored.select("batch", "id", "label", "a", V.log_softmax(F.col("x")).alias("logp")), "scored")
    count = scored.count()
    if not count:
        return 0.0, [np.zeros((0, 0))] * 2
    out = _output_gradient(scored, count)
    back = _matmul(out.select("batch", "id", F.col("g").alias("x")), w1.T, ["batch", "id"])
    into = V.weighted_sum(inner.join(back.select("batch", F.col("id").alias("dst"), "x"), ["batch", "dst"]), ["batch", "src"], "x", w0.shape[1], F.col("weight"))
    into = dropout(into.select("batch", F.col("src").alias("id"), "x"), drop, seed).withColumnRenamed("x", "d")
    inside = z0.select("batch", "id", F.col("a0").alias("x"), "z").join(into, ["batch", "id"])
    return float(nll_loss(scored).first()["loss"]), [gradient_sum(inside.select("x", _where_positive("z", "d").alias("g"))), gradient_sum(out)]


def _output_gradient(scored: DataFrame, count: int) -> DataFrame:
    """Of rows (logp, label, a, ...) the input x of the last matrix and g, the gradient of the mean loss at its output."""
    g = F.transform("logp", lambda v, i: (F.exp(v) - F.when(i == F.col("label"), 1.0).otherwise(0.0)) / count)
    return scored.select(*[c for c in scored.columns if c not in ("logp", "label", "a")], F.col("a").alias("x"), g.alias("g"))


def _where_positive(z: str, d: str) -> Column:
    return F.zip_with(z, d, lambda z, d: F.when(z > 0, d).otherwise(0.0))


def full_batch_sums(weighted: DataFrame, features: DataFrame, width: int) -> DataFrame:
    """(id, x): the sums of raw features that every step begins with; they need no weights of the model."""
    return grid.summed(weighted, features.select("id", F.col("features").alias("x")), width, weight=F.col("weight"))


def full_batch_step(weighted: DataFrame, features: DataFrame, labels: DataFrame, seeds: DataFrame, layers: list[Adam], rate: float = 0.01, sums: DataFrame | None = None) -> float:
    """One step of a GCN of two layers over the seeds (id): forward, loss, backward, an Adam update of each matrix.

    Returns the mean loss. Forward rows stay distributed; only the gradients of the small matrices come back. sums: those
    of full_batch_sums, where several steps share them. Edges are summed over in a grid of blocks at every width, so that
    no task sends partial sums of nearly all vertices."""
    w0, w1 = (a.w for a in layers)
    a0 = full_batch_sums(weighted, features, w0.shape[0]) if sums is None else sums
    z0 = written(_matmul(a0.select("id", F.col("x").alias("a0"), "x"), w0, ["id", "a0"]).withColumnRenamed("x", "z"), "hidden")
    a1 = grid.summed(weighted, z0.select("id", V.relu(F.col("z")).alias("x")), w0.shape[1], weight=F.col("weight"))
    scored = _matmul(a1.join(seeds, "id").join(labels, "id").select("id", "label", F.col("x").alias("a"), "x"), w1, ["id", "label", "a"])
    scored = written(scored.select("id", "label", "a", V.log_softmax(F.col("x")).alias("logp")), "scored")
    n = scored.count()
    if not n:
        return 0.0
    out = _output_gradient(scored, n)
    into = grid.summed(weighted, _matmul(out.select("id", F.col("g").alias("x")), w1.T, ["id"]), w0.shape[1], "dst", "src", F.col("weight")).withColumnRenamed("x", "d")
    inner = z0.join(into, "id").select(F.col("a0").alias("x"), _where_positive("z", "d").alias("g"))
    for state, g in zip(layers, (gradient_sum(inner), gradient_sum(out)), strict=True):
        state.update(g if g.size else np.zeros_like(state.w), rate)
    return nll_loss(scored).first()["loss"]
