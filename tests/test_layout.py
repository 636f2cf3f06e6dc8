"""Stored graphs, hubs, wide vectors, ranks by bins, functions of users."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopflow.functions import vectors as V
from hopflow.operators import layout, messages, model, partition, prepare, ranking, sampling


def some_edges(spark, n=400, hub=300):
    rng = np.random.default_rng(1)
    pairs = {(int(s), int(d)) for s, d in rng.integers(0, n, (3000, 2))} | {(s, 7) for s in range(hub)}
    return spark.createDataFrame(sorted(pairs), "src long, dst long")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("most", [1, 10, 64, 1 << 16])
def test_samples_of_a_stored_graph_are_the_same(spark, most):
    e = some_edges(spark)
    stored = layout.stored(e, buckets=5, most=most)
    seeds = spark.createDataFrame([(b, d) for b in range(4) for d in (7, 3, 11, 399, 1000)], "batch long, id long")
    for fanouts in ([5, 3], [-1, 2], [2, 0]):
        assert rows_of(sampling.sample_khop(seeds, stored, fanouts, 9)) == rows_of(sampling.sample_khop(seeds, e, fanouts, 9))
    assert rows_of(stored.edges.select("src", "dst")) == rows_of(e)


def test_a_graph_is_opened_again(spark, tmp_path):
    e = some_edges(spark)
    layout.save_graph(e.unionByName(spark.createDataFrame([(None, 1), (1, None)], "src long, dst long")), str(tmp_path / "g"), buckets=3, most=50)
    again = layout.open_graph(spark, str(tmp_path / "g"))
    assert rows_of(again.edges.select("src", "dst")) == rows_of(e) and again.buckets == 3
    assert {r["dst"]: r["salts"] for r in again.hubs.collect()}[7] >= 6
    frontier = spark.createDataFrame([(0, 7), (0, 8)], "batch long, dst long")
    assert rows_of(sampling.sample_neighbors(frontier, again, 4, 0)) == rows_of(sampling.sample_neighbors(frontier, e, 4, 0))


def test_an_empty_graph(spark):
    stored = layout.stored(some_edges(spark).limit(0), buckets=2)
    assert rows_of(sampling.sample_khop(spark.createDataFrame([(0, 1)], "batch long, id long"), stored, [2, 2])) == []


def _above_scan(plan):
    """The operators between the scan of each stored graph and the join above it."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    out = []
    for k, line in enumerate(lines):
        if "Bucketed: true" in line:
            mine, at = [], depth(line)
            for before in reversed(lines[:k]):
                if depth(before) < at:
                    at = depth(before)
                    mine.append(before.strip(" :+-*()0123456789").split(" ")[0])
                    if "Join" in before:
                        break
            out.append(mine)
    return out


def test_edges_do_not_move(spark):
    """Of each layer's plan: neither an exchange nor a sort of the edges."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        block = sampling.sample_khop(spark.range(50).select(F.lit(0).cast("long").alias("batch"), "id"), layout.stored(some_edges(spark), buckets=4), [3, 2])
        plan = block._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = _above_scan(plan)
    assert len(above) >= 2
    for operators in above:
        assert "SortMergeJoin" in operators[-1] and not any("Exchange" in o for o in operators), operators


def test_a_hub_is_spread(spark):
    """A million in-edges of one vertex: no task meets over 1 / 32 of them, and the sample is that of the plain edges."""
    e = spark.range(1_000_000).select(F.col("id").alias("src"), F.lit(5).cast("long").alias("dst"))
    stored = layout.stored(e, buckets=128, most=1024)
    # Where a plan joins by (dst, salt) a task reads one bucket; alone Spark would pack the files as it likes.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)
    tasks = [r["n"] for r in stored.edges.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("dst"), F.max("salt")).collect()]
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert sum(tasks) == 1_000_000 and max(tasks) < 1_000_000 / 32
    frontier = spark.createDataFrame([(0, 5), (1, 5)], "batch long, dst long")
    assert rows_of(sampling.sample_neighbors(frontier, stored, 4, 0, 3)) == rows_of(sampling.sample_neighbors(frontier, e, 4, 0, 3))


def test_chunks(spark, tmp_path):
    e, ranges = some_edges(spark), [(0, 0, 100), (1, 100, 300), (2, 300, 400)]
    layout.save_chunks(e, ranges, str(tmp_path / "c"))
    whole = rows_of(partition.owned_edges(e, ranges))
    assert rows_of(layout.load_chunks(spark, str(tmp_path / "c"))) == whole
    one = layout.load_chunks(spark, str(tmp_path / "c"), 1, 2)
    assert rows_of(one) == [r for r in whole if r[2:] == (1, 2)]
    assert "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("batch", [7, 10_000])
@pytest.mark.parametrize("held", [1000, 64 << 20])
def test_wide_sums_equal_narrow_ones(spark, monkeypatch, batch, held):
    monkeypatch.setattr(V, "HELD", held)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rng = np.random.default_rng(3)
        rows = [(int(k), -int(k) % 3, rng.normal(size=6).tolist(), float(rng.normal())) for k in np.append(rng.integers(0, 40, 300), [5] * 300)]
        rows += [(None, 1, [1.0] * 6, 1.0), (2, 0, [None, 1.0, 2.0, 3.0, 4.0, 5.0], None)]
        df = spark.createDataFrame(rows, "k long, b int, x array<double>, w double").repartition(3)
        for weight in (None, F.col("w")):
            wide, narrow = (V.weighted_sum(df, ["k", "b"], "x", 6, weight, narrow=n) for n in (0, 128))
            assert wide.schema == narrow.schema or [f.dataType for f in wide.schema] == [f.dataType for f in narrow.schema]
            a, b = ({(r["k"], r["b"]): r["x"] for r in d.collect()} for d in (wide, narrow))
            assert a.keys() == b.keys() and all(np.allclose(a[k], [v or 0.0 for v in b[k]]) for k in a)
        with pytest.raises(Exception, match="vectors of 5 numbers"):
            V.weighted_sum(df, ["k"], "x", 5, narrow=0).collect()
        assert V.weighted_sum(df.limit(0), ["k"], "x", 6, narrow=0).collect() == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_wide_aggregates(spark):
    """602 numbers a vertex, forward and backward, against numpy."""
    e = some_edges(spark, 60, 50)
    x = np.random.default_rng(0).normal(size=(60, 602))
    rows = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "id long, x array<double>")
    e = e.filter("src < 60 and dst < 60")
    w = prepare.gcn_edge_weight(e, 60)
    a = np.zeros((60, 60))
    for r in w.collect():
        a[r["dst"], r["src"]] = r["weight"]
    for df, want in ((messages.gcn_aggregate(w, rows, 602), a @ x), (messages.gcn_aggregate_backward(w, rows, 602), a.T @ x)):
        got = {r["id"]: r["x"] for r in df.collect()}
        assert all(np.allclose(v, want[i]) for i, v in got.items()) and len(got) > 10


def test_bins_never_fall(spark):
    rng = np.random.default_rng(1)
    values = sorted({0, 1, 2, 3, 2**53, 2**62, 2**63 - 1, -1, -5, -(2**62), *[int(v) for v in rng.integers(0, 2**40, 500)], *range(500)})
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", ranking.bin_of(F.col("v")).alias("b"))
    bins = [r["b"] for r in df.orderBy("v").collect()]
    assert bins == sorted(bins) and max(bins) <= 64 * ranking.OCTAVE


@pytest.mark.parametrize("high", [1, 3, 1000, 2**40])
def test_top_by_bins(spark, high):
    rng = np.random.default_rng(high % 97)
    rows = [(k, i, int(v)) for k in range(2) for i, v in enumerate(rng.integers(0, high, 300))] + [(7, 1, 5)]
    df = spark.createDataFrame(rows, "k long, id long, value long").repartition(5)
    for size in (0, 1, 40, 10_000):
        best = rows_of(ranking.top(df, "value", F.lit(size), ["k"]).select("k", "slot", "id", "value"))
        assert best == sorted((k, s, i, -v) for k in (0, 1, 7) for s, (v, i) in enumerate(sorted((-v, i) for j, i, v in rows if j == k)[:size]))
    alone = rows_of(ranking.top(df.filter("k = 0"), "value", F.lit(5)).select("slot", "id"))
    assert alone == [(s, i) for s, (_, i) in enumerate(sorted((-v, i) for j, i, v in rows if j == 0)[:5])]


def _gaps():
    def update(state, rows):
        src = rows.column(rows.schema.get_field_index("src")).to_numpy()
        mine = {"first": int(src[0]), "last": int(src[-1]), "widest": int(np.diff(src, prepend=src[0]).max()), "parts": 1}
        return mine if state is None else {**merge(state, mine), "parts": 1}

    def merge(a, b):
        return {"first": a["first"], "last": b["last"], "widest": max(a["widest"], b["widest"], b["first"] - a["last"]), "parts": a["parts"] + b["parts"]}

    def finish(dst, state):
        return None if dst == 13 else {"dst": dst, "widest": state["widest"], "parts": state["parts"]}

    return update, merge, finish, "first long, last long, widest long, parts int", "dst long, widest long, parts int"


def test_functions_of_in_edges_merge(spark):
    e = some_edges(spark).unionByName(spark.createDataFrame([(1, None)], "src long, dst long"))
    got = {r["dst"]: r["widest"] for r in model.grouped_dst_map(e, *_gaps()).collect()}
    want = {}
    for s, d in sorted(map(tuple, some_edges(spark).collect())):
        want.setdefault(d, []).append(s)
    assert got == {d: max((b - a for a, b in zip(v, v[1:])), default=0) for d, v in want.items() if d != 13}


def test_functions_of_a_hub_meet_in_parts(spark):
    """A million in-edges of one vertex lie in several tasks, of which each makes one state."""
    e = spark.range(1_000_000).select((F.col("id") * 2).alias("src"), F.lit(5).cast("long").alias("dst")).filter("src < 1000 or src > 1500")
    r = model.grouped_dst_map(e, *_gaps()).collect()
    assert [(x["dst"], x["widest"]) for x in r] == [(5, 504)] and r[0]["parts"] >= 4


def test_functions_of_batches(spark):
    rows = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(20)], "id long, x array<double>")
    double = model.vertex_map(rows, lambda x: x * 2, second=None)
    assert {r["id"]: r["x"] for r in double.collect()} == {i: [2.0 * i, 4.0] for i in range(20)}
    both = model.vertex_map(rows, lambda x, y: (x * y).sum(axis=1), "s", second=double, kind="double")
    assert both.columns == ["id", "x", "s"] and {r["id"]: r["s"] for r in both.collect()} == {i: 2.0 * i * i + 8 for i in range(20)}
    column = model.vertex_map(rows, F.get("x", F.lit(0)) + F.get("y", F.lit(1)), "s", second=double)
    assert {r["id"]: r["s"] for r in column.collect()} == {i: i + 4.0 for i in range(20)}
    with pytest.raises(Exception, match="1 results for"):
        model.vertex_map(rows.coalesce(1), lambda x: x[:1]).collect()
    weights = prepare.edge_weight_fn(spark.createDataFrame([(3, 1), (5, 5)], "src long, dst long"), lambda s, d: (s - d) / 2)
    assert rows_of(weights) == [(3, 1, 1.0), (5, 5, 0.0)]


def test_softmax_of_several_columns(spark):
    e = some_edges(spark, 30, 20)
    scores = e.withColumn("score", F.array(F.col("src") * 1.0, (F.col("src") - 4) * 1000.0, F.lit(0.0)))
    a = messages.edge_softmax(scores, heads=3)
    for k in range(3):
        alone = messages.edge_softmax(scores.select("src", "dst", F.get("score", F.lit(k)).alias("score")))
        got, want = ({(r["src"], r["dst"]): r["a"] for r in d.collect()} for d in (a.select("src", "dst", F.get("a", F.lit(k)).alias("a")), alone))
        assert got.keys() == want.keys() and all(np.isclose(got[x], want[x]) for x in got)
