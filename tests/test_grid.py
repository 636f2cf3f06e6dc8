"""Sums and joins by a grid of blocks against plain Python; no vector travels with an edge."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopflow.operators import grid, hotset, layout, messages


def pairs(seed=1, n=60, many=800):
    """Edges with repeats, a hub, loops, null ends and ids without vectors."""
    drawn = [(int(a), int(b)) for a, b in np.random.default_rng(seed).integers(0, n, (many, 2))]
    return [*drawn, *[(i, 3) for i in range(n)], (None, 3), (3, None)]


def walks(seeds, edges, hops):
    now = Counter(seeds)
    for _ in range(hops):
        following = Counter()
        for (batch, at), c in now.items():
            for src, dst in edges:
                if dst == at and src is not None:
                    following[batch, src] += c
        now = following
    return dict(now)


@pytest.mark.parametrize("wide, kept", [(512, False), (4, False), (512, True)])
def test_dense_hops(spark, monkeypatch, wide, kept):
    """Many super-batches at each vertex: counts are vectors, cut into tiles, and no hop after the first is a join."""
    monkeypatch.setattr(hotset, "WIDE", wide)
    rows = pairs()
    seeds = [(i % 25 - 7, i % 60) for i in range(200)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    edges = layout.stored(edges.dropna(), most=16) if kept else edges
    found = hotset.hop_counts(spark.createDataFrame(seeds, "super_batch long, id long"), edges, 3)
    assert {(r.super_batch, r.id): r["count"] for r in found.collect()} == walks(seeds, rows, 3)
    assert "MapInArrow" in found._jdf.queryExecution().toString()


def test_dense_hops_without_super_batch(spark):
    rows, seeds = pairs(), [*[(i % 25, i % 60) for i in range(200)], (None, 5), (None, 3)]
    found = hotset.hop_counts(spark.createDataFrame(seeds, "super_batch long, id long"), spark.createDataFrame(rows, "src long, dst long"), 2)
    assert {(r.super_batch, r.id): r["count"] for r in found.collect()} == walks(seeds, rows, 2)


def test_cells_are_partitions(spark):
    edges = spark.createDataFrame(pairs(), "src long, dst long").dropna()
    rows = grid.packed(spark.range(60).select("id", F.array(F.col("id").cast("double")).alias("x")), grid.packed_matrix(1))
    cells = grid.dealt(edges, rows, (3, 2), "src", "dst").withColumn("p", F.spark_partition_id())
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    assert cells.filter("x is null").filter(place("src", 3) * 2 + place("dst", 2) != F.col("p")).count() == 0
    assert cells.filter("x is not null").groupBy("src").agg(F.countDistinct("p").alias("k")).filter("k <> 2").count() == 0


def test_repeated_and_missing_ids(spark):
    key, at = grid.met(np.array([2, 2, 5, 7]), np.array([1, 2, 5, 5, 6, 7, 9]))
    assert list(zip(key, at)) == [(1, 0), (1, 1), (2, 2), (3, 2), (5, 3)]


@pytest.mark.parametrize("block", [64 << 20, 4000])
def test_wide_sums(spark, monkeypatch, block):
    """Vectors of 200 numbers, with null weights and elements, forward and backward, in blocks of a few vectors too."""
    monkeypatch.setattr(grid, "BLOCK", block)
    weight = lambda a, b: None if a % 5 == 0 else b * 0.5
    edges = [(a, b, None if a is None or b is None else weight(a, b)) for a, b in pairs()]
    x = {i: [None if (i, k) == (3, 5) else float(i * k % 7) for k in range(200)] for i in range(58)}
    table, rows = spark.createDataFrame(edges, "src long, dst long, weight double"), spark.createDataFrame(list(x.items()), "id long, x array<double>")
    for made, ends in ((messages.gcn_aggregate(table, rows, 200), (0, 1)), (messages.gcn_aggregate_backward(table, rows, 200), (1, 0))):
        want = {}
        for e in edges:
            give, take = e[ends[0]], e[ends[1]]
            if give in x and take is not None:
                want[take] = want.get(take, 0) + (e[2] or 0) * np.array([v or 0 for v in x[give]])
        got = {r.id: r.x for r in made.collect()}
        assert set(got) == set(want)
        assert all(np.allclose(got[k], want[k]) for k in want)
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [64 << 20, 4000])
def test_edges_of_both_ends(spark, monkeypatch, block):
    """Every edge with both vectors and its other columns; odd lengths, null elements, a null vector and a repeated id."""
    monkeypatch.setattr(grid, "BLOCK", block)
    rows = [(i, None if i == 9 else [None if (i, k) == (3, 5) else float(i * k) for k in range(3 if i == 7 else 20)]) for i in range(58)] + [(4, [1.0, 2.0])]
    edges = [(a, b, f"{a}-{b}") for a, b in pairs()]
    got = messages.scatter_src_dst(spark.createDataFrame(edges, "src long, dst int, name string"), spark.createDataFrame(rows, "id long, x array<double>"))
    assert got.dtypes == [("dst", "int"), ("src", "bigint"), ("name", "string"), ("x", "array<double>")]
    want = [(b, a, name, None if x is None or y is None else [*x, *y]) for a, b, name in edges for i, x in rows if i == a for j, y in rows if j == b]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [64 << 20, 400])
def test_attention_in_one_pass(spark, monkeypatch, block):
    """The softmax over the cells of a hub, with scores of up to 1000, equals that of joined edges."""
    monkeypatch.setattr(grid, "BLOCK", block)
    rows = np.random.default_rng(2).uniform(-500, 500, (58, 5))
    edges = [(a, b) for a, b in pairs() if a is not None and b is not None]
    want = {}
    for dst in {b for _, b in edges if b < 58}:
        met = np.array([rows[a] for a, b in edges if b == dst and a < 58])
        score = met[:, 0] + rows[dst, 1]
        score = np.where(score > 0, score, score * 0.2)
        e = np.exp(score - score.max())
        want[dst] = (met[:, 2:] * e[:, None]).sum(axis=0) / e.sum()
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, x array<double>")
    got = {r.id: r.x for r in grid.attended(spark.createDataFrame(pairs(), "src long, dst long"), table, 3, 0.2).collect()}
    assert set(got) == set(want)
    assert all(np.allclose(got[k], want[k]) for k in want)
