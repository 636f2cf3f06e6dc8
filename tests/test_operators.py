"""Properties and hand-made cases of the graph operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopflow.functions import hashing
from hopflow.functions import vectors as V
from hopflow.functions.hashing import hash_of, hash_py
from hopflow.operators import batching, hotset, messages, model, nodes, partition, prepare, ranking, runlogs, sampling
from hopflow.sources import edges as edge_files
from hopflow.sources import node_files


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


@pytest.fixture(scope="module")
def small(spark):
    """Ten vertices; 9 has no edge, 8 only a loop, 0 is a hub."""
    pairs = sorted({(i, 0) for i in range(8)} | {(0, 3), (1, 2), (2, 1), (3, 4), (4, 5), (5, 6), (6, 7), (7, 5), (8, 8)})
    return pairs, edges(spark, pairs)


def vectors(spark, n=10, d=3, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id long, x array<double>")


def test_hash_agrees_with_plain_numbers(spark):
    ids = [0, 1, 2**31, 2**32 - 1, 2**40 + 7]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    assert [r[0] for r in df.select(hash_of(5, F.col("id"), 9)).collect()] == [hash_py(5, i, 9) for i in ids]


def test_degrees_keep_vertices_without_edges(spark, small):
    pairs, e = small
    out = {r["id"]: r["degree"] for r in prepare.out_degree(e, 10).collect()}
    assert out == {i: sum(s == i for s, _ in pairs) for i in range(10)} and out[9] == 0
    assert all(r["degree"] >= 1 for r in prepare.in_degree(e, 10, 1).collect())
    assert {r["id"]: r["offset"] for r in prepare.build_csr(e, 10).collect()} == {i: sum(s < i for s, _ in pairs) for i in range(10)}


def test_ids_above_31_bits(spark, tmp_path):
    rows = [(2**31 + 5, 2**32 - 1), (0, 7), (3, 3)]
    path = tmp_path / "e"
    edge_files.write_edges_binary(edges(spark, rows).coalesce(1), str(path))
    assert sorted(tuple(r) for r in edge_files.read_edges_binary(spark, str(path)).collect()) == sorted(rows)
    with pytest.raises(Exception, match="32 bits"):
        edge_files.write_edges_binary(edges(spark, [(2**32, 1)]), str(tmp_path / "bad"))


def test_text_files(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# c\n% c\n\n1 2\n 3\t4  0.5 \nx y\n5\n")
    assert [tuple(r) for r in edge_files.read_edges_text(spark, str(tmp_path / "e.txt")).collect()] == [(1, 2, None), (3, 4, 0.5)]
    (tmp_path / "f.csv").write_text("1,2\n3,4\n5,6\n")
    assert [tuple(r) for r in node_files.read_features_csv(spark, str(tmp_path / "f.csv"), 2).collect()] == [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])]
    with pytest.raises(Exception, match="number of features"):
        node_files.read_features_csv(spark, str(tmp_path / "f.csv"), 3).collect()
    (tmp_path / "m").write_text("0 train\n1 val\n2 eval\n3 test\n4 none\n")
    assert [r["mask"] for r in node_files.read_mask(spark, str(tmp_path / "m")).orderBy("id").collect()] == [0, 1, 1, 2, 3]
    (tmp_path / "l").write_text("7 3\n")
    assert [tuple(r) for r in node_files.read_labels(spark, str(tmp_path / "l")).collect()] == [(7, 3)]


@pytest.mark.parametrize("fanout", [0, 1, 3, 100, -1])
def test_samples(spark, small, fanout):
    pairs, e = small
    frontier = spark.createDataFrame([(b, d) for b in range(3) for d in range(10)], "batch long, dst long")
    got = [tuple(r) for r in sampling.sample_neighbors(frontier, e, fanout, 0, 5).collect()]
    assert len(set(got)) == len(got) and {(s, d) for _, _, d, s in got} <= set(pairs)
    for b in range(3):
        for d in range(10):
            degree = sum(t == d for _, t in pairs)
            assert sum(g[0] == b and g[2] == d for g in got) == (degree if fanout < 0 else min(degree, fanout))
    again = sampling.sample_neighbors(frontier.repartition(7), e.repartition(5), fanout, 0, 5)
    assert sorted(map(tuple, again.collect())) == sorted(got)


def test_samples_are_uniform(spark):
    e = edges(spark, [(s, 0) for s in range(20)])
    frontier = spark.range(4000).select(F.col("id").alias("batch"), F.lit(0).cast("long").alias("dst"))
    counts = [r["count"] for r in sampling.sample_neighbors(frontier, e, 5, 0).groupBy("src").count().collect()]
    assert len(counts) == 20 and sum((c - 1000) ** 2 / 1000 for c in counts) < 45


def test_layers_follow_sources(spark, small):
    _, e = small
    seeds = spark.createDataFrame([(0, 5), (0, 0), (1, 7)], "batch long, id long")
    block = sampling.sample_khop(seeds, e, [2, 2], 3).collect()
    for b in (0, 1):
        assert {r["dst"] for r in block if r["layer"] == 1 and r["batch"] == b} <= {r["src"] for r in block if r["layer"] == 0 and r["batch"] == b}


def test_batches(spark):
    seeds = spark.range(150)
    pos = {r["id"]: r["pos"] for r in batching.shuffle_nodes(seeds, 3).collect()}
    assert sorted(pos.values()) == list(range(150)) and pos == {r["id"]: r["pos"] for r in batching.shuffle_nodes(seeds.repartition(9), 3).collect()}
    shuffled = batching.shuffle_nodes(seeds, 3)
    local = {r["id"]: r["pos"] for r in batching.local_shuffle(shuffled, 40, 150, 3).collect()}
    assert sorted(local.values()) == list(range(150)) and all(local[i] == pos[i] for i in pos if pos[i] >= 120)
    assert {frozenset(i for i in pos if pos[i] // 40 == k) for k in range(3)} == {frozenset(i for i in local if local[i] // 40 == k) for k in range(3)}
    batches = batching.make_batches(batching.shuffle_nodes(spark.range(1, 66), 0), 64)
    split = [tuple(r) for r in batching.split_batch_across_workers(batches, 64, 65, 3).collect()]
    assert sorted(w for b, w, _ in split if b == 1) == [0, 1, 2] and sum(i == 0 for _, _, i in split) == 2
    assert [sum(b == 0 and w == k for b, w, _ in split) for k in range(3)] == [21, 21, 22]
    assert batching.shuffle_nodes(seeds.limit(0)).collect() == []


def test_ranges_cover(spark, small):
    _, e = small
    for parts, page in ((1, 4), (3, 2), (4, 1024)):
        r = partition.balanced_ranges(e, 10, parts, page)
        assert r[0][1] == 0 and r[-1][2] == 10 and all(a[2] == b[1] for a, b in zip(r, r[1:])) and len(r) == parts


def test_hot_ties_and_empty(spark):
    counts = spark.createDataFrame([(0, i, 5) for i in (4, 2, 9, 7)], "super_batch long, id long, count long")
    assert [r["id"] for r in hotset.presample_hot_fixed(counts, 2).orderBy("slot").collect()] == [2, 4]
    assert hotset.presample_hot(counts, 0.0).collect() == []
    needed = spark.createDataFrame([(0, 1), (0, 2)], "super_batch long, id long")
    assert hotset.cache_hit_rate(hotset.split_hits_misses(needed, counts.limit(0).withColumn("slot", F.col("id")))).first()["hits"] == 0
    newest = hotset.merge_newest(spark.createDataFrame([(1, 1, 5.0), (1, 3, 2.0), (1, 2, 9.0)], "id long, version long, value double"))
    assert [tuple(r) for r in newest.collect()] == [(1, 3, 2.0)]


def test_hot_set_round_trip(spark, tmp_path):
    hot = spark.createDataFrame([(s, k, 10 * s + k) for s in range(2) for k in range(5)], "super_batch long, slot long, id long")
    hotset.save_hot_set(hot, str(tmp_path / "h"))
    got = hotset.load_hot_set(spark.read.parquet(str(tmp_path / "h")), 0.5).collect()
    assert sorted((r["super_batch"], r["id"]) for r in got) == [(0, 0), (0, 1), (1, 10), (1, 11)]


def test_adjoint(spark, small):
    _, e = small
    w = prepare.gcn_edge_weight(e, 10)
    (x, xs), (g, gs) = vectors(spark, seed=1), vectors(spark, seed=2)
    forward = {r["id"]: r["x"] for r in messages.gcn_aggregate(w, xs, 3).collect()}
    backward = {r["id"]: r["x"] for r in messages.gcn_aggregate_backward(w, gs, 3).collect()}
    assert math.isclose(sum(np.dot(v, g[i]) for i, v in forward.items()), sum(np.dot(v, x[i]) for i, v in backward.items()))
    halves = messages.scatter_src_dst(e, xs)
    back = {r["id"]: r["x"] for r in messages.scatter_src_dst_backward(halves, 3).collect()}
    degree = {r["id"]: r["degree"] for r in prepare.undirected_degree(e, 10).collect()}
    assert all(np.allclose(v, x[i] * degree[i]) for i, v in back.items())


def test_softmax_sums_to_one(spark, small):
    _, e = small
    scored = messages.edge_softmax(e.withColumn("score", (F.col("src") - 4) * 1000.0))
    sums = scored.groupBy("dst").agg(F.sum("a").alias("s")).collect()
    assert all(math.isclose(r["s"], 1.0) for r in sums)


def test_cached_gather_is_the_same(spark):
    _, xs = vectors(spark)
    needed = spark.createDataFrame([(b, i % 10) for b in range(3) for i in range(12)], "super_batch long, id long")
    for hot in (spark.range(0), spark.range(4), spark.range(10)):
        plain = sorted(map(str, hotset.gather_features(needed, xs).collect()))
        assert sorted(map(str, hotset.gather_features_cached(needed, xs, hot).select("id", "super_batch", "x").collect())) == sorted(map(str, hotset.gather_features(needed, xs).select("id", "super_batch", "x").collect())) and plain


def test_gradients_against_differences(spark, small):
    _, e = small
    w = prepare.gcn_edge_weight(e, 10).toPandas()
    a = np.zeros((10, 10))
    a[w["dst"], w["src"]] = w["weight"]
    x, _ = vectors(spark)
    features = spark.createDataFrame([(i, x[i].tolist()) for i in range(10)], "id long, features array<double>")
    labels = np.arange(10) % 4
    seeds = [0, 1, 3, 5, 7]
    w0, w1 = (np.asarray(model.fixed_weights(*s)) for s in ((3, 5), (5, 4)))

    def loss(p, q):
        z = a @ np.maximum(a @ x @ p, 0) @ q
        logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return -np.mean([logp[i, labels[i]] for i in seeds])

    def slopes(k):
        m = (w0, w1)[k]
        out = np.zeros_like(m)
        for i in np.ndindex(m.shape):
            d = np.zeros_like(m)
            d[i] = 1e-6
            out[i] = (loss(w0 + d, w1) - loss(w0 - d, w1)) / 2e-6 if k == 0 else (loss(w0, w1 + d) - loss(w0, w1 - d)) / 2e-6
        return out

    class Plain(model.Adam):
        def update(self, gradient, rate=0.01, **_):
            self.gradient = gradient

    layers = [Plain(w0), Plain(w1)]
    got = model.full_batch_step(prepare.gcn_edge_weight(e, 10), features, spark.createDataFrame([(i, int(labels[i])) for i in range(10)], "id long, label long"), spark.createDataFrame([(i,) for i in seeds], "id long"), layers)
    assert math.isclose(got, loss(w0, w1), rel_tol=1e-9)
    for k in (0, 1):
        assert np.allclose(layers[k].gradient, slopes(k), atol=1e-6)


def test_adam():
    a = model.Adam(np.asarray([1.0, -2.0]))
    a.update(np.asarray([0.5, 0.0]), rate=0.1)
    assert np.allclose(a.w, [0.9, -2.0])
    b = model.Adam(np.asarray([1.0]))
    b.update(np.asarray([0.5]), rate=0.1, bias_correction=False)
    assert np.allclose(b.w, 1.0 - 0.1 * 0.05 / np.sqrt(0.00025))


def test_vertex_math(spark):
    df = spark.createDataFrame([(0, [1000.0, -1000.0, 1000.0])], "id long, x array<double>")
    r = df.select(V.log_softmax(F.col("x")).alias("s"), V.argmax(F.col("x")).alias("k"), V.relu(F.col("x")).alias("r")).first()
    assert np.allclose(r["s"], [-math.log(2), -2000 - math.log(2), -math.log(2)]) and r["k"] == 0 and r["r"] == [1000.0, 0.0, 1000.0]
    assert model.dropout(df, 0.5, training=False).first()["x"] == [1000.0, -1000.0, 1000.0]
    assert model.linear(df, [[1.0], [1.0], [0.0]]).first()["x"] == [0.0]


def test_masks_without_rows(spark):
    one = spark.createDataFrame([(0, 3)], "id long, predicted long")
    got = model.accuracy_by_mask(one, spark.createDataFrame([(0, 1)], "id long, mask int"), spark.createDataFrame([(0, 3)], "id long, label long"))
    assert [tuple(r) for r in got.orderBy("mask").collect()] == [(0, 0, 0, 0.0), (1, 1, 1, 1.0), (2, 0, 0, 0.0)]
    v = spark.range(4)
    assert [r["mask"] for r in nodes.split_codes(v.filter("id < 3"), v.filter("id = 1"), v.filter("id < 1"), v).orderBy("id").collect()] == [2, 1, 0, None]


def test_run_logs(spark):
    lines = spark.createDataFrame([("#run_time=4.28 (s)",), ("average epoch time: 0.42",), ("Epoch[3]:Times[0.5(s)]:loss 0.77",), ("epoch 3 Train Acc: 0.76 12 16",), ("x",)], "value string")
    assert {r["name"]: r["value"] for r in runlogs.parse_metrics(lines).collect()} == {"run_time": 4.28, "average epoch time": 0.42}
    assert [tuple(r) for r in runlogs.parse_train_log(lines).collect()] == [(3, 0.5, 0.77, 0.76, 12, 16)]
    usage = spark.createDataFrame([("a", 10.0, 500), ("a", 20.0, 501), ("a", 40.0, 2000)], "name string, rate double, ts long")
    assert runlogs.cpu_usage(usage, 1000, 1400).collect()[0]["rate"] == 20.0


def test_ranks_and_running_sums_by_pages(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, int(v)) for k in range(3) for i, v in zip(rng.permutation(200).tolist(), rng.integers(0, 6, 200))]
    df = spark.createDataFrame(rows, "k long, id long, value long")
    for page in (1, 7, 4096):
        got = {(r["k"], r["id"]): r["s"] for r in ranking.running(df, "value", "s", ["k"], page).collect()}
        assert got == {(k, i): sum(w for j, h, w in rows if j == k and h < i) for k, i, _ in rows}
        best = sorted((r["k"], r["slot"], r["id"]) for r in ranking.top(df, "value", F.floor(F.col("_all") * 0.3), ["k"]).collect())
        assert best == [(k, s, i) for k in range(3) for s, (_, i) in enumerate(sorted((-v, i) for j, i, v in rows if j == k)[:60])]


def test_ranges_do_not_depend_on_books(spark, small):
    _, e = small
    for parts, page in ((1, 1), (3, 1), (4, 2), (9, 1)):
        assert partition.balanced_ranges(e, 10, parts, page, book=2) == partition.balanced_ranges(e, 10, parts, page)


def test_lists_of_hubs_come_in_chunks(spark):
    e = edges(spark, [(i, 0) for i in range(50)] + [(3, 1)])
    got = prepare.build_csc(e, 60, 8).collect()
    hub = sorted((r["chunk"], r["offset"], r["nbrs"]) for r in got if r["id"] == 0)
    assert hub == [(k, 8 * k, list(range(8 * k, min(8 * k + 8, 50)))) for k in range(7)]
    assert [tuple(r) for r in got if r["id"] == 59] == [(59, 0, [], 51)] and len(got) == 7 + 59


@pytest.mark.parametrize("drop", [0.0, 0.5])
def test_epoch_of_sampled_batches(spark, small, drop):
    """Losses and weights after an epoch of three steps against plain numpy on the same samples."""
    _, e = small
    x, _ = vectors(spark)
    features = spark.createDataFrame([(i, x[i].tolist()) for i in range(10)], "id long, features array<double>")
    labels = np.arange(10) % 4
    truth = spark.createDataFrame([(i, int(labels[i])) for i in range(10)], "id long, label long")
    batches = batching.make_batches(batching.shuffle_nodes(spark.range(9), 2), 2, 2)
    block = sampling.sampled_weights(sampling.sample_khop(batches.select("batch", "id"), e, [2, 2], 3), prepare.out_degree(e, 10), prepare.in_degree(e, 10)).toPandas()
    where = batches.toPandas()
    mine, plain = ([model.Adam(np.asarray(model.fixed_weights(*s))) for s in ((3, 5), (5, 4))] for _ in range(2))
    losses = model.train_epoch(batches, e, 10, features, truth, mine, [2, 2], 0.01, 3, drop)
    assert len(losses) == 3
    for step, got in losses:
        gradients, total, count = [np.zeros((3, 5)), np.zeros((5, 4))], 0.0, 0
        rows = where[where["super_batch"] == step]
        for b in sorted(rows["batch"].unique()):
            a = [np.zeros((10, 10)), np.zeros((10, 10))]
            for r in block[block["batch"] == b].itertuples():
                a[r.layer][r.dst, r.src] = r.weight
            reached = a[1].any(axis=1)[:, None]
            keep = np.asarray([[hash_py(3 + step, i, j) >= int(drop * 2**31) for j in range(5)] for i in range(10)]) / (1 - drop)
            a0 = a[1] @ x
            z0 = a0 @ plain[0].w
            a1 = a[0] @ (np.maximum(z0, 0) * keep * reached)
            z = a1 @ plain[1].w
            logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
            seeds = [i for i in rows[rows["batch"] == b]["id"] if a[0][i].any()]
            g = np.zeros_like(z)
            for i in seeds:
                total -= logp[i, labels[i]]
                count += 1
                g[i] = np.exp(logp[i]) - np.eye(4)[labels[i]]
            gradients[1] += a1.T @ g
            gradients[0] += a0.T @ ((a[0].T @ (g @ plain[1].w.T)) * keep * (z0 > 0))
        assert math.isclose(got, total / count, rel_tol=1e-9)
        for state, g in zip(plain, gradients, strict=True):
            state.update(g / count)
    assert all(np.allclose(p.w, m.w) for p, m in zip(plain, mine, strict=True))


def test_hash_continued(spark):
    """The hash of parts and one more, and places in the order of a hash."""
    rows = hashing.with_hash(spark.range(200), "h", 7, F.col("id")).withColumn("more", hashing.continued(F.col("h"), F.col("id") * 3))
    assert all(r["more"] == hashing.hash_py(7, r["id"], 3 * r["id"]) for r in rows.collect())
    placed = batching.places(spark.range(200).withColumnRenamed("id", "key"), "key", 7, 1, F.col("key")).orderBy("pos").collect()
    assert [r["pos"] for r in placed] == list(range(200))
    assert [r["key"] for r in placed] == sorted(range(200), key=lambda i: (hashing.hash_py(7, 1, i), i))
    assert batching.places(spark.range(0), "id", 7, F.col("id")).collect() == []
