"""Binary edges as a data source, line numbers, bad lines, run folders."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopflow.operators import runlogs
from hopflow.sources import edges as E
from hopflow.sources import node_files
from hopflow.sources.scratch import written_by


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_binary_round_trip_with_weights(spark, tmp_path):
    rows = [(i, 2**32 - 1 - i, i / 4) for i in range(1000)]
    df = spark.createDataFrame([(w, d, s) for s, d, w in rows], "weight double, dst long, src long").repartition(3)
    E.write_edges_binary(df, str(tmp_path / "w"), weighted=True)
    back = E.read_edges_binary(spark, str(tmp_path / "w"), weighted=True)
    assert got(back) == rows and back.columns == ["src", "dst", "weight"]


@pytest.mark.parametrize("split", [8, 24, 1000, 1 << 20])
def test_spans_are_whole_records(spark, tmp_path, split):
    E.write_edges_binary(spark.range(5000).select(F.col("id").alias("src"), (F.col("id") * 3).alias("dst")).repartition(2), str(tmp_path / "e"))
    n = 5000 if split > 500 else 60
    if n < 5000:
        E.write_edges_binary(spark.range(n).select(F.col("id").alias("src"), (F.col("id") * 3).alias("dst")).repartition(2), str(tmp_path / "e"), mode="overwrite")
    df = spark.read.format("edges").option("split", split).load(str(tmp_path / "e"))
    assert got(df) == [(i, 3 * i) for i in range(n)]
    assert df.rdd.getNumPartitions() >= n * 8 // max(split, 8) // 2


def test_append_and_overwrite(spark, tmp_path):
    path, one = str(tmp_path / "e"), lambda a: spark.createDataFrame([(a, a + 1)], "src long, dst long")
    E.write_edges_binary(one(1), path)
    E.write_edges_binary(one(5), path)
    assert got(E.read_edges_binary(spark, path)) == [(1, 2), (5, 6)]
    E.write_edges_binary(one(9), path, mode="overwrite")
    assert got(E.read_edges_binary(spark, path)) == [(9, 10)] and len(list((tmp_path / "e").glob("*.bin"))) == 1
    E.write_edges_binary(one(9).limit(0), path, mode="overwrite")
    assert got(E.read_edges_binary(spark, path)) == [] and not list((tmp_path / "e").glob("*.bin"))


def test_a_failed_write_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "e")
    E.write_edges_binary(spark.createDataFrame([(1, 2)], "src long, dst long"), path)
    for bad in ((1 << 32, 0), (-1, 0), (None, 3)):
        rows = spark.createDataFrame([(k, k) for k in range(50)] + [bad], "src long, dst long").repartition(4)
        with pytest.raises(Exception, match="32 bits|no src"):
            E.write_edges_binary(rows, path)
        assert got(E.read_edges_binary(spark, path)) == [(1, 2)]


def test_foreign_files(spark, tmp_path):
    """Without a list of files all are read; a part of a record is an error; a file outside the list is not read."""
    (tmp_path / "a.bin").write_bytes(np.asarray([[1, 2], [3, 4]], "<u4").tobytes())
    (tmp_path / "_ignored").write_bytes(b"x")
    assert got(E.read_edges_binary(spark, str(tmp_path))) == [(1, 2), (3, 4)]
    (tmp_path / "b.bin").write_bytes(b"123456789")
    with pytest.raises(Exception, match="whole number of records"):
        E.read_edges_binary(spark, str(tmp_path)).collect()
    (tmp_path / E.COMMITTED).write_text(json.dumps(["a.bin"]))
    assert got(E.read_edges_binary(spark, f"file://{tmp_path}")) == [(1, 2), (3, 4)]


def test_bad_lines(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# c\n1 2\nx y\n5\n 7 8 z\n")
    path = str(tmp_path / "e.txt")
    assert got(E.read_edges_text(spark, path)) == sorted([(1, 2, None), (7, 8, None)])
    assert got(E.bad_edge_lines(spark.read.text(path))) == [("5",), ("x y",)]
    with pytest.raises(Exception, match="no edge: "):
        E.read_edges_text(spark, path, bad_lines="fail").collect()
    with pytest.raises(ValueError):
        E.read_edges_text(spark, path, bad_lines="ignore")


def test_line_numbers_are_the_same_for_any_split(spark, tmp_path):
    rng, lines = np.random.default_rng(2), []
    for k in range(4):
        mine = [f"{k}:{i}:" + "x" * int(rng.integers(0, 90)) for i in range(0 if k == 2 else 400)]
        (tmp_path / f"part-{k}.csv").write_text("".join(f"{x}\n" for x in mine))
        lines += mine
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size, cost in (("128m", "4m"), ("1000b", "1b"), ("7000b", "100b")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            df = node_files.number_lines(spark, str(tmp_path))
            assert [r["value"] for r in df.orderBy("id").collect()] == lines
            assert got(df.select("id")) == [(i,) for i in range(len(lines))]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_run_folders(spark, tmp_path):
    for run, seconds in (("gcn_cache_push_cora", 0.5), ("gat_all_gpu_x y", 2.0)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "output.log").write_text(f"#run_time=4.2 (s)\naverage epoch time: {seconds}\n")
        (tmp_path / run / "other.txt").write_text("average epoch time: 99\n")
    runs = runlogs.read_runs(spark, str(tmp_path))
    assert got(runlogs.epoch_time_table(runlogs.parse_metrics(runs))) == [("gat_x y_all_gpu", 2.0), ("gcn_cora_cache_push", 0.5)]


def test_folders_by_value(spark):
    df = spark.createDataFrame([(k, i, str(i)) for k in (3, 5) for i in range(40)], "super_batch long, id long, v string")
    t = written_by(df, "t", "super_batch", "id")
    assert t.values == {3, 5} and got(t.of(5)) == sorted((i, str(i)) for i in range(40))
    assert all("/super_batch=5/" in f for f in t.of(5).inputFiles())
    assert written_by(df.limit(0), "t", "super_batch", "id").values == set()
