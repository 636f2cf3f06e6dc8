"""Graphs stored once: edges in buckets by dst, sorted, so that samples and sums move the frontier and never the edges; and
the chunks that a partitioned graph has.

A vertex with more than `most` in-edges is a hub: its in-list is cut by a hash of src into so many salts that each has
about `most`. Buckets are by (dst, salt), so a hub is spread over them, whatever share of the edges it has."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopflow.operators.partition import owned_edges
from hopflow.sources.scratch import folder, written

#: In-edges that one salt of a vertex has, in the mean, at most.
MOST = 1 << 16
#: Tasks over which a chunk is dealt when it is written.
SLICES = 8


@dataclass
class StoredGraph:
    """edges (src, dst, salt) in buckets; hubs (dst, salts), at most one row for each `most` edges."""

    edges: DataFrame
    hubs: DataFrame
    buckets: int

    def frontier(self, rows: DataFrame, dst: str = "dst") -> DataFrame:
        """rows with column salt: once for each salt that the in-list of their dst has."""
        with_ = rows.join(self.hubs.withColumnRenamed("dst", dst), dst, "left")
        return with_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def in_edges(frontier: DataFrame, edges: DataFrame | StoredGraph) -> DataFrame:
    """frontier (dst, ...) joined with its in-edges: (dst, ..., src). Of a stored graph only the frontier is shuffled."""
    if isinstance(edges, StoredGraph):
        # Merge: a broadcast frontier would be sent to every task.
        return edges.frontier(frontier).hint("merge").join(edges.edges, ["dst", "salt"]).drop("salt")
    return frontier.join(edges.select("src", "dst"), "dst")


def hubs_of(edges: DataFrame, most: int = MOST) -> DataFrame:
    """(dst, salts) of the vertices with more than `most` in-edges."""
    counts = edges.groupBy("dst").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    return counts.select("dst", F.ceil(F.col("n") / most).cast("int").alias("salts"))


def salted(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """(src, dst, salt): edges of hubs are dealt over the hub's salts by a hash of src, all others have salt 0."""
    with_ = edges.select("src", "dst").join(hubs, "dst", "left")
    return with_.select("src", "dst", F.coalesce(F.pmod(F.xxhash64("src"), F.col("salts")), F.lit(0)).cast("int").alias("salt"))


def save_graph(edges: DataFrame, path: str, buckets: int | None = None, most: int = MOST) -> StoredGraph:
    """Writes edges (src, dst), null ends left out, below path, and opens them: one file for each bucket.

    Edges are read twice, to find the hubs and to deal them, and so they are written as they come before that."""
    spark = edges.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = written(edges.select("src", "dst").dropna(), "edges")
    hubs_of(edges, most).write.parquet(f"{path}/hubs")
    rows = salted(edges, spark.read.schema("dst long, salts int").parquet(f"{path}/hubs"))
    name = _name()
    dealt = rows.repartition(buckets, "dst", "salt")
    dealt.write.format("parquet").option("path", f"{path}/edges").bucketBy(buckets, "dst", "salt").sortBy("dst", "salt", "src").saveAsTable(name)
    about = json.dumps({"buckets": buckets, "most": most})
    spark.range(1).select(F.lit(about).alias("value")).write.text(f"{path}/about")
    return StoredGraph(spark.table(name), spark.read.schema("dst long, salts int").parquet(f"{path}/hubs"), buckets)


def open_graph(spark: SparkSession, path: str) -> StoredGraph:
    """A graph that save_graph has written, in this session or another."""
    about, name = json.loads(spark.read.text(f"{path}/about").agg(F.max("value")).first()[0]), _name()
    spark.sql(f"CREATE TABLE {name} (src BIGINT, dst BIGINT, salt INT) USING parquet CLUSTERED BY (dst, salt) SORTED BY (dst, salt, src) INTO {about['buckets']} BUCKETS LOCATION '{path}/edges'")
    return StoredGraph(spark.table(name), spark.read.schema("dst long, salts int").parquet(f"{path}/hubs"), about["buckets"])


def stored(edges: DataFrame, buckets: int | None = None, most: int = MOST) -> StoredGraph:
    """The edges as a stored graph in the scratch folder."""
    return save_graph(edges, folder(edges.sparkSession, "graph"), buckets, most)


def _name() -> str:
    return f"hopflow_graph_{uuid.uuid4().hex[:12]}"


def save_chunks(edges: DataFrame, ranges: list[tuple[int, int, int]], path: str) -> None:
    """Edges below path by the part of their dst and, in it, by the part of their src, sorted by (dst, src)."""
    owned = owned_edges(edges, ranges)
    dealt = owned.repartition("part", "src_part", F.pmod(F.xxhash64("dst"), F.lit(SLICES)))
    dealt.sortWithinPartitions("part", "src_part", "dst", "src").write.partitionBy("part", "src_part").parquet(path)


def load_chunks(spark: SparkSession, path: str, part: int | None = None, src_part: int | None = None) -> DataFrame:
    """(src, dst, part, src_part) of saved chunks: all, those of a part, or one; only their folders are read."""
    rows = spark.read.schema("src long, dst long, part int, src_part int").parquet(path)
    for column, wanted in (("part", part), ("src_part", src_part)):
        rows = rows if wanted is None else rows.filter(F.col(column) == wanted)
    return rows
