"""Graph views over the test tables: vertices from `embeddings`, edges from `lineitem`."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopflow.operators import layout, model, prepare
from hopflow.operators.layout import StoredGraph

WIDTH = 64
TRAIN, EVAL = 0.65, 0.10


class Graph:
    """The views of one data folder. num_vertices is a job parameter; here it is the row count of a table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.n = self.table("embeddings").count()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def raw(self) -> DataFrame:
        return self.table("lineitem").select((F.col("l_orderkey") % self.n).alias("src"), (F.col("l_partkey") % self.n).alias("dst"))

    def edges(self) -> DataFrame:
        return prepare.prepare_graph(self.raw(), self.n)

    def hub(self) -> DataFrame:
        """edges() and five hubs. Duplicates are dropped once, behind both."""
        loops = [self.vertices().select(F.col("id").alias("src"), end.alias("dst")) for end in (F.col("id"), F.col("id") % 5)]
        return prepare.dedup_edges(prepare.add_reverse_edges(self.raw()).unionByName(loops[0]).unionByName(loops[1]))

    @cached_property
    def kept(self) -> StoredGraph:
        """The edges of edges(), written once in buckets."""
        return layout.stored(self.edges(), most=1024)

    @cached_property
    def stored(self) -> StoredGraph:
        """The edges of hub(), written once in buckets; a vertex of over 1024 in-edges has its list cut."""
        return layout.stored(self.hub(), most=1024)

    def vertices(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"))

    def features(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))

    def labels(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))

    def masks(self) -> DataFrame:
        train, eval_ = int(self.n * TRAIN), int(self.n * EVAL)
        return self.vertices().select("id", F.when(F.col("id") < train, 0).when(F.col("id") < train + eval_, 1).otherwise(2).alias("mask"))

    def seeds(self) -> DataFrame:
        return self.masks().filter("mask = 0").select("id")

    def scores(self, classes: int = 10) -> DataFrame:
        """Class scores of every vertex: its whole vector through a fixed matrix."""
        return model.linear(self.features().select("id", F.col("features").alias("x")), model.fixed_weights(WIDTH, classes, 9), out="logits")


#: The same views for DuckDB, as the head of a WITH clause.
VIEWS = f"""
WITH n AS (SELECT count(*) AS n FROM embeddings),
v AS (SELECT vec_id AS id FROM embeddings),
raw AS (SELECT l_orderkey % (SELECT n FROM n) AS src, l_partkey % (SELECT n FROM n) AS dst FROM lineitem),
g AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM raw UNION ALL SELECT dst, src FROM raw UNION ALL SELECT id, id FROM v)),
hub AS MATERIALIZED (SELECT src, dst FROM g UNION SELECT id, id % 5 FROM v),
x AS (SELECT vec_id AS id, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings),
m AS (SELECT id, CASE WHEN id < CAST(floor((SELECT n FROM n) * {TRAIN}) AS BIGINT) THEN 0
  WHEN id < CAST(floor((SELECT n FROM n) * {TRAIN}) AS BIGINT) + CAST(floor((SELECT n FROM n) * {EVAL}) AS BIGINT) THEN 1 ELSE 2 END AS mask FROM v),
lab AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label FROM embeddings),
lg AS (SELECT id, c, sum(value * sin(31.0 * pos + c + 9) / sqrt(64.0)) AS z FROM x, (SELECT unnest(range(10)) AS c) GROUP BY ALL),
od AS (SELECT v.id, count(e.src) AS deg FROM v LEFT JOIN g e ON e.src = v.id GROUP BY v.id),
ind AS (SELECT v.id, count(e.dst) AS deg FROM v LEFT JOIN g e ON e.dst = v.id GROUP BY v.id),
w AS (SELECT g.src, g.dst, 1 / (sqrt(greatest(od.deg, 1)) * sqrt(greatest(ind.deg, 1))) AS weight
  FROM g JOIN od ON od.id = g.src JOIN ind ON ind.id = g.dst)
"""
