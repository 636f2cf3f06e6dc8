"""The registered graph queries, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopflow.functions import vectors as V
from hopflow.functions.hashing import M, hash_of, hash_sql
from hopflow.operators import batching, hotset, layout, messages, model, nodes, partition, prepare, runlogs, sampling
from hopflow.sources import edges as edge_files
from hopflow.sources import node_files
from hopflow.sources.fixtures import VIEWS, WIDTH, Graph
from hopflow.sources.scratch import folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BATCH, PIPELINE, PARTS, PAGE, FANOUTS, RATE, SEED = 64, 2, 4, 64, (5, 3), 0.2, 11
N = "(SELECT n FROM n)"


def query(sql: str | None = None, views: str = ""):
    """Registers a function of a Graph under its name; sql: what follows the common views."""

    def register(f: Callable[[Graph], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Graph(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = VIEWS + (f", {views}" if views else "") + sql
        return f

    return register


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def flat(df: DataFrame, *keys: str, vector: str = "x") -> DataFrame:
    return V.exploded(df, list(keys), vector)


R6 = "round({}, 6) + 0.0"

# 2.1 sources


@query("SELECT l_orderkey AS src, l_partkey AS dst, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS weight FROM lineitem WHERE l_linenumber % 5 <> 0")
def read_edges_text(g: Graph) -> DataFrame:
    """Text files written from lineitem: some lines with weights, some comments."""
    weight = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("  "), F.col("l_quantity").cast("string"))).otherwise("")
    line = F.concat(F.when(F.col("l_linenumber") % 5 == 0, F.lit("# ")).otherwise(" "), F.col("l_orderkey"), F.lit("\t"), F.col("l_partkey"), weight)
    return edge_files.read_edges_text(g.spark, _text(g, g.table("lineitem").select(line.alias("value"))))


@query("SELECT CAST(l_orderkey AS VARCHAR) || ' x' || CAST(l_partkey AS VARCHAR) AS value FROM lineitem WHERE l_linenumber % 3 = 0")
def bad_edge_lines(g: Graph) -> DataFrame:
    """The lines of a text file whose ends are no numbers."""
    bad = F.when(F.col("l_linenumber") % 3 == 0, " x").otherwise(" ")
    lines = g.table("lineitem").select(F.concat(F.col("l_orderkey").cast("string"), bad, F.col("l_partkey").cast("string")).alias("value"))
    return edge_files.bad_edge_lines(g.spark.read.text(_text(g, lines)))


def _text(g: Graph, lines: DataFrame) -> str:
    """The path of text files with these lines."""
    path = folder(g.spark, "lines")
    lines.select("value").write.text(path)
    return path


def _lineitem_edges(g: Graph) -> DataFrame:
    return g.table("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_extendedprice").alias("weight"))


@query("SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem")
def read_edges_binary(g: Graph) -> DataFrame:
    """Binary files written from lineitem and read back."""
    path = folder(g.spark, "edges")
    edge_files.write_edges_binary(_lineitem_edges(g), path)
    return edge_files.read_edges_binary(g.spark, path)


@query("SELECT l_orderkey AS src, l_partkey AS dst, round(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE), 3) + 0.0 AS weight FROM lineitem")
def write_edges_binary(g: Graph) -> DataFrame:
    """Binary files with the bits of a weight behind each edge."""
    path = folder(g.spark, "weighted")
    edge_files.write_edges_binary(_lineitem_edges(g), path, weighted=True)
    return rounded(edge_files.read_edges_binary(g.spark, path, weighted=True), "weight", digits=3)


def _numbers(sep: str):
    return F.array_join(F.transform("features", lambda v: v.cast("string")), sep)


@query("SELECT id, pos, round(value, 4) + 0.0 AS value FROM x")
def read_features(g: Graph) -> DataFrame:
    lines = g.features().select(F.concat_ws(" ", F.col("id").cast("string"), _numbers("  ")).alias("value"))
    return V.exploded(node_files.read_features(g.spark, _text(g, lines), WIDTH), ["id"], "features", 4)


@query("SELECT dense_rank() OVER (ORDER BY id) - 1 AS id, pos, round(value, 4) + 0.0 AS value FROM x")
def read_features_csv(g: Graph) -> DataFrame:
    """Comma lines in id order; the line number is the id."""
    lines = g.features().orderBy("id").select(_numbers(", ").alias("value"))
    return V.exploded(node_files.read_features_csv(g.spark, _text(g, lines), WIDTH), ["id"], "features", 4)


@query("SELECT id, label FROM lab")
def read_labels(g: Graph) -> DataFrame:
    return node_files.read_labels(g.spark, _text(g, g.labels().select(F.concat_ws(" ", F.col("id").cast("string"), F.col("label").cast("string")).alias("value"))))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, CAST(label AS VARCHAR) || ' ' || CAST(vec_id AS VARCHAR) AS value FROM embeddings")
def number_rows(g: Graph) -> DataFrame:
    """Headerless comma lines in id order, numbered, written with blanks between, and read again."""
    lines = g.labels().orderBy("id").select(F.concat_ws(",", F.col("label").cast("string"), F.col("id").cast("string")).alias("value"))
    target = folder(g.spark, "numbered")
    node_files.save_numbered(g.spark, _text(g, lines), target)
    t = F.split("value", " ", 2)
    return g.spark.read.text(target).select(t[0].cast("long").alias("id"), t[1].alias("value"))


@query("SELECT vec_id AS id, CASE label % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS mask FROM embeddings")
def read_mask(g: Graph) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("train", "eval", "val", "test", "other")])
    lines = g.labels().select(F.concat_ws(" ", F.col("id").cast("string"), F.element_at(words, (F.col("label") % 5 + 1).cast("int"))).alias("value"))
    return node_files.read_mask(g.spark, _text(g, lines))


@query("SELECT id, CASE WHEN label % 7 = 0 THEN 2 WHEN label % 5 = 0 THEN 1 WHEN label % 2 = 0 THEN 0 END AS mask FROM lab")
def read_split_files(g: Graph) -> DataFrame:
    """Three files of ids that overlap; the later one wins."""
    ids = lambda k: node_files.read_ids(g.spark, _text(g, g.labels().filter(F.col("label") % k == 0).select(F.col("id").cast("string").alias("value"))))
    return nodes.split_codes(ids(2), ids(5), ids(7), g.vertices())


# 2.2 preparation


@query("SELECT * FROM raw UNION ALL SELECT id, id FROM v")
def add_self_loops(g: Graph) -> DataFrame:
    return prepare.add_self_loops(g.raw(), g.n)


@query("SELECT src, dst FROM raw UNION ALL SELECT dst, src FROM raw")
def add_reverse_edges(g: Graph) -> DataFrame:
    return prepare.add_reverse_edges(g.raw())


@query("SELECT DISTINCT src, dst FROM raw")
def dedup_edges(g: Graph) -> DataFrame:
    return prepare.dedup_edges(g.raw())


@query("SELECT src, dst FROM raw ORDER BY src, dst")
def sort_edges(g: Graph) -> DataFrame:
    return prepare.sort_edges(g.raw())


@query("SELECT src, dst FROM g")
def prepare_graph(g: Graph) -> DataFrame:
    return g.edges()


@query("SELECT count(*) AS edges, greatest(max(src), max(dst)) AS max_id, greatest(max(src), max(dst)) + 1 AS vertices FROM raw")
def graph_stats(g: Graph) -> DataFrame:
    return prepare.graph_stats(g.raw())


@query("SELECT dst AS src, src AS dst FROM raw")
def transpose_graph(g: Graph) -> DataFrame:
    return prepare.transpose_graph(g.raw())


@query("SELECT id, deg AS degree FROM od")
def out_degree(g: Graph) -> DataFrame:
    return prepare.out_degree(g.edges(), g.n)


@query("SELECT id, greatest(deg, 1) AS degree FROM ind")
def in_degree(g: Graph) -> DataFrame:
    return prepare.in_degree(g.edges(), g.n, 1)


@query("SELECT v.id, count(e.id) AS degree FROM v LEFT JOIN (SELECT src AS id FROM raw UNION ALL SELECT dst FROM raw) e ON e.id = v.id GROUP BY v.id")
def undirected_degree(g: Graph) -> DataFrame:
    return prepare.undirected_degree(g.raw(), g.n)


CHUNK = 100


def _csc(key: str, other: str) -> str:
    return f"""
SELECT id, chunk, nbrs, CAST(sum(c) OVER (ORDER BY id, chunk) - c AS BIGINT) AS "offset" FROM (
  SELECT v.id, coalesce({other} // {CHUNK}, 0) AS chunk, coalesce(string_agg(CAST({other} AS VARCHAR), ',' ORDER BY {other}), '') AS nbrs, count({other}) AS c
  FROM v LEFT JOIN g ON g.{key} = v.id GROUP BY v.id, coalesce({other} // {CHUNK}, 0))"""


@query(_csc("dst", "src"))
def build_csc(g: Graph) -> DataFrame:
    return prepare.build_csc(g.edges(), g.n, CHUNK).withColumn("nbrs", F.array_join("nbrs", ","))


@query(_csc("src", "dst"))
def build_csr(g: Graph) -> DataFrame:
    return prepare.build_csr(g.edges(), g.n, CHUNK).withColumn("nbrs", F.array_join("nbrs", ","))


@query("SELECT src, dst, round(weight, 9) AS weight FROM w")
def gcn_edge_weight(g: Graph) -> DataFrame:
    return rounded(prepare.gcn_edge_weight(g.edges(), g.n), "weight", digits=9)


@query("SELECT src, dst, round(weight / count(*) OVER (PARTITION BY dst), 9) AS weight FROM w")
def mean_edge_weight(g: Graph) -> DataFrame:
    return rounded(prepare.mean_edge_weight(g.edges(), g.n), "weight", digits=9)


@query("SELECT src, dst, 1.0 / (1 + abs(src - dst)) AS weight FROM g")
def edge_weight_fn(g: Graph) -> DataFrame:
    return prepare.edge_weight_fn(g.edges(), F.lit(1.0) / (1 + F.abs(F.col("src") - F.col("dst"))))


@query("SELECT src, dst, round(sqrt(abs(src - dst)) / (1 + src % 7), 9) + 0.0 AS weight FROM g")
def edge_weight_function(g: Graph) -> DataFrame:
    """Weights by a numpy function of the ends of a batch of edges."""

    def weight(src, dst):
        import numpy as np

        return np.sqrt(np.abs(src - dst)) / (1 + src % 7)

    return rounded(prepare.edge_weight_fn(g.edges(), weight), "weight", digits=9)


# 2.3 partitioning

# The greedy cut in SQL: one recursive step for each part over the running work of pages.
RANGES = f"""pg AS (SELECT id // {PAGE} AS p, sum(deg + {12 * (PARTS + 1)}) AS w FROM od GROUP BY 1),
run AS (SELECT p, sum(w) OVER (ORDER BY p) AS c FROM pg),
cut AS (SELECT * FROM (WITH RECURSIVE k(part, lo, hi, done) AS (
  SELECT -1, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS HUGEINT)
  UNION ALL
  SELECT part + 1, hi, CASE WHEN part + 1 = {PARTS - 1} THEN (SELECT max(p) + 1 FROM run)
      ELSE (SELECT coalesce(max(p) + 1, hi) FROM run WHERE p >= hi AND c - done <= ((SELECT max(c) FROM run) - done) / ({PARTS} - part - 1.0)) END,
    CASE WHEN part + 1 = {PARTS - 1} THEN done
      ELSE (SELECT coalesce(max(c), done) FROM run WHERE p >= hi AND c - done <= ((SELECT max(c) FROM run) - done) / ({PARTS} - part - 1.0)) END
  FROM k WHERE part < {PARTS - 1}) SELECT * FROM k) WHERE part >= 0),
rg AS (SELECT part, least(lo * {PAGE}, {N}) AS lo, least(hi * {PAGE}, {N}) AS hi FROM cut),
own AS (SELECT src, dst, a.part, b.part AS src_part FROM g JOIN rg a ON dst >= a.lo AND dst < a.hi JOIN rg b ON src >= b.lo AND src < b.hi)"""


def _ranges(g: Graph) -> list[tuple[int, int, int]]:
    return partition.balanced_ranges(g.edges(), g.n, PARTS, PAGE)


@query("SELECT part, lo, hi FROM rg", RANGES)
def balanced_ranges(g: Graph) -> DataFrame:
    return g.spark.createDataFrame(_ranges(g), "part int, lo long, hi long")


@query("SELECT id, part FROM v JOIN rg ON id >= lo AND id < hi", RANGES)
def assign_partition(g: Graph) -> DataFrame:
    return partition.assign_partition(g.vertices(), _ranges(g))


@query("SELECT part, src_part, count(*) AS edges FROM own GROUP BY ALL", RANGES)
def partition_edges(g: Graph) -> DataFrame:
    return partition.partition_edges(g.edges(), _ranges(g))


def _chunks(g: Graph) -> str:
    path = folder(g.spark, "chunks")
    layout.save_chunks(g.edges(), _ranges(g), path)
    return path


@query("SELECT src, dst, part, src_part FROM own", RANGES)
def stored_chunks(g: Graph) -> DataFrame:
    """The chunks of a partitioned graph, written and read back."""
    return layout.load_chunks(g.spark, _chunks(g))


@query("SELECT src, dst, part, src_part FROM own WHERE part = 2 AND src_part = 1", RANGES)
def stored_chunk(g: Graph) -> DataFrame:
    """One chunk, from its own folder."""
    return layout.load_chunks(g.spark, _chunks(g), 2, 1)


@query("SELECT dst, count(*) AS edges, sum(src) AS sources FROM hub GROUP BY dst")
def stored_graph(g: Graph) -> DataFrame:
    """A graph written in buckets and opened again, as by another session."""
    path = folder(g.spark, "graph")
    layout.save_graph(g.hub(), path, most=256)
    return layout.open_graph(g.spark, path).edges.groupBy("dst").agg(F.count("*").alias("edges"), F.sum("src").alias("sources"))


@query("SELECT part, src, row_number() OVER (PARTITION BY part ORDER BY src) - 1 AS mirror_idx FROM (SELECT DISTINCT part, src FROM own)", RANGES)
def mirrors(g: Graph) -> DataFrame:
    return partition.mirrors(g.edges(), _ranges(g), page=100)


@query("SELECT src, string_agg(CAST(part AS VARCHAR), ',' ORDER BY part) AS parts, count(*) AS copies FROM (SELECT DISTINCT part, src FROM own) GROUP BY src", RANGES)
def mirror_presence(g: Graph) -> DataFrame:
    return partition.mirror_presence(g.edges(), _ranges(g))


@query("SELECT part, src_part, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM own GROUP BY ALL", RANGES)
def active_counts(g: Graph) -> DataFrame:
    return partition.active_counts(g.edges(), _ranges(g))


# 2.4 nodes


@query("SELECT x.id, label, mask, round(sum(value), 6) + 0.0 AS total FROM x JOIN lab USING (id) JOIN m USING (id) GROUP BY ALL")
def join_node_tables(g: Graph) -> DataFrame:
    rows = nodes.join_node_tables(g.features(), g.labels(), g.masks())
    return rounded(rows.select("id", "label", "mask", F.aggregate("features", F.lit(0.0), lambda a, b: a + b).alias("total")), "total")


@query("SELECT id, CAST(id % 3 AS INTEGER) AS mask FROM v")
def split_by_mod(g: Graph) -> DataFrame:
    return nodes.split_by_mod(g.vertices())


@query("SELECT id, mask FROM m")
def split_by_range(g: Graph) -> DataFrame:
    return nodes.split_by_range(g.vertices(), g.n)


@query(f"SELECT id, 4.0 AS total, {hash_sql(5, 'id')} % 7 AS label FROM v")
def synthetic_nodes(g: Graph) -> DataFrame:
    return nodes.synthetic_nodes(g.vertices(), 4, 7).select("id", F.aggregate("features", F.lit(0.0), lambda a, b: a + b).alias("total"), "label")


@query("SELECT id, CASE mask WHEN 0 THEN 'train' WHEN 1 THEN 'eval' ELSE 'test' END AS split FROM m")
def tag_union_splits(g: Graph) -> DataFrame:
    return nodes.tag_union_splits(*[nodes.nodes_of_split(g.masks(), k) for k in range(3)])


@query("SELECT id FROM m WHERE mask = 1")
def nodes_of_split(g: Graph) -> DataFrame:
    return nodes.nodes_of_split(g.masks(), 1)


# 2.5 batching

SHUFFLED = f"""sh AS (SELECT id, row_number() OVER (ORDER BY {hash_sql(SEED, 'id')}, id) - 1 AS pos FROM m WHERE mask = 0),
bt AS (SELECT id, pos, pos // {BATCH} AS batch, pos // {BATCH * PIPELINE} AS super_batch FROM sh), tot AS (SELECT count(*) AS t FROM sh)"""


def _shuffled(g: Graph) -> DataFrame:
    return batching.shuffle_nodes(g.seeds(), SEED)


def _batches(g: Graph) -> DataFrame:
    return batching.make_batches(_shuffled(g), BATCH, PIPELINE)


@query("SELECT id, pos FROM sh", SHUFFLED)
def shuffle_nodes(g: Graph) -> DataFrame:
    return _shuffled(g)


@query("SELECT id, pos, batch, super_batch FROM bt", SHUFFLED)
def make_batches(g: Graph) -> DataFrame:
    return _batches(g)


LOCAL = SHUFFLED + f""", sb AS (SELECT id, pos, pos // {BATCH} AS sb FROM sh), whole AS (SELECT t // {BATCH} AS k FROM tot),
pl AS (SELECT i AS sb, row_number() OVER (ORDER BY {hash_sql(SEED, 1, 'i')}, i) - 1 AS place FROM (SELECT unnest(range((SELECT k FROM whole))) AS i))"""


@query(f"""SELECT id, place * {BATCH} + row_number() OVER (PARTITION BY sb.sb ORDER BY {hash_sql(SEED, 2, 'id')}, id) - 1 AS pos FROM sb JOIN pl ON pl.sb = sb.sb
UNION ALL SELECT id, pos FROM sb WHERE sb >= (SELECT k FROM whole)""", LOCAL)  # fmt: skip
def local_shuffle(g: Graph) -> DataFrame:
    return batching.local_shuffle(_shuffled(g), BATCH, g.seeds().count(), SEED)


@query(f"""SELECT batch, least(o // sz, 2) AS worker, id FROM (SELECT id, batch, pos - batch * {BATCH} AS o,
  greatest(least({BATCH}, t - batch * {BATCH}), 3) // 3 AS sz FROM bt, tot)""", SHUFFLED)  # fmt: skip
def split_batch_across_workers(g: Graph) -> DataFrame:
    return batching.split_batch_across_workers(_batches(g), BATCH, g.seeds().count(), 3)


@query("SELECT id, pos FROM sh WHERE pos % 50 < 20", SHUFFLED)
def strided_batches(g: Graph) -> DataFrame:
    return batching.strided_batches(_shuffled(g), 20, 50)


# 2.6 sampling


def _sample(frontier: str, edges: str, fanout: int, layer: int, name: str) -> str:
    return f"""{name} AS (SELECT batch, {layer} AS layer, dst, src FROM (
  SELECT batch, f.dst, e.src, row_number() OVER (PARTITION BY batch, f.dst ORDER BY {hash_sql(SEED, layer, 'batch', 'f.dst', 'e.src')}, e.src) AS r
  FROM {frontier} f JOIN {edges} e ON e.dst = f.dst) WHERE r <= {fanout})"""


KHOP = f"""{SHUFFLED}, f0 AS (SELECT batch, id AS dst FROM bt), {_sample('f0', 'hub', FANOUTS[0], 0, 's0')},
f1 AS (SELECT DISTINCT batch, src AS dst FROM s0), {_sample('f1', 'hub', FANOUTS[1], 1, 's1')},
bk AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1),
hd AS (SELECT v.id, count(e.src) AS o, (SELECT count(*) FROM hub h WHERE h.dst = v.id) AS i FROM v LEFT JOIN hub e ON e.src = v.id GROUP BY v.id),
bw AS (SELECT batch, layer, dst, src, 1 / (sqrt(greatest(a.o, 1)) * sqrt(greatest(b.i, 1))) AS weight FROM bk JOIN hd a ON a.id = src JOIN hd b ON b.id = dst)"""


def _block(g: Graph) -> DataFrame:
    return sampling.sample_khop(_batches(g).select("batch", "id"), g.stored, list(FANOUTS), SEED)


def _weighted_block(g: Graph, kind: str = "sum", denominator: str = "sampled") -> DataFrame:
    edges = g.stored.edges
    return sampling.sampled_weights(written(_block(g), "block"), prepare.out_degree(edges, g.n), prepare.in_degree(edges, g.n), kind, denominator)


@query("SELECT id, least(deg, 3) AS size FROM ind")
def sample_sizes(g: Graph) -> DataFrame:
    return sampling.sample_sizes(prepare.in_degree(g.edges(), g.n), 3)


@query("SELECT * FROM s0", KHOP)
def sample_neighbors(g: Graph) -> DataFrame:
    return sampling.sample_neighbors(_batches(g).select("batch", F.col("id").alias("dst")), g.stored, FANOUTS[0], 0, SEED)


@query("SELECT * FROM bk", KHOP)
def sample_khop(g: Graph) -> DataFrame:
    return _block(g)


@query("SELECT * FROM s0 UNION ALL SELECT * FROM s2", f"{KHOP}, f2 AS (SELECT batch, dst FROM f1 UNION SELECT batch, dst FROM f0), {_sample('f2', 'hub', FANOUTS[1], 1, 's2')}")
def sample_khop_merged(g: Graph) -> DataFrame:
    return sampling.sample_khop(_batches(g).select("batch", "id"), g.stored, list(FANOUTS), SEED, merge=True)


@query("""SELECT batch, 0 AS layer, f0.dst, src FROM f0 JOIN g ON g.dst = f0.dst
UNION ALL SELECT DISTINCT f.batch, 1, f.dst, g.src FROM (SELECT DISTINCT batch, src AS dst FROM f0 JOIN g ON g.dst = f0.dst) f JOIN g ON g.dst = f.dst""", KHOP)  # fmt: skip
def all_neighbors(g: Graph) -> DataFrame:
    return sampling.sample_khop(_batches(g).select("batch", "id"), g.kept, [-1, -1], SEED)


@query("SELECT * FROM s0 UNION ALL SELECT * FROM s1 WHERE dst % 3 <> 0", KHOP)
def sample_khop_omit_hot(g: Graph) -> DataFrame:
    batches = _batches(g)
    omit = _block(g).filter("layer = 0 and src % 3 = 0").select("batch", F.col("src").alias("id")).distinct()
    return sampling.sample_khop(batches.select("batch", "id"), g.stored, list(FANOUTS), SEED, omit=omit)


@query("""SELECT batch, layer, dst, src, dense_rank() OVER (PARTITION BY batch, layer ORDER BY src) - 1 AS src_local,
  dense_rank() OVER (PARTITION BY batch, layer ORDER BY dst) - 1 AS dst_local FROM bk""", KHOP)  # fmt: skip
def relabel_block(g: Graph) -> DataFrame:
    return sampling.relabel_block(_block(g))


@query("""SELECT batch, layer, dst, count(*) AS "count", CAST(sum(count(*)) OVER (PARTITION BY batch, layer ORDER BY dst) - count(*) AS BIGINT) AS column_offset
FROM bk GROUP BY batch, layer, dst""", KHOP)  # fmt: skip
def block_offsets(g: Graph) -> DataFrame:
    return sampling.block_offsets(_block(g))


@query("SELECT batch, layer, src, count(*) AS degree FROM bk GROUP BY ALL", KHOP)
def sampled_degrees(g: Graph) -> DataFrame:
    return sampling.sampled_degrees(_block(g), "src")


@query("""SELECT t.batch, 1 AS layer, t.dst, CASE WHEN count(b.src) = 0 THEN 3 ELSE count(b.src) END AS degree
FROM f1 t LEFT JOIN s1 b ON b.batch = t.batch AND b.dst = t.dst AND b.dst % 3 <> 0 GROUP BY ALL""", KHOP)  # fmt: skip
def sampled_degrees_hot(g: Graph) -> DataFrame:
    targets = _block(g).filter("layer = 0").select("batch", F.lit(1).alias("layer"), F.col("src").alias("dst")).distinct()
    return sampling.sampled_degrees_hot(sample_khop_omit_hot(g).filter("layer = 1"), targets, FANOUTS[1])


@query("SELECT batch, layer, dst, src, round(weight / count(*) OVER (PARTITION BY batch, layer, dst), 9) AS weight FROM bw", KHOP)
def sampled_weights(g: Graph) -> DataFrame:
    return rounded(_weighted_block(g, "mean"), "weight", digits=9)


@query("SELECT batch, layer, dst, src, round(weight / greatest(i, 1), 9) AS weight FROM bw JOIN hd ON hd.id = dst", KHOP)
def sampled_weights_global(g: Graph) -> DataFrame:
    """Means divided by the in-degree in the whole graph."""
    return rounded(_weighted_block(g, "mean", "global"), "weight", digits=9)


@query("SELECT batch, layer, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM bk GROUP BY ALL", KHOP)
def block_stats(g: Graph) -> DataFrame:
    return sampling.block_stats(_block(g))


# 2.7 hot set

HOT = f"""{KHOP}, c0 AS (SELECT super_batch, id, 1 AS c FROM bt),
c1 AS (SELECT super_batch, src AS id, sum(c) AS c FROM c0 JOIN g ON g.dst = c0.id GROUP BY ALL),
c2 AS (SELECT super_batch, src AS id, CAST(sum(c) AS BIGINT) AS "count" FROM c1 JOIN g ON g.dst = c1.id GROUP BY ALL),
rk AS (SELECT super_batch, id, "count", row_number() OVER (PARTITION BY super_batch ORDER BY "count" DESC, id) - 1 AS slot, count(*) OVER (PARTITION BY super_batch) AS k FROM c2),
hot AS (SELECT super_batch, slot, id, "count" FROM rk WHERE slot < CAST(floor((k + 1) * {RATE}) AS BIGINT)),
need AS (SELECT DISTINCT b.super_batch, s.src AS id FROM s0 s JOIN (SELECT DISTINCT batch, super_batch FROM bt) b USING (batch)),
fl AS (SELECT need.super_batch, need.id, hot.id IS NOT NULL AS hit FROM need LEFT JOIN hot ON hot.super_batch = need.super_batch AND hot.id = need.id)"""


def _counts(g: Graph) -> DataFrame:
    return hotset.hop_counts(_batches(g).select("super_batch", "id"), g.kept, 2)


def _hot(g: Graph) -> DataFrame:
    return hotset.presample_hot(_counts(g), RATE)


def _need(g: Graph) -> DataFrame:
    first = sampling.sample_neighbors(_batches(g).select("batch", F.col("id").alias("dst")), g.stored, FANOUTS[0], 0, SEED)
    return first.select(F.floor(F.col("batch") / PIPELINE).alias("super_batch"), F.col("src").alias("id")).distinct()


@query(f"SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) - 1 AS slot FROM (SELECT id, deg AS degree FROM od ORDER BY deg DESC, id LIMIT CAST(floor({N} * {RATE}) AS BIGINT))")
def hot_by_degree(g: Graph) -> DataFrame:
    return hotset.hot_by_degree(prepare.out_degree(g.edges(), g.n), g.n, RATE)


@query('SELECT super_batch, id, "count" FROM c2', HOT)
def hop_counts(g: Graph) -> DataFrame:
    return _counts(g)


@query('SELECT super_batch, slot, id, "count" FROM hot', HOT)
def presample_hot(g: Graph) -> DataFrame:
    return _hot(g)


@query('SELECT super_batch, slot, id, "count" FROM rk WHERE slot < 40', HOT)
def presample_hot_fixed(g: Graph) -> DataFrame:
    return hotset.presample_hot_fixed(_counts(g), 40)


def _saved(g: Graph) -> DataFrame:
    path = folder(g.spark, "hot")
    hotset.save_hot_set(_hot(g), path)
    return g.spark.read.parquet(path)


@query("SELECT super_batch, slot, id FROM hot", HOT)
def save_hot_set(g: Graph) -> DataFrame:
    return _saved(g).select(F.col("super_batch").cast("long").alias("super_batch"), "slot", "id")


@query("SELECT super_batch, slot, id FROM (SELECT *, count(*) OVER (PARTITION BY super_batch) AS c FROM hot) WHERE slot < CAST(floor(c * 0.5) AS BIGINT)", HOT)
def load_hot_set(g: Graph) -> DataFrame:
    return hotset.load_hot_set(_saved(g), 0.5).select(F.col("super_batch").cast("long").alias("super_batch"), "slot", "id")


@query("SELECT id, super_batch, slot FROM hot", HOT)
def cache_index(g: Graph) -> DataFrame:
    return _hot(g).select("id", "super_batch", "slot")


@query("SELECT super_batch, id, hit FROM fl", HOT)
def split_hits_misses(g: Graph) -> DataFrame:
    return hotset.split_hits_misses(_need(g), _hot(g))


@query("SELECT count(*) AS lookups, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS hits, CAST(sum(CAST(NOT hit AS INT)) AS BIGINT) AS transferred FROM fl", HOT)
def cache_hit_rate(g: Graph) -> DataFrame:
    return hotset.cache_hit_rate(hotset.split_hits_misses(_need(g), _hot(g)))


@query("SELECT super_batch, count(*) AS transferred FROM fl WHERE NOT hit GROUP BY 1", HOT)
def transferred_vertices(g: Graph) -> DataFrame:
    return hotset.split_hits_misses(_need(g), _hot(g)).filter(~F.col("hit")).groupBy("super_batch").agg(F.count("*").alias("transferred"))


GATHERED = "SELECT super_batch, id, pos, round(value, 6) + 0.0 AS value FROM need JOIN x USING (id)"


@query(GATHERED, HOT)
def gather_features(g: Graph) -> DataFrame:
    return flat(hotset.gather_features(_need(g), g.features()), "super_batch", "id", vector="features")


@query(GATHERED, HOT)
def gather_features_cached(g: Graph) -> DataFrame:
    hot = hotset.hot_by_degree(prepare.out_degree(g.edges(), g.n), g.n, RATE)
    return flat(hotset.gather_features_cached(_need(g), g.features(), hot), "super_batch", "id", vector="features")


@query("SELECT batch, bt.id, label FROM bt JOIN lab USING (id)", SHUFFLED)
def gather_labels(g: Graph) -> DataFrame:
    return _batches(g).select("batch", "id").join(g.labels(), "id")


@query("SELECT pos, part, sh.id, label FROM sh JOIN rg ON sh.id >= lo AND sh.id < hi JOIN lab ON lab.id = sh.id", f"{SHUFFLED}, {RANGES}")
def gather_by_partition(g: Graph) -> DataFrame:
    return partition.assign_partition(_shuffled(g), _ranges(g)).join(g.labels(), "id").orderBy("part", "pos")


@query("""SELECT need.super_batch, need.id, x.pos, CASE WHEN hit THEN round(x.value * 2, 6) ELSE round(x.value, 6) END + 0.0 AS value,
  CASE WHEN hit THEN round(x.value * 3, 6) ELSE round(ag.value, 6) END + 0.0 AS aggregate
FROM need JOIN fl USING (super_batch, id) JOIN x ON x.id = need.id
JOIN (SELECT dst AS id, pos, sum(weight * value) AS value FROM w JOIN x ON x.id = src GROUP BY ALL) ag ON ag.id = need.id AND ag.pos = x.pos""", HOT)  # fmt: skip
def override_hot_embeddings(g: Graph) -> DataFrame:
    """Vectors and the sums over their in-edges, both taken from the hot set where it has them."""
    sums = messages.gcn_aggregate(prepare.gcn_edge_weight(g.edges(), g.n), _x(g), WIDTH).withColumnRenamed("x", "aggregate")
    rows = hotset.gather_features(_need(g), g.features()).join(sums, "id")
    ready = _hot(g).select("super_batch", "id").join(g.features(), "id")
    ready = ready.select("super_batch", "id", F.transform("features", lambda v: v * 2).alias("features"), F.transform("features", lambda v: v * 3).alias("aggregate"))
    done = hotset.override_hot_embeddings(rows, ready, ("features", "aggregate"))
    pairs = done.select("super_batch", "id", F.posexplode(F.arrays_zip("features", "aggregate")).alias("pos", "p"))
    return rounded(pairs.select("super_batch", "id", "pos", F.col("p.features").alias("value"), F.col("p.aggregate").alias("aggregate")), "value", "aggregate")


@query("SELECT user_id AS id, version, value FROM (SELECT user_id, epoch_us(ts) // 1000 AS version, value, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, value DESC) AS r FROM events) WHERE r = 1")
def merge_newest(g: Graph) -> DataFrame:
    return hotset.merge_newest(g.table("events").select(F.col("user_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("version"), "value"))


def _gradients(g: Graph) -> DataFrame:
    """A gradient vector for each edge of the blocks: that of its dst."""
    rows = _block(g).select(F.floor(F.col("batch") / PIPELINE).alias("super_batch"), "batch", "layer", F.col("dst").alias("id"), "src")
    return rows.join(_x(g), "id")


GROUPED = "(SELECT DISTINCT batch, super_batch FROM bt)"


@query(f"SELECT super_batch, slot, pos, round(sum(value), 6) + 0.0 AS value FROM bk JOIN {GROUPED} USING (batch) JOIN hot USING (super_batch) JOIN x ON x.id = bk.dst WHERE hot.id = bk.dst GROUP BY ALL", HOT)
def accumulate_hot_gradients(g: Graph) -> DataFrame:
    return flat(hotset.accumulate_hot_gradients(_gradients(g), _hot(g), WIDTH), "super_batch", "slot")


@query(f"""SELECT bk.batch, layer, bk.dst AS id, src, CASE WHEN hot.id IS NULL THEN round(mark, 5) ELSE 0 END + 0.0 AS mark
FROM bk JOIN {GROUPED} b ON b.batch = bk.batch JOIN (SELECT id, sum(value * (pos + 1)) AS mark FROM x GROUP BY id) y ON y.id = bk.dst
LEFT JOIN hot ON hot.super_batch = b.super_batch AND hot.id = bk.dst""", HOT)  # fmt: skip
def zero_hot_gradients(g: Graph) -> DataFrame:
    """The local gradients after that: zero for cached ids."""
    return marked(hotset.zero_hot_gradients(_gradients(g), _hot(g), WIDTH), "batch", "layer", "id", "src")


@query(f"SELECT count(*) AS edges, round(sum(weight), 6) AS total, round(avg(weight), 9) AS mean FROM w WHERE dst IN (SELECT id FROM od ORDER BY deg DESC, id LIMIT CAST(floor({N} * {RATE}) AS BIGINT))")
def hot_edge_weight_avg(g: Graph) -> DataFrame:
    out = hotset.hot_edge_weight_avg(prepare.gcn_edge_weight(g.edges(), g.n), hotset.hot_by_degree(prepare.out_degree(g.edges(), g.n), g.n, RATE))
    return rounded(rounded(out, "total"), "mean", digits=9)


@query(f"""SELECT super_batch, slot, id, least(slot // greatest(c // 3, 1), 2) AS worker FROM (SELECT super_batch, slot, id, count(*) OVER (PARTITION BY super_batch) AS c FROM hot)""", HOT)
def hot_slices_per_worker(g: Graph) -> DataFrame:
    return batching.hot_slices_per_worker(_hot(g).select("super_batch", "slot", "id"), 3)


@query(f"""SELECT coalesce(place, super_batch) AS super_batch, slot, hot.id FROM hot LEFT JOIN
(SELECT i, row_number() OVER (ORDER BY {hash_sql(SEED, 1, 'i')}, i) - 1 AS place FROM (SELECT unnest(range((SELECT t // {BATCH * PIPELINE} FROM tot))) AS i)) ON i = super_batch""", HOT)  # fmt: skip
def local_shuffle_with_hot(g: Graph) -> DataFrame:
    return batching.move_hot_lists(_hot(g).select("super_batch", "slot", "id"), g.seeds().count() // (BATCH * PIPELINE), SEED)


# 2.8 message passing


def _x(g: Graph) -> DataFrame:
    return g.features().select("id", F.col("features").alias("x"))


#: Edge rows hold whole vectors; the query gives one number for each, in which every element counts differently.
MARK = "round(sum(value * (pos + 1)), 5) + 0.0 AS mark"


def marked(edge_rows: DataFrame, *keys: str) -> DataFrame:
    steps = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return rounded(edge_rows.select(*(keys or ("src", "dst")), steps.alias("mark")), "mark", digits=5)


@query(f"SELECT src, dst, {MARK} FROM hub JOIN x ON x.id = src GROUP BY ALL")
def scatter_src(g: Graph) -> DataFrame:
    return marked(messages.scatter_src(g.hub(), _x(g)))


@query(f"SELECT src, dst, {MARK} FROM hub JOIN x ON x.id = dst GROUP BY ALL")
def scatter_dst(g: Graph) -> DataFrame:
    return marked(messages.scatter_dst(g.hub(), _x(g)))


@query(f"SELECT src, dst, {MARK} FROM (SELECT src, dst, pos, value FROM hub JOIN x ON x.id = src UNION ALL SELECT src, dst, pos + 64, value FROM hub JOIN x ON x.id = dst) GROUP BY ALL")
def scatter_src_dst(g: Graph) -> DataFrame:
    return marked(messages.scatter_src_dst(g.hub(), _x(g)))


@query("SELECT id, pos, round(sum(value), 5) + 0.0 AS value FROM (SELECT src AS id, pos, value FROM hub JOIN x ON x.id = src UNION ALL SELECT dst, pos, value FROM hub JOIN x ON x.id = dst) GROUP BY ALL")
def scatter_src_dst_backward(g: Graph) -> DataFrame:
    """The halves of edge gradients added up at both ends."""
    return V.exploded(messages.scatter_src_dst_backward(messages.scatter_src_dst(g.hub(), _x(g)), WIDTH), ["id"], "x", 5)


@query("SELECT dst, pos, round(sum(value), 6) + 0.0 AS value FROM g JOIN x ON x.id = src GROUP BY ALL")
def aggregate_dst_sum(g: Graph) -> DataFrame:
    return flat(messages.aggregate_dst_sum(messages.scatter_src(g.edges(), _x(g)), WIDTH), "dst")


@query(f"SELECT src, dst, {MARK} FROM g JOIN x ON x.id = dst GROUP BY ALL")
def aggregate_dst_sum_backward(g: Graph) -> DataFrame:
    return marked(messages.aggregate_dst_sum_backward(g.edges(), _x(g)))


def _extreme(order: str) -> str:
    return f"SELECT dst, pos, value, src FROM (SELECT dst, pos, value, src, row_number() OVER (PARTITION BY dst, pos ORDER BY value {order}, src) AS r FROM g JOIN x ON x.id = src) WHERE r = 1"


@query(_extreme("DESC"))
def aggregate_dst_max(g: Graph) -> DataFrame:
    return messages.aggregate_dst_extreme(messages.scatter_src(g.edges(), _x(g)), WIDTH)


@query(_extreme("ASC"))
def aggregate_dst_min(g: Graph) -> DataFrame:
    return messages.aggregate_dst_extreme(messages.scatter_src(g.edges(), _x(g)), WIDTH, largest=False)


@query(f"SELECT src, w.dst, w.pos, x.value FROM ({_extreme('DESC')}) w JOIN x ON x.id = w.dst AND x.pos = w.pos")
def aggregate_dst_max_backward(g: Graph) -> DataFrame:
    return messages.aggregate_dst_extreme_backward(aggregate_dst_max(g), _x(g))


@query("SELECT dst AS id, pos, round(sum(weight * value), 6) + 0.0 AS value FROM w JOIN x ON x.id = src GROUP BY ALL")
def gcn_aggregate(g: Graph) -> DataFrame:
    return flat(messages.gcn_aggregate(prepare.gcn_edge_weight(g.edges(), g.n), _x(g), WIDTH), "id")


WIDE = 10


@query(f"""SELECT id, 64 * k + pos AS pos, round(v * (k + 1), 5) + 0.0 AS value FROM (SELECT dst AS id, pos, sum(weight * value) AS v FROM w JOIN x ON x.id = src GROUP BY ALL),
(SELECT unnest(range({WIDE})) AS k)""")  # fmt: skip
def gcn_aggregate_wide(g: Graph) -> DataFrame:
    """Vectors of 640 numbers: those of the table once, twice, up to ten times as large."""
    wide = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(WIDE)), lambda k: F.transform("x", lambda v: v * k)))
    rows = _x(g).select("id", wide.alias("x"))
    weighted = prepare.gcn_edge_weight(written(g.edges(), "edges"), g.n)
    return V.exploded(messages.gcn_aggregate(weighted, rows, WIDE * WIDTH), ["id"], "x", 5)


@query("SELECT src AS id, pos, round(sum(weight * value), 6) + 0.0 AS value FROM w JOIN x ON x.id = dst GROUP BY ALL")
def gcn_aggregate_backward(g: Graph) -> DataFrame:
    return flat(messages.gcn_aggregate_backward(prepare.gcn_edge_weight(g.edges(), g.n), _x(g), WIDTH), "id")


@query("SELECT batch, layer, dst, pos, round(sum(weight * value), 6) + 0.0 AS value FROM bw JOIN x ON x.id = src GROUP BY ALL", KHOP)
def block_aggregate(g: Graph) -> DataFrame:
    return flat(messages.block_aggregate(_weighted_block(g), _x(g), WIDTH), "batch", "layer", "dst")


@query("SELECT batch, layer, src, pos, round(sum(weight * value), 6) + 0.0 AS value FROM bw JOIN x ON x.id = dst GROUP BY ALL", KHOP)
def block_aggregate_backward(g: Graph) -> DataFrame:
    block = _weighted_block(g)
    grads = block.select("batch", "layer", "dst").distinct().join(_x(g).withColumnRenamed("id", "dst"), "dst")
    return flat(messages.block_aggregate_backward(block, grads, WIDTH), "batch", "layer", "src")


@query("SELECT batch, layer, dst, pos, round(sum(weight * value) / count(*), 6) + 0.0 AS value FROM bw JOIN x ON x.id = src GROUP BY ALL", KHOP)
def mean_aggregate(g: Graph) -> DataFrame:
    return flat(messages.block_aggregate(_weighted_block(g, "mean"), _x(g), WIDTH), "batch", "layer", "dst")


@query("SELECT dst AS id, pos, round(sum(value), 6) + 0.0 AS value FROM hub JOIN x ON x.id = src GROUP BY ALL")
def unweighted_aggregate(g: Graph) -> DataFrame:
    return flat(messages.unweighted_aggregate(g.hub(), _x(g), WIDTH), "id")


@query(f"""SELECT super_batch, p.dst, pos, round(sum(value), 6) + 0.0 AS value FROM p JOIN x ON x.id = p.src GROUP BY ALL""",
       f"{HOT}, hf AS (SELECT super_batch AS batch, id AS dst FROM hot), {_sample('hf', 'g', FANOUTS[0], 0, 'p0')}, p AS (SELECT batch AS super_batch, dst, src FROM p0)")
def pushdown_hot_aggregate(g: Graph) -> DataFrame:
    """One layer computed once for the hot ids of each super-batch."""
    frontier = _hot(g).select(F.col("super_batch").alias("batch"), F.col("id").alias("dst"))
    block = sampling.sample_neighbors(frontier, g.kept, FANOUTS[0], 0, SEED).withColumn("weight", F.lit(1.0))
    return flat(messages.block_aggregate(block, _x(g), WIDTH).withColumnRenamed("batch", "super_batch"), "super_batch", "dst")


@query("SELECT dst AS id, pos, round(sum(weight * value), 6) + 0.0 AS value FROM w JOIN x ON x.id = src WHERE dst % 3 <> 0 GROUP BY ALL")
def aggregate_skip_hot(g: Graph) -> DataFrame:
    return flat(messages.aggregate_skip(prepare.gcn_edge_weight(g.edges(), g.n), _x(g), WIDTH, g.vertices().filter("id % 3 = 0")), "id")


@query("SELECT part, o.src AS id, pos, round(value, 6) + 0.0 AS value FROM (SELECT DISTINCT part, src FROM own) o JOIN x ON x.id = o.src", RANGES)
def fetch_dep_neighbors(g: Graph) -> DataFrame:
    return flat(messages.fetch_dep_neighbors(partition.mirrors(g.edges(), _ranges(g)), _x(g)), "part", "id")


SCORES = f"sc AS (SELECT src, dst, ({hash_sql(4, 'src', 'dst')} % 20001 - 10000) / 10.0 AS score FROM hub), sm AS (SELECT src, dst, e / sum(e) OVER (PARTITION BY dst) AS a FROM (SELECT src, dst, exp(score - max(score) OVER (PARTITION BY dst)) AS e FROM sc))"


def _softmax(g: Graph) -> DataFrame:
    return messages.edge_softmax(g.hub().withColumn("score", (hash_of(4, F.col("src"), F.col("dst")) % 20001 - 10000) / 10.0))


@query("SELECT src, dst, round(a, 9) + 0.0 AS a FROM sm", SCORES)
def edge_softmax(g: Graph) -> DataFrame:
    return rounded(_softmax(g).select("src", "dst", "a"), "a", digits=9)


@query("SELECT src, dst, round(a * g - a * sum(a * g) OVER (PARTITION BY dst), 9) + 0.0 AS gs FROM (SELECT src, dst, a, (src % 7 - 3) / 4.0 AS g FROM sm)", SCORES)
def edge_softmax_backward(g: Graph) -> DataFrame:
    rows = _softmax(g).withColumn("g", (F.col("src") % 7 - 3) / 4.0)
    return rounded(messages.edge_softmax_backward(rows).select("src", "dst", "gs"), "gs", digits=9)


HEADS = f"""hs AS (SELECT src, dst, k, ({hash_sql(4, 'src', 'dst', 'k')} % 20001 - 10000) / 1000.0 AS score FROM hub, (SELECT unnest(range(4)) AS k)),
ha AS (SELECT src, dst, k, e / sum(e) OVER (PARTITION BY dst, k) AS a FROM (SELECT src, dst, k, exp(score - max(score) OVER (PARTITION BY dst, k)) AS e FROM hs))"""


def _heads(g: Graph) -> DataFrame:
    score = F.array(*[(hash_of(4, F.col("src"), F.col("dst"), k) % 20001 - 10000) / 1000.0 for k in range(4)])
    return messages.edge_softmax(g.hub().withColumn("score", score), heads=4)


@query("SELECT src, dst, k, round(a, 9) + 0.0 AS a, round(a * g - a * sum(a * g) OVER (PARTITION BY dst, k), 9) + 0.0 AS gs FROM (SELECT src, dst, k, a, (src % 7 - 3 + k) / 4.0 AS g FROM ha)", HEADS)
def edge_softmax_heads(g: Graph) -> DataFrame:
    """Scores in four columns, forward and backward."""
    grads = F.array(*[(F.col("src") % 7 - 3 + k) / 4.0 for k in range(4)])
    rows = messages.edge_softmax_backward(_heads(g).withColumn("g", grads), heads=4)
    flat_ = rows.select("src", "dst", F.posexplode(F.arrays_zip("a", "gs")).alias("k", "p")).select("src", "dst", "k", F.col("p.a").alias("a"), F.col("p.gs").alias("gs"))
    return rounded(flat_, "a", "gs", digits=9)


# 2.9 models and metrics. Weights are sin(31 i + j + salt) / sqrt(rows).


def _matrix(rows: int, salt: int) -> str:
    return f"sin(31.0 * {{i}} + {{j}} + {salt}) / sqrt({rows}.0)"


LAYER1 = f"""h0 AS (SELECT id, j, sum(value * {_matrix(64, 0).format(i='pos', j='j')}) AS v FROM x, (SELECT unnest(range(8)) AS j) GROUP BY ALL),
h1 AS (SELECT dst AS id, j, greatest(sum(weight * v), 0) AS v FROM w JOIN h0 ON h0.id = src GROUP BY ALL),
z1 AS (SELECT id, c, sum(v * {_matrix(8, 1).format(i='h1.j', j='c')}) AS v FROM h1, (SELECT unnest(range(5)) AS c) GROUP BY ALL),
z2 AS (SELECT dst AS id, c, sum(weight * v) AS v FROM w JOIN z1 ON z1.id = src GROUP BY ALL)"""


def _gcn(g: Graph) -> DataFrame:
    return model.gcn_infer(prepare.gcn_edge_weight(g.edges(), g.n), g.features(), model._layers([WIDTH, 8, 5]))


@query("SELECT id, c AS pos, round(v - ln(sum(exp(v)) OVER (PARTITION BY id)), 6) + 0.0 AS value FROM z2", LAYER1)
def gcn_infer(g: Graph) -> DataFrame:
    return flat(_gcn(g), "id", vector="logp")


@query("SELECT id, round(sqrt(sum(value * value)), 6) + 0.0 AS value FROM x GROUP BY id")
def vertex_map(g: Graph) -> DataFrame:
    """The length of each vector, by an expression."""
    return rounded(model.vertex_map(_x(g), F.sqrt(V.dot(F.col("x"), F.col("x"))), "value").select("id", "value"), "value")


@query("SELECT x.id, x.pos, round(x.value * ag.value + (x.pos % 3), 6) + 0.0 AS value FROM x JOIN (SELECT dst AS id, pos, sum(value) AS value FROM g JOIN x ON x.id = src GROUP BY ALL) ag ON ag.id = x.id AND ag.pos = x.pos")
def vertex_map_two(g: Graph) -> DataFrame:
    """A numpy function of two inputs: a vertex's vector and the sum over its in-edges."""

    def both(x, y):
        import numpy as np

        return x * y + np.arange(x.shape[1]) % 3

    return flat(model.vertex_map(_x(g), both, second=messages.unweighted_aggregate(g.edges(), _x(g), WIDTH)), "id")


@query("SELECT src, dst, round(spread + src % 5, 6) + 0.0 AS value FROM g JOIN (SELECT id, max(value) - min(value) AS spread FROM x GROUP BY id) y ON y.id = src")
def edge_map_function(g: Graph) -> DataFrame:
    """A numpy function of edge rows: the spread of the vector and an end."""
    spread = lambda x, src: x.max(axis=1) - x.min(axis=1) + src % 5
    rows = messages.edge_map(messages.scatter_src(g.edges(), _x(g)), spread, "value", ["x", "src"], "double")
    return rounded(rows.select("src", "dst", "value"), "value")


@query("SELECT src, dst, round(sum(value * value) * 3 - 1, 6) AS value FROM g JOIN x ON x.id = src GROUP BY ALL")
def edge_map(g: Graph) -> DataFrame:
    return rounded(messages.edge_map(messages.scatter_src(g.edges(), _x(g)), V.dot(F.col("x"), F.col("x")) * 3 - 1, "value").select("src", "dst", "value"), "value")


@query("SELECT dst, max(src - before) AS widest, count(*) AS edges FROM (SELECT dst, src, lag(src, 1, src) OVER (PARTITION BY dst ORDER BY src) AS before FROM g) GROUP BY dst")
def grouped_dst_map(g: Graph) -> DataFrame:
    """Of each dst the widest gap between sources: a function of its in-edges in order."""


    def update(state, rows):
        import numpy as np

        src = rows.column(rows.schema.get_field_index("src")).to_numpy()
        mine = {"first": int(src[0]), "last": int(src[-1]), "widest": int(np.diff(src, prepend=src[0]).max()), "edges": len(src)}
        return mine if state is None else merge(state, mine)

    def merge(a, b):
        return {"first": a["first"], "last": b["last"], "widest": max(a["widest"], b["widest"], b["first"] - a["last"]), "edges": a["edges"] + b["edges"]}

    def finish(dst, state):
        return {"dst": dst, "widest": state["widest"], "edges": state["edges"]}

    return model.grouped_dst_map(g.edges(), update, merge, finish, "first long, last long, widest long, edges long", "dst long, widest long, edges long")


@query("SELECT round(sum(value * value), 6) AS total FROM x WHERE id % 2 = 0")
def vertex_reduce(g: Graph) -> DataFrame:
    return rounded(model.vertex_reduce(_x(g), F.col("id") % 2 == 0, V.dot(F.col("x"), F.col("x"))), "total")


@query(f"SELECT id, j AS pos, round(sum(value * {_matrix(64, 0).format(i='pos', j='j')}), 6) + 0.0 AS value FROM x, (SELECT unnest(range(8)) AS j) GROUP BY ALL")
def linear(g: Graph) -> DataFrame:
    return flat(model.linear(_x(g), model.fixed_weights(WIDTH, 8)), "id")


@query("SELECT id, pos, round(greatest(value, 0), 6) + 0.0 AS value FROM x")
def relu(g: Graph) -> DataFrame:
    return flat(_x(g).withColumn("x", V.relu(F.col("x"))), "id")


@query("SELECT id, pos, round(CASE WHEN value > 0 THEN value ELSE value * 0.2 END, 6) + 0.0 AS value FROM x")
def leaky_relu(g: Graph) -> DataFrame:
    return flat(_x(g).withColumn("x", V.leaky_relu(F.col("x"), 0.2)), "id")


@query(f"SELECT id, pos, round(CASE WHEN {hash_sql(0, 'id', 'pos')} >= {int(0.3 * M)} THEN value / (1 - 0.3) ELSE 0 END, 6) + 0.0 AS value FROM x")
def dropout(g: Graph) -> DataFrame:
    return flat(model.dropout(_x(g), 0.3), "id")


@query("SELECT id, c AS pos, round(z - ln(sum(exp(z)) OVER (PARTITION BY id)), 6) + 0.0 AS value FROM lg")
def log_softmax(g: Graph) -> DataFrame:
    return flat(g.scores().select("id", V.log_softmax(F.col("logits")).alias("x")), "id")


@query("SELECT round(avg(-(l.z - s)), 9) AS loss FROM lab JOIN lg l ON l.id = lab.id AND l.c = label JOIN (SELECT id, ln(sum(exp(z))) AS s FROM lg GROUP BY id) t ON t.id = lab.id")
def nll_loss(g: Graph) -> DataFrame:
    return rounded(model.nll_loss(g.scores().join(g.labels(), "id").select(V.log_softmax(F.col("logits")).alias("logp"), "label")), "loss", digits=9)


PREDICTED = "pr AS (SELECT id, c AS predicted FROM (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY z DESC, c) AS r FROM lg) WHERE r = 1)"


def _predicted(g: Graph) -> DataFrame:
    return model.predict(g.scores(), "logits").select("id", "predicted")


@query("SELECT id, predicted FROM pr", PREDICTED)
def predict(g: Graph) -> DataFrame:
    return _predicted(g)


@query("""SELECT k AS mask, count(id) FILTER (predicted = label) AS correct, count(id) AS total,
  CASE WHEN count(id) > 0 THEN round(count(id) FILTER (predicted = label) / count(id), 9) ELSE 0 END AS accuracy
FROM (SELECT CAST(unnest(range(3)) AS INT) AS k) LEFT JOIN (SELECT id, predicted, label, mask FROM pr JOIN lab USING (id) JOIN m USING (id)) ON mask = k GROUP BY k""", PREDICTED)  # fmt: skip
def accuracy_by_mask(g: Graph) -> DataFrame:
    return rounded(model.accuracy_by_mask(_predicted(g), g.masks(), g.labels()), "accuracy", digits=9)


@query("SELECT CAST(sum(CAST(predicted = label AS INT)) AS BIGINT) AS correct, count(*) AS seeds, round(sum(CAST(predicted = label AS INT)) / count(*), 9) AS accuracy FROM bt JOIN pr USING (id) JOIN lab USING (id)", f"{SHUFFLED}, {PREDICTED}")
def accuracy_minibatch(g: Graph) -> DataFrame:
    rows = _batches(g).select("batch", "id").join(_predicted(g), "id").join(g.labels(), "id")
    return rounded(model.accuracy_minibatch(rows), "accuracy", digits=9)


@query("SELECT a.pos AS i, b.pos AS j, round(sum(a.value * b.value), 5) + 0.0 AS v FROM x a JOIN x b USING (id) GROUP BY ALL")
def gradient_sum(g: Graph) -> DataFrame:
    total = model.gradient_sum(g.features().select(F.col("features").alias("x"), F.col("features").alias("g")))
    cells = [(i, j, float(total[i, j])) for i in range(total.shape[0]) for j in range(total.shape[1])]
    return rounded(g.spark.createDataFrame(cells, "i int, j int, v double"), "v", digits=5)


def _attention(width: int, out: int, salt: int):
    w = model.fixed_weights(width, out, salt)
    left, right = (model.fixed_weights(out, 1, salt + k) for k in (10, 20))
    return w, [r[0] for r in left], [r[0] for r in right]


GAT = f"""h0 AS (SELECT id, j, sum(value * {_matrix(64, 0).format(i='pos', j='j')}) AS v FROM x, (SELECT unnest(range(6)) AS j) GROUP BY ALL),
en AS (SELECT id, sum(v * {_matrix(6, 10).format(i='j', j='0')}) AS l, sum(v * {_matrix(6, 20).format(i='j', j='0')}) AS r FROM h0 GROUP BY id),
ss AS (SELECT src, dst, CASE WHEN a.l + b.r > 0 THEN a.l + b.r ELSE (a.l + b.r) * 0.2 END AS s FROM g JOIN en a ON a.id = src JOIN en b ON b.id = dst),
al AS (SELECT src, dst, e / sum(e) OVER (PARTITION BY dst) AS a FROM (SELECT src, dst, exp(s - max(s) OVER (PARTITION BY dst)) AS e FROM ss))"""


@query("SELECT dst AS id, j AS pos, round(greatest(sum(a * v), 0), 6) + 0.0 AS value FROM al JOIN h0 ON h0.id = src GROUP BY ALL", GAT)
def gat_layer(g: Graph) -> DataFrame:
    return flat(model.gat_layer(g.edges(), _x(g), *_attention(WIDTH, 6, 0)), "id")


GAT2 = GAT + f""", x1 AS (SELECT dst AS id, j AS pos, greatest(sum(a * v), 0) AS value FROM al JOIN h0 ON h0.id = src GROUP BY ALL),
k0 AS (SELECT id, j, sum(value * {_matrix(6, 1).format(i='pos', j='j')}) AS v FROM x1, (SELECT unnest(range(5)) AS j) GROUP BY ALL),
en2 AS (SELECT id, sum(v * {_matrix(5, 11).format(i='j', j='0')}) AS l, sum(v * {_matrix(5, 21).format(i='j', j='0')}) AS r FROM k0 GROUP BY id),
s2 AS (SELECT src, dst, CASE WHEN a.l + b.r > 0 THEN a.l + b.r ELSE (a.l + b.r) * 0.2 END AS s FROM g JOIN en2 a ON a.id = src JOIN en2 b ON b.id = dst),
al2 AS (SELECT src, dst, e / sum(e) OVER (PARTITION BY dst) AS a FROM (SELECT src, dst, exp(s - max(s) OVER (PARTITION BY dst)) AS e FROM s2)),
x2 AS (SELECT dst AS id, j, greatest(sum(a * v), 0) AS v FROM al2 JOIN k0 ON k0.id = src GROUP BY ALL)"""


@query("SELECT id, j AS pos, round(v - ln(sum(exp(v)) OVER (PARTITION BY id)), 6) + 0.0 AS value FROM x2", GAT2)
def gat_infer(g: Graph) -> DataFrame:
    return flat(model.gat_infer(g.edges(), g.features(), [_attention(WIDTH, 6, 0), _attention(6, 5, 1)]), "id", vector="logp")


@query("SELECT id, c AS pos, round(v - ln(sum(exp(v)) OVER (PARTITION BY id)), 6) + 0.0 AS value FROM z2", "mw AS (SELECT src, dst, weight / count(*) OVER (PARTITION BY dst) AS weight FROM w), " + LAYER1.replace("FROM w JOIN", "FROM mw JOIN"))
def sage_infer(g: Graph) -> DataFrame:
    return flat(model.gcn_infer(prepare.mean_edge_weight(g.edges(), g.n), g.features(), model._layers([WIDTH, 8, 5])), "id", vector="logp")


@query(
    "SELECT (id * 31 + pos) % 4 AS part, pos, id, round(w - 0.05 * nm / (1 - 0.9 * 0.9 * 0.9) / (sqrt(nv / (1 - pow(0.999, 3))) + 1e-9), 6) + 0.0 AS w, round(nm, 9) + 0.0 AS m, round(nv, 9) + 0.0 AS v, "
    "round(w - 0.05 * nm / (sqrt(nv) + 1e-9), 6) + 0.0 AS plain FROM au",
    "au AS (SELECT id, pos, value AS w, 0.9 * (value * 0.1) + 0.1 * (pos / 64.0 - value + 0.001 * value) AS nm, 0.999 * (value * value * 0.2) + 0.001 * (pos / 64.0 - value + 0.001 * value) * (pos / 64.0 - value + 0.001 * value) AS nv FROM x)",
)
def adam_update(g: Graph) -> DataFrame:
    """Every number of the vectors is a parameter with its own state; with and without the correction of the bias."""
    rows = g.features().select("id", F.posexplode("features").alias("pos", "w"))
    state = rows.select("id", "pos", ((F.col("id") * 31 + F.col("pos")) % 4).alias("part"), "w", (F.col("w") * 0.1).alias("m"), (F.col("w") * F.col("w") * 0.2).alias("v"), (F.col("pos") / 64.0 - F.col("w")).alias("g"))
    done = model.adam_update(state, 3, 0.05, 0.001)
    plain = model.adam_update(state, 3, 0.05, 0.001, bias_correction=False).select("id", "pos", F.col("w").alias("plain"))
    return rounded(rounded(done.join(plain, ["id", "pos"]), "w", "plain"), "m", "v", digits=9)


TRAIN = f"""{KHOP}, a0 AS (SELECT batch, dst AS id, pos, sum(weight * value) AS v FROM bw JOIN x ON x.id = src WHERE layer = 1 GROUP BY ALL),
hd0 AS (SELECT batch, id, j, greatest(sum(v * {_matrix(64, 0).format(i='pos', j='j')}), 0) AS v FROM a0, (SELECT unnest(range(8)) AS j) GROUP BY ALL),
a1 AS (SELECT bw.batch, dst AS id, j, sum(weight * v) AS v FROM bw JOIN hd0 ON hd0.batch = bw.batch AND hd0.id = src WHERE layer = 0 GROUP BY ALL),
z AS (SELECT batch, id, c, sum(v * {_matrix(8, 1).format(i='a1.j', j='c')}) AS v FROM a1, (SELECT unnest(range(10)) AS c) GROUP BY ALL),
lp AS (SELECT batch, id, c, v - ln(sum(exp(v)) OVER (PARTITION BY batch, id)) AS lp FROM z)"""


@query(f"SELECT round(-avg(lp), 9) AS loss FROM lp JOIN lab ON lab.id = lp.id AND lab.label = c WHERE batch < {PIPELINE}", TRAIN)
def first_loss(g: Graph) -> DataFrame:
    """The loss of the first step of an epoch: the forward pass over sampled blocks."""
    return rounded(g.spark.createDataFrame(_epoch(g, 1), "super_batch long, loss double").select("loss"), "loss", digits=9)


def _epoch(g: Graph, steps: int | None = None) -> list[tuple[int, float]]:
    import numpy as np

    layers = [model.Adam(np.asarray(w)) for w in model._layers([WIDTH, 8, 10])]
    batches = _batches(g) if steps is None else _batches(g).filter(F.col("super_batch") < steps)
    return model.train_epoch(batches, g.stored, g.n, g.features(), g.labels(), layers, list(FANOUTS), seed=SEED)


def _adam_sql(k: int, layer: int) -> str:
    """The matrix and its state after step k (from 0), by its gradient."""
    m, v, t = "(0.9 * p.m + 0.1 * coalesce(d.v, 0))", "(0.999 * p.s + 0.001 * coalesce(d.v, 0) * coalesce(d.v, 0))", k + 1
    w = f"p.v - 0.01 * ({m} / (1 - pow(0.9, {t}))) / (sqrt({v} / (1 - pow(0.999, {t}))) + 1e-9)"
    return f"w{layer}_{t} AS MATERIALIZED (SELECT p.i, p.j, {w} AS v, {m} AS m, {v} AS s FROM w{layer}_{k} p LEFT JOIN d{layer}_{k} d ON d.i = p.i AND d.j = p.j)"


def _step_sql(k: int, outer: str, inner: str, truth: str = "lab") -> str:
    """A step of training unrolled: forward, loss, backward and update. outer: the sums of raw features (batch, id, pos,
    v) that the step reads; inner: its edges (batch, src, dst, weight); truth: the labels of its seeds."""
    return f"""
z_{k} AS MATERIALIZED (SELECT batch, id, w.j, sum(a0.v * w.v) AS v FROM {outer} a0 JOIN w0_{k} w ON w.i = a0.pos GROUP BY ALL),
e_{k} AS MATERIALIZED ({inner}),
a1_{k} AS MATERIALIZED (SELECT e.batch, dst AS id, j, sum(weight * greatest(z.v, 0)) AS v FROM e_{k} e JOIN z_{k} z ON z.batch = e.batch AND z.id = e.src GROUP BY ALL),
y_{k} AS MATERIALIZED (SELECT batch, id, w.j AS c, sum(a.v * w.v) AS v FROM a1_{k} a JOIN w1_{k} w ON w.i = a.j GROUP BY ALL),
l_{k} AS MATERIALIZED (SELECT y.batch, y.id, c, label, v - ln(sum(exp(v)) OVER (PARTITION BY y.batch, y.id)) AS lp FROM y_{k} y JOIN {truth} lab ON lab.id = y.id),
g_{k} AS MATERIALIZED (SELECT batch, id, c, (exp(lp) - CAST(c = label AS INT)) / (SELECT count(*) FROM l_{k} WHERE c = label) AS v FROM l_{k}),
b_{k} AS MATERIALIZED (SELECT batch, id, w.i, sum(g.v * w.v) AS v FROM g_{k} g JOIN w1_{k} w ON w.j = g.c GROUP BY ALL),
i_{k} AS MATERIALIZED (SELECT e.batch, src AS id, i, sum(weight * b.v) AS v FROM e_{k} e JOIN b_{k} b ON b.batch = e.batch AND b.id = e.dst GROUP BY ALL),
d1_{k} AS MATERIALIZED (SELECT a.j AS i, g.c AS j, sum(a.v * g.v) AS v FROM a1_{k} a JOIN g_{k} g USING (batch, id) GROUP BY ALL),
d0_{k} AS MATERIALIZED (SELECT a.pos AS i, z.j, sum(a.v * n.v) AS v FROM z_{k} z JOIN i_{k} n ON n.batch = z.batch AND n.id = z.id AND n.i = z.j AND z.v > 0 JOIN {outer} a ON a.batch = z.batch AND a.id = z.id GROUP BY ALL),
{_adam_sql(k, 0)}, {_adam_sql(k, 1)}"""


def _batch_step_sql(k: int) -> str:
    """The step over the batches of super-batch k."""
    return _step_sql(k, f"(SELECT * FROM a0s WHERE super_batch = {k})", f"SELECT bw.* FROM bw JOIN {GROUPED} b ON b.batch = bw.batch AND b.super_batch = {k} WHERE layer = 0")


START = f"""w0_0 AS MATERIALIZED (SELECT i, j, {_matrix(64, 0).format(i='i', j='j')} AS v, 0.0 AS m, 0.0 AS s FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(8)) AS j)),
w1_0 AS MATERIALIZED (SELECT i, j, {_matrix(8, 1).format(i='i', j='j')} AS v, 0.0 AS m, 0.0 AS s FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(10)) AS j))"""
#: Steps that the SQL of an epoch is unrolled to; the tables of up to sf0.1 have no more.
STEPS = 12
EPOCH = f"""{KHOP}, a0s AS MATERIALIZED (SELECT super_batch, bw.batch, dst AS id, pos, sum(weight * value) AS v FROM bw JOIN x ON x.id = src JOIN {GROUPED} b ON b.batch = bw.batch WHERE layer = 1 GROUP BY ALL),
{START},{','.join(map(_batch_step_sql, range(STEPS)))}"""


@query(" UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS super_batch, round(-avg(lp), 6) AS loss FROM l_{k} WHERE c = label HAVING count(*) > 0" for k in range(STEPS)), EPOCH)
def train_epoch(g: Graph) -> DataFrame:
    """The losses of the steps of an epoch."""
    return rounded(g.spark.createDataFrame(_epoch(g), "super_batch long, loss double"), "loss")


WHOLE = f"""a0s AS MATERIALIZED (SELECT 0 AS batch, dst AS id, pos, sum(weight * value) AS v FROM w JOIN x ON x.id = src GROUP BY ALL),
{START},{','.join(_step_sql(k, 'a0s', 'SELECT 0 AS batch, src, dst, weight FROM w', '(SELECT lab.* FROM lab JOIN m ON m.id = lab.id WHERE mask = 0)') for k in range(2))}"""


@query(" UNION ALL ".join(f"SELECT {k} AS epoch, round(-avg(lp), 6) AS loss FROM l_{k} WHERE c = label" for k in range(2)), WHOLE)
def full_batch_step(g: Graph) -> DataFrame:
    """The losses of two steps on the whole graph."""
    import numpy as np

    layers = [model.Adam(np.asarray(w)) for w in model._layers([WIDTH, 8, 10])]
    weighted = written(prepare.gcn_edge_weight(written(g.edges(), "edges"), g.n), "weighted")
    sums = written(model.full_batch_sums(weighted, g.features(), WIDTH), "sums")
    losses = [(k, float(model.full_batch_step(weighted, g.features(), g.labels(), g.seeds(), layers, sums=sums))) for k in range(2)]
    return rounded(g.spark.createDataFrame(losses, "epoch int, loss double"), "loss")


# 2.10 run logs, over the events table

USAGE = "us AS (SELECT CAST(user_id AS VARCHAR) AS name, value AS rate, epoch_us(ts) // 1000 AS ts FROM events), mid AS (SELECT (min(ts) + max(ts)) // 2 AS t FROM us)"


def _usage(g: Graph) -> DataFrame:
    return g.table("events").select(F.col("user_id").cast("string").alias("name"), F.col("value").alias("rate"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"))


def _middle(g: Graph) -> int:
    r = _usage(g).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return (r["a"] + r["b"]) // 2


@query('SELECT name, round(avg(rate), 6) AS rate, count(*) AS "rows" FROM us, mid WHERE ts > t - 3600000 - 500 AND ts < t + 3600000 + 500 GROUP BY name', USAGE)
def cpu_usage(g: Graph) -> DataFrame:
    t = _middle(g)
    return rounded(runlogs.cpu_usage(_usage(g), t - 3600000, t + 3600000), "rate")


@query('SELECT round(avg(floor(rate)), 6) AS rate, count(*) AS "rows" FROM us, mid WHERE ts BETWEEN t - 3600000 - 500 AND t + 3600000 + 500', USAGE)
def gpu_usage(g: Graph) -> DataFrame:
    t = _middle(g)
    rows = _usage(g).withColumn("rate", F.concat(F.floor("rate").cast("string"), F.lit("%")))
    return rounded(runlogs.gpu_usage(rows, t - 3600000, t + 3600000), "rate")


@query("SELECT name, rate, ts FROM us WHERE length(name) < 9", USAGE)
def parse_cpu_log(g: Graph) -> DataFrame:
    u = _usage(g)
    line = F.concat_ws(" ", F.lit(" "), "name", F.lit("root 20 0 1g 2m 3k S"), F.col("rate").cast("string"), F.lit("0.1 0:01 python"), F.col("ts").cast("string"))
    return runlogs.parse_cpu_log(u.select(line.alias("value")).unionByName(u.limit(1).select(F.lit("short").alias("value"))))


@query("SELECT CAST(CAST(floor(rate) AS BIGINT) AS VARCHAR) || '%' AS rate, ts FROM us", USAGE)
def parse_gpu_log(g: Graph) -> DataFrame:
    line = F.concat_ws(" ", F.lit("| 30C P0 |"), F.concat(F.floor("rate").cast("string"), F.lit("%")), F.lit("Default |"), F.col("ts").cast("string"))
    return runlogs.parse_gpu_log(_usage(g).select(line.alias("value")))


@query("SELECT CAST(o_orderkey AS INT) AS epoch, o_totalprice AS seconds, o_custkey / 8.0 AS loss, 0.5 AS accuracy, o_custkey AS correct, o_orderkey AS total FROM orders")
def parse_train_log(g: Graph) -> DataFrame:
    o = g.table("orders")
    first = F.concat(F.lit("Epoch["), F.col("o_orderkey"), F.lit("]:Times["), F.col("o_totalprice").cast("string"), F.lit("(s)]:loss\t"), (F.col("o_custkey") / 8.0).cast("string"))
    second = F.concat(F.lit("epoch "), F.col("o_orderkey"), F.lit(" Train Acc: 0.5 "), F.col("o_custkey"), F.lit(" "), F.col("o_orderkey"))
    return runlogs.parse_train_log(o.select(F.explode(F.array(first, second, F.lit("other line"))).alias("value")))


@query("SELECT CAST(o_custkey AS VARCHAR) AS run, 'run_time' AS name, o_totalprice AS value FROM orders UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'average epoch time', CAST(o_orderkey AS DOUBLE) FROM orders")
def parse_metrics(g: Graph) -> DataFrame:
    return runlogs.parse_metrics(_metric_lines(g))


def _metric_lines(g: Graph) -> DataFrame:
    lines = F.array(F.concat(F.lit("#run_time="), F.col("o_totalprice").cast("string"), F.lit(" (s)")), F.concat(F.lit("average epoch time: "), F.col("o_orderkey"), F.lit(" (s)")), F.lit("no metric here"))
    return g.table("orders").select(F.col("o_custkey").cast("string").alias("run"), F.explode(lines).alias("value"))


@query("SELECT 'gcn_' || CAST(o_custkey AS VARCHAR) || '_cache_push' AS run, CAST(max(o_orderkey) AS DOUBLE) AS seconds FROM orders GROUP BY 1")
def epoch_time_table(g: Graph) -> DataFrame:
    """Run folders with a log each, written and read. Runs have names of four parts, of which the last comes second."""
    path = folder(g.spark, "runs")
    lines = _metric_lines(g).select(F.concat(F.lit("gcn_cache_push_"), F.col("run")).alias("run"), "value")
    _save_runs(g.spark, lines, path)
    return runlogs.epoch_time_table(runlogs.parse_metrics(runlogs.read_runs(g.spark, path, "*.txt")))


def _save_runs(spark: SparkSession, lines: DataFrame, path: str) -> None:
    """Log lines (run, value) as text files in a folder for each run."""
    lines.repartition("run").write.partitionBy("run").text(path)
