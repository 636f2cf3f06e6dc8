"""Near-duplicate texts by SimHash and anchor points, checked by exact Jaccard similarity.

The set of a text's word shingles (five words) gives 320 bits: eight blocks of 26 bits that are looked up at the anchors
of a covering code, and 64 further bits. Two texts with similarity 0.8 differ in about 15 % of the bits; they meet where
one of the eight blocks differs in at most 1 bit, mostly also in 2, and are candidates if at most CHECK of the further
bits differ. Each candidate link is then decided by the Jaccard similarity of the whole shingle sets.

Bits miss a pair with some probability, which falls with the similarity: of random pairs 0.97 are found at 0.8, 0.99 at
0.85, all at 0.9. A text has 22 anchors in the mean for each block, so rows grow with the texts; at N texts with nothing
in common, N * N / 2**11 pairs of bits meet by chance and 1 in 2500 of them is checked in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflow.llm.common import hot_keys, maybe_in, salted_join, written
from hopflow.llm.components import components
from hopflow.llm.simhash import Code, dealt, link_at_anchors, shingle_hashes, spread
from hopflow.operators.ranking import in_order

WIDTH, SIMILARITY = 5, 0.8
CODE, BLOCKS = Code(4, 11), 8
#: Bits of the last 64 in which candidates differ at most: 3 standard deviations above the mean at similarity 0.8.
CHECK = 18
_STEPS = (np.arange(1, 6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
_NAMES = ["low", "high", "w0", "w1", "w2", "w3", "bits"]


def _scattered(h: np.ndarray) -> np.ndarray:
    """Five independent words for each hash."""
    x = h[:, None] + _STEPS
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Two sums that tell shingle sets apart, then five words of bits; each bit is set if it is in over half of the set."""
    shingles = np.unique(shingle_hashes(text, width))
    ones, sums, n = np.zeros(320, np.int64), np.zeros(5, np.uint64), len(shingles)
    for at in range(0, n, 8192):
        words = _scattered(shingles[at : at + 8192])
        sums += words.sum(axis=0, dtype=np.uint64)
        bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), 40), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return np.concatenate([sums[:2], np.packbits(2 * ones > n).view(">u8").astype(np.uint64)])


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Of rows (row, text): row, low, high (equal for equal shingle sets), w0 .. w3, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.stack([sketch(t.as_py() or b"", width) for t in batch.column(1)]) if batch.num_rows else np.empty((0, 7), np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(found[:, k]).view(np.int64)) for k in range(7)]], names=["row", *_NAMES])

    return docs.select("row", F.col("text").cast("binary")).mapInArrow(run, "row long, " + ", ".join(f"{c} long" for c in _NAMES))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the distinct hashes of the shingles of rows (node, text), by their lower 32 bits, which takes some
    one in four billion pairs of shingles for equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [np.unique(shingle_hashes(t.as_py() or b"", width).astype(np.uint32)).view(np.int32) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["node", "shingles"])

    return docs.select("node", F.col("text").cast("binary")).mapInArrow(run, "node long, shingles array<int>")


def _judged(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v, near): whether the sets at both ends have this Jaccard similarity or more."""
    both = edges
    for end, other in (("u", "v"), ("v", "u")):
        hot = hot_keys(edges.groupBy(end).agg(F.count("*").alias("n")), [end], "n")
        # Links and sets both grow with the texts, so neither is broadcast at any size.
        both = salted_join(both, sets.select(F.col("node").alias(end), F.col("shingles").alias(f"_{end}")), [end], hot, F.xxhash64(other), strategy="merge")
    common, total = F.size(F.array_intersect("_u", "_v")), F.size("_u") + F.size("_v")
    return both.select("u", "v", (common * (1 + similarity) >= total * similarity - 1e-9).alias("near"))


def _linked(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The candidate links (u, v, d), u < v, that hold, as far as they tell components apart.

    First each node is judged against the candidate that differs in fewest bits, at most one link for each; then the
    links that still lead from one component to another."""
    ends = candidates.select(F.inline(F.array(F.struct("u", "v", "d", F.col("u").alias("node")), F.struct("u", "v", "d", F.col("v").alias("node")))))
    nearest = ends.groupBy("node").agg(F.min(F.struct("d", "u", "v")).alias("e")).select("e.u", "e.v").distinct()
    first = written(_judged(nearest, sets, similarity), "judged")
    held = first.filter("near").select("u", "v")
    root = components(held, "near1").select(F.col("u").alias("node"), F.col("v").alias("root"))
    rest = candidates.select("u", "v").join(first.select("u", "v"), ["u", "v"], "left_anti")
    for end in ("u", "v"):
        named = root.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
        rest = rest.join(named, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    rest = written(rest.filter("_u <> _v").select("u", "v"), "rest")
    return held.unionByName(_judged(rest, sets, similarity).filter("near").select("u", "v"))


def near_groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(row, group): of every row of docs (row long and distinct, text), the smallest row that links reach from it.

    Texts are linked where the Jaccard similarity of their sets of `width`-word shingles (words lower-cased in A-Z; with
    fewer words the whole sequence) is `similarity` or more, as far as the bits find the pair. Texts with equal sets,
    copies among them, count once, so a group of copies costs what one text costs; texts without words, null among them,
    have equal sets. At an anchor a spanning forest of the candidates is taken, not all pairs. Texts are read whole; an
    empty table gives no rows."""
    rows = written(sketches(docs, width), "sketches")
    distinct = rows.groupBy("low", "high").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in _NAMES[2:]])
    # Numbered by what the sets are, so that what follows does not depend on how the rows are dealt over tasks.
    distinct = written(in_order(distinct, [F.col("low"), F.col("high")], "node", write=written), "distinct")
    spread_ = dealt(distinct.select("node", "bits", "w0", "w1", "w2", "w3")).mapInArrow(spread(CODE, BLOCKS, 2), "anchor long, node long, bits long")
    met = link_at_anchors(spread_, CHECK)
    candidates = written(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "d").distinct(), "candidates")
    # Written, so that its size is known: it is sent to the texts if it is small, and they are shuffled otherwise.
    ends = candidates.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    nodes = written(distinct.select("row", "node").join(ends, "node"), "nodes")
    sets = written(_sets(maybe_in(docs.select("row", "text"), nodes, "row").join(nodes, "row"), width), "sets")
    links = components(_linked(candidates, sets, similarity), "near2").select(F.col("u").alias("node"), F.col("v").alias("root"))
    named = distinct.select("low", "high", "row", "node").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("row").alias("group"))
    named = named.join(smallest, "root").select("low", "high", "group")
    return rows.select("row", "low", "high").join(named, ["low", "high"]).select("row", "group")
