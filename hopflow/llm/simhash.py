"""SimHash near-duplicates by anchor points of a covering code.

Two fingerprints of 64 bits that differ in at most 3 bits differ in at most 1 bit in one of their halves. The anchors
of a half are the words of a covering code of radius 1 on 32 bits: a Hamming code on 31 of them, and the last bit
free. A fingerprint goes to every anchor within radius + threshold = 2 of each half, at most 17 for each half; of two
halves within 1 bit, the anchor that covers one is within 2 of the other, so the pair meets there. At an anchor the
fingerprints are compared in full, and what leaves it is a spanning forest of the links, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflow.llm.common import written
from hopflow.llm.components import components

WIDTH, SEED, THRESHOLD = 3, 42, 3
#: Distinct fingerprints that are compared at one anchor at once; larger anchors are cut into blocks of this many.
BLOCK = 2048
#: Nodes that a task sends to their anchors, in the mean.
SPREAD_ROWS = 8192


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased words; bytes.lower and bytes.split know ASCII alone."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[k:] for k in range(width)]))
    h = xxhash.xxh64_intdigest
    return np.fromiter([h(s, SEED) for s in shingles], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half of the hashes; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id of every row and its fingerprint as a signed long `fp`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(shingle_hashes(t.as_py() or b"")) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    left = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary"))
    return left.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


class Code:
    """A covering code of radius 1: the Hamming code on the first 2**checks - 1 bits of a block, the other `free` bits as
    they are."""

    def __init__(self, checks: int, free: int):
        self.length = (1 << checks) - 1
        self.width = self.length + free
        bit = [0] + [1 << (p - 1) for p in range(1, self.length + 1)]
        # For each syndrome the changes of at most 2 Hamming bits that reach a code word: bit s alone, and all pairs
        # i ^ j = s; for 0 none. Unused places repeat the first.
        rows = [[bit[s]] + [bit[i] | bit[i ^ s] for i in range(1, 1 << checks) if s and i ^ s > i] for s in range(1 << checks)]
        most = max(map(len, rows))
        self.shifts = np.asarray([r + r[:1] * (most - len(r)) for r in rows], np.uint32)
        self.masks = [sum(1 << (p - 1) for p in range(1, self.length + 1) if p >> k & 1) for k in range(checks)]
        self.flips = np.asarray([1 << k for k in range(self.length, self.width)], np.uint32)
        # Two changes of free bits are left over only for a value that is a code word.
        self.twice = np.asarray([1 << i | 1 << j for i in range(self.length, self.width) for j in range(self.length, i)], np.uint32)

    def anchors(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For values of `width` bits: the row and the code word of every anchor within radius + 1 = 2 bits."""
        syndrome = np.zeros(len(block), np.uint32)
        for k, mask in enumerate(self.masks):
            syndrome |= (np.bitwise_count(block & np.uint32(mask)) & 1).astype(np.uint32) << np.uint32(k)
        nearest = (block ^ self.shifts[syndrome, 0])[:, None]
        found = np.concatenate([block[:, None] ^ self.shifts[syndrome], nearest ^ self.flips, nearest ^ self.twice], axis=1)
        keep = np.ones(found.shape, bool)
        keep[syndrome == 0, 1 : self.shifts.shape[1]] = False
        keep[syndrome != 0, found.shape[1] - len(self.twice) :] = False
        rows, cols = np.nonzero(keep)
        return rows, found[rows, cols]


#: The anchors of 32-bit halves: a Hamming code on 31 bits, and the last bit free.
HALVES = Code(5, 1)


def spread(code: Code, blocks: int, per_word: int):
    """Of rows (node, bits, words...): a row (anchor, node, bits) for each anchor of each block of the words.

    A word of 64 bits has `per_word` blocks of `code.width` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, bits = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            words = [batch.column(2 + k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(batch.num_columns - 2)]
            for at in range(0, len(node), 2048):
                keys, rows = [], []
                for b in range(blocks):
                    word = words[b // per_word][at : at + 2048] >> np.uint64(b % per_word * 32)
                    mine, anchor = code.anchors((word & np.uint64((1 << code.width) - 1)).astype(np.uint32))
                    keys.append(anchor.astype(np.int64) | (b << 32))
                    rows.append(mine + at)
                where = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(node[where]), pa.array(bits[where])], names=["anchor", "node", "bits"])

    return run


def dealt(nodes: DataFrame) -> DataFrame:
    """nodes (column node) over so many tasks that what each sends to its anchors is counted within its memory."""
    return nodes.repartition(max(1, -(-nodes.count() // SPREAD_ROWS)), "node")


def forest(node: np.ndarray, bits: np.ndarray, threshold: int) -> list[tuple[int, int, int]]:
    """Links (node, node, differing bits) that connect nodes exactly as all links within the threshold do, one fewer than
    each component has members: the nearest ones, a minimum spanning forest."""
    bits, n = bits.view(np.uint64), len(node)
    if n <= 64:
        near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= threshold
        if np.count_nonzero(near) == n:  # each node is near itself alone
            return []
    far = np.uint8(255)
    best, parent, k, out = np.full(n, far), np.zeros(n, np.int64), 0, []
    left = np.ones(n, bool)
    for _ in range(n - 1):
        left[k] = False
        best[k] = far
        d = np.bitwise_count(bits ^ bits[k])
        nearer = left & (d < best)
        best[nearer], parent[nearer] = d[nearer], k
        j = int(np.argmin(best))
        if best[j] <= threshold:
            out.append((int(node[parent[j]]), int(node[j]), int(best[j])))
        k = j if left[j] else int(np.argmax(left))
    return out


def _compare(threshold: int):
    """Links at each cell, of rows (anchor, cell, node, bits) that come with equal cells in a row, nodes in order. Cells
    have a bounded size."""

    def links(block: np.ndarray) -> np.ndarray:
        """block: whole cells."""
        new = np.flatnonzero(np.any(block[1:, :2] != block[:-1, :2], axis=1)) + 1
        starts = np.concatenate([[0], new])
        sizes = np.diff(np.append(starts, len(block)))
        two = starts[sizes == 2]
        apart = np.bitwise_count(block[two, 3].view(np.uint64) ^ block[two + 1, 3].view(np.uint64)).astype(np.int64)
        near = apart <= threshold
        out = [np.stack([block[two, 2][near], block[two + 1, 2][near], apart[near]], axis=1)]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if found := forest(block[s : s + n, 2], np.ascontiguousarray(block[s : s + n, 3]), threshold):
                out.append(np.asarray(found, np.int64))
        return np.concatenate(out)

    def batch_of(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in range(3)], names=["u", "v", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)], axis=1)
            if pending:
                rows = np.concatenate([*pending, rows])
            other = np.any(rows[:, :2] != rows[-1, :2], axis=1)
            whole = len(rows) - int(np.argmax(other[::-1])) if other.any() else 0
            pending = [rows[whole:]]
            if whole > 1:
                yield batch_of(links(rows[:whole]))
        if pending and len(pending[0]) > 1:
            yield batch_of(links(pending[0]))

    return run


def link_at_anchors(spread_: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """(u, v, d): of rows (anchor, node, bits), links with their differing bits that connect the nodes of each anchor as all its pairs of bits within
    the threshold do.

    Anchors with more than `block` nodes are cut into blocks; every pair of blocks is a cell of its own, so no task
    holds more than two blocks of an anchor at once and no pair is lost."""
    zero = F.lit(0).cast("long")
    # Written, so that its size is known: few anchors are large, and Spark then needs no shuffle to join them.
    large = written(spread_.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > block), "anchors")
    met = spread_.join(large, "anchor", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("long"))
    cells = met.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).select(
        "anchor", "node", "bits", "own",
        F.explode(F.when(F.col("blocks") == 1, F.array(zero)).otherwise(F.sequence(zero, F.col("blocks") - 1))).alias("other"),
    )
    cell = F.shiftleft(F.least("own", "other"), 31) + F.greatest("own", "other")
    together = cells.select("anchor", cell.alias("cell"), "node", "bits").repartition("anchor", "cell").sortWithinPartitions("anchor", "cell", "node")
    return together.mapInArrow(_compare(threshold), "u long, v long, d long")


def link_fingerprints(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v): links that connect the distinct fingerprints of column `fp` as all pairs within the threshold do."""
    fp = F.col("fp")
    rows = dealt(distinct.select(fp.alias("node"), fp.alias("bits"), fp.alias("w"))).mapInArrow(spread(HALVES, 2, 2), "anchor long, node long, bits long")
    return link_at_anchors(rows, THRESHOLD, block).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, fingerprint (16 hex digits), component_id, component_size.

    component_id is the smallest id among the rows whose fingerprints reach this one's by steps of at most 3 differing
    bits; null only where all of them have a null id. Rows with equal fingerprints, and so all copies, count once in
    the comparison. Texts without words have fingerprint zero and are linked like any others. Texts are read whole;
    an empty table gives no rows; other columns are ignored."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "distinct")
    links = components(link_fingerprints(distinct), "simhash")
    rooted = distinct.join(links.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # A component's fingerprints are counted where they are before they meet.
    best = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("component_size"))
    named = rooted.join(best, "root").select("fp", "component_id", "component_size")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size"
    )
