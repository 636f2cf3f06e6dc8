"""Language-model scores by deleted interpolation of word n-grams.

    P(w | v) = L2[b] * c(v, w) / c(v) + L1[b] * c(w) / N + L0[b] / (V + 1),   b = bucket of c(v)

with maximum-likelihood estimates of two orders and a uniform share. The weights of a bucket are learned by
expectation-maximisation on counts that are held out of the estimates; the final estimates use all training counts.

Rows are dealt into blocks by a hash of their id and text, so a row that is read again, or whose task is run again,
comes to the same block. Blocks are merged in levels. A block counts its own n-grams and sends each distinct one once, as
sorted runs of 64-bit keys, to the nodes of its group of `fan` blocks, one node for each of `fan` parts of the key space.
A node adds what it receives and sends it on in the same way: the nodes of a part and of `fan` neighbouring groups meet,
and cut the part into `fan` again. At the last level all groups have met. There are as many nodes at a level as blocks, a
node receives at most `fan` runs of a kind, each a share of its sender's n-grams, and the levels are few: up to
FAN blocks there is one, up to FAN**2 there are two. Within one level the rows exchanged grow with the square of the
blocks, to 3 * FAN for a block at most; from there on they grow with the input. Counts come back the same way, but only
for n-grams that others have too; all others a sender knows by itself. Whole blocks are held out to learn the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopflow.llm.common import written

#: Rows and bytes of a block in the mean at most, blocks at least, and the share of blocks held out.
BLOCK_ROWS, BLOCK_BYTES, LEAST_BLOCKS, HELD_EVERY = 4096, 16 << 20, 32, 5
#: Buckets of context frequency: 0, 1, 2-3, 4-7, ...; steps of the learning histogram for each doubling of a ratio.
BUCKETS, STEPS, ROUNDS = 48, 4, 60
NEVER = -(1 << 20)
#: Blocks, or groups of them, that meet at a node at most, and parts of the key space at least. A second level writes and
#: sends the n-grams of blocks once more (some 2 x the text), so it comes late: from FAN blocks on, 32 GB of average text.
FAN, LEAST_PARTS = 4096, 32
START, END = b" start", b" end"  # no word has a space

_SALT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _scatter(x: np.ndarray) -> np.ndarray:
    """An invertible mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * _SALT[0]
    x = (x ^ (x >> np.uint64(29))) * _SALT[1]
    return x ^ (x >> np.uint64(32))


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte plane by byte plane; what compresses well on its way."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(x: np.ndarray) -> bytes:
    kind = "<u1" if not len(x) or x.max() < 256 else "<u4" if x.max() < 1 << 32 else "<u8"
    return kind.encode() + x.astype(kind).view(np.uint8).reshape(-1, int(kind[2])).T.tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:3].decode())
    planes = np.frombuffer(data, np.uint8, offset=3).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)


def cuts(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to): where ascending keys fall into equal parts of the key space; parts without keys are left out.
    Cutting into a * b parts refines the cut into a."""
    if not len(keys):
        return
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
        yield int(part[a]), int(a), int(b)


class Block:
    """Tokens of some documents, their distinct words and word pairs, and the keys of these."""

    def __init__(self, texts: list[bytes | None], train: list[bool]):
        vocabulary = {END: 0, START: 1}
        parts, lengths = [], []
        for t in texts:
            words = t.lower().split() if t else []  # bytes: A-Z and the six ASCII spaces
            for w in set(words).difference(vocabulary):
                vocabulary[w] = len(vocabulary)
            words.append(END)
            parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
            lengths.append(len(words))
        self.lengths = np.asarray(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.word = np.concatenate(parts) if parts else np.empty(0, np.int32)
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.starts] = 1
        self.context = before
        h = xxhash.xxh3_64_intdigest
        hashes = np.fromiter((h(w) for w in vocabulary), np.uint64, len(vocabulary))
        self.keys1 = _scatter(hashes * _SALT[2] + np.uint64(1))
        pairs, self.pair = np.unique(before.astype(np.int64) * len(vocabulary) + self.word, return_inverse=True)
        left, right = pairs // len(vocabulary), pairs % len(vocabulary)
        self.keys2 = _scatter(_scatter(hashes[left]) * _SALT[2] + hashes[right])
        use = np.repeat(np.asarray(train, bool), self.lengths)
        self.count1 = np.bincount(self.word[use], minlength=len(vocabulary)).astype(np.int64)
        self.count1[1] = int(np.sum(train))
        self.count2 = np.bincount(self.pair[use], minlength=len(pairs)).astype(np.int64)

    def runs(self, parts: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(kind, part, places, ascending keys): 0 words, 1 pairs, 2 the start of a document."""
        for kind, places, keys in ((0, np.delete(np.arange(len(self.keys1)), 1), self.keys1), (1, np.arange(len(self.keys2)), self.keys2), (2, np.asarray([1]), self.keys1)):
            places = places[np.argsort(keys[places])]
            for p, a, b in cuts(keys[places], parts):
                yield kind, p, places[a:b], keys[places[a:b]]

    def take(self, rows: dict[tuple[int, int], tuple[int, bytes, bytes]], parts: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words and of pairs: from `rows` where several blocks have them; else the block's own, or none."""
        out = (self.count1.copy(), self.count2.copy()) if own else (np.zeros_like(self.count1), np.zeros_like(self.count2))
        for kind, part, places, keys in self.runs(parts):
            if (kind, part) not in rows:
                continue
            check, mask, counts = rows[kind, part]
            if check != checksum(keys):
                raise ValueError("the table has other rows than when it was read before")
            shared = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(keys)).astype(bool)
            out[kind == 1][places[shared]] = unpack_counts(counts)
        return out


def checksum(keys: np.ndarray) -> int:
    """Tells whether two runs of keys are the same."""
    return int((np.bitwise_xor.reduce(keys) ^ np.uint64(len(keys))).astype(np.int64))


def bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(c.astype(float))[1], BUCKETS - 1)


def learn_weights(rows: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Expectation-maximisation over a histogram (bucket, steps of P2 / P0, steps of P1 / P0, tokens).

    The result has a row (L2, L1, L0) for each bucket. Each share starts with one token of its own, so that none is 0
    but L2 where the context was never seen."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = (0, 0.5, 0.5)
    if not rows:
        return weights
    b, q2, q1, n = np.asarray(rows, np.int64).T
    ratio = lambda q: np.where(q == NEVER, 0.0, np.exp2(q / STEPS))
    p = np.stack([ratio(q2), ratio(q1), np.ones(len(b))], axis=1)
    for _ in range(ROUNDS):
        share = p * weights[b]
        share *= (n / share.sum(axis=1))[:, None]
        total = np.ones((BUCKETS, 3))
        total[0, 0] = 0
        np.add.at(total, b, share)
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


def _blocks(slim: DataFrame) -> int:
    """The number of blocks of rows (id, text): enough that none is large in rows or bytes."""
    size = slim.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    return max(LEAST_BLOCKS, -(-size["rows"] // BLOCK_ROWS), -(-(size["bytes"] or 0) // BLOCK_BYTES))


def tree(blocks: int) -> tuple[int, int]:
    """(levels, fan): the fewest levels of at most FAN senders a node, and the smallest fan that they need."""
    levels = fan = 1
    while FAN**levels < blocks:
        levels += 1
    while fan**levels < blocks:
        fan += 1
    return levels, fan if levels > 1 else max(fan, LEAST_PARTS)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, test_fold: int = 1) -> DataFrame:
    """The id of every row, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of P of the text).

    Words are lower-cased in A-Z; each text ends in an end token. The model learns from the rows whose crc32(id as text)
    mod `folds` is not `test_fold`; a row with a null id is scored, but neither learned from nor held out. A null text
    counts as empty: its end token alone. Copies are learned as often as they occur. Without rows to learn from every
    token has the uniform share. An empty table gives no rows; other columns are ignored. docs is read several times, in
    any order; its rows must be the same each time. Rows that repeat both id and text share a block."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(rest != test_fold, F.lit(False)).alias("train"), F.coalesce(rest == test_fold, F.lit(False)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    blocks = _blocks(slim)
    levels, parts = tree(blocks)
    slim = slim.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    held_block = F.col("block") % HELD_EVERY == HELD_EVERY - 1

    sent = [slim.select("block", "train", "text").groupBy("block").applyInArrow(_counter(parts), _RUN)]
    for level in range(1, levels):
        sent[-1] = written(sent[-1], "ngrams")
        sent.append(sent[-1].groupBy("family", "part").applyInArrow(_merger(parts, level), _RUN))
    top = written(sent[-1].groupBy("family", "part").applyInArrow(lambda rows: _answer(rows, None, parts, levels), _ANSWER), "answers")
    sums = top.filter("sender is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_main", "tokens_held", "types_main", "types")]).first()
    back = top.filter("sender is not null")
    for level in range(levels - 1, 0, -1):
        above = back.withColumnsRenamed({"sender": "family", "part": "run_part", "sender_part": "part"})
        back = written(sent[level - 1].groupBy("family", "part").cogroup(above.groupBy("family", "part")).applyInArrow(_answerer(parts, level), _ANSWER), "answers")
    back = back.select(F.col("sender").alias("block"), "kind", F.col("part").alias("run_part"), "run", "shared", "main", "total")

    learning = slim.filter(held_block).select("block", "train", "text")
    seen = learning.groupBy("block").cogroup(back.filter(held_block).groupBy("block")).applyInArrow(_observer(parts, sums["tokens_main"], sums["types_main"]), "b int, q2 int, q1 int, n long")
    histogram = seen.groupBy("b", "q2", "q1").agg(F.sum("n").alias("n")).collect()  # bounded by the steps, not by the rows
    weights = learn_weights([tuple(r) for r in histogram])

    id_type = docs.schema[id_col].dataType.simpleString()
    out = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scorer = _scorer(parts, sums["tokens_main"] + sums["tokens_held"], sums["types"], weights)
    done = slim.select("block", "id", "train", "held_out", "text").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(scorer, out)
    return done.withColumnRenamed("id", id_col)


#: What a sender gives to the node (family, part): a run of keys and its counts, over all training rows and over those of
#: main blocks; without the latter they are none if the sender is a held-out block, and all otherwise.
_RUN = "family long, part long, sender long, held boolean, kind int, keys binary, main binary, total binary"
_SENT = pa.schema([("family", pa.int64()), ("part", pa.int64()), ("sender", pa.int64()), ("held", pa.bool_()), ("kind", pa.int32()), ("keys", pa.binary()), ("main", pa.binary()), ("total", pa.binary())])
#: What a node gives back to (sender, sender_part), for the run that it sent to the node's part.
_ANSWER = "sender long, sender_part long, part long, kind int, run long, shared binary, main binary, total binary, tokens_main long, tokens_held long, types_main long, types long"
_ANSWERED = pa.schema([(c, pa.int64()) for c in ("sender", "sender_part", "part")] + [("kind", pa.int32()), ("run", pa.int64())] + [(c, pa.binary()) for c in ("shared", "main", "total")] + [(c, pa.int64()) for c in ("tokens_main", "tokens_held", "types_main", "types")])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _counter(fan: int):
    """The runs of a block, each with its counts."""

    def run(docs: pa.Table) -> pa.Table:
        now = docs.column("block")[0].as_py()
        block = Block(docs.column("text").to_pylist(), docs.column("train").to_pylist())
        held = now % HELD_EVERY == HELD_EVERY - 1
        out = [(now // fan, p, now, held, kind, pack(keys), None, pack_counts((block.count2 if kind == 1 else block.count1)[places])) for kind, p, places, keys in block.runs(fan)]
        return _table(out, _SENT)

    return run


class Node:
    """The runs of one kind that a node has received, added up by key."""

    def __init__(self, rows: list[dict]):
        self.rows, self.each = rows, [unpack(r["keys"]) for r in rows]
        keys, totals = np.concatenate(self.each), [unpack_counts(r["total"]) for r in rows]
        mains = [unpack_counts(r["main"]) if r["main"] is not None else np.zeros_like(t) if r["held"] else t for r, t in zip(rows, totals, strict=True)]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        self.keys, self.others = keys[starts], sizes > 1
        self.total, self.main = (np.add.reduceat(np.concatenate(x)[order], starts) for x in (totals, mains))
        self.place = np.empty(len(keys), np.int64)
        self.place[order] = np.repeat(np.arange(len(starts)), sizes)

    def learn(self, answers: dict[int, tuple[int, bytes, bytes, bytes]], parts: int) -> None:
        """Takes over the counts of the level above, where others have an n-gram too."""
        for p, a, b in cuts(self.keys, parts):
            if p in answers:
                check, mask, main, total = answers[p]
                if check != checksum(self.keys[a:b]):
                    raise ValueError("a node has other n-grams than when it sent them")
                shared = a + np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a))
                self.main[shared], self.total[shared], self.others[shared] = unpack_counts(main), unpack_counts(total), True

    def answers(self) -> Iterator[tuple[dict, int, np.ndarray, np.ndarray]]:
        """(row, checksum, mask, places): for each run received, what of it others have."""
        at = 0
        for r, k in zip(self.rows, self.each, strict=True):
            g = self.place[at : at + len(k)]
            at += len(k)
            shared = self.others[g]
            if shared.any():
                yield r, checksum(k), shared, g[shared]


def _nodes(table: pa.Table) -> Iterator[tuple[int, Node]]:
    rows = table.select(["sender", "held", "kind", "keys", "main", "total"]).to_pylist()
    for kind in (0, 1, 2):
        mine = [r for r in rows if r["kind"] == kind]
        if mine:
            yield kind, Node(mine)


def _merger(fan: int, level: int):
    """What a node of a level sends to the next."""

    def run(table: pa.Table) -> pa.Table:
        family = table.column("family")[0].as_py()
        out = [
            (family // fan, p, family, None, kind, pack(x.keys[a:b]), pack_counts(x.main[a:b]), pack_counts(x.total[a:b]))
            for kind, x in _nodes(table)
            for p, a, b in cuts(x.keys, fan ** (level + 1))
        ]
        return _table(out, _SENT)

    return run


def _answer(table: pa.Table, above: pa.Table | None, fan: int, level: int) -> pa.Table:
    """What a node gives back to its senders: a mask over the run that each sent and the counts of what the mask marks.
    `above`: what the next level gave back to the node. Where there is none, counts are final, and the sums over the
    node's words go in a row without sender."""
    if not table.num_rows:
        return _table([], _ANSWERED)
    part, out = table.column("part")[0].as_py(), []
    learned = above.select(["kind", "run_part", "run", "shared", "main", "total"]).to_pylist() if above is not None else []
    for kind, x in _nodes(table):
        if above is not None:
            x.learn({r["run_part"]: (r["run"], r["shared"], r["main"], r["total"]) for r in learned if r["kind"] == kind}, fan ** (level + 1))
        elif kind == 0:
            out.append((None, None, part, None, None, None, None, None, int(x.main.sum()), int((x.total - x.main).sum()), int((x.main > 0).sum()), int((x.total > 0).sum())))
        for r, check, shared, g in x.answers():
            main = None if r["held"] is False else pack_counts(x.main[g])
            out.append((r["sender"], part // fan, part, kind, check, np.packbits(shared).tobytes(), main, pack_counts(x.total[g]), 0, 0, 0, 0))
    return _table(out, _ANSWERED)


def _answerer(fan: int, level: int):
    return lambda rows, above: _answer(rows, above, fan, level)


def _rows(back: pa.Table, counts: str) -> dict[tuple[int, int], tuple[int, bytes, bytes]]:
    columns = [back.column(c).to_pylist() for c in ("kind", "run_part", "run", "shared", counts)]
    return {(k, p): (check, mask, c) for k, p, check, mask, c in zip(*columns, strict=True)}


def _observer(parts: int, tokens: int, types: int):
    """Of the held-out tokens of a block: how far each estimate lies above the uniform share, by context frequency.

    No main document is in a held-out block, so n-grams that only this block has have main count 0; its test documents
    are read, so that its runs are those that it sent, but not observed."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        texts = docs.column("text").to_pylist()
        train = docs.column("train").to_pylist()
        x = Block(texts, train)
        c1, c2 = x.take(_rows(back, "main"), parts, own=False)
        use = np.repeat(np.asarray(train, bool), x.lengths)
        pair, word, context, uniform = x.pair[use], x.word[use], c1[x.context[use]], 1 / (types + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            steps = lambda p: np.where(p > 0, np.rint(STEPS * np.log2(p / uniform)), NEVER).astype(np.int64)
            q2 = steps(np.where(context > 0, c2[pair] / context, 0.0))
            q1 = steps(c1[word] / max(tokens, 1))
        found, n = np.unique(np.stack([bucket(context), q2, q1], axis=1), axis=0, return_counts=True)
        return pa.table({"b": pa.array(found[:, 0], pa.int32()), "q2": pa.array(found[:, 1], pa.int32()), "q1": pa.array(found[:, 2], pa.int32()), "n": pa.array(n, pa.int64())})

    return run


def _scorer(parts: int, tokens: int, types: int, weights: np.ndarray):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        texts, train = docs.column("text").to_pylist(), docs.column("train").to_pylist()
        x = Block(texts, train)
        c1, c2 = x.take(_rows(back, "total"), parts, own=True)
        word, context = c1[x.word], c1[x.context]
        w = weights[bucket(context)]
        p = w[:, 0] * c2[x.pair] / np.maximum(context, 1) + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (types + 1)
        base = np.log10((word + 0.5) / (tokens + 0.5 * (types + 1)))
        if not tokens:
            p = np.full(len(word), 1 / (types + 1))
        added = lambda v: np.add.reduceat(v, x.starts)
        return pa.table({
            "id": docs.column("id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(x.lengths),
            "n_known": pa.array(added((word > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(texts), tokens, np.int64)),
            "base_score": pa.array(added(base)), "score": pa.array(added(np.log10(p))),
        })

    return run
