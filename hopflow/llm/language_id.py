"""Language identification by segmentation-marginalised unigrams.

Each language gives every piece of a fixed public vocabulary a probability. A word's probability is the sum, over all
ways to cut it into pieces, of the product of their probabilities, which a forward pass computes; a text's is the
product over its words. The piece probabilities are learned by expectation-maximisation: a forward-backward pass
gives the expected number of times that each piece is used in the training words of a language.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of letters; digits and the underscore are left out.
LETTERS = re.compile(r"[^\W\d_]+")
#: Longer runs of letters are read in parts of this many, which keeps products within floating-point range.
LONGEST = 32
SPACE = "▁"
#: Different texts of each language that the model is fitted on, at most: those with the smallest hash.
SAMPLE = 1500
ROUNDS, SMOOTHING = 3, 0.05
#: Words whose scores a worker remembers.
MEMORY = 600_000
UNDETERMINED = "und"
#: Rows whose words are scored together.
TOGETHER = 512
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)
HASH_SPREAD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bins of the sampling histogram for each halving of the share of rows.
CUTS = 16


def words(text: str) -> list[str]:
    """Lower-cased runs of letters, long ones in parts."""
    found = LETTERS.findall(text.lower())
    return [p for w in found for p in ([w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w), LONGEST)])]


def has_letter(found: list[str]) -> bool:
    return any(c.isalpha() for w in found for c in w)


def read_pieces(vocabulary_path: str) -> list[str]:
    """The lower-case pieces of letters of a sentencepiece vocabulary, with or without a mark for a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size())}
    return sorted(p for p in pieces if (b := p.removeprefix(SPACE)) and b.isalpha() and b == b.lower())


@dataclass
class Model:
    """Piece probabilities: rows are the pieces, then one row for any character that is no piece; columns languages."""

    pieces: list[str]
    languages: list[str]
    p: np.ndarray
    prior: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


class PieceTable:
    """Finds the pieces of many strings at once, by a polynomial hash of their characters."""

    def __init__(self, pieces: list[str]):
        keys = np.zeros(len(pieces), np.uint64)
        for k, piece in enumerate(pieces):
            h = 0
            for c in piece:
                h = (h * int(HASH_BASE) + ord(c) + 1) % 2**64
            keys[k] = h
        self.size = 1 << 20
        self.keys = np.zeros((2, self.size), np.uint64)
        self.ids = np.full((2, self.size), -1, np.int64)
        order = np.arange(len(pieces))
        for level in (0, 1):  # those that share a place in the first table are in the second
            _, first = np.unique(self._place(keys[order], level), return_index=True)
            at = self._place(keys[order[first]], level)
            self.keys[level][at], self.ids[level][at] = keys[order[first]], order[first]
            order = np.delete(order, first)
        if len(order):
            raise ValueError("pieces share a place in both tables")

    def _place(self, h: np.ndarray, level: int) -> np.ndarray:
        return ((h * HASH_SPREAD[level]) >> np.uint64(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash, or -1."""
        at = self._place(h, 0)
        out = np.where(self.keys[0][at] == h, self.ids[0][at], -1)
        at = self._place(h, 1)
        return np.where(self.keys[1][at] == h, self.ids[1][at], out)


class Reader:
    """Finds pieces in words and remembers the scores of words; one for each worker and model."""

    def __init__(self, model: Model):
        self.rows = model.p.tolist()
        self.p = np.concatenate([model.p, np.zeros((1, model.p.shape[1]))])
        self.n = len(model.languages)
        self.longest = max(map(len, model.pieces), default=1)
        self.table = PieceTable(model.pieces)
        self.unknown = len(model.pieces)
        self.tree: dict = {}
        for k, piece in enumerate(model.pieces):
            node = self.tree
            for c in piece:
                node = node.setdefault(c, {})
            node[None] = k
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1024, self.n))

    def arcs(self, word: str) -> list[tuple[int, int, int]]:
        """(from, to, piece) of every piece in the marked word, by its start."""
        s, out = SPACE + word, []
        for i in range(len(s)):
            node, single = self.tree, False
            for j in range(i, len(s)):
                node = node.get(s[j])
                if node is None:
                    break
                k = node.get(None)
                if k is not None:
                    out.append((i, j + 1, k))
                    single |= j == i
            if not single:
                out.append((i, i + 1, self.unknown))
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log P of each word in each language: one forward pass for all words of a length."""
        out = np.empty((len(words), self.n))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == n)
            marked = "".join([SPACE + words[k] for k in rows.tolist()])
            codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(rows), n + 1).T.astype(np.uint64) + np.uint64(1)
            alpha = np.zeros((n + 2, len(rows), self.n))
            alpha[0] = 1.0
            for i in range(n + 1):
                h = np.zeros(len(rows), np.uint64)
                for j in range(i, min(n + 1, i + self.longest)):
                    h = h * HASH_BASE + codes[j]
                    found = self.table.find(h)
                    if j == i:
                        found[found < 0] = self.unknown
                    # Row -1 is zero: what is no piece adds nothing.
                    alpha[j + 1] += alpha[i] * self.p.take(found, axis=0, mode="wrap")
            out[rows] = np.log(alpha[n + 1])
        return out

    def learn(self, found: set[str]) -> None:
        """Remembers the scores of words that are not yet known."""
        missing = sorted(found.difference(self.index))
        if not missing:
            return
        if len(self.index) + len(missing) > MEMORY:
            self.index.clear()
            missing = sorted(found)
        need = len(self.index) + len(missing)
        if need > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((max(need, 2 * len(self.scores)) - len(self.scores), self.n))])
        self.scores[len(self.index) : need] = self.word_scores(missing)
        self.index.update(zip(missing, range(len(self.index), need), strict=True))

    def text(self, found: list[str]) -> np.ndarray:
        """log P of a list of known words in each language."""
        at = np.fromiter(map(self.index.__getitem__, found), np.int64, len(found))
        return self.scores[at].sum(axis=0)

    def expected(self, word: str, language: int) -> list[tuple[int, float]]:
        """How often each piece is expected in a word of a language."""
        arcs, rows, n = self.arcs(word), self.rows, len(word) + 1
        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        alpha[0] = beta[n] = 1.0
        for i, j, k in arcs:
            alpha[j] += alpha[i] * rows[k][language]
        for i, j, k in reversed(arcs):
            beta[i] += beta[j] * rows[k][language]
        return [(k, alpha[i] * rows[k][language] * beta[j] / alpha[n]) for i, j, k in arcs]


_readers: dict[str, Reader] = {}


def _reader(model: Model) -> Reader:
    if model.key not in _readers:
        _readers.clear()
        _readers[model.key] = Reader(model)
    return _readers[model.key]


def fit(labelled: DataFrame, vocabulary_path: str, lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """Learns a model from rows with a language; None if there are none with a letter.

    At most `sample` different texts of each language are used, those with the smallest hash, each once. What comes to the driver: a bounded histogram for each language, and a row for each piece."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # The share of rows with a smaller hash, on a logarithmic scale: the last bins hold the smallest.
    share = (F.pmod("h", F.lit(1 << 53)) + 1) / float(1 << 53)
    binned = rows.withColumn("b", F.floor(-F.log2(share) * CUTS).cast("int"))
    # Equal texts share a hash and take one place of the sample, however many they are.
    texts = binned.groupBy("lang", "b", "h").agg(F.count("*").alias("copies"))
    cuts: dict[str, int] = {}
    seen: Counter = Counter()
    taken: Counter = Counter()
    for r in sorted(texts.groupBy("lang", "b").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).collect(), key=lambda r: (r["lang"], -r["b"])):
        if taken[r["lang"]] + r["n"] <= sample or r["lang"] not in cuts:
            cuts[r["lang"]] = r["b"]
        taken[r["lang"]] += r["n"]
        seen[r["lang"]] += r["copies"]
    if not cuts:
        return None
    languages = sorted(cuts)
    limits = F.create_map(*[F.lit(x) for l in languages for x in (l, cuts[l])])
    chosen = binned.filter(F.col("b") >= limits[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")
    place = {l: k for k, l in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(found)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys]), pa.array([found[k] for k in keys], pa.int64())], names=["l", "word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((place[lang], w) for w in words(text))
            if len(found) > 100_000:
                yield out()
        if found:
            yield out()

    table = chosen.mapInArrow(count, "l int, word string, n long").groupBy("l", "word").agg(F.sum("n").alias("n")).persist()
    try:
        pieces = read_pieces(vocabulary_path)
        p = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
        for _ in range(ROUNDS):
            p = _round(table, Model(pieces, languages, p, np.zeros(len(languages))))
            if p is None:
                return None
    finally:
        table.unpersist()
    prior = np.asarray([seen[l] for l in languages], float)
    return Model(pieces, languages, p, np.log(prior / prior.sum()))


def _round(table: DataFrame, model: Model) -> np.ndarray | None:
    """One step of expectation-maximisation over the word counts."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared.value)
        total = np.zeros(shared.value.p.shape)
        for batch in batches:
            for l, w, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for k, x in reader.expected(w, l):
                    total[k, l] += n * x
        k, l = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(l.astype(np.int32)), pa.array(total[k, l])], names=["k", "l", "x"])

    got = table.mapInArrow(expect, "k int, l int, x double").groupBy("k", "l").agg(F.sum("x").alias("x")).collect()
    shared.unpersist()
    if not got:
        return None
    counts = np.full(model.p.shape, SMOOTHING)
    for r in got:
        counts[r["k"], r["l"]] += r["x"]
    return counts / counts.sum(axis=0)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", name: str = "_language") -> DataFrame:
    """docs with a struct (lang_pred, score): the most probable language of the whole text and its posterior.

    `und` and 0 for a null text or one without a letter; ties go to the first language by name."""
    if model is None:
        return docs.withColumn(name, F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    other = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = _reader(m)
        for batch in batches:
            langs, scores = [], []
            for at in range(0, batch.num_rows, TOGETHER):
                found = [words(t) if t else [] for t in batch.column(len(other)).slice(at, TOGETHER).to_pylist()]
                reader.learn(set().union(*found))
                for x in found:
                    if not has_letter(x):
                        langs.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    ll = reader.text(x) + m.prior
                    k = int(np.argmax(ll))
                    langs.append(m.languages[k])
                    scores.append(1.0 / math.fsum(np.exp(ll - ll[k])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*other, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in other)
    out = docs.select(*[F.col(f"`{c}`") for c in other], F.col(text_col)).mapInArrow(run, f"{fields}, lang_pred string, score double")
    return out.withColumn(name, F.struct("lang_pred", "score")).drop("lang_pred", "score")


def identify(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The id of every row, held_out, lang_pred, score.

    Learns from the rows with a language whose crc32(id as text) mod 4 is not 2; only the text is read to predict. A row
    with a null id takes no part in learning and is not held out. Texts are read whole; equal texts of a
    language are learned once, and each copy counts in how common the language is. An empty table gives no rows, and without rows to learn from all are `und`; other columns are ignored."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    model = fit(docs.filter(rest != 2), vocabulary_path, lang_col, text_col)
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(rest == 2, F.lit(False)).alias("_held"), F.col(text_col).alias("_text"))
    done = predict(slim, model, "_text", "_found")
    return done.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), F.col("_found.lang_pred").alias("lang_pred"), F.col("_found.score").alias("score"))
