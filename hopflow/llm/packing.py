"""Packing token streams into fixed windows by order-preserving dynamic programming.

Each input partition is packed by itself, in reading order, so nothing is shuffled. The stream of its tokens may be
cut at document ends (free), at sentence ends (a small penalty) and, inside stretches without either, at fixed
distances (a large penalty). With T(j) the tokens before boundary j, the cheapest way to fill windows up to j is

    f(j) = penalty(j) + min over i, T(j) - T(i) <= size, of f(i) + size - (T(j) - T(i)),

a minimum over a sliding range of f(i) + T(i), which a monotone queue gives in constant time for each boundary.
Partitions are packed in stretches of bounded length: what follows the last chosen cut goes on to the next stretch.

Texts are tokenized in chunks of some MB: Arrow splits them into words and numbers the distinct ones, these are cut into
letters and what follows them, and only parts that a worker has not met yet go to the tokenizer.
"""

from __future__ import annotations

import codecs
import os
import zlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 4096
#: The id that ends a document.
END_ID = 2
#: Penalties of a cut, in tokens of padding.
SENTENCE_CUT, HARD_CUT = 4, 16
#: Distance of the cuts that are allowed where there is no sentence end.
HARD_STEP = 32
#: Bytes of text tokenized at once (a longer text is a chunk of its own).
CHUNK = 1 << 23
#: Tokens packed at once, parts of words remembered, and the longest part that is remembered.
STRETCH, MEMORY, MEMORABLE = 1 << 19, 600_000, 48
#: Plain words: lower-case Latin letters, which need no normalisation, then ASCII symbols without the apostrophe, which
#: may join letters. The tokenizer splits such a word between the two and nowhere else.
PLAIN = r"^(?P<letters>[a-zß-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"

_words: dict[int, Words] = {}


@dataclass
class Words:
    """What a worker knows of a vocabulary; one for each worker."""

    tokenizer: object
    #: The same merges for plain letters between spaces, without normalisation and without a split by a pattern.
    plain: object
    #: Ids that end a sentence, and ids that end a word.
    sentence_ends: np.ndarray
    word_ends: np.ndarray
    #: The ids of parts of words met so far, as bytes.
    known: dict[bytes, bytes] = field(default_factory=dict)


def _load(vocabulary: str) -> Words:
    key = hash(vocabulary)
    if key not in _words:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        t = Tokenizer.from_str(vocabulary)
        plain = Tokenizer(t.model)
        plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        found = Words(t, plain, np.zeros(t.get_vocab_size() + 1, bool), np.zeros(t.get_vocab_size() + 1, bool))
        for piece, i in t.get_vocab().items():
            bare = piece.removesuffix("</w>")
            found.word_ends[i] = piece.endswith("</w>")
            found.sentence_ends[i] = bare and not bare.isalnum() and bare[-1] in ".!?" and piece.endswith("</w>")
        _words.clear()
        _words[key] = found
    return _words[key]


def _byte_letters() -> str:
    """The character that stands for each byte in the vocabulary: itself if it is printable, or the next free one above
    255. Bytes up to 127 are themselves here, so that spaces stay."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return "".join(chr(b if b < 128 or b in own else 256 + other.index(b)) for b in range(256))


BYTE_LETTERS = _byte_letters()


def _plain_ids(parts: list[bytes], words: Words) -> list[bytes]:
    """The ids of runs of lower-case Latin letters: each has one id that ends a word."""
    lines = [codecs.charmap_decode(b" ".join(parts[k : k + 1000]), "strict", BYTE_LETTERS)[0] for k in range(0, len(parts), 1000)]
    ids = np.concatenate([np.array(e.ids, "<u4") for e in words.plain.encode_batch_fast(lines, add_special_tokens=False)])
    ends = ((np.flatnonzero(words.word_ends[ids]) + 1) * 4).tolist()
    ids = ids.tobytes()
    return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _other_ids(parts: list[bytes], words: Words) -> list[bytes]:
    """The ids of any other runs without white space."""
    return [np.array(words.tokenizer.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes() for x in parts]


def _lists(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists that `codes` choose, one after the other, and their lengths; `flat` holds lists of `lengths`."""
    n = lengths[codes]
    shift = (np.cumsum(lengths) - lengths)[codes] - (np.cumsum(n) - n)
    at = np.repeat(shift, n)
    at += np.arange(len(at))
    return flat[at], n


def _look_up(parts: pa.Array, words: Words, tokenize: Callable[[list[bytes], Words], list[bytes]]) -> list[bytes]:
    """The ids of distinct parts of words; those not known yet are tokenized."""
    parts = parts.view(_bytes_type(parts.type)).to_numpy(zero_copy_only=False).tolist()
    found = list(map(words.known.get, parts))
    new = [k for k, ids in enumerate(found) if ids is None]
    if new:
        for k, ids in zip(new, tokenize([parts[k] for k in new], words), strict=True):
            found[k] = ids
            if len(parts[k]) <= MEMORABLE:
                words.known[parts[k]] = ids
    return found


def _encode(texts: pa.Array, words: Words) -> list[np.ndarray]:
    """encode for one chunk: the tokenizer drops white space and no id spans any, so each distinct word is cut once."""
    lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    split = pc.ascii_split_whitespace(lower)
    coded = split.flatten().dictionary_encode()
    cut = pc.extract_regex(coded.dictionary, PLAIN)
    letters = pc.fill_null(pc.struct_field(cut, "letters"), "").dictionary_encode()
    others = pc.coalesce(pc.struct_field(cut, "marks"), coded.dictionary).dictionary_encode()  # marks, or a whole word
    words.known[b""] = b""
    parts = _look_up(letters.dictionary, words, _plain_ids) + _look_up(others.dictionary, words, _other_ids)
    if len(words.known) > MEMORY:
        words.known.clear()
    flat, n = np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    pairs = np.stack([letters.indices.to_numpy(), others.indices.to_numpy() + len(letters.dictionary)], axis=1)
    flat, n = _lists(flat, n, pairs.ravel())
    flat, n = _lists(flat, n.reshape(-1, 2).sum(axis=1), coded.indices.to_numpy())
    ends = np.append(0, np.cumsum(n))[split.offsets.to_numpy()[1:]]
    flat = np.insert(flat, ends, np.uint32(END_ID)).astype("<u4", copy=False)
    return np.split(flat, (ends + np.arange(1, len(ends) + 1))[:-1])


def _bytes_type(text_type: pa.DataType) -> pa.DataType:
    return pa.large_binary() if pa.types.is_large_string(text_type) else pa.binary()


def encode(texts: pa.Array, vocabulary: str) -> Iterator[np.ndarray]:
    """The ids of each text of an array of bytes, with the end id; null is empty."""
    words = _load(vocabulary)
    texts = pc.fill_null(texts, b"")
    # ASCII kernels of Arrow take strings; a view does not ask whether the bytes are UTF-8.
    texts = texts.view(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string())
    chunk = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64) // CHUNK
    edges = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(texts)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield from _encode(texts.slice(a, b - a), words)


def boundaries(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a document may be cut, and at what penalty; its end is the last."""
    n = len(ids)
    cuts = np.flatnonzero(ends[ids[:-1]]) + 1
    cuts = np.append(cuts[cuts < n - 1], n)
    before = np.append(0, cuts[:-1])
    count = (cuts - before - 1) // HARD_STEP + 1  # hard cuts before each cut, and the cut itself
    last = np.cumsum(count) - 1
    step = np.arange(1, last[-1] + 2) - np.repeat(last + 1 - count, count)
    out = np.repeat(before, count) + step * HARD_STEP
    cost = np.full(len(out), HARD_CUT, np.int64)
    out[last], cost[last] = cuts, SENTENCE_CUT
    cost[-1] = 0
    return out, cost


def pad(length: int, size: int = SIZE) -> int:
    return 0 if length & (length - 1) == 0 else size - length


def tail_cost(length: int, size: int = SIZE) -> int:
    """Of the last tokens: padding, or cuts into lengths 2**k, whichever is cheaper."""
    return min(pad(length, size), (length.bit_count() - 1) * HARD_CUT)


def best_cuts(at: list[int], penalty: list[int], last: bool, size: int = SIZE) -> list[int]:
    """The chosen cuts among boundaries `at` (ascending, gaps of at most `size`), counted from token 0.

    last: the final boundary must be a cut. Otherwise the cheapest of those in the last window ends the list."""
    pos, g, back = [0, *at], [0], [-1]  # g: f + T, so g(j) = penalty(j) + size + min g(i)
    queue = deque([0])  # boundaries; ascending, as is their g
    for j, (t, p) in enumerate(zip(at, penalty, strict=True), 1):
        while t - pos[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        cost = g[i] + size + p
        while g[queue[-1]] >= cost:  # ends at i: g(i) is less
            queue.pop()
        queue.append(j)
        g.append(cost)
        back.append(i)
    end = len(pos) - 1
    if last:
        near = range(bisect_left(pos, pos[end] - size, 0, end), end)
        if near:
            back[end] = min(near, key=lambda i: g[i] - pos[i] + tail_cost(pos[end] - pos[i], size))
    else:
        near = range(max(1, bisect_right(pos, pos[end] - size)), end + 1)
        end = min(near, key=lambda j: (g[j] - pos[j], -j))
    out = []
    while end > 0:
        out.append(pos[end])
        end = back[end]
    return out[::-1]


def tail_cuts(start: int, end: int, size: int = SIZE) -> list[int]:
    """The last window as one padded sequence, or as sequences of lengths 2**k, which need no padding."""
    n = end - start
    if tail_cost(n, size) == pad(n, size):
        return [end]
    cuts, at = [], start
    for k in range(size.bit_length(), -1, -1):
        if n >> k & 1:
            at += 1 << k
            cuts.append(at)
    return cuts


@dataclass
class Stretch:
    """Tokens of consecutive documents that are not yet in a sequence."""

    #: id, ids that are left, position of the first of them in the document, tokens of the document
    docs: list[tuple] = field(default_factory=list)
    cuts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    tokens: int = 0

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.cuts.append(boundaries(ids, ends))
        self.tokens += len(ids)

    def pack(self, last: bool) -> Iterator[list[tuple]]:
        """Sequences as lists of (doc_id, start, ids, doc_tokens)."""
        if not self.docs:
            return
        starts = np.cumsum([0, *[len(d[1]) for d in self.docs]])
        at = np.concatenate([c + s for (c, _), s in zip(self.cuts, starts[:-1], strict=True)])
        cost = np.concatenate([p for _, p in self.cuts])
        cuts = best_cuts(at.tolist(), cost.tolist(), last)
        if last:
            before = cuts[-2] if len(cuts) > 1 else 0
            cuts = cuts[:-1] + tail_cuts(before, cuts[-1])
        d, a = 0, 0
        for b in cuts:
            pieces = []
            while a < b:
                doc_id, ids, first, n = self.docs[d]
                lo = a - int(starts[d])
                hi = min(len(ids), b - int(starts[d]))
                pieces.append((doc_id, first + lo, ids[lo:hi], n))
                a = int(starts[d]) + hi
                d += hi == len(ids)
            yield pieces
        end = cuts[-1]
        rest, rest_cuts = [], []
        for k in range(d, len(self.docs)):
            doc_id, ids, first, n = self.docs[k]
            lo = max(0, end - int(starts[k]))
            c, p = self.cuts[k]
            rest.append((doc_id, ids[lo:], first + lo, n))
            rest_cuts.append((c[c > lo] - lo, p[c > lo]))
        self.docs, self.cuts, self.tokens = rest, rest_cuts, self.tokens - end


def pack_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens.

    Columns: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Each id of a document, the end id
    included, lies in exactly one piece; sequences follow the reading order of their partition. A null or empty text is
    the end id alone; null and repeated ids are documents like others; a text longer than a sequence spans several.
    An empty table gives no rows; other columns are ignored."""
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = _load(vocabulary.value).sentence_ends
        stretch, n, rows = Stretch(), TaskContext.get().partitionId() << 32, []
        arrow = None

        def sequences(last: bool) -> None:
            nonlocal n
            for pieces in stretch.pack(last):
                offset = 0
                for doc_id, start, ids, total in pieces:
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, n, offset))
                    offset += len(ids)
                n += 1

        def out() -> pa.RecordBatch:
            cols = [list(c) for c in zip(*rows, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], arrow), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=schema.names)

        for batch in batches:
            arrow = batch.schema.field(0).type
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1), vocabulary.value), strict=True):
                stretch.add(doc_id, ids, ends)
                if stretch.tokens >= STRETCH:
                    sequences(last=False)
                    if len(rows) > 10_000:
                        yield out()
        sequences(last=True)
        if rows:
            yield out()

    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, schema)
