"""Naive-Bayes evidence about a text, as DataFrame expressions.

A text is described by a few shapes, ratios cut into 16 bins on a logarithmic scale, and by which words of a small
learned lexicon it has. Both are fitted on a bounded sample of labelled rows; scoring is one projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopflow.llm.common import let

BINS = 16
#: Labelled rows that a fit reads, at most: those with the smallest hash of their id.
SAMPLE = 20_000
#: Texts with fewer words than these have bins of their own, since their ratios vary more.
SIZES = (16, 64)
#: A lexicon word is in at least so many sampled texts of its class, so many times as often as elsewhere, and so many
#: standard deviations more often than by chance.
LEAST_TEXTS, LEAST_RATIO, LEAST_EXCESS = 10, 6.0, 5.0
#: ASCII characters that are no letters.
NO_LETTER = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SHAPES = ("symbols", "capitals", "exclamations", "echoes", "word_length", "size")


def describe(text: Column) -> Column:
    """A struct of a text: n (its tokens), tokens (lower-cased runs of letters), bins (one for each shape).

    One expression that binds what it uses again, so that moving it into a filter or a projection repeats nothing."""
    whole = F.coalesce(text, F.lit(""))

    def measured(t: Column) -> Column:
        # The few characters that are counted, kept in one pass.
        marks = F.regexp_replace(t, r"[^#*$%&|<>A-Z!]+", "")
        tokens = F.array_remove(F.split(F.lower(t), NO_LETTER), "")
        return let(marks, lambda m: F.struct(
            tokens.alias("tokens"), F.length(t).alias("length"), F.length(F.translate(m, "#*$%&|<>", "")).alias("others"),
            F.length(F.translate(m, "!", "")).alias("not_exclaimed"), F.length(m).alias("marks"),
        ))

    def scaled(part: Column, of: Column) -> Column:
        return F.when(of > 0, F.least(F.lit(BINS - 2), F.floor(F.log2(1 + 1024 * part / of)).cast("int"))).otherwise(BINS - 1)

    def binned(m: Column) -> Column:
        tokens, n = m["tokens"], F.size(m["tokens"])
        symbols, exclamations = m["marks"] - m["others"], m["marks"] - m["not_exclaimed"]
        capitals = m["marks"] - symbols - exclamations
        # Tokens that the next one repeats; the slice makes the comparison one zip.
        again = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda x, y: x == y)
        echoes = F.size(F.filter(again, lambda same: same))
        size = sum((F.when(n < limit, 1).otherwise(0) for limit in SIZES), F.lit(0))
        bins = (
            scaled(symbols, n), scaled(capitals, m["length"]), scaled(exclamations, n), scaled(echoes, n),
            F.when(n > 0, F.least(F.lit(BINS - 2), F.floor(m["length"] / n).cast("int"))).otherwise(BINS - 1),
        )
        return F.struct(n.cast("long").alias("n"), tokens.alias("tokens"), F.array(*[x + BINS * size for x in bins], size).alias("bins"))

    return let(whole, lambda t: let(measured(t), binned))


@dataclass
class Evidence:
    """Log-probabilities of each class: of each bin of each shape, and what each lexicon word adds when it is there."""

    classes: list[str]
    prior: list[float]
    shapes: dict[str, list[list[float]]]
    lexicon: list[str]
    present: list[list[float]]
    absent: list[float]
    #: labelled texts that the fit has read
    texts: float = 0.0


def sample_labels(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most `sample` rows (id, class), those with the smallest hash of the id; ids that are null have no document."""
    return labelled.filter("id is not null and class is not null").orderBy(F.xxhash64("id"), "class").limit(sample)


def fit(docs: DataFrame, labelled: DataFrame, classes: list[str], id_col: str = "doc_id", text_col: str = "text", lexicon_size: int = 0, sample: int = SAMPLE) -> Evidence:
    """Fits on the documents of sample_labels(labelled), columns id and class.

    The sample bounds what is broadcast; what comes to the driver is bounded by the bins and the lexicon."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample_labels(labelled, sample)), "id")
    known = chosen.select("class", describe(F.col("text")).alias("d")).select("class", F.col("d.tokens").alias("tokens"), F.col("d.bins").alias("bins")).persist()
    try:
        rows = known.select("class", F.posexplode("bins").alias("s", "b")).groupBy("class", "s", "b").agg(F.count("*").alias("n")).collect()
        place = {c: k for k, c in enumerate(classes)}
        blocks = len(SIZES) + 1
        tables = {s: [[0.5] * (blocks if s == "size" else BINS * blocks) for _ in classes] for s in SHAPES}
        for r in rows:
            if r["class"] in place:
                tables[SHAPES[r["s"]]][place[r["class"]]][r["b"]] += r["n"]
        texts = [sum(t) - 0.5 * blocks for t in tables["size"]]
        shapes = {s: [_conditional(t, blocks if s == "size" else BINS) for t in table] for s, table in tables.items()}
        prior = [math.log((x + 1) / (sum(texts) + len(classes))) for x in texts]
        words = _lexicon(known, classes, texts, lexicon_size) if lexicon_size else []
    finally:
        known.unpersist()
    p = [[(w[c] + 0.1) / (texts[k] + 0.2) if texts[k] else 0.5 for k, c in enumerate(classes)] for w in words]
    present = [[math.log(x / (1 - x)) for x in row] for row in p]
    absent = [sum(math.log(1 - row[k]) for row in p) for k in range(len(classes))]
    return Evidence(classes, prior, shapes, [w["word"] for w in words], present, absent, sum(texts))


def _conditional(counts: list[float], width: int) -> list[float]:
    """Log-probabilities of bins among those of the same size of text."""
    blocks = [counts[a : a + width] for a in range(0, len(counts), width)]
    return [math.log(x / sum(b)) for b in blocks for x in b]


def _lexicon(known: DataFrame, classes: list[str], texts: list[float], size: int) -> list[dict]:
    """The words that tell one class from the rest most clearly."""
    each = known.select("class", F.explode(F.array_distinct("tokens")).alias("word"))
    counts = each.groupBy("word").agg(*[F.sum(F.when(F.col("class") == c, 1).otherwise(0)).alias(c) for c in classes])
    total = sum(texts)
    clear = []
    for k, c in enumerate(classes):
        others = sum((F.col(x) for x in classes if x != c), F.lit(0))
        ratio = (F.col(c) / max(texts[k], 1.0)) / ((others + 0.5) / max(total - texts[k], 1.0))
        chance = (F.col(c) + others) * (texts[k] / max(total, 1.0))
        excess = (F.col(c) - chance) / F.sqrt(F.greatest(chance, F.lit(0.1)))
        clear.append(F.when((F.col(c) >= LEAST_TEXTS) & (ratio >= LEAST_RATIO) & (excess >= LEAST_EXCESS), F.col(c) * F.log(ratio)).otherwise(0.0))
    ranked = counts.withColumn("_worth", F.greatest(*clear)).filter("_worth > 0").orderBy(F.desc("_worth"), "word").limit(size)
    return [r.asDict() for r in ranked.collect()]


def log_likelihoods(e: Evidence, text: Column) -> Column:
    """log P(text | class) + const for each class, as an array."""
    return let(describe(text), lambda d: _log_likelihoods(e, d))


def _log_likelihoods(e: Evidence, description: Column) -> Column:

    def of(d: Column) -> Column:
        shapes = [
            sum((F.element_at(F.array(*[F.lit(x) for x in e.shapes[s][k]]), d["bins"][i] + 1) for i, s in enumerate(SHAPES)), F.lit(e.absent[k]))
            for k in range(len(e.classes))
        ]
        if not e.lexicon:
            return F.array(*shapes)
        found = F.array_intersect(d["tokens"], F.array(*[F.lit(w) for w in e.lexicon]))
        table = F.create_map(*[x for w, row in zip(e.lexicon, e.present, strict=True) for x in (F.lit(w), F.array(*[F.lit(v) for v in row]))])
        # One pass over the few lexicon words of a text, for all classes at once.
        return F.aggregate(found, F.array(*shapes), lambda sums, w: F.zip_with(sums, F.element_at(table, w), lambda a, b: a + b))

    return of(description)


def judged(e: Evidence, text: Column) -> Column:
    """A struct of a text: tokens (their number) and posterior, an array of class posteriors."""
    prior = F.array(*[F.lit(p) for p in e.prior])
    above = lambda ll: let(F.array_max(ll), lambda top: F.transform(ll, lambda x: F.exp(x - top)))
    shares = lambda w: let(F.aggregate(w, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(w, lambda x: x / total))
    scored = lambda d: let(F.zip_with(_log_likelihoods(e, d), prior, lambda a, b: a + b), lambda ll: let(above(ll), shares))
    return let(describe(text), lambda d: F.struct(d["n"].alias("tokens"), scored(d).alias("posterior")))
