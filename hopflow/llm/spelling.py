"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word is cut into two even segments. One inserted, deleted or replaced code point leaves one of them as it is: of two
words of equal length both have that segment in the same place; of a word and one that is longer by a code point, the
first segment is in the same place and the second one place further on. So each word is indexed by its two segments, and
probes, with the substrings at these places, the words of its own length and those that are one shorter.

Many words share a segment of three or four letters. So the segment that an edit may have touched is cut in two again by
the same rule, two or three times in all: a key is all of a word but a stretch of it (the gap), of three code points at
most in words of up to 24. Candidates share a key and are verified by the edit distance of their gaps. A pair of equal
length has one key in common. Another pair may have two, where a letter is repeated across a cut; it is taken at the
first: the key at whose gap's start the letter could also be inserted is passed over, unless it is the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopflow.llm.common import ASCII_LOWER, ASCII_UPPER, written

RUN = "[A-Za-z\\u00C0-\\u00FF]"
#: Words have at least this many code points and occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One run in TYPOS loses a code point, chosen by a hash of document and run.
TYPOS = 31
#: A near word with this many times a word's occurrences is its form.
FACTOR = 10
#: Words of up to this length are cut twice, longer ones three times.
SHORT = 12


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts with at least LEAST_LENGTH code points and LEAST_COUNT occurrences.

    Runs of fewer letters are not words, before or after a code point is deleted. Counted on the map side."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(ident.alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"{RUN}{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    # In a run of ASCII letters alone lower() does the same as the slower translate().
    plain = F.length("run") == F.octet_length("run")
    lowered = runs.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", ASCII_UPPER, ASCII_LOWER)).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    counted = hashed.select(F.when(F.col("h") % TYPOS == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= LEAST_LENGTH)
    return counted.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _gaps(length: Column) -> Column:
    """The gaps (start, stop) of a word of this length: its segments after two or three cuts."""

    def cut(start: Column, stop: Column, times: int) -> list[Column]:
        if not times:
            return [F.struct(start.alias("start"), stop.alias("stop"))]
        half = start + F.floor((stop - start) / 2).cast("int")
        return [*cut(start, half, times - 1), *cut(half, stop, times - 1)]

    return F.when(length <= SHORT, F.array(*cut(F.lit(0), length, 2))).otherwise(F.array(*cut(F.lit(0), length, 3)))


def _keys(counted: DataFrame, longer: int) -> DataFrame:
    """The keys (length, start, known) of words (word, n), with what is in the gap: of a word itself, or of the words that
    it would be if it were `longer` = 1 code point shorter."""
    length = F.length("word") - longer
    cut = counted.filter(length >= LEAST_LENGTH).select("word", "n", length.cast("int").alias("length"), F.inline(_gaps(length.cast("int"))))
    known = F.concat(F.substr("word", F.lit(1), F.col("start")), F.substr("word", F.col("stop") + 1 + longer))
    gap = F.substr("word", F.col("start") + 1, F.col("stop") - F.col("start") + longer)
    return cut.select("length", "start", known.alias("known"), gap.alias("gap"), "n", F.lit(longer).alias("longer"))


def near_words(counted: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of distinct words (word, n) that are one edit apart, in both directions."""
    key = ["length", "start", "known"]
    index = _keys(counted, 0).select(*key, F.col("gap").alias("own"), F.col("n").alias("own_n"))
    probe = _keys(counted, 0).unionByName(_keys(counted, 1))
    own, gap = F.col("own"), F.col("gap")
    # Of two words of equal length the smaller is the index's; of others the pair is taken at its first key.
    once = F.when(F.col("longer") == 0, own < gap).otherwise((F.col("start") == 0) | (F.substr(gap, F.lit(2)) != own))
    pairs = index.join(probe, key).filter(once & (F.levenshtein(own, gap, 1) == 1))
    whole = lambda part: F.concat(F.substr("known", F.lit(1), F.col("start")), part, F.substr("known", F.col("start") + 1))
    pairs = pairs.select(whole(own).alias("a"), F.col("own_n").alias("m"), whole(gap).alias("b"), "n")
    both = F.array(F.struct(F.col("a").alias("word"), F.col("m").alias("n"), F.col("b").alias("near"), F.col("n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("n").alias("n"), F.col("a").alias("near"), F.col("m").alias("near_n")))
    return pairs.select(F.inline(both))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): where the forms lead. Every step multiplies the occurrences by FACTOR, so there
    are no cycles, and each round, which is written, doubles the steps taken."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = written(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row for each word of the texts.

    Runs of letters A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z; where 31 divides the crc32 of `<doc_id>:<run>` its
    code point number crc32 % length is deleted. n: occurrences in all texts; n_near: words one edit away; form: the one
    with most occurrences (ties: the smallest in code-point order), if these are FACTOR * n or more, and null otherwise;
    form_n: the form's occurrences; root: where the forms lead from word to word, the word itself without a form.

    Null texts have no words; a null id counts as empty; repeated rows count each; an empty table gives no rows; other
    columns are ignored. A run may be as long as a text: it has eight keys at most."""
    counted = written(words(docs, id_col, text_col), "words")
    best = near_words(counted).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    named = counted.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    enough = F.col("near_n") >= FACTOR * F.col("n")
    named = written(named.select("word", "n", "n_near", F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n")), "near")
    roots = _roots(named.filter("form is not null"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
