"""Quality rules: a threshold table compiled into one projection. DataFrame functions only.

The measures of a text are counts; a rule compares a multiple of one count with a multiple of another, so that the
verdict is integer arithmetic and the same on every engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopflow.llm.common import let, words_of

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as be was by this are from at or an not "
    "le la les de du des et un une est que qui dans pour sur pas au avec ce il "
    "der die das und ist nicht ein eine zu mit von auf den dem im für sich "
    "el los las en y que por con para una su al lo como del se es no"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A text passes if low * per <= measure * scale <= high * per; None: no bound."""

    name: str
    measure: str
    per: str
    scale: int
    low: int | None
    high: int | None


#: The rules, each as: measure, in relation to, times scale, least, most.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 10, 20, 150),
    Rule("symbols_per_word", "n_symbols", "n_words", 100, None, 15),
    Rule("stop_words", "n_stop_kinds", "one", 1, 2, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 100, None, 40),
    Rule("capitals", "n_capitals", "word_chars", 100, None, 40),
    Rule("exclamations", "n_exclamations", "n_words", 100, None, 50),
)


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words that lie in a window of `width` words found at least twice in the text.

    Texts without a repeated window, the usual case, need one hash set; others sort their windows."""

    def covered(windows: Column) -> Column:
        in_order = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def at(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["w"] == x["w"], F.lit(False))
            starts = F.transform(F.filter(s, same), lambda x: x["i"])
            offsets = F.array(*[F.lit(d) for d in range(width)])
            return let(starts, lambda p: F.size(F.array_distinct(F.flatten(F.transform(offsets, lambda d: F.transform(p, lambda i: i + d))))))

        return let(in_order, at)

    def windows(w: Column) -> Column:
        whole = F.slice(w, 1, F.size(w) - (width - 1))
        return F.transform(whole, lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + d) for d in range(1, width)]))

    def count(w: Column) -> Column:
        found = let(windows(w), lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(t)))
        return F.when(F.size(w) < width, F.lit(0)).otherwise(found)

    return let(words, count)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that the rules use, for each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), words_of(F.col(text_col)).alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stops = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    kept_only = lambda chars: F.length(F.regexp_replace("_text", f"[^{chars}]+", "")).cast("long")
    spread = left.select(
        "_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        kept_only(SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("again"))).alias("_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        # Each stop word counts once, however often a text has it; the words of a text are a set here.
        F.size(F.array_intersect(F.col("_words"), stops)).cast("long").alias("n_stop_kinds"),
        kept_only("A-Z").alias("n_capitals"),
        kept_only("!").alias("n_exclamations"),
    )
    return spread.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols",
        F.col("_lines.again").cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.col("_lines.lines").cast("long").alias("n_lines"), "n_stop_kinds", "n_capitals", "n_exclamations",
    )


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of every row, base_failed, kept, and the names of the rules it breaks.

    base_failed: under 50 words, or over half of the words in repeated three-word windows. A row is kept if it passes
    that and every rule of the table. A null or empty text has no words and fails; an empty table gives no rows; null
    and repeated ids are rows like others; other columns are ignored. Whole texts are measured, however long."""
    found = measures(docs, id_col, text_col).withColumn("one", F.lit(1))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    def broken(r: Rule) -> Column:
        value, unit = F.col(r.measure) * r.scale, F.col(r.per)
        low = value < unit * r.low if r.low is not None else F.lit(False)
        return low | (value > unit * r.high) if r.high is not None else low

    fails = F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    return (
        found.withColumn("base_failed", base)
        .withColumn("broken_rules", F.array_join(fails, ","))
        .withColumn("kept", ~F.col("base_failed") & (F.col("broken_rules") == ""))
        .drop("one")
    )


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same over a table `documents`, in DuckDB's SQL."""
    tests = []
    for r in rules:
        bounds = [f"{r.measure} * {r.scale} < {r.per} * {r.low}"] * (r.low is not None) + [f"{r.measure} * {r.scale} > {r.per} * {r.high}"] * (r.high is not None)
        tests.append(f"CASE WHEN {' OR '.join(bounds)} THEN '{r.name}' END")
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
k AS (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM k),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1),
p AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         coalesce(p.n, 0) AS n_repeat_words,
         CAST(len(list_distinct(list_filter(w, lambda x: list_contains([{stops}], x)))) AS BIGINT) AS n_stop_kinds,
         CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(length(regexp_replace(t, '[^!]+', '', 'g')) AS BIGINT) AS n_exclamations, 1 AS one
  FROM d LEFT JOIN p USING (rid)),
v AS (
  SELECT *, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m),
b AS (SELECT *, array_to_string(list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL), ',') AS broken_rules FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_kinds, n_capitals,
       n_exclamations, base_failed, broken_rules, NOT base_failed AND broken_rules = '' AS kept
FROM b
"""
