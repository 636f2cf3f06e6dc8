"""Mixing to target weights by soft membership. DataFrame functions only.

A classifier fitted on the labelled table gives each document posteriors over domains. Rates r in 0 to 1 are fitted to
the documents by distributed projected-gradient least squares: the expected tokens of domain c, the sum over documents
of r * tokens * posterior(c), are to match targets, and what is minimised is the sum over domains of the squared miss
over the domain's tokens. The gradient of a document's rate, for each of its tokens, is the inner product of its
posteriors with one number for each domain, which a pass over all documents adds up. A step moves every rate against that
gradient, scaled by the curvature over the rates that can move, and projects it to 0 to 1.

All rates start at 1. A rate is a function of the posteriors and of the few numbers of each step taken, so the documents
are only read, and a pass tries steps of several lengths at once.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopflow.llm import evidence
from hopflow.llm.common import fresh, written

DOMAINS = ["clean", "low", "toxic"]
TARGETS = {"clean": 0.96, "low": 0.02, "toxic": 0.02}
LEXICON = 256
#: Share of the domain of the largest weight that targets give up: a document that brings another domain's tokens brings
#: some of its own too, and without these the targets could not all be met.
SPARE = 0.005
#: The fit ends where every domain misses its target by less than this share of it, or of all tokens where that is larger ...
TOLERANCE, LEAST = 1e-5, 1e-7
#: ... or where a step lowers the squared miss by less than this share; steps after which it gives up with a warning.
PROGRESS, STEPS = 1e-4, 40
#: Lengths that one pass tries of a step scaled by curvature, and of the plain gradient, which always descends at length 1;
#: the share of a domain's tokens that is added to its curvature.
SCALED, PLAIN, RIDGE = (1 / 8, 1 / 4, 1 / 2, 1.0, 2.0), (1.0, 4.0, 16.0, 64.0, 256.0), 1e-6


def domain_labels(labels: DataFrame) -> DataFrame:
    """(id, class) of the labelled table: low quality, else toxic, else clean; rows that say neither are left out."""
    kind = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return labels.select(F.col("doc_id").alias("id"), kind.alias("class"))


def rate(posterior: Column, steps: list[list[float]]) -> Column:
    """The rate after these steps: 1, less the inner product of the posteriors with each step, projected after each."""
    r = F.lit(1.0)
    for step in steps:
        r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), r - _inner(posterior, step)))
    return r


def _inner(posterior: Column, numbers: list[float]) -> Column:
    return sum((F.element_at(posterior, c + 1) * float(x) for c, x in enumerate(numbers)), F.lit(0.0))


@dataclass
class Mix:
    """The steps taken, the targets in tokens and what was reached, by domain, and the number of passes over the documents."""

    steps: list[list[float]]
    goal: list[float]
    reached: list[float]
    passes: int


def _sums(members: DataFrame, sums: list[Column]) -> np.ndarray:
    """Sums over all documents, added up on the map side."""
    return np.asarray([x or 0.0 for x in members.agg(*[F.sum(x).alias(f"x{i}") for i, x in enumerate(sums)]).first()], float)


def _shares(n: int) -> list[Column]:
    return [F.element_at("posterior", c + 1) for c in range(n)]


def _curvature(members: DataFrame, steps: list[list[float]], slope: np.ndarray) -> np.ndarray:
    """The sum of tokens * p p^T over the rates that can move against this slope."""
    p, n = _shares(len(slope)), len(slope)
    rows = members.select("tokens", "posterior", rate(F.col("posterior"), steps).alias("r"), _inner(F.col("posterior"), slope.tolist()).alias("g"))
    moves = F.when((F.col("g") > 0) & (F.col("r") > 0) | (F.col("g") < 0) & (F.col("r") < 1), F.col("tokens")).otherwise(0)
    return _sums(rows, [moves * p[c] * p[d] for c in range(n) for d in range(n)]).reshape(n, n)


def _tried(members: DataFrame, steps: list[list[float]], moves: list[np.ndarray]) -> np.ndarray:
    """The tokens of each domain after each of these steps."""
    n = len(moves[0])
    p = _shares(n)
    rows = members.select("tokens", "posterior", rate(F.col("posterior"), steps).alias("r"))
    moved = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r") - _inner(F.col("posterior"), m.tolist()))) for m in moves]
    rows = rows.select("tokens", "posterior", *[(F.col("tokens") * r).alias(f"t{k}") for k, r in enumerate(moved)])
    return _sums(rows, [F.col(f"t{k}") * p[c] for k in range(len(moves)) for c in range(n)]).reshape(len(moves), n)


def fit_rates(members: DataFrame, targets: dict[str, float], domains: list[str], spare: float = SPARE) -> Mix:
    """The steps for a table with columns tokens and posterior.

    Each step is two passes over the documents: one adds up the curvature of the rates that can move, the other what
    steps of several lengths would reach, of which the best is taken. It ends by TOLERANCE, by PROGRESS where the targets
    cannot all be met, or after STEPS.

    The targets are those that keep the domain of the largest weight but for `spare`; where another has fewer tokens than
    its target the rest stays lacking, since nothing is repeated."""
    weight = np.asarray([max(targets.get(d, 0.0), 0.0) for d in domains])
    members = members.filter("tokens > 0").select("tokens", "posterior")
    have = _sums(members, [F.col("tokens") * p for p in _shares(len(domains))])
    total = have.sum()
    if not total or weight.sum() <= 0:
        return Mix([], have.tolist(), have.tolist(), 1)
    weight = weight / weight.sum()
    goal = weight * have[weight.argmax()] * (1 - spare) / weight.max()
    scale = np.maximum(have, LEAST * total)
    enough = np.maximum(TOLERANCE * goal, LEAST * total)
    steps: list[list[float]] = []
    reached, passes = have, 1
    while np.any(_missed(reached, goal, have) > enough):
        miss = reached - goal
        curve = _curvature(members, steps, miss / scale)
        direction = np.linalg.solve(curve + RIDGE * np.diag(scale), miss)
        moves = [direction * x for x in SCALED] + [miss / scale * x for x in PLAIN]
        tried = _tried(members, steps, moves)
        passes += 2
        costs = ((tried - goal) ** 2 / scale).sum(axis=1)
        best, now = int(costs.argmin()), float((miss**2 / scale).sum())
        if costs[best] >= now * (1 - PROGRESS):
            break
        steps.append(moves[best].tolist())
        reached = tried[best]
        if len(steps) == STEPS:
            warnings.warn(f"mixing: {_missed(reached, goal, have).max() / total:.1e} of all tokens are missed after {passes} passes", stacklevel=2)
            break
    return Mix(steps, goal.tolist(), reached.tolist(), passes)


def _missed(reached: np.ndarray, goal: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Tokens that a domain is away from its target, or from what it has where that is less."""
    return np.abs(reached - np.minimum(goal, have))


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", spare: float = SPARE) -> tuple[Mix, DataFrame]:
    """The fitted mixture, and the written table (id, row, tokens, posterior) of all documents."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    e = evidence.fit(slim, domain_labels(labels), DOMAINS, "id", "text", lexicon_size=LEXICON)
    members = slim.select("id", F.monotonically_increasing_id().alias("row"), evidence.judged(e, F.col("text")).alias("j")).select("id", "row", "j.tokens", "j.posterior")
    members = written(members, "members")
    # Without a labelled text the posteriors say nothing, and every document stays.
    return fit_rates(members, targets or TARGETS, DOMAINS, spare) if e.texts else Mix([], [], [], 0), members


def _key(doc_id: Column, row: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("row "), row.cast("string")))


def chosen(key: Column, rate_: Column, seed: int = 7) -> Column:
    """Whether a row with this rate is in the mixture; the key decides, so a second run chooses alike."""
    draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / float(1 << 30)
    return draw < F.coalesce(rate_, F.lit(0.0))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", spare: float = SPARE) -> DataFrame:
    """The id of every row, n_tokens, p_clean, p_low, p_toxic, rate, chosen, and the same in all rows for each domain:
    goal_<domain> and reached_<domain>, tokens that the targets ask for and that the rates give.

    A null or empty text has no tokens, weighs nothing and is judged by the bins that texts without words have.
    Tokens are runs of letters. Repeated rows are weighed each; those with one id are chosen alike, a null id by its row.
    Without labels all posteriors are even; without labels, tokens, or targets, all rates are 1 and goals null. An empty
    table gives no rows; other columns are ignored."""
    found, members = fit(docs, labels, targets, id_col, text_col, spare)
    done = members.withColumn("rate", rate(F.col("posterior"), found.steps))
    ends = [F.lit(v[k] if v else None).cast("double").alias(f"{name}_{d}") for name, v in (("goal", found.goal), ("reached", found.reached)) for k, d in enumerate(DOMAINS)]
    return done.select(F.col("id").alias(id_col), F.col("tokens").alias("n_tokens"), *[F.element_at("posterior", k + 1).alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", chosen(_key(F.col("id"), F.col("row")), F.col("rate")).alias("chosen"), *ends)


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", spare: float = SPARE) -> DataFrame:
    """The rows of docs that the mixture has, with their own columns; a null id is drawn by its row.

    The posteriors are found once and written beside the rows, then read by the fit and by the choice."""
    judged, row = fresh(docs, "_judged"), fresh(docs, "_row")
    e = evidence.fit(docs, domain_labels(labels), DOMAINS, id_col, text_col, lexicon_size=LEXICON)
    rows = written(docs.withColumn(judged, evidence.judged(e, F.col(text_col))).withColumn(row, F.monotonically_increasing_id()), "judged")
    found = fit_rates(rows.select(F.col(judged)["tokens"].alias("tokens"), F.col(judged)["posterior"].alias("posterior")), targets or TARGETS, DOMAINS, spare) if e.texts else Mix([], [], [], 0)
    kept = rows.filter(chosen(_key(F.col(id_col), F.col(row)), rate(F.col(judged)["posterior"], found.steps)))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
