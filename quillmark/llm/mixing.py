"""Soft-membership mixing to target weights, in DataFrame functions only.

A naive Bayes classifier fitted on the labelled table gives every document a posterior
over domains. Document rates r >= 0 then bring the expected domain token totals
sum_d r_d tokens_d p_dk to their targets, by projected gradient least squares:
r_d <- max(0, r_d - p_d . M gap). M is the inverse of the domains' Gram matrix
sum_d tokens_d p_dk p_dl over the documents with a positive rate, which makes the problem
well-conditioned (a Newton step while the same rates are zero); where such a step takes the
gaps further off, that of the Gram matrix of all documents is taken instead, whose largest
curvature is 1. A pass gathers one row of gaps and Gram matrix; a document's rate is a
fold of the passes' step vectors over its own posterior.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import io

#: Hash classes of words, labelled rows to fit on (expected number), passes at most; a
#: domain's largest gap, relative to its target (to its size where the target is 0).
BUCKETS = 4096
MAX_LABELLED = 20_000
PASSES = 40
TOLERANCE = 1e-3
_WORDS = "[\\x09-\\x0D ]+"
TOKENS, POST, RESIDUAL = "__mix_tokens", "__mix_posterior", "__mix_residual"

#: Target shares of tokens for the domains that the labels table spans.
TARGETS = {"q1t0": 0.86, "q0t0": 0.08, "q1t1": 0.055, "q0t1": 0.005}


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _WORDS), "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int") + 1


def _table(values: list[float]) -> Column:
    """A constant array; one literal instead of an expression for each entry."""
    return F.from_json(F.lit(json.dumps([round(v, 6) for v in values])), "array<double>")


def _looked_up(weights: list[float]) -> Column:
    """Sum of the weights of a row's buckets."""
    table = _table(weights)
    return F.aggregate(F.col("__mix_b"), F.lit(0.0), lambda acc, b: acc + F.element_at(table, b))


@dataclass
class Classifier:
    """Log prior and per-bucket log-likelihoods of each domain, relative to the first."""

    domains: list[str]
    prior: list[float] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)


def labelled_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxic; rows with a null or a value other than 0
    and 1 are left out and a doc_id that repeats takes its largest values."""
    known = labels.filter("doc_id is not null and quality in (0, 1) and toxic in (0, 1)")
    one = known.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return one.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain"))


def fit_classifier(docs: DataFrame, domains: DataFrame, text: str = "text") -> Classifier:
    """Naive Bayes on at most about MAX_LABELLED rows, chosen by a hash of doc_id.

    That bound makes the broadcast of the sample and the gathered counts
    (BUCKETS x domains) safe at any size of the tables.
    """
    n = domains.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mixing")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = domains.filter(draw < min(1.0, MAX_LABELLED / max(n, 1)))
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    counts = rows.select("domain", F.explode(words_of("text")).alias("w")).groupBy("domain", bucket(F.col("w")).alias("b")).count()
    got = [(r[0], r[1], r[2]) for r in counts.collect()]
    sizes = {r[0]: r[1] for r in rows.groupBy("domain").count().collect()}
    names = sorted(sizes)
    if not names or not got:
        return Classifier([])
    table = {name: [0.5] * BUCKETS for name in names}
    for name, b, c in got:
        table[name][b - 1] += c
    logs = {name: [math.log(c) for c in v] for name, v in table.items()}
    totals = {name: math.log(sum(v)) for name, v in table.items()}
    base = names[0]
    return Classifier(
        names,
        [math.log(sizes[x] / sizes[base]) for x in names],
        [[(logs[x][b] - totals[x]) - (logs[base][b] - totals[base]) for b in range(BUCKETS)] for x in names],
    )


def with_posteriors(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``docs`` with the number of words and the posterior over ``model.domains``.

    Log-likelihoods are divided by the square root of the number of words, since words
    of a text aren't independent; that keeps the membership soft.
    """
    hashed = docs.withColumn("__mix_b", F.transform(words_of(text), bucket)).withColumn(TOKENS, F.size("__mix_b").cast("long"))
    scale = F.sqrt(F.greatest(F.col(TOKENS), F.lit(1)).cast("double"))
    scores = [F.lit(0.0)]
    for prior, weights in zip(model.prior[1:], model.weights[1:], strict=True):
        scores.append(F.lit(prior) + _looked_up(weights) / scale)
    logits = hashed.withColumn("__mix_s", F.array(*scores))
    top = F.array_max("__mix_s")
    shifted = logits.withColumn("__mix_e", F.transform("__mix_s", lambda s: F.exp(s - top)))
    total = F.aggregate("__mix_e", F.lit(0.0), lambda a, e: a + e)
    return shifted.withColumn(POST, F.transform("__mix_e", lambda e: e / total)).drop("__mix_b", "__mix_s", "__mix_e")


def rate_of(steps: list[list[float]], n_domains: int) -> Column:
    """The rate after these passes: a fold of projected steps from 1."""
    if not steps:
        return F.lit(1.0)
    constant = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")

    def step(r: Column, s: Column) -> Column:
        moved = r
        for k in range(n_domains):
            moved = moved - F.col(POST)[k] * s[k]
        return F.greatest(F.lit(0.0), moved)

    return F.aggregate(constant, F.lit(1.0), step)


def fit_rates(rows: DataFrame, domains: list[str], targets: dict[str, float]) -> tuple[list[list[float]], float]:
    """The steps of projected gradient least squares and the largest relative gap that
    they leave; each pass gathers one row. Warns where that is TOLERANCE or more."""
    k = len(domains)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]

    def measured(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals by domain, Gram matrix of the documents with a positive rate, all tokens."""
        post = [F.col(POST)[i] for i in range(k)]
        active = F.when(F.col("r") > 0, F.col(TOKENS)).otherwise(F.lit(0))
        sums = [F.sum(F.col("r") * F.col(TOKENS) * x) for x in post] + [F.sum(active * post[i] * post[j]) for i, j in pairs]
        got = rows.select(TOKENS, POST, rate_of(steps, k).alias("r")).agg(F.sum(TOKENS), *sums).first()
        gram = np.zeros((k, k))
        for (i, j), x in zip(pairs, got[k + 1 :], strict=True):
            gram[i, j] = gram[j, i] = x or 0.0
        return np.array([x or 0.0 for x in got[1 : k + 1]]), gram, float(got[0] or 0)

    def inverse(gram: np.ndarray) -> np.ndarray:
        return np.linalg.pinv(gram, rcond=1e-10, hermitian=True)

    steps: list[list[float]] = []
    totals, gram, n = measured(steps)
    if not n:
        return [], 0.0
    share = np.maximum(totals / n, 1e-9)
    asked = sum(targets.get(d, 0.0) for d in domains)
    want = np.array([targets.get(d, 0.0) / asked for d in domains]) if asked > 0 else share
    size = np.where(want > 0, want, share)
    plain = inverse(gram / n)
    gap = totals / n - want
    best = steps, gap, gap @ plain @ gap
    newton = True
    for _ in range(PASSES):
        if np.max(np.abs(best[1]) / size) < TOLERANCE:
            break
        steps = [*best[0], ((inverse(gram / n) if newton else plain) @ best[1]).tolist()]
        totals, found, _n = measured(steps)
        gap = totals / n - want
        if gap @ plain @ gap < best[2]:
            best, gram, newton = (steps, gap, gap @ plain @ gap), found, True
        elif newton:
            newton = False
        else:  # not even the safe step comes nearer: the targets are out of reach
            break
    residual = float(np.max(np.abs(best[1]) / size))
    if residual >= TOLERANCE:
        warnings.warn(f"mixing: the targets are missed by up to {residual:.2%} of a domain's target", stacklevel=2)
    return best[0], residual


def mix(spark: SparkSession, docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> tuple[DataFrame, list[str]]:
    """(``docs`` with token count, posterior array, ``rate`` and residual, domain names).

    The residual, the same in every row, is the largest relative gap to a target; it is
    TOLERANCE or more where no rates meet the targets.
    Every row gets a rate, rows that repeat the same one. A null or empty text has no
    tokens, the prior as its posterior and no say in the fit. Without labelled rows
    there are no domains and every rate is 1. Targets are shares of all tokens for
    domains by name; those of absent domains are shared out among the others.
    """
    domains = labelled_domains(labels)
    model = fit_classifier(docs, domains)
    if not model.domains:
        return docs.withColumn(TOKENS, F.size(words_of("text")).cast("long")).withColumn(POST, F.array().cast("array<double>")).withColumn("rate", F.lit(1.0)).withColumn(RESIDUAL, F.lit(0.0)), []
    rows = io.staged(with_posteriors(docs, model), "mix_posteriors")
    steps, residual = fit_rates(rows, model.domains, targets or TARGETS)
    return rows.withColumn("rate", rate_of(steps, len(model.domains))).withColumn(RESIDUAL, F.lit(residual)), model.domains


def realised(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows repeated by their rate: its whole part, and once more with the probability
    of the rest, drawn from a hash of the key."""
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(F.col("rate") + draw).cast("int")
    kept = rows.withColumn("__mix_copies", copies).filter(F.col("__mix_copies") > 0)
    return kept.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).drop("__mix_copies", "__mix_copy", "rate", TOKENS, POST, RESIDUAL)
