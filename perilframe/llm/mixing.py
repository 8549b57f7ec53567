"""Mixing to target weights with soft domain membership, in DataFrame functions only.

A labelled table names the domain of some documents. A naive Bayes classifier over hashed words, learned from SAMPLE
labelled rows at most (those whose ids hash lowest), gives every document a posterior over the domains; its evidence is
that of EVIDENCE words whatever the length, so memberships stay soft. With n_i tokens and posterior p_i, document i at
rate r_i adds r_i * n_i * p_i to the expected domain totals. Rates are fitted by projected gradient least squares: from
rate 1 on, every step moves each document's rate against the gradient of half the squared misses (as shares of all tokens,
rates weighted by tokens, the gradient of a document is p_i . miss) and sets what falls below 0 to 0. Of the plain step in LENGTHS, alone
or with a part (KEPT) of the step before, and of the step scaled by the inverse of the D x D second moments of the documents with
positive rate in SCALED, the one with the smallest misses is taken; the plain step of length 1 always lowers them, as the moments have
trace 1 at most. A step is D numbers, so a document's rate is its posterior taken through the steps so far; rates are stored every CHAIN
steps, and the steps since are one generated expression. A round is two aggregates
over the stored posteriors, of D * D sums and of D sums for each step that is tried.

The fit ends within CLOSE of the targets, or where a round lowers the squared misses by less than GAIN of them: then no rates meet the
targets, and those found are near the least misses. That miss, and one left after ROUNDS rounds, is told by a warning.

Targets are shares by domain; they are scaled to the tokens of all documents. Null texts have no tokens and posterior
equal to the prior; null labels, and labels without a target, teach nothing; a domain without training rows has posterior
0 and can't be filled; without any training row every domain is equally likely. Ids play no part, so nulls and
repeated rows are rated like any others. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontam import let
from .store import stored

SAMPLE = 50_000  # labelled rows to learn from, at most
BUCKETS = 1 << 13  # words are hashed to this many features
EVIDENCE = 40.0
ROUNDS = 60
CLOSE = 1e-6  # miss, as a share of all tokens
GAIN = 1e-4
SCALED = (1.0, 0.5, 0.25, 0.0625)
LENGTHS = (1.0, 4.0, 16.0, 64.0, 256.0)
KEPT = (0.5, 0.9)  # of the step before
CHAIN = 8  # steps in one expression


def tokens(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"\s+"), "")


def bucket(word) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def learn(docs: DataFrame, labels: DataFrame, label: str, domains: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(log prior, log-probabilities of domain by bucket)."""
    named = labels.select(F.col("doc_id").alias("llm_id"), F.col(label).cast("string").alias("llm_domain"))
    named = named.where(F.col("llm_id").isNotNull() & F.col("llm_domain").isin(domains))
    sample = named.groupBy("llm_id").agg(F.max("llm_domain").alias("llm_domain")).orderBy(F.xxhash64("llm_id"), "llm_id").limit(SAMPLE)
    rows = docs.select(F.col("doc_id").alias("llm_id"), "text").join(F.broadcast(sample), "llm_id")  # SAMPLE rows at most
    prior = {r[0]: r[1] for r in rows.groupBy("llm_domain").count().collect()}  # a row for each domain
    words = rows.select("llm_domain", F.explode(tokens()).alias("word")).groupBy("llm_domain", bucket("word").alias("bucket")).count()
    counts = np.zeros((len(domains), BUCKETS))
    for d, b, n in words.collect():  # BUCKETS rows a domain at most
        counts[domains.index(d), b] = n
    seen = np.array([prior.get(d, 0) for d in domains], float)
    if not seen.sum():
        return np.zeros(len(domains)), np.zeros_like(counts)
    with np.errstate(divide="ignore"):
        return np.log(seen / seen.sum()), np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS))


def posterior(text: str, prior: np.ndarray, weight: np.ndarray) -> tuple[Column, Column]:
    """(number of tokens, array of posteriors) of a text."""
    total = weight.max(0)
    tables = [F.lit(np.ascontiguousarray(w - total)) for w in weight]

    def scores(found):
        one = lambda t: F.aggregate(found, F.lit(0.0), lambda s, b: s + F.get(t, b))
        n = F.greatest(F.size(found), F.lit(1))
        return F.array(*(F.lit(float(p) if math.isfinite(p) else -1e9) + EVIDENCE * one(t) / n for p, t in zip(prior, tables, strict=True)))

    def softmax(s):
        return let(F.transform(s, lambda x: F.exp(x - F.array_max(s))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))

    return F.size(tokens(text)).cast("long"), let(F.transform(tokens(text), bucket), lambda f: let(scores(f), softmax))


def rate(p: str, steps: list[np.ndarray], start: Column | None = None) -> Column:
    """The rate of a document with posterior ``p``: 1 (or ``start``), projected to 0 or more after every step."""
    out = F.lit(1.0) if start is None else start
    for v in steps:
        out = F.greatest(F.lit(0.0), out - sum((F.get(p, F.lit(d)) * float(x) for d, x in enumerate(v)), F.lit(0.0)))
    return out


def fit_rates(rows: DataFrame, share: np.ndarray) -> tuple[list[np.ndarray], float]:
    """(the steps of the rates of ``n, p``, tokens and posteriors; the largest miss, as a share of all tokens)."""
    k = range(len(share))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return [], 0.0

    base = rows.select("n", *(F.get("p", F.lit(d)).alias(f"p{d}") for d in k), "p", F.lit(1.0).alias("r"))

    def means(own: DataFrame, columns: list[Column]) -> np.ndarray:
        return np.array(own.agg(*(F.sum(F.col("n") * c) for c in columns)).first(), float).reshape(-1, len(share)) / total

    steps: list[np.ndarray] = []
    done = 0  # steps in the stored rates
    miss = means(base, [F.col(f"p{d}") for d in k])[0] - share
    for _ in range(ROUNDS):
        if np.abs(miss).max() < CLOSE:
            break
        if len(steps) - done == CHAIN:  # else every round would generate and run all steps again
            base, done = stored(base.withColumn("r", rate("p", steps[done:], F.col("r")))), len(steps)
        own = base.withColumn("r", rate("p", steps[done:], F.col("r")))
        moments = means(own, [F.when(F.col("r") > 0, F.col(f"p{d}") * F.col(f"p{e}")).otherwise(0.0) for d in k for e in k])
        scaled = np.linalg.lstsq(moments + 1e-9 * np.eye(len(share)), miss, rcond=None)[0]
        tried = [*(x * scaled for x in SCALED), *(x * miss for x in LENGTHS)]
        if steps:
            tried += [x * miss + y * steps[-1] for x in LENGTHS[:-1] for y in KEPT]
        ahead = own.withColumns({f"r{j}": rate("p", [v], F.col("r")) for j, v in enumerate(tried)})
        misses = means(ahead, [F.col(f"r{j}") * F.col(f"p{d}") for j in range(len(tried)) for d in k]) - share
        best = int((misses**2).sum(1).argmin())
        if misses[best] @ misses[best] > (1 - GAIN) * (miss @ miss):
            break
        steps, miss = [*steps, tried[best]], misses[best]
    return steps, float(np.abs(miss).max())


def mixed(docs: DataFrame, labels: DataFrame, label: str, targets: dict[str, float], keep: list[str] | None = None) -> DataFrame:
    """``docs`` with llm_n_tokens, llm_posterior (in the order of the sorted targets) and llm_rate.

    With ``keep`` only those columns of ``docs`` are returned; they are stored with the posteriors, and each text is read
    and classified once. Without, texts are not written a second time, but classified again when the result is read.
    """
    domains = sorted(targets)
    share = np.array([targets[d] for d in domains], float)
    prior, weight = learn(docs, labels, label, domains)
    n, p = posterior("text", prior, weight)
    own = docs.select(*(keep or ()), n.alias("llm_n_tokens"), p.alias("llm_posterior"))
    rows = stored(own)
    steps, miss = fit_rates(rows.select(F.col("llm_n_tokens").alias("n"), F.col("llm_posterior").alias("p")), share / share.sum())
    if miss >= CLOSE:
        warnings.warn(f"rates miss the targets by up to {miss:.2g} of all tokens", stacklevel=2)
    out = docs.withColumns({"llm_n_tokens": n, "llm_posterior": p}) if keep is None else rows
    return out.withColumn("llm_rate", rate("llm_posterior", steps))
