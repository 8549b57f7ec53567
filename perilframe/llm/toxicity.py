"""Toxic passages by maximum-scoring segment search.

Words (lower-cased runs of letters and digits) get log-odds between toxic and other training documents under a
Dirichlet prior drawn from the pooled counts; words whose log-odds are not significant count nothing, and every word
costs a drift, so that the expected score is negative. A linear scan finds all maximal-scoring segments of a text. The
extreme-value law of such scores, P(S >= s) = 1 - exp(-K n exp(-L s)), turns them into p-values; L follows from the
word scores of non-toxic text, K from its best segments. The evidence of a document, the sum of -log10 p over its
significant segments (or that of its best one), is calibrated to a probability by a logistic curve.

Learning uses at most SAMPLE labelled rows, those whose ids hash lowest. Null texts are empty; an empty text has
evidence 0. Ids without or with several labels: only non-null 0/1 labels count, the largest one of an id. Without both
classes among the training rows every score is the share of toxic rows (0 where there are none).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import held_out
from .textio import ALNUM, Texts, Words, append_columns, longs, pieces, table

SAMPLE = 50_000  # labelled rows to learn from, at most
DRIFT = 0.2
PRIOR = 0.01  # Dirichlet mass of a word: this share of its pooled count, plus a half
LEAST_Z = 3.0
SIGNIFICANT = 0.05
FIELDS = "llm_score double, llm_evidence double, llm_passages array<struct<begin:int,end:int,score:double,p_value:double>>"


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    gain: np.ndarray
    rate: float = 1.0  # L of the extreme-value law
    size: float = 1.0  # K
    slope: float = 0.0
    offset: float = 0.0


def segments(at: list[int], low: list[float], high: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score), given the words that gain and the running totals around them.

    Every segment knows the nearest earlier one that starts at a lower total. What a search has skipped on that chain is
    either behind the link of the new segment or merged into it, so no link is followed twice: the time is linear.
    """
    first: list[int] = []
    last: list[int] = []
    start: list[float] = []
    top: list[float] = []
    lower: list[int] = []
    columns = (first, last, start, top, lower)
    for i, a, b in zip(at, low, high, strict=True):
        j, s = len(first) - 1, i
        while j >= 0 and start[j] >= a:
            j = lower[j]
        merged = len(first)
        while j >= 0 and top[j] < b:
            merged, s, a = j, first[j], start[j]
            j = lower[j]
        for c, x in zip(columns, (s, i + 1, a, b, j), strict=True):
            del c[merged:]
            c.append(x)
    return [(s, e, b - a) for s, e, a, b in zip(first, last, start, top, strict=True)]


def scan(model: Model, texts: Texts) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Number of words and segments of each text."""
    w = Words(texts, lower=True, member=ALNUM)
    h = w.hashes()
    gain = np.zeros(len(h))
    if len(model.words) and len(h):
        i = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
        gain = np.where(model.words[i] == h, model.gain[i], 0.0)
    total = np.concatenate([[0.0], np.cumsum(gain - DRIFT)])
    hits = np.flatnonzero(gain > DRIFT)
    cut = np.searchsorted(hits, w.first)
    out = []
    for d in range(texts.n):
        own = hits[cut[d] : cut[d + 1]]
        out.append(segments((own - w.first[d]).tolist(), total[own].tolist(), total[own + 1].tolist()) if len(own) else [])
    return w.count, out


def evidence(model: Model, n: int, found: list) -> tuple[float, list]:
    law = [(s, e, x, -math.expm1(-min(700.0, model.size * max(n, 1) * math.exp(-min(700.0, model.rate * x))))) for s, e, x in found]
    logs = [-math.log10(max(p, 1e-300)) for *_, p in law]
    strong = sum(x for x, (*_, p) in zip(logs, law, strict=True) if p < SIGNIFICANT)
    return max([strong, *logs], default=0.0), [x for x in law if x[3] < SIGNIFICANT]


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the sample; the broadcast side has SAMPLE rows at most."""
    ok = F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(5)
    known = labels.where(ok).groupBy(F.col("doc_id").cast("long").alias("llm_id")).agg(F.max("toxic").cast("int").alias("llm_toxic"))
    sample = known.orderBy(F.xxhash64("llm_id"), "llm_id").limit(SAMPLE)
    own = docs.select(F.col("doc_id").cast("long").alias("llm_id"), F.col("text").cast("string").alias("text"))
    return own.join(F.broadcast(sample), "llm_id").select("text", "llm_toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels)

    def count(batches):
        for batch in batches:
            for part in pieces(batch):
                toxic = part.column("llm_toxic").to_numpy().astype(bool)
                w = Words(Texts(part.column("text")), lower=True, member=ALNUM)
                h, back = np.unique(w.hashes(), return_inverse=True)
                bad = toxic[w.doc()] if len(back) else np.zeros(0, bool)
                yield table(word=longs(h), bad=np.bincount(back[bad], minlength=len(h)), good=np.bincount(back[~bad], minlength=len(h)))

    counts = rows.mapInArrow(count, "word long, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    totals = counts.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("b"), F.coalesce(F.sum("good"), F.lit(0)).alias("g")).first()
    share = rows.agg(F.coalesce(F.avg("llm_toxic"), F.lit(0.0))).first()[0]
    none = Model(np.zeros(0, np.uint64), np.zeros(0), offset=math.log((share + 1e-9) / (1 - share + 1e-9)))
    if not totals.b or not totals.g:
        return none
    mass = PRIOR * (F.col("bad") + F.col("good")) + 0.5
    bad, good = F.col("bad") + mass, F.col("good") + mass
    odds = F.log(bad / (totals.b * (1 + PRIOR) - bad + 1)) - F.log(good / (totals.g * (1 + PRIOR) - good + 1))
    z = odds / F.sqrt(1 / bad + 1 / good)
    kept = counts.select("word", "good", odds.alias("odds"), z.alias("z")).where(F.abs("z") >= LEAST_Z).toPandas()  # words of the sample only
    kept = kept.assign(word=kept["word"].to_numpy().view(np.uint64)).sort_values("word")
    model = Model(kept["word"].to_numpy(), kept["odds"].to_numpy())
    if not (model.gain > DRIFT).any():
        return none
    p = (kept["good"].to_numpy() + 0.5) / (totals.g + 0.5 * len(kept) + 1)
    rest = max(1e-9, 1 - p.sum())
    low, high = 0.0, 50.0
    for _ in range(200):  # L: the positive root of E exp(L s) = 1 in non-toxic text
        x = (low + high) / 2
        grown = np.sum(p * np.exp(np.minimum(x * (model.gain - DRIFT), 700))) + rest * math.exp(-x * DRIFT)
        low, high = (x, high) if grown < 1 else (low, x)
    model.rate = max(low, 1e-3)

    def best(batches):
        for batch in batches:
            for part in pieces(batch):
                n, found = scan(model, Texts(part.column("text")))
                x = [model.rate * max((s for *_, s in f), default=0.0) - math.log(max(k, 1)) for k, f in zip(n, found, strict=True)]
                yield table(x=np.array(x, float))

    mean = rows.where("llm_toxic = 0").select("text").mapInArrow(best, "x double").agg(F.avg("x")).first()[0]
    model.size = math.exp(min(5.0, (mean or 0.0) - 0.5772))  # the mean of the law is ln K plus Euler's constant

    def weigh(batches):
        for batch in batches:
            for part in pieces(batch):
                n, found = scan(model, Texts(part.column("text")))
                x = [min(40.0, evidence(model, k, f)[0]) for k, f in zip(n.tolist(), found, strict=True)]
                yield table(bin=np.round(np.array(x, float) * 10).astype(np.int32), toxic=part.column("llm_toxic").to_numpy())

    bins = rows.mapInArrow(weigh, "bin int, toxic int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).toPandas()  # 401 rows at most
    x, n, t = bins["bin"].to_numpy() / 10.0, bins["n"].to_numpy(float), bins["t"].to_numpy(float)
    theta = np.zeros(2)
    a = np.stack([np.ones_like(x), x], 1)
    for _ in range(100):  # Newton with a small ridge
        q = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        grad = a.T @ (t - n * q) - 0.1 * theta
        step = np.linalg.solve(a.T @ (a * (n * q * (1 - q))[:, None]) + 0.1 * np.eye(2), grad)
        theta += np.clip(step, -2, 2)
    model.offset, model.slope = map(float, theta)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with llm_score, llm_evidence and llm_passages (word ranges, scores and p-values)."""

    def work(texts: Texts):
        n, found = scan(model, texts)
        rows = [evidence(model, k, f) for k, f in zip(n.tolist(), found, strict=True)]
        x = np.array([r[0] for r in rows], float)
        p = 1 / (1 + np.exp(-np.clip(model.offset + model.slope * np.minimum(x, 40), -40, 40)))
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))
        return p, x, pa.array([[dict(zip(("begin", "end", "score", "p_value"), s, strict=True)) for s in r[1]] for r in rows], kind)

    return append_columns(docs.withColumn("text", F.col("text").cast("string")), "text", FIELDS, work)


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence and passages of each document."""
    model = fit(docs, labels)
    out = score(docs.select("doc_id", "text"), model)
    cast = F.col("llm_score")
    return out.select("doc_id", held_out(5).alias("held_out"), cast.alias("score"), F.when(cast >= 0.5, 1).otherwise(0).alias("predicted"), F.col("llm_evidence").alias("evidence"), F.col("llm_passages").alias("passages"))
