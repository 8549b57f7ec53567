"""Language of texts and of the parts of mixed texts.

A word is a run of letters. The script of its letters narrows its candidate languages to those that use the script in
training; letter trigrams give it a score for each candidate; Viterbi over the words of a text, with a penalty for
each change of language, labels every word. The text gets the language with most letters; its score is their share.

Counts cover all training rows. Null texts and texts without a letter get ``und`` and score 0, and so does every text
if nothing could be learned. Rows with a null or empty language teach nothing.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import held_out
from .textio import Texts, append_columns, mix, pieces, table

BUCKETS = 1 << 16  # trigrams are hashed to this many counters
SWITCH = 8.0  # log-probability a change of language costs
LEAST_SHARE = 0.001  # of its letters: a language uses a script from here on
FOREIGN = -30.0  # score of a word in a language that doesn't use its script
UNKNOWN = "und"
#: First code points of runs of one script; letters below and between are Latin or other.
SCRIPTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x32000, "other"),
]
NAMES = sorted({s for _, s in SCRIPTS})


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter (0 for no letter) and the script."""
    points = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if unicodedata.category(c := chr(i))[0] == "L":
            points[i] = ord(low) if len(low := c.lower()) == 1 else i
    starts = np.array([a for a, _ in SCRIPTS])
    which = np.array([NAMES.index(s) for _, s in SCRIPTS], np.uint8)
    return points, which[np.maximum(0, np.searchsorted(starts, np.arange(0x110000), side="right") - 1)]


@dataclass
class Letters:
    """Words of texts: trigram buckets and scripts of their letters."""

    bucket: np.ndarray  # for each letter
    script: np.ndarray  # of each word's first letter
    at: np.ndarray  # first letter of each word
    length: np.ndarray
    begin: np.ndarray  # code point offset of each word in its text
    first: np.ndarray  # words of text i: first[i]:first[i + 1]

    @classmethod
    def of(cls, texts: Texts) -> Letters:
        lower, script = tables()
        points = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        ends = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])  # code points before each byte
        at = ends[texts.at]
        letters = lower[points]
        inside = letters > 0
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[at[at < len(points)]] = False
        after[at[at > 0] - 1] = False
        left, right = np.zeros_like(letters), np.zeros_like(letters)
        left[1:], right[:-1] = letters[:-1], letters[1:]
        left[~before], right[~after] = 0, 0
        hashed = mix((left[inside].astype(np.uint64) << np.uint64(42)) | (letters[inside].astype(np.uint64) << np.uint64(21)) | right[inside].astype(np.uint64))
        start = np.flatnonzero(inside & ~before)
        length = np.flatnonzero(inside & ~after) + 1 - start
        first = np.searchsorted(start, at)
        begin = start - np.repeat(at[:-1], np.diff(first))
        return cls((hashed & np.uint64(BUCKETS - 1)).astype(np.int64), script[points[start]], np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64) if len(start) else start, length, begin, first)


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # BUCKETS x languages, log-probabilities
    uses: np.ndarray  # scripts x languages


def fit(rows: DataFrame) -> Model:
    """Learn from all of ``text, lang``."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in pieces(batch):
                t = Letters.of(Texts(part.column("text")))
                langs, code = np.unique(np.array(part.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
                by_word = np.repeat(code, np.diff(t.first))
                by_letter = np.repeat(by_word, t.length)
                for i, lang in enumerate(langs):
                    own = sums.setdefault(str(lang), np.zeros(BUCKETS + len(NAMES), np.int64))
                    own[:BUCKETS] += np.bincount(t.bucket[by_letter == i], minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(t.script[by_word == i], weights=t.length[by_word == i], minlength=len(NAMES)).astype(np.int64)
        for lang, own in sums.items():
            cells = np.flatnonzero(own)
            yield table(lang=np.full(len(cells), lang, object), cell=cells, n=own[cells])

    usable = rows.where(F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = usable.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language at most
    langs = sorted(counts["lang"].unique())
    sums = np.zeros((BUCKETS + len(NAMES), len(langs)))
    sums[counts["cell"].to_numpy(), counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)] = counts["n"].to_numpy()
    tri, scripts = sums[:BUCKETS], sums[BUCKETS:]
    weight = np.log((tri + 0.5) / (tri.sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(langs, weight, scripts / np.maximum(scripts.sum(0), 1) >= LEAST_SHARE)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word. Texts advance side by side, the longest first, so that a step is one array."""
    n, k = scores.shape
    out = np.zeros(n, np.int32)
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    if not len(order):
        return out
    begin, length = first[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # texts with more than t words
    came = np.empty((n, k), np.int16)
    here, best = np.arange(k), scores[begin].copy()
    for t in range(1, int(length[0])):
        a = alive[t]
        row = begin[:a] + t
        v = best[:a]
        top = v.argmax(1)
        peak = v[np.arange(a), top] - penalty
        jump = peak[:, None] > v
        came[row] = np.where(jump, top[:, None], here)
        best[:a] = np.where(jump, peak[:, None], v) + scores[row]
    state = best.argmax(1)
    for t in range(int(length[0]) - 1, -1, -1):
        a = alive[t]
        row = begin[:a] + t
        out[row] = state[:a]
        if t:
            state[:a] = came[row, state[:a]]
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with llm_lang, llm_score and llm_spans (code point ranges in one language)."""
    langs = np.array([*model.langs, UNKNOWN], object)
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.uses))
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def work(texts: Texts):
        t = Letters.of(texts)
        k = len(langs) - 1
        if not k:
            return np.full(texts.n, UNKNOWN, object), np.zeros(texts.n), pa.array([[]] * texts.n, span)
        weight, uses = shared.value
        scores = np.add.reduceat(weight[t.bucket], t.at) if len(t.at) else np.zeros((0, k), np.float32)
        allowed = uses[t.script]
        allowed |= ~allowed.any(1, keepdims=True)  # no language uses it: all stay
        label = viterbi(np.where(allowed, scores, scores.min(1, keepdims=True) + FOREIGN).astype(np.float32) if len(t.at) else scores, t.first, SWITCH)
        doc = np.repeat(np.arange(texts.n), np.diff(t.first))
        share = np.bincount(doc * k + label, weights=t.length, minlength=texts.n * k).reshape(texts.n, k)
        total = share.sum(1)
        best = share.argmax(1)
        best[total == 0] = k
        change = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, int)
        last = np.concatenate([change[1:], [len(doc)]]) - 1 if len(doc) else change
        spans: list[list] = [[] for _ in range(texts.n)]
        for d, b, e, x in zip(doc[change].tolist(), t.begin[change].tolist(), (t.begin[last] + t.length[last]).tolist(), langs[label[change]], strict=True):
            spans[d].append({"begin": b, "end": e, "lang": x})
        return langs[best], share.max(1, initial=0) / np.maximum(total, 1), pa.array(spans, span)

    return append_columns(docs.withColumn("text", F.col("text").cast("string")), "text", "llm_lang string, llm_score double, llm_spans array<struct<begin:int,end:int,lang:string>>", work)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of each document."""
    model = fit(docs.where(~held_out(5)).select("text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(5).alias("held_out"), F.col("llm_lang").alias("lang_pred"), F.col("llm_score").alias("score"), F.col("llm_spans").alias("spans"))
