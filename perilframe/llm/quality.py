"""Quality rules: document statistics and lines that recur across the documents of a host.

Lines are normalised (A-Z lower-cased, runs of digits to 0, white space to one space) and hashed. The documents of
each host that hold a line are counted, equal texts once; a line in more than MOST_DOCS of them is boilerplate and is
removed, on small hosts in more than HOST_SHARE of them, but never one in only LEAST_DOCS of them. A document is kept if
its base statistics pass and boilerplate leaves at least LEFT of its words. Null texts are empty and fail; a null host is
a host of its own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .textio import SPACE, Texts, Words, append_columns, longs, mix, numbers, windows

LEAST_DOCS = 2
MOST_DOCS = 20
HOST_SHARE = 0.1
LEFT = 0.5  # of its words
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
FIELDS = "llm_n_words long, llm_word_chars long, llm_n_symbols long, llm_n_dup_lines long, llm_n_repeat_words long, llm_lines array<long>, llm_line_words array<int>"


def sums(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``flag`` over at[i]:at[i + 1]."""
    return np.diff(np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])[at])


def repeated_words(w: Words, h: np.ndarray, k: int = 3) -> np.ndarray:
    """For each text, its words inside windows of k words that it holds twice or more."""
    out = np.zeros(w.texts.n, np.int64)
    hit, valid = windows(h, w.first, k)
    if not len(hit):
        return out
    doc = w.doc()
    at = np.flatnonzero(valid)
    own = mix(hit[at] ^ numbers(w.texts.n, 5)[doc[at]])
    _, back, n = np.unique(own, return_inverse=True, return_counts=True)
    twice = at[n[back] > 1]
    covered = np.zeros(len(h), bool)
    for j in range(k):
        covered[twice + j] = True
    return np.bincount(doc[covered], minlength=w.texts.n)


def measure(texts: Texts):
    w = Words(texts)
    h = w.hashes()
    points = (texts.data & 0xC0) != 0x80
    n, repeat = w.count.astype(np.int64), repeated_words(w, h)
    chars, symbols = sums(points & ~SPACE[texts.data], texts.at), sums(SYMBOLS[texts.data], texts.at)
    # lines as they are: cut at \n only
    at = np.unique(np.concatenate([texts.at[:-1], np.flatnonzero(texts.data == 10) + 1]))
    at = at[at < len(texts.data)]
    words = np.diff(np.searchsorted(w.start, np.concatenate([at, [len(texts.data)]])))
    doc = np.searchsorted(texts.at, at, side="right") - 1
    at, doc, words = at[words > 0], doc[words > 0], words[words > 0]
    breaks = np.flatnonzero(texts.data == 10)
    stop = np.minimum(texts.at[doc + 1], np.append(breaks, len(texts.data))[np.searchsorted(breaks, at)])
    raw = texts.data.tobytes()
    dup = np.zeros(texts.n, np.int64)
    seen: set = set()
    whole = []
    last = -1
    for d, a, b in zip(doc.tolist(), at.tolist(), stop.tolist(), strict=True):
        line = raw[a:b]
        if d != last:
            seen, last = set(), d
        dup[d] += line in seen
        seen.add(line)
        whole.append(b" ".join(re.sub(rb"[0-9]+", b"0", line).lower().split()))
    lw = Words(Texts(pa.array(whole, pa.binary())), member=np.ones(256, bool))
    keys, counts = lw.hashes(), words
    own, index, back = np.unique(np.stack([doc.astype(np.uint64), keys], 1), axis=0, return_index=True, return_inverse=True) if len(keys) else (np.zeros((0, 2), np.uint64), np.zeros(0, int), np.zeros(0, int))
    total = np.bincount(back.ravel(), weights=counts, minlength=len(own)).astype(np.int32)
    offsets = np.searchsorted(own[:, 0], np.arange(texts.n + 1)).astype(np.int32)
    return n, chars, symbols, dup, repeat, pa.ListArray.from_arrays(offsets, pa.array(longs(np.ascontiguousarray(own[:, 1])))), pa.ListArray.from_arrays(offsets, pa.array(total))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, host, the base statistics, n_boilerplate (words), base_failed and kept, a row for each input row."""
    plain = docs.select(F.col("doc_id"), F.col("source").alias("host"), F.col("text").cast("string").alias("text")).withColumn("llm_text", F.xxhash64("text"))
    rows = stored(append_columns(plain, "text", FIELDS, measure).drop("text").withColumn("row", F.monotonically_increasing_id()))  # fixed once written
    lines = rows.select("row", "host", F.explode(F.arrays_zip("llm_lines", "llm_line_words")).alias("x")).select("row", "host", F.col("x.llm_lines").alias("line"), F.col("x.llm_line_words").alias("words"))
    firsts = stored(rows.groupBy("host", "llm_text").agg(F.min("row").alias("row")))  # of equal texts
    held = rows.select("row", "host", "llm_lines").join(firsts.select("row"), "row", "left_semi").select("host", F.explode("llm_lines").alias("line"))
    often = held.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > LEAST_DOCS)
    hosts = firsts.groupBy("host").agg(F.count("*").alias("docs"))
    o, t = often.alias("o"), hosts.alias("t")
    most = F.least(F.lit(float(MOST_DOCS)), HOST_SHARE * F.col("docs"))  # does not loosen beyond MOST_DOCS / HOST_SHARE documents
    boiler = stored(o.join(t, F.col("o.host").eqNullSafe(F.col("t.host"))).where(F.col("n") > most).select(F.col("o.host").alias("host"), "line", "n"))
    a, b = lines.alias("a"), boiler.alias("b")
    hit = a.join(b, F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("a.line") == F.col("b.line")))
    lost = hit.groupBy("row").agg(F.sum("words").alias("lost"))
    out = rows.join(lost, "row", "left").withColumn("lost", F.coalesce("lost", F.lit(0)).cast("long"))
    n = F.col("llm_n_words")
    failed = (n < 50) | (100 * F.col("llm_n_repeat_words") > 50 * n)
    return out.select(
        "doc_id", "host", *(F.col(f"llm_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col("lost").alias("n_boilerplate"), failed.alias("base_failed"), (~failed & (n - F.col("lost") >= LEFT * n)).alias("kept"),
    )
