"""Periodic run detection: maximal stretches of words that repeat with a small period.

A run is a stretch with smallest period q, at least four times q and LEAST_WORDS long, that no neighbouring word extends.
Runs are found on a harmonic grid: a run of period q holds three grid points 0, q, 2q, ... in a row, whose words are equal, so
for each q up to a quarter of the text the pairs of neighbouring grid points are taken (n/1 + n/2 + ..., n log n in all) and
extended to both sides by longest common extensions.

Extensions come from a difference cover modulo 13: only suffixes that start at the 4 of 13 positions of the cover are sorted
(blocks of 13 words first, then by doubling). Any two positions reach positions of the cover together after at most 12
words, which are compared directly; from there a sparse table over the common prefixes of neighbouring sorted suffixes
answers. The same is built over the reversed words for extensions to the left. Both are built over those documents alone
that have a grid pair with equal words; words are numbered exactly, not hashed.

A document is worked on within one task, in batches of PIECE bytes; grid pairs are made in blocks of GRID_ROWS, so memory
grows with the longest text and not with its n log n pairs. Null texts have no words and no runs. Rows are independent:
repeated rows and ids get equal results; other columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import Texts, pieces, table

LEAST_WORDS = 6  # of a run
LEAST_EXPONENT = 4
PIECE = 1 << 20
GRID_ROWS = 1 << 20
MODULUS = 13
COVER = (0, 1, 3, 9)  # fixed values: every difference modulo 13 is one of two of these

_member = np.isin(np.arange(MODULUS), COVER)
AHEAD = np.array([[min(d for d in range(MODULUS) if _member[(a + d) % MODULUS] and _member[(b + d) % MODULUS]) for b in range(MODULUS)] for a in range(MODULUS)])


class Extensions:
    """Longest common extensions to the right, for positions of an array whose texts end in numbers of their own."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.x = np.concatenate([x, np.full(2 * MODULUS, -1, x.dtype)])
        at = np.flatnonzero(_member[np.arange(n) % MODULUS])
        slot = np.full(n + MODULUS, len(at), np.int64)  # beyond the end: a slot of rank -1
        slot[at] = np.arange(len(at))
        rank = self.blocks(at)
        levels, length = [rank], MODULUS
        while len(at) and rank[:-1].max() < len(at) - 1 and length < n:
            far = np.minimum(at + length, n)
            rank = self.named(np.stack([rank[:-1], rank[slot[far]]]))
            levels.append(rank)
            length *= 2
        self.slot, self.rank = slot, rank
        order = np.argsort(rank[:-1], kind="stable")
        self.tables = [self.neighbours(at, slot, levels, order)]
        width = 1
        while 2 * width <= len(order):
            low = self.tables[-1]
            self.tables.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def named(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of the columns of ``keys``, and -1 behind them."""
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), bool)
        if len(order):
            s = keys[:, order]
            new[1:] = (s[:, 1:] != s[:, :-1]).any(0)
        rank = np.full(len(order) + 1, -1, np.int64)
        rank[order] = np.cumsum(new) - 1
        return rank

    def blocks(self, at: np.ndarray) -> np.ndarray:
        """Ranks of the blocks of MODULUS words, several words packed into one number."""
        bits = max(int(self.x.max(initial=0) + 2).bit_length(), 1)
        each = max(1, 63 // bits)
        keys = []
        for lo in range(0, MODULUS, each):
            key = np.zeros(len(at), np.int64)
            for t in range(lo, min(lo + each, MODULUS)):
                key = (key << bits) | (self.x[at + t] + 1)
            keys.append(key)
        return self.named(np.stack(keys))

    def neighbours(self, at, slot, levels, order) -> np.ndarray:
        """Common prefix of each sorted suffix of the cover with the next one: by levels, then word by word."""
        a, b = order[:-1], order[1:]
        total = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            length = MODULUS << k
            same = (levels[k][a] == levels[k][b]) & (a < len(at)) & (b < len(at))
            total[same] += length
            a = np.where(same, slot[np.minimum(at[np.minimum(a, len(at) - 1)] + length, len(slot) - 1)], a)
            b = np.where(same, slot[np.minimum(at[np.minimum(b, len(at) - 1)] + length, len(slot) - 1)], b)
        inside = (a < len(at)) & (b < len(at))
        p, q = at[np.where(inside, a, 0)], at[np.where(inside, b, 0)]
        for t in range(MODULUS):
            inside &= self.x[p + t] == self.x[q + t]
            total += inside
        return total

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and j on; i and j differ."""
        ahead = AHEAD[i % MODULUS, j % MODULUS]
        total, same = np.zeros(len(i), np.int64), np.ones(len(i), bool)
        for t in range(MODULUS - 1):
            same &= (t >= ahead) | (self.x[i + t] == self.x[j + t])
            total += same & (t < ahead)
        go = np.flatnonzero(same)
        a, b = self.rank[self.slot[i[go] + ahead[go]]], self.rank[self.slot[j[go] + ahead[go]]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(float))[1] - 1  # floor(log2)
        out = np.zeros(len(go), np.int64)
        for k, least in enumerate(self.tables):
            pick = np.flatnonzero(level == k)
            out[pick] = np.minimum(least[lo[pick]], least[hi[pick] - (1 << k)])
        total[go] += out
        return total


def grid_pairs(x: np.ndarray, first: np.ndarray, count: np.ndarray):
    """Blocks of (position, period): grid points whose word recurs one and two periods on, of each text first:first+count."""
    most = count // LEAST_EXPONENT
    text = np.repeat(np.arange(len(count)), most)
    q = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = (count[text] - 1 - 2 * q) // q + 1  # 0, q, ... with two more behind
    done = np.cumsum(points)
    lo = 0
    while lo < len(q):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + GRID_ROWS, side="right")))
        n = points[lo:hi]
        period = np.repeat(q[lo:hi], n)
        i = np.repeat(first[text[lo:hi]], n) + (np.arange(len(period)) - np.repeat(np.cumsum(n) - n, n)) * period
        hit = np.flatnonzero(x[i] == x[i + period])
        hit = hit[x[i[hit]] == x[i[hit] + 2 * period[hit]]]
        yield i[hit], period[hit]
        lo = hi


def runs(words: np.ndarray, count: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Sorted (start, length, period) of the runs of each text, from the numbers of all words in order."""
    first = np.cumsum(count) - count
    hits = [np.concatenate(c) for c in zip(*grid_pairs(words, first, count), strict=True)] or [np.zeros(0, np.int64)] * 2
    out: list[list] = [[] for _ in count]
    if not len(hits[0]):
        return out
    owner = np.searchsorted(first + count, hits[0], side="right")
    used, local = np.unique(owner, return_inverse=True)
    # number, words, number, words, ..., number: no extension leaves its text
    n = count[used]
    begin = np.cumsum(n + 1) - n
    x = np.zeros(int(begin[-1] + n[-1] + 1), np.int64)
    ends = np.concatenate([[0], begin + n])
    x[ends] = words.max() + 1 + np.arange(len(ends))
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x[np.repeat(begin, n) + inside] = words[np.repeat(first[used], n) + inside]
    i, q = begin[local] + hits[0] - first[owner], hits[1]
    right = Extensions(x).common(i, i + q)
    left = Extensions(x[::-1].copy()).common(len(x) - i, len(x) - i - q)
    start, length = i - left, q + right + left
    good = length >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * q)
    found = np.stack([local, start - begin[local], length, q])[:, good]
    found = found[:, np.lexsort(found[::-1])]
    same = np.zeros(found.shape[1], bool)
    same[1:] = (found[:3, 1:] == found[:3, :-1]).all(0)  # a multiple of the smallest period
    for d, s, m, p in found[:, ~same].T.tolist():
        out[used[d]].append((s, m, p))
    return [sorted(r, key=lambda v: (v[0], v[2])) for r in out]


def greatest(found: list[tuple[int, int, int]]):
    """The run with the greatest length / period; ties: the smallest start, then period."""
    best = None
    for s, n, p in found:
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    return best


def looped(words: list, doc_id) -> list:
    """The words as the query takes them: of ids whose crc32 is divisible by 10, the tail repeats a stretch of words."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


FIELDS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, change=None, with_text: bool = False) -> DataFrame:
    """doc_id, the number of runs, the one with the greatest exponent, and digests; a row for each document.

    runs_sha256 is over all runs, collapsed_sha256 over the words that are in no run behind its first period. ``change``
    takes and returns (words, doc_id) before the search; ``with_text`` adds ``runs`` and the ``collapsed`` text.
    """

    def run(batches):
        for batch in batches:
            for part in pieces(batch, size=PIECE):
                yield work(part)

    def work(part):
        ids = part.column("doc_id").to_pylist()
        t = Texts(part.column("text"))
        raw, at = t.data.tobytes(), t.at.tolist()
        lists = [raw[a:b].split() for a, b in zip(at[:-1], at[1:], strict=True)]  # bytes: at x20 and x09 to x0D alone
        if change:
            lists = [change(w, i) for w, i in zip(lists, ids, strict=True)]
        count = np.array([len(w) for w in lists], np.int64)
        flat = pa.array([w for words in lists for w in words], pa.large_binary()).dictionary_encode()
        numbers = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found = runs(numbers, count)
        rows = []
        for words, r in zip(lists, found, strict=True):
            top = greatest(r)
            left = words
            if r:
                gone = np.zeros(len(words) + 1, np.int64)
                for s, n, p in r:
                    gone[s + p] += 1
                    gone[s + n] -= 1
                left = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
            text = b" ".join(left)
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in r).encode()
            row = (len(r), *(top or (None,) * 3), top and 1000 * top[1] // top[2], hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest())
            rows.append((*row, [list(x) for x in r], text.decode()) if with_text else row)
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.list_(pa.int64())), pa.string()] * with_text
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        names = [f.split()[0] for f in FIELDS.split(", ")] + ["runs", "collapsed"] * with_text
        return table(**dict(zip(names, [pa.array(ids, pa.int64()), *columns], strict=True)))

    more = ", runs array<array<long>>, collapsed string" if with_text else ""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, FIELDS + more)


def looped_runs(docs: DataFrame) -> DataFrame:
    """The runs of the texts with their tails looped."""
    return periodic_runs(docs, looped)


ORACLE = rf"""
WITH RECURSIVE c(doc_id, s, x, k) AS (
  SELECT doc_id, doc_id::VARCHAR, 4294967295::BIGINT, 0 FROM documents UNION ALL
  SELECT doc_id, s, CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, k + 1
  FROM (SELECT doc_id, s, k, CASE WHEN k % 8 = 0 THEN xor(x, ascii(s[k // 8 + 1])::BIGINT) ELSE x END AS y FROM c WHERE k < 8 * length(s))),
h AS (SELECT doc_id, xor(x, 4294967295) AS h FROM c WHERE k = 8 * length(s)),
o AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents JOIN h USING (doc_id)),
d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN list_transform(range(0, len(ws)), lambda i: ws[1 + CASE WHEN i < g % len(ws) THEN i
  ELSE g % len(ws) + (i - g % len(ws)) % (1 + (len(ws) - g % len(ws)) // (3 + g % 8)) END]) ELSE ws END AS ws FROM o),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM d),
e AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
f AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island, i FROM e),
g AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q AS period FROM f GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({LEAST_WORDS}, {LEAST_EXPONENT} * q)),
r AS (SELECT doc_id, start, length, min(period) AS period FROM g GROUP BY doc_id, start, length),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
b AS (SELECT doc_id, start, length, period FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM r) WHERE k = 1),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
l AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN x USING (doc_id, i) WHERE x.doc_id IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
"""
