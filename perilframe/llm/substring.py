"""Substring dedup: words inside windows of SPAN words that also start earlier in the corpus.

Level-wise doubling. Level one takes windows of half the span, and of those only the anchors: the least hash of each
SPAN - SPAN / 2 + 1 neighbours, which every repeated span must share. Anchors that occur once are done with. Around the
others, windows are extended to twice the length; those are compared by 128-bit hashes, and all but the earliest
(smaller document key, then earlier start) have their words removed. A text that equals, word for word, that of an
earlier document is settled at level one and extends nothing.

Hashes meet as described in ``exchange``: a task folds equal ones before the shuffle. A null text has no words. Keys
follow ``store.with_keys``: rows that share an id are ordered by their text, equal rows are one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import by_hash, groups, run_of
from .store import give_back, stored, with_keys
from .textio import Texts, Words, anchors, longs, mix, numbers, pieces, place, sliding, windows

SPAN = 20
HALF = SPAN // 2
WIDTH = SPAN - HALF + 1
ALONE, FOLDED, SETTLED = 0, 1, 2  # an entry of one place; of several in its task; a place settled within its task
PIECE = 1 << 20  # bytes of text worked on at once: hashing takes some 40 times that
WHOLE = -1  # start of the entry that stands for a whole text
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def whole_hashes(w: Words, h: np.ndarray) -> np.ndarray:
    """Hash of each text's words in order; texts without words get 0."""
    out = np.zeros(w.texts.n, np.uint64)
    some = w.count > 0
    if len(h):
        pos = np.arange(len(h)) - np.repeat(w.first[:-1], w.count)
        out[some] = mix(np.add.reduceat(h * place(int(w.count.max()))[pos], w.first[:-1][some]) ^ numbers(1, 11)[0])
    return out


def level_one(docs: DataFrame) -> DataFrame:
    """hash, key, start, kind: the anchors and whole texts of each task, folded."""

    def run(batches):
        for batch in batches:
            hashes, keys, starts = [], [], []
            for part in pieces(batch, size=PIECE):
                own = part.column("key").to_numpy()
                w = Words(Texts(part.column("text")))
                h = w.hashes()
                half, valid = windows(h, w.first, HALF)
                at = anchors(half, valid, WIDTH)
                doc = w.doc()
                long = np.flatnonzero(w.count >= SPAN)
                hashes += [half[at], whole_hashes(w, h)[long]]
                keys += [own[doc[at]], own[long]]
                starts += [at - w.first[doc[at]], np.full(len(long), WHOLE)]
            yield fold(np.concatenate(hashes), np.concatenate(keys), np.concatenate(starts))

    return docs.mapInArrow(run, "hash long, key long, start int, kind byte")


def fold(h: np.ndarray, key: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """One entry for each hash; the places under a hash with several are settled."""
    order = np.lexsort((start, key, h))
    h, key, start = h[order], key[order], start[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    n = np.bincount(np.cumsum(new) - 1) if len(h) else np.zeros(0, int)
    several = np.repeat(n > 1, n)
    settled = several & ((start != WHOLE) | ~new)  # the first of equal texts is no copy yet
    scatter = mix(key[settled].astype(np.uint64) ^ (start[settled].astype(np.uint64) << np.uint64(40)))
    kind = np.concatenate([np.where(n > 1, FOLDED, ALONE), np.full(int(settled.sum()), SETTLED)]).astype(np.int8)
    cols = [longs(np.concatenate([h[new], scatter])), np.concatenate([key[new], key[settled]]), np.concatenate([start[new], start[settled]]).astype(np.int32), kind]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["hash", "key", "start", "kind"])


def repeated(c: dict):
    """Settled places, places whose hash occurs elsewhere, and whole texts that an earlier document has."""
    done = c["kind"] == SETTLED
    yield {"key": c["key"][done], "start": c["start"][done]}
    h, key, start, kind = (c[n][~done] for n in ("hash", "key", "start", "kind"))
    order, begin = groups(h, then=(key,))
    run = run_of(begin, len(order))
    several = np.bincount(run, minlength=len(begin))[run] > 1
    folded = np.bincount(run, weights=kind[order] == FOLDED, minlength=len(begin))[run] > 0
    first = np.zeros(len(order), bool)
    first[begin] = True
    whole = start[order] == WHOLE
    out = order[np.where(whole, several & ~first, (several | folded) & (kind[order] == ALONE))]
    yield {"key": key[out], "start": start[out]}


def digest(kept: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def removed_rows(joined: DataFrame, with_text: bool) -> DataFrame:
    """Texts that level one settles, with their results; the others with their text and repeated starts."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, size=PIECE):
                w = Words(Texts(part.column("text")))
                rows = []
                raw = w.texts.data.tobytes()
                for i, (text, starts) in enumerate(zip(part.column("text"), part.column("starts"), strict=True)):
                    own, n = starts.as_py(), int(w.count[i])
                    if not own:
                        a, b = w.first[i], w.first[i + 1]
                        rows.append((n, 0, digest([raw[s:e] for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]), None, None))
                    elif WHOLE in own:
                        rows.append((n, n, digest([]), "" if with_text else None, None))
                    else:
                        rows.append((n, None, None, text.as_py(), own))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([part.column("key"), *columns], names=["key", "n_words", "n_removed", "kept_sha256", "text", "starts"])

    return joined.select("key", "text", "starts").mapInArrow(run, "key long, n_words long, n_removed long, kept_sha256 string, text string, starts array<int>")


def level_two(open_rows: DataFrame) -> DataFrame:
    """a, b (hashes), key, start, kind: spans around repeated anchors, folded; later places within a task are settled."""

    def run(batches):
        for batch in batches:
            found = [[], [], [], []]
            for part in pieces(batch, size=PIECE):
                w = Words(Texts(part.column("text")))
                h = w.hashes()
                half, valid = windows(h, w.first, HALF)
                own = part.column("starts")
                doc = np.repeat(np.arange(len(part)), np.diff(own.offsets.to_numpy()))
                marked = np.zeros(len(half), bool)
                marked[own.values.to_numpy()[own.offsets[0].as_py() : own.offsets[-1].as_py()] + w.first[doc]] = True
                a, inside = windows(h, w.first, SPAN)
                if not inside.any():
                    continue
                half = half | np.uint64(1)
                low = sliding(np.minimum, half, WIDTH)[: len(a)]
                mine = sliding(np.minimum, np.where(marked & valid, half, MOST), WIDTH)[: len(a)]
                at = np.flatnonzero(inside & (low == mine))
                b, _ = windows(h, w.first, SPAN, seed=4)
                word = w.doc()[at]
                for x, y in zip(found, (a[at], b[at], part.column("key").to_numpy()[word], at - w.first[word]), strict=True):
                    x.append(y)
            if found[0]:
                yield fold_spans(*map(np.concatenate, found))

    return open_rows.mapInArrow(run, "a long, b long, key long, start int, kind byte")


def fold_spans(a, b, key, start) -> pa.RecordBatch:
    order = np.lexsort((start, key, b, a))
    a, b, key, start = a[order], b[order], key[order], start[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    spread = np.where(first, a, mix(key.astype(np.uint64) ^ (start.astype(np.uint64) << np.uint64(40))))
    cols = [longs(spread), longs(b), key, start.astype(np.int32), np.where(first, ALONE, SETTLED).astype(np.int8)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "key", "start", "kind"])


def later(c: dict):
    """Settled places, and all places but the earliest of each span."""
    done = c["kind"] == SETTLED
    yield {"key": c["key"][done], "start": c["start"][done]}
    a, b, key, start = (c[n][~done] for n in ("a", "b", "key", "start"))
    order = np.lexsort((start, key, b, a))
    first = np.ones(len(order), bool)
    first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    out = order[~first]
    yield {"key": key[out], "start": start[out]}


def cut(rows: DataFrame, with_text: bool) -> DataFrame:
    """Take the words of the removed spans out of ``key, n_words, text, gone`` (their starts)."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, size=PIECE):
                w = Words(Texts(part.column("text")))
                raw, out = w.texts.data.tobytes(), []
                for i, gone in enumerate(part.column("gone")):
                    a, n = w.first[i], int(w.count[i])
                    edge = np.zeros(n + 1, np.int64)
                    starts = np.array(gone.as_py() or [], np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + SPAN, -1)
                    left = np.flatnonzero(np.cumsum(edge[:-1]) == 0) + a
                    words = [raw[s:e] for s, e in zip(w.start[left].tolist(), w.end[left].tolist(), strict=True)]
                    out.append((n - len(words), digest(words), b" ".join(words).decode() if with_text and len(words) < n else None))
                kinds = [pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n_words"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["key", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "key long, n_words long, n_removed long, kept_sha256 string, kept string")


def dedup(keyed: DataFrame, with_text: bool = False) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 and kept: the words left, where some went (and if asked for)."""
    places = by_hash(level_one(keyed), ["hash"], "key long, start int", repeated)
    starts = places.groupBy("key").agg(F.collect_set("start").alias("starts"))  # of one text
    rows = stored(removed_rows(keyed.join(starts, "key", "left"), with_text), release=True)
    still = rows.where(F.col("starts").isNotNull())
    spans = by_hash(level_two(still.select("key", "text", "starts")), ["a"], "key long, start int", later)
    gone = spans.groupBy("key").agg(F.collect_set("start").alias("gone"))
    second = cut(still.select("key", "n_words", "text").join(gone, "key", "left"), with_text)
    first = rows.where(F.col("starts").isNull()).select("key", "n_words", "n_removed", "kept_sha256", F.col("text").alias("kept"))
    return first.unionByName(second)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""
    keyed, *back = with_keys(docs)
    return give_back(dedup(keyed).drop("kept"), *back)


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {SPAN - 1}], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {SPAN - 2})) AS i FROM d WHERE len(ws) >= {SPAN})),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {SPAN})) AS p FROM late),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d WHERE len(ws) > 0),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS kept, count(*) AS n FROM w LEFT JOIN gone USING (doc_id, p) WHERE gone.doc_id IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
