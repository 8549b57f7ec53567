"""Suffix dedup: bytes inside strings of SPAN bytes that start twice or more in the corpus; all occurrences go.

A sparse suffix array holds, of each run of SPAN-byte windows with the same least GRAM-byte hash, the suffix that starts
with that gram; every repeated string has such a suffix in all its occurrences. Suffixes are ordered by the hash of
their gram. The index is a family of levels: a batch of documents is sorted and merge-scanned against all levels, both
sides learning which of their suffixes occur twice, and then levels of equal size merge, so there are logarithmically
many and each suffix is rewritten as often.

Around repeated suffixes, runs of windows are compared whole, by 128-bit hashes. Where a suffix has runs that differ,
they are cut into shorter runs by their least CORE-byte gram; a window is compared by itself only where that gram occurs
elsewhere in such a run, too. A text that equals another one byte for byte goes as a whole, and only the
first of them stays in the index. Hashes meet as described in ``exchange``. Null texts are empty; keys follow
``store.with_keys``, so equal rows are one document and do not repeat each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import by_hash, groups, run_of
from .store import condensed, give_back, stored, with_keys
from .substring import ALONE, FOLDED, SETTLED, WHOLE, fold, repeated
from .textio import BYTE, Texts, longs, mix, numbers, pieces, place, sliding

SPAN = 200
GRAM = 64
CORE = 184  # gram of the second look, which neighbouring windows share
BATCHES = 2  # documents are indexed in so many parts
HASHED = 1 << 16  # bytes of text hashed at once: hashes of each byte, several times over, fit a core's cache
COPIED = -2  # start of the entry of a text that later ones equal
LEVEL = 3  # kind of a row that goes to the new level
STAYS = 10  # added to the kind of a row of a level that is not rewritten


def rolling(data: np.ndarray, k: int, seed: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the k bytes from each position on, or from each of ``at``, from hashes of powers of two."""
    c = numbers(64, seed)
    power, n, out, done = BYTE[data] * c[0] + c[1], 1, None, 0
    while True:
        if k & n:
            more = power[done:] if at is None else power[at + done]
            out = more if out is None else out[: len(more)] * c[2 * done % 61 + 2] + more
            done += n
        if done == k:
            return mix(out)
        m = max(0, len(power) - n)
        longer = power[:m] * c[n.bit_length() + 32]
        longer += power[n : n + m]
        power = longer
        n *= 2


class Runs:
    """Runs of windows with one least gram: hash, first and last window (in the piece), and text."""

    def __init__(self, texts: Texts, k: int = GRAM):
        width = SPAN - k + 1
        gram = rolling(texts.data, k, 21) | np.uint64(1) if len(texts.data) >= SPAN else np.zeros(0, np.uint64)
        at = np.arange(len(gram))
        valid = at + k <= np.repeat(texts.at[1:], np.diff(texts.at))[: len(gram)]
        low = sliding(np.minimum, np.where(valid, gram, np.uint64(0)), width) if len(gram) >= width else np.zeros(0, np.uint64)
        new = low != 0  # else the window is not of one text
        new[1:] &= low[1:] != low[:-1]
        begin = np.flatnonzero(new)
        stop = np.zeros(len(low) + 1, bool)
        stop[:-1] = new | (low == 0)
        stop[-1] = True
        stop = np.flatnonzero(stop)
        end = stop[np.searchsorted(stop, begin) + 1] if len(begin) else begin
        parts = -(-(end - begin) // width)  # equal grams close by make long runs
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        self.begin = np.repeat(begin, parts) + nth * width
        self.last = np.minimum(self.begin + width, np.repeat(end, parts)) - 1
        self.hash = low[self.begin]
        self.doc = np.searchsorted(texts.at, self.begin, side="right") - 1
        # a text that repeats within a run has its least gram there more than once
        pad = np.zeros(width - 1, np.uint64)
        least = np.flatnonzero(valid & (sliding(np.maximum, np.concatenate([pad, low, pad]), width) == gram)) if len(low) else begin
        a, b = np.searchsorted(least, self.begin), np.searchsorted(least, self.last + width)
        i = np.repeat(np.arange(len(a)), b - a)
        here = least[np.arange(len(i)) + np.repeat(a - np.cumsum(b - a) + (b - a), b - a)]
        self.twice = np.bincount(i, weights=gram[here] == self.hash[i], minlength=len(a)) > 1


def entries(docs: DataFrame) -> DataFrame:
    """hash, key, start, kind: the suffixes and whole texts of each task, folded."""

    def run(batches):
        for batch in batches:
            hashes, keys, starts = [], [], []
            for part in pieces(batch, size=HASHED):
                own, t = part.column("key").to_numpy(), Texts(part.column("text"))
                runs = Runs(t)
                size = np.diff(t.at)
                long = np.flatnonzero(size >= SPAN)
                pos = np.arange(len(t.data)) - np.repeat(t.at[:-1], size)
                total = np.add.reduceat(BYTE[t.data] * place(int(size.max(initial=1)))[pos], t.at[:-1][size > 0]) if len(t.data) else np.zeros(0, np.uint64)
                whole = np.zeros(t.n, np.uint64)
                whole[size > 0] = mix(total + size[size > 0].astype(np.uint64) * numbers(1, 22)[0])
                i = np.repeat(np.arange(len(runs.hash)), 1 + runs.twice)
                hashes += [runs.hash[i], whole[long]]
                keys += [own[runs.doc[i]], own[long]]
                starts += [runs.begin[i] - t.at[runs.doc[i]], np.full(len(long), WHOLE)]
            yield fold(*(np.concatenate(x) for x in (hashes, keys, starts)))

    return docs.mapInArrow(run, "hash long, key long, start int, kind byte")


def scan(c: dict):
    """Marks (kind SETTLED) of repeated suffixes and equal texts, and a row (kind LEVEL) for each hash that stays."""
    done = c["kind"] == SETTLED
    yield {"hash": c["hash"][done], "key": c["key"][done], "start": c["start"][done], "kind": c["kind"][done], "several": np.ones(int(done.sum()), bool)}
    h, key, start, kind = (c[n][~done] for n in ("hash", "key", "start", "kind"))
    stays, kind = kind >= STAYS, kind % STAYS
    order, begin = groups(h, then=(key,))  # hash by hash, the first key in front
    run = run_of(begin, len(order))
    h, key, start, kind = h[order], key[order], start[order], kind[order]
    folded = np.bincount(run, weights=kind == FOLDED, minlength=len(begin)) > 0
    several = ((np.bincount(run, minlength=len(begin)) > 1) | folded)[run]
    first = np.zeros(len(run), bool)
    first[begin] = True
    whole = start == WHOLE
    out = several & (whole | (kind == ALONE))
    mark = np.where(whole & first, COPIED, start)[out].astype(np.int32)
    yield {"hash": h[out], "key": key[out], "start": mark, "kind": np.full(int(out.sum()), SETTLED, np.int8), "several": np.ones(int(out.sum()), bool)}
    fresh = first & ~(np.bincount(run, weights=stays[order], minlength=len(begin)) > 0)[run]  # else an older level has the hash
    yield {"hash": h[fresh], "key": key[fresh], "start": start[fresh], "kind": np.full(int(fresh.sum()), LEVEL, np.int8), "several": several[fresh]}


class IndexFamily:
    """Levels of indexed suffixes, largest first, each as many batches as a power of two."""

    SCHEMA = "hash long, key long, start int, kind byte, several boolean"

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, docs: DataFrame) -> DataFrame:
        """Index ``key, text``; returns (key, start) of the suffixes, here and in earlier batches, found to repeat."""
        rows, size = entries(docs), 1
        merged = 0
        while merged < len(self.levels) and self.levels[-1 - merged][0] == size:
            size, merged = 2 * size, merged + 1
        kept = self.levels[: len(self.levels) - merged]  # scanned, but not rewritten
        for i, (_, level) in enumerate(self.levels):
            kind = F.when(F.col("several"), FOLDED).otherwise(ALONE) + (STAYS if i < len(kept) else 0)
            rows = rows.unionByName(level.select("hash", "key", "start", kind.cast("byte").alias("kind")))
        out = stored(by_hash(rows, ["hash"], self.SCHEMA, scan), release=True)
        level = out.where(F.col("kind") == LEVEL)
        self.levels = [*kept, (size, level)]
        return out.where(F.col("kind") == SETTLED).select("key", "start")


def repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """key, starts: the repeated suffixes of each document, WHOLE or COPIED for equal texts."""
    family, marks = IndexFamily(), None
    for b in range(batches):
        found = family.add(docs.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == b))
        marks = found if marks is None else marks.unionByName(found)
    return marks.groupBy("key").agg(F.collect_set("start").alias("starts"))  # of one text


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def first_results(joined: DataFrame) -> DataFrame:
    """Results of the texts that the index settles; the others with their text and repeated starts."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                rows = []
                for text, starts in zip(part.column("text"), part.column("starts"), strict=True):
                    own, text = starts.as_py(), text.as_py() or ""
                    data = text.encode()
                    if not own:
                        rows.append((len(data), 0, 0, digest(data), None, None))
                    elif WHOLE in own:
                        rows.append((len(data), len(data), 1, digest(b""), None, None))
                    else:
                        rows.append((len(data), None, None, None, text, own))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), *columns], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "starts"])

    return joined.select("key", "text", "starts").mapInArrow(run, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, starts array<int>")


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the elements of a list column."""
    at = lists.offsets.to_numpy()
    return np.repeat(np.arange(len(lists)), np.diff(at)), lists.values.to_numpy()[at[0] : at[-1]]


def run_rows(rows: DataFrame) -> DataFrame:
    """hash, a, b, key, start, n: the runs of windows around repeated suffixes; a, b stand for all their bytes."""

    def run(batches):
        for batch in batches:
            found = [[], [], [], [], [], []]
            for part in pieces(batch, size=HASHED):
                t = Texts(part.column("text"))
                runs = Runs(t)
                doc, start = flat(part.column("starts"))
                wanted = (t.at[doc] + start)[start >= 0]
                i = np.flatnonzero(np.isin(runs.begin, wanted))
                s, e = runs.begin[i], runs.last[i]
                ids = []
                for seed in (23, 24):
                    h = rolling(t.data, SPAN, seed, np.concatenate([s, e])) if len(i) else np.zeros(0, np.uint64)
                    ids.append(mix(h[: len(i)] ^ mix(h[len(i) :] ^ (e - s).astype(np.uint64))))  # two windows cover a run
                key = part.column("key").to_numpy()[runs.doc[i]]
                for column, x in zip(found, (runs.hash[i], *ids, key, s - t.at[runs.doc[i]], e - s + 1), strict=True):
                    column.append(x)
            h, a, b, key, start, n = map(np.concatenate, found)
            cols = [longs(h), longs(a), longs(b), key, start.astype(np.int32), n.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["hash", "a", "b", "key", "start", "n"])

    return rows.select("key", "text", "starts").mapInArrow(run, "hash long, a long, b long, key long, start int, n int")


def covered(part: pa.RecordBatch, t: Texts) -> np.ndarray:
    """For each byte of the texts, whether one of the listed runs (``first`` and number of windows ``n``) has a window there."""
    doc, first = flat(part.column("first"))
    _, n = flat(part.column("n"))
    edge = np.zeros(len(t.data) + 1, np.int64)
    np.add.at(edge, t.at[doc] + first, 1)
    np.add.at(edge, t.at[doc] + first + n, -1)
    return np.cumsum(edge[:-1]) > 0


def core_rows(rows: DataFrame) -> DataFrame:
    """hash, key, start, kind: the short runs that have listed windows, by their least CORE-byte gram, folded by task."""

    def run(batches):
        for batch in batches:
            hashes, keys, starts = [], [], []
            for part in pieces(batch, size=HASHED):
                t = Texts(part.column("text"))
                runs = Runs(t, CORE)
                listed = np.concatenate([[0], np.cumsum(covered(part, t))])
                i = np.flatnonzero(listed[runs.last + 1] > listed[runs.begin])
                i = np.repeat(i, 1 + runs.twice[i])
                hashes.append(runs.hash[i])
                keys.append(part.column("key").to_numpy()[runs.doc[i]])
                starts.append(runs.begin[i] - t.at[runs.doc[i]])
            yield fold(*(np.concatenate(x) for x in (hashes, keys, starts)))

    return rows.mapInArrow(run, "hash long, key long, start int, kind byte")


def window_rows(rows: DataFrame) -> DataFrame:
    """a, b, key, start, kind: the listed windows from the starts ``cores`` on, folded by task."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                found = [[], [], [], []]
                for small in pieces(part, size=HASHED):
                    t = Texts(small.column("text"))
                    doc, core = flat(small.column("cores"))
                    near = np.zeros(len(t.data) + SPAN, bool)
                    for j in range(SPAN - CORE + 1):  # the most windows that share a gram
                        near[t.at[doc] + core + j] = True
                    at = np.flatnonzero(covered(small, t) & near[: len(t.data)])
                    owner = np.searchsorted(t.at, at, side="right") - 1
                    hashes = [rolling(t.data, SPAN, seed, at) if len(at) else np.zeros(0, np.uint64) for seed in (23, 24)]
                    for column, x in zip(found, (*hashes, small.column("key").to_numpy()[owner], at - t.at[owner]), strict=True):
                        column.append(x)
                a, b, key, start = map(np.concatenate, found)
                if not len(a):
                    continue
                order = np.lexsort((start, key, b, a))
                a, b, key, start = a[order], b[order], key[order], start[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                times = np.bincount(np.cumsum(new) - 1)
                several = np.repeat(times > 1, times)
                spread = mix(key[several].astype(np.uint64) ^ (start[several].astype(np.uint64) << np.uint64(40)))
                kind = np.concatenate([np.where(times > 1, FOLDED, ALONE), np.full(int(several.sum()), SETTLED)]).astype(np.int8)
                cols = [longs(np.concatenate([a[new], spread])), longs(np.concatenate([b[new], b[several]])), np.concatenate([key[new], key[several]]), np.concatenate([start[new], start[several]]).astype(np.int32), kind]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "key", "start", "kind"])

    return rows.mapInArrow(run, "a long, b long, key long, start int, kind byte")


def twice(c: dict):
    """Settled windows, and those that occur elsewhere."""
    done = c["kind"] == SETTLED
    yield {"key": c["key"][done], "start": c["start"][done]}
    a, b, key, start, kind = (c[n][~done] for n in ("a", "b", "key", "start", "kind"))
    order, begin = groups(a, b)
    run = run_of(begin, len(order))
    several = (np.bincount(run, minlength=len(begin)) > 1) | (np.bincount(run, weights=kind[order] == FOLDED, minlength=len(begin)) > 0)
    out = order[several[run] & (kind[order] == ALONE)]
    yield {"key": key[out], "start": start[out]}


def cut(rows: DataFrame) -> DataFrame:
    """Take the removed windows (``first`` and their number ``n``) out of the texts."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                out = []
                for text, first, n, starts in zip(part.column("text"), part.column("first"), part.column("n"), part.column("starts"), strict=True):
                    data = text.as_py().encode()
                    edge = np.zeros(len(data) + 1, np.int64)
                    s = np.array(first.as_py() or [], np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + np.array(n.as_py() or [], np.int64) + SPAN - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    if COPIED in starts.as_py():
                        gone[:] = True
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                    out.append((len(data), int(gone.sum()), spans, digest(np.frombuffer(data, np.uint8)[~gone].tobytes())))
                kinds = [pa.int64()] * 3 + [pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.select("key", "text", "starts", "first", "n").mapInArrow(run, "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def told_runs(still: DataFrame) -> DataFrame:
    """hash, key, start, n, times, stands: the runs around repeated suffixes, how often each kind occurs, and one to stand for it."""
    runs = stored(run_rows(still))
    same = stored(runs.groupBy("a", "b").agg(F.count("*").alias("times"), F.min(F.struct("key", "start")).alias("stand")), release=True)
    return runs.join(same, ["a", "b"]).select("hash", "key", "start", "n", "times", (F.struct("key", "start") == F.col("stand")).alias("stands"))


def listed_by_key(windows: DataFrame) -> DataFrame:
    """key, first, n: the runs of windows of each text as two lists."""
    per = windows.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("x"))  # of one text
    return per.select("key", F.col("x.start").alias("first"), F.col("x.n").alias("n"))


def repeated_windows(still: DataFrame) -> DataFrame:
    """key, first, n: the runs of windows that occur elsewhere, of each text that has some."""
    told = condensed(still.sparkSession, lambda: told_runs(still))
    open_suffixes = told.where("times = 1").select("hash").distinct()
    compare = told.where("stands").join(open_suffixes, "hash", "left_semi")  # one of each kind of run
    listed = stored(still.select("key", "text").join(listed_by_key(compare), "key"), release=True)
    cores = by_hash(core_rows(listed), ["hash"], "key long, start int", repeated).groupBy("key").agg(F.collect_set("start").alias("cores"))  # of one text
    windows = by_hash(window_rows(listed.join(cores, "key").select("key", "text", "first", "n", "cores")), ["a"], "key long, start int", twice)
    return listed_by_key(windows.select("key", "start", F.lit(1).alias("n")).unionByName(told.where("times > 1").select("key", "start", "n")))


def dedup(keyed: DataFrame, batches: int = BATCHES) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256.

    What is left on disk for the last step is one table of the texts that have repeats and one of the windows to remove.
    """
    spark = keyed.sparkSession
    rows = condensed(spark, lambda: first_results(keyed.join(repeats(keyed, batches), "key", "left")))
    still = rows.where(F.col("starts").isNotNull()).select("key", "text", "starts")
    gone = condensed(spark, lambda: repeated_windows(still))
    second = cut(still.join(gone, "key", "left"))
    first = rows.where(F.col("starts").isNull()).drop("text", "starts")
    return first.unionByName(second)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    keyed, *back = with_keys(docs)
    return give_back(dedup(keyed), *back)
