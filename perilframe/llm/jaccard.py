"""Exact Jaccard join on word shingles by parity sketches.

The set of a document is its distinct SHINGLE-word shingles, as 64-bit hashes. Two documents link when
100 * |A & B| >= 75 * |A | B|, so their sets differ in at most D = (|A| + |B|) / 7 elements, and their sizes by a factor of 4/3.

Sketch. The hash range is cut into equal blocks; a block of a set is the XOR of the (remixed) hashes in it, 64 parity
bits. Each element of the symmetric difference changes one block, so all but D blocks of a linked pair agree. The
number of blocks doubles from size band to size band; a set that may meet smaller ones of the band below is sketched for
that band as well. Blocks that agree because both are empty say nothing: a set with more than D blocks that are not
empty shares one of those with every set it is linked to. The few others (small sets) also send their prefix, the first
|A| / 4 + 1 elements in hash order; two linked sets always share one of those.

Join. Equal blocks meet as described in ``exchange``, folded by task. A set is done with if fewer of its blocks meet
another set than a link needs. Of the rest, with one row for all equal sets, each set leaves out the blocks that most
others share, as many as it can while a linked set still shares one that is left, and sets are paired with the pivot of
each group, never with all members. Close pairs, by a wide parity sketch, are verified on the full sets. Groups with
members in several components after that are compared sketch by sketch, chunk against chunk; for any two components the
closest pair is verified first, then all, until nothing new is linked. No link that changes a component is
lost: sets that share no block can't link, and those whose sketches are not close can't either.

Null texts and texts without words have empty sets and link with nothing; texts below SHINGLE words are one shingle.
Keys follow ``store.with_keys``; component_id is the smallest doc_id, nulls left aside (null where all are).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .decontam import small
from .exchange import by_hash, groups, run_of
from .store import stored, with_keys
from .substring import whole_hashes
from .textio import Texts, Words, longs, mix, numbers, pieces, table, windows

SHINGLE = 5
CHUNK = 256
WIDEST = 256  # bytes of a sketch that travels with each key
SMALLEST = 64  # largest set of the first band
BLOCKS = 25  # of the first band
ALONE, FOLDED, SHARED, NEED, SIZE = range(5)  # a key of one set; of several of its task; facts on a set


def sets_of(texts: Texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all texts, offsets by text)."""
    w = Words(texts, lower=lower)
    h = w.hashes()
    full, valid = windows(h, w.first, SHINGLE)
    doc = w.doc()
    short = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
    value = np.concatenate([full[valid], whole_hashes(w, h)[short]])
    owner = np.concatenate([doc[: len(full)][valid], short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(texts.n + 1))


def set_ids(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set; 0 for the empty one."""
    n = np.diff(at)
    out = np.zeros(len(n), np.uint64)
    if len(value):
        some = n > 0
        total = np.add.reduceat(mix(value ^ numbers(1, 12)[0]), at[:-1][some])
        parity = np.bitwise_xor.reduceat(mix(value ^ numbers(1, 13)[0]), at[:-1][some])
        out[some] = mix(total ^ mix(parity ^ n[some].astype(np.uint64))) | np.uint64(1)
    return out


def band_of(size: np.ndarray) -> np.ndarray:
    """0 up to SMALLEST elements, then one more for each doubling."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / SMALLEST))).astype(np.int64)


def slices(at: np.ndarray, which: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions of the first ``length`` elements of the sets ``which``."""
    return np.repeat(at[:-1][which] - np.concatenate([[0], np.cumsum(length)[:-1]]), length).astype(np.int64) + np.arange(length.sum())


def sketch(value: np.ndarray, at: np.ndarray, which: np.ndarray, band: np.ndarray, differences: np.ndarray):
    """(set, key) of the blocks that aren't empty, and how many of them a linked set shares at least."""
    if not len(which):
        return which, np.zeros(0, np.uint64), which
    n = np.diff(at)[which]
    h, owner = value[slices(at, which, n)], np.repeat(np.arange(len(which)), n)
    place = ((h >> np.uint64(32)) * (BLOCKS << band).astype(np.uint64)[owner]) >> np.uint64(32)
    new = np.ones(len(h), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    parity = np.bitwise_xor.reduceat(mix(h ^ numbers(1, 14)[0]), begin)
    owner, place = owner[begin], place[begin]
    key = mix(parity ^ mix(place + (band[owner].astype(np.uint64) << np.uint64(48))))
    return which[owner], key, np.bincount(owner, minlength=len(which)) - differences


def keys_of(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set, key) of all keys, with their kind (0: blocks of its band, 1: of the one below, 2: prefix) and the least number
    of keys of that kind that a linked set shares; and the least of these numbers for each set."""
    n = np.diff(at)
    band, some = band_of(n), np.flatnonzero(n > 0)
    need = np.full(len(n), np.iinfo(np.int32).max, np.int64)
    parts = []
    below = some[band_of(np.ceil(0.75 * n[some])) < band[some]]
    largest = SMALLEST << np.maximum(band - 1, 0)
    for kind, which, of, partner in ((0, some, band, np.floor(n / 0.75)), (1, below, band - 1, np.minimum(n, largest))):
        owner, key, least = sketch(value, at, which, of[which], ((n + partner) // 7).astype(np.int64)[which])
        each = np.ones(len(n), np.int64)
        each[which] = np.maximum(least, 1)
        parts.append((owner, key, np.full(len(key), kind), each[owner]))
        need[which] = np.minimum(need[which], least)
    weak = np.flatnonzero((n > 0) & (need < 1))
    length = n[weak] - np.ceil(0.75 * n[weak]).astype(np.int64) + 1
    prefix = mix(value[slices(at, weak, length)] ^ numbers(1, 15)[0])
    parts.append((np.repeat(weak, length), prefix, np.full(len(prefix), 2), np.ones(len(prefix), np.int64)))
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), np.maximum(need, 1)


def sketches(docs: DataFrame) -> DataFrame:
    """hash, key, kind, fact: the keys of each piece of the documents, folded, and facts on them."""

    def run(batches):
        for part in (p for batch in batches for p in pieces(batch)):
            value, at = sets_of(Texts(part.column("text")))
            key = part.column("key").to_numpy()
            n, ids = np.diff(at), set_ids(value, at)
            _, first, back, times = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
            copied = (times[back] > 1) & (n > 0)
            stand = np.zeros(len(n), bool)
            stand[first] = True
            only = np.flatnonzero(stand)  # one of equal sets sends the keys
            owner, h, _, _, least = keys_of(value[slices(at, only, n[only])], np.concatenate([[0], np.cumsum(n[only])]))
            owner = only[owner]
            need = np.ones(len(n), np.int64)
            need[only] = least
            order, begin = groups(h, then=(key[owner],))
            run = run_of(begin, len(order))
            several = np.bincount(run, minlength=len(begin)) > 1
            shared = np.bincount(owner[order], weights=several[run], minlength=len(n)).astype(np.int64)
            shared[copied] = np.maximum(shared[copied], need[copied])
            at_begin = order[begin]
            seen = np.flatnonzero(shared)
            rows = [(longs(h[at_begin]), key[owner[at_begin]], np.where(several, FOLDED, ALONE), np.zeros(len(begin), np.int64))]
            for kind, which, fact in ((SHARED, seen, shared), (NEED, np.arange(len(n)), need), (SIZE, np.arange(len(n)), n)):
                rows.append((longs(mix(key[which].astype(np.uint64))), key[which], np.full(len(which), kind), fact[which]))
            h, k, kind, fact = (np.concatenate(c) for c in zip(*rows, strict=True))
            yield table(hash=h, key=k, kind=kind.astype(np.int8), fact=fact.astype(np.int64))

    return docs.mapInArrow(run, "hash long, key long, kind byte, fact long")


def met(c: dict):
    """Facts as they are, and for each set how many of its keys meet another one."""
    told = c["kind"] > FOLDED
    yield {"key": c["key"][told], "kind": c["kind"][told], "fact": c["fact"][told]}
    h, key, kind = (c[n][~told] for n in ("hash", "key", "kind"))
    order, begin = groups(h)
    run = run_of(begin, len(order))
    several = np.bincount(run, minlength=len(begin))[run] > 1
    own, times = np.unique(key[order[several & (kind[order] == ALONE)]], return_counts=True)
    yield {"key": own, "kind": np.full(len(own), SHARED, np.int8), "fact": times.astype(np.int64)}


def sets(docs: DataFrame) -> DataFrame:
    """key, id, n, parity (a wide sketch, a bit for each of four elements at most) and elements of each document's set."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                value, at = sets_of(Texts(part.column("text")))
                arrays = pa.ListArray.from_arrays(at.astype(np.int32), pa.array(longs(value)))
                n = np.diff(at)
                width = 4 * SMALLEST << band_of(n)
                to = np.concatenate([[0], np.cumsum(width)])
                bits = np.bincount(np.repeat(to[:-1], n) + (mix(value) & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64), minlength=to[-1]) & 1
                parity = np.packbits(bits.astype(np.uint8)).tobytes()
                sketch = pa.array([parity[a:b] for a, b in zip((to[:-1] // 8).tolist(), (to[1:] // 8).tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(longs(set_ids(value, at))), pa.array(n.astype(np.int64)), sketch, arrays], names=["key", "id", "n", "parity", "elements"])

    return docs.select("key", "text").mapInArrow(run, "key long, id long, n long, parity binary, elements array<long>")


def near(batches):
    """The pairs whose parity sketches differ in no more bits than the sets of a linked pair may in elements."""
    for batch in batches:
        keep = []
        for x, y, n in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), (np.add(batch.column("na").to_numpy(), batch.column("nb").to_numpy()) // 7).tolist(), strict=True):
            p, q = int.from_bytes(x), int.from_bytes(y)
            a, b = len(x), len(y)
            while a > b:  # the wider sketch is folded
                a //= 2
                p = (p >> 8 * a) ^ (p & ((1 << 8 * a) - 1))
            while b > a:
                b //= 2
                q = (q >> 8 * b) ^ (q & ((1 << 8 * b) - 1))
            keep.append((p ^ q).bit_count() <= n)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def members(own: DataFrame) -> DataFrame:
    """hash, key, kind, need: the keys of sets."""

    def run(batches):
        for batch in batches:
            lists, key = batch.column("elements"), batch.column("key").to_numpy()
            at = lists.offsets.to_numpy().astype(np.int64)
            value = lists.values.to_numpy()[at[0] : at[-1]].view(np.uint64)
            owner, h, kind, need, _ = keys_of(value, at - at[0])
            yield table(hash=longs(h), key=key[owner], kind=kind.astype(np.int8), need=need.astype(np.int32))

    return own.select("key", "elements").mapInArrow(run, "hash long, key long, kind byte, need int")


def with_sets(pairs: DataFrame, own: DataFrame, column: str, short: str) -> DataFrame:
    """The stored pairs (a, b) whose sizes allow a link, with both sizes and both values of a column."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    own = own.join(small(stored(keys)), "key", "left_semi")
    a = own.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col(column).alias(f"{short}a"))
    b = own.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col(column).alias(f"{short}b"))
    return pairs.join(a, "a").join(b, "b").where("4 * least(na, nb) >= 3 * greatest(na, nb)")


def linked(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets link."""
    common = with_sets(pairs, own, "elements", "e").withColumn("i", F.size(F.array_intersect("ea", "eb")))
    return common.where(100 * F.col("i") >= 75 * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def folded_bits(parity: list[bytes], width: int) -> np.ndarray:
    """Parity sketches as rows of 64-bit words, folded to ``width`` bytes."""
    out = np.empty((len(parity), width // 8), np.uint64)
    for i, p in enumerate(parity):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(p, np.uint64).reshape(-1, width // 8), 0)  # positions are low bits of a hash
    return out


def narrow(own: DataFrame) -> DataFrame:
    """key, n and parity, folded to WIDEST bytes: a large set is in many groups."""

    def run(batches):
        for batch in batches:
            parity = [folded_bits([p], min(len(p), WIDEST)).tobytes() for p in batch.column("parity").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(parity, pa.binary())], names=["key", "n", "parity"])

    return own.select("key", "n", "parity").mapInArrow(run, "key long, n long, parity binary")


def blocks(mine: DataFrame, own: DataFrame, most: int | None) -> DataFrame:
    """Pairs (a, b) across components whose sketches are close, among the members of each group; ``most`` for any two
    components, the closest first. Groups are cut into chunks of about CHUNK members, and a task compares two chunks."""
    chunk = F.pmod(F.xxhash64("key", F.lit(1)), F.ceil(F.col("g") / CHUNK))
    rows = mine.join(narrow(own), "key").groupBy("hash", chunk.alias("i"))
    lists = stored(rows.agg(F.collect_list(F.struct("key", "component", "n", "parity")).alias("m")))  # about CHUNK members
    two = lists.select("hash", "i", F.col("m").alias("ma")).join(lists.select("hash", F.col("i").alias("j"), F.col("m").alias("mb")), "hash").where("i <= j")

    def run(batches):
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            for ma, mb in zip(batch.column("ma"), batch.column("mb"), strict=True):
                sides = []
                for m in (ma.values, mb.values):
                    parity = m.field("parity").to_pylist()
                    sides.append((*(m.field(c).to_numpy(zero_copy_only=False) for c in ("key", "component", "n")), parity, np.array([len(p) for p in parity])))
                (ka, ca, na, pa_, wa), (kb, cb, nb, pb, wb) = sides
                best = []
                for x in np.unique(wa):
                    for y in np.unique(wb):
                        ia, ib, width = np.flatnonzero(wa == x), np.flatnonzero(wb == y), int(min(x, y))
                        apart = np.bitwise_count(folded_bits([pa_[i] for i in ia], width)[:, None] ^ folded_bits([pb[i] for i in ib], width)[None]).sum(2, dtype=np.int64)
                        s, t = na[ia][:, None], nb[ib][None]
                        ok = (apart <= (s + t) // 7) & (ca[ia][:, None] != cb[ib][None]) & (4 * np.minimum(s, t) >= 3 * np.maximum(s, t))
                        u, v = np.nonzero(ok)
                        best.append(np.stack([ka[ia[u]], kb[ib[v]], ca[ia[u]], cb[ib[v]], apart[u, v]], 1))
                pairs = np.concatenate(best)
                if most is not None and len(pairs):
                    low, high = np.minimum(pairs[:, 2], pairs[:, 3]), np.maximum(pairs[:, 2], pairs[:, 3])
                    order = np.lexsort((pairs[:, 4], high, low))
                    pairs, low, high = pairs[order], low[order], high[order]
                    new = np.ones(len(pairs), bool)
                    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
                    begin = np.flatnonzero(new)
                    pairs = pairs[np.arange(len(pairs)) - begin[np.cumsum(new) - 1] < most]
                found.append(np.sort(pairs[:, :2], 1))
            a, b = np.unique(np.concatenate(found), axis=0).T
            yield table(a=np.ascontiguousarray(a), b=np.ascontiguousarray(b))

    return two.select("ma", "mb").mapInArrow(run, "a long, b long")


def components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n of every document; key, component of those linked with another one)."""
    facts = by_hash(sketches(docs), ["hash"], "key long, kind byte, fact long", met)
    pick = lambda kind: F.when(F.col("kind") == kind, F.col("fact"))
    info = stored(facts.groupBy("key").agg(F.coalesce(F.sum(pick(SHARED)), F.lit(0)).alias("shared"), F.max(pick(NEED)).alias("need"), F.max(pick(SIZE)).alias("n")))
    alive = info.where((F.col("shared") >= F.col("need")) & (F.col("n") > 0)).select("key")
    own = stored(sets(docs.join(small(stored(alive)), "key")))
    classes = stored(own.groupBy("id").agg(F.min("key").alias("stand"), F.count("*").alias("times")))
    standing = stored(own.join(classes.select(F.col("stand").alias("key")), "key", "left_semi").select("key", "n", "parity", "elements"))
    places = stored(members(standing))
    often = stored(places.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1"))
    # a linked set shares ``need`` of these keys, so the need - 1 most frequent ones can go: the rarest shared one stays on both sides
    rank = F.row_number().over(Window.partitionBy("key", "kind").orderBy(F.desc("times"), F.desc("hash")))  # of one document
    rare = places.join(often, "hash").withColumn("rank", rank).where("rank >= need")
    places = stored(rare.select("hash", "key")).withColumn("order", F.xxhash64("key"))
    labels = standing.select("key", F.col("key").alias("component"))
    done = None
    for most in itertools.chain((0, 1), itertools.repeat(None)):
        now = places.join(labels, "key")
        size = now.groupBy("hash").agg(F.count("*").alias("g"), F.min("order").alias("low"), F.min("component").alias("c"), F.max("component").alias("d"))
        mixed = size.where("c <> d").select("hash", "g", "low")
        mine = stored(now.join(mixed, "hash"))
        if mine.isEmpty():
            break
        if most == 0:
            pivots = mine.where("order = low").select("hash", F.col("key").alias("p"), F.col("component").alias("pc"))
            met_pivot = mine.join(pivots, "hash").where("component <> pc")
            pairs = met_pivot.select(F.least("key", "p").alias("a"), F.greatest("key", "p").alias("b")).distinct()
        else:
            pairs = blocks(mine, standing, most).distinct()
        new = stored(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"))
        if not new.isEmpty():
            done = new if done is None else done.unionByName(new)
            close = stored(with_sets(new, standing, "parity", "p").mapInArrow(near, "a long, b long"))
            c, d = (labels.select(F.col("key").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
            roots = stored(connected(linked(close, standing).join(c, "a").join(d, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
            if most is None and roots.isEmpty():
                break
            moved = labels.join(roots.select(F.col("key").alias("component"), F.col("component").alias("root")), "component", "left")
            labels = stored(moved.select("key", F.coalesce("root", "component").alias("component")))
        elif most is None:
            break  # every pair across components was verified
    of = own.select("key", "id").join(classes, "id").join(labels.withColumnRenamed("key", "stand"), "stand")
    return info.select("key", "n"), of.select("key", "component")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each document."""
    keyed, full, plain = with_keys(docs)
    info, found = components(keyed)
    out = info.join(found, "key", "left").select("key", F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))
    if plain:
        return out.withColumnRenamed("key", "doc_id")
    out = full.select(F.col("llm_key").alias("key"), "doc_id").join(out, "key")
    least = out.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return out.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS k, doc_id AS c FROM n UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.k WHERE r.c < e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(c) FROM r WHERE r.k = d.doc_id), d.doc_id)::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
