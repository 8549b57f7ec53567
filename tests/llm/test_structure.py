"""Fingerprints, periodic runs and the filter audit against brute force, with nulls, ties, repeated rows, clashing columns and long texts."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perilframe.llm import audit, merkle, periods
from perilframe.llm.textio import Texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mask int, h string, part string, task int, tail string, period int"
REST = (0, 1, "h", "p", 2, "tail", 3)


def words(t):
    return [w for w in re.split("[ \t\n\v\f\r]+", t or "") if w]


def corpus():
    rng = random.Random(8)
    known = ["".join(rng.choice("abcdeéABC#") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    text = lambda n: "".join(rng.choice(known) + rng.choice([" "] * 9 + ["\n", "\n\n", "\t"]) for _ in range(n))
    out = [text(rng.randint(1, 500)) for _ in range(40)]
    out += [(text(rng.randint(1, 9)) + " ") * rng.randint(2, 12) + text(3) for _ in range(40)]
    out += out[:6] * 3 + ["", None, "", " \n ", "A", "A " * 400, "z" * 5000, "ab ab " * 60 + "c " * 9, text(9000), "é" * 7, "x y x y x y x y", "x x x x x x"]
    return [(i, t, None, ("a", "b", None, "")[i % 4], *REST) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, a shared id with two texts, null ids."""
    rows = corpus()
    t = rows[0][1]
    more = [rows[1], rows[1], (2, rows[30][1], *rows[2][2:]), (None, t, None, None, *REST), (None, None, None, None, *REST), (None, t, None, "a", *REST)]
    return spark.createDataFrame(rows + more, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 120, 2)] + [(4, 1, None), (4, 1, None), (None, 1, 1), (9999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# --- fingerprints


def edits(rows):
    texts = [t or "" for _, t in rows]
    return [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)]


def test_fingerprints_of_edits(docs):
    rows = sorted((r[0], r[1]) for r in corpus())
    got = {r.doc_id: r for r in merkle.edited_neighbours(docs).collect()}
    assert len(got) == len(rows)
    plain = {r.doc_id: r.fingerprint for r in merkle.fingerprints(docs).collect()}
    for (i, t), e, (_, n) in zip(rows, edits(rows), rows[1:] + rows[:1], strict=True):
        t, n, r = t or "", n or "", got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == plain[i] and (r.fingerprint == r.edited_fingerprint) == (t == e)
        assert r.near_edited == pytest.approx(shared(t, e)) and r.near_next == pytest.approx(shared(t, n))
        if t == e:
            assert r.edit_begin is None and r.edit_end is None
        else:  # every code point that differs lies in the span
            begin = next((k for k, (x, y) in enumerate(zip(t, e, strict=False)) if x != y), min(len(t), len(e)))
            assert r.edit_begin <= begin and r.edit_begin <= r.edit_end <= len(t)
            assert t[: r.edit_begin] == e[: r.edit_begin] and (r.edit_end == len(t) or e.endswith(t[r.edit_end :]))
    by_text = collections.defaultdict(set)
    for i, t in rows:
        by_text[t or ""].add(got[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values()) and len(set().union(*by_text.values())) == len(by_text)


def leaves(t):
    """Leaves by definition, one text at a time."""
    hashes = merkle.Words(Texts(pa.array([t]))).hashes()
    raw, out, begin, last = t.encode(), [], 0, None
    ends = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    cut = {ends[k + 1] for k, h in enumerate(hashes) if h % np.uint64(merkle.LEAF_WORDS) == 0 and k + 1 < len(ends)}
    for k in range(1, len(raw) + 1):
        if k == len(raw) or k in cut or raw[k - 1 : k] == b"\n" or k - begin == merkle.MOST_BYTES:
            out.append(raw[begin:k])
            begin = k
    return out


def shared(a, b):
    if a == b:
        return 1.0
    x, y = (collections.Counter(merkle.digest(v).hex()[: merkle.LEAF_HEX] for v in leaves(t)) for t in (a, b))
    return 2 * (x & y).total() / (x.total() + y.total())


def test_an_edit_in_the_middle_is_located():
    rng = random.Random(1)
    w = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    edit = [*w[:1500], "other", *w[1501:]]
    a, b = merkle.trees(Texts(pa.array([" ".join(w), " ".join(edit)])))
    begin, end = merkle.edited_span(a, b)
    at = len(" ".join(w[:1500])) + 1
    assert begin <= at < end and end - begin < 1500
    same = {s[0] for s in a.sections} & {s[0] for s in b.sections}
    assert len(a.sections) - len(same) <= 3 and a.root != b.root
    assert merkle.likeness(a.fingerprint(), b.fingerprint()) > 0.97


def test_fingerprint_small_tables(spark, odd, docs):
    assert merkle.edited_neighbours(docs.where("doc_id < 0")).count() == 0
    one = merkle.edited_neighbours(spark.createDataFrame([(7, "one two three")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"one twoone tw").hexdigest()
    got = merkle.edited_neighbours(odd).collect()
    assert len(got) == odd.count() and sum(r.doc_id is None for r in got) == 3
    twice = [r for r in got if r.doc_id == 1]
    assert len(twice) == 3 and sum(r.near_next == 1.0 for r in twice) == 2  # repeated rows follow each other
    assert len({r.fingerprint for r in got if r.doc_id == 2}) == 2


@pytest.mark.parametrize("tasks", ["1", "7"])
def test_fingerprints_do_not_depend_on_tasks(spark, docs, tasks):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    expected = sorted(map(tuple, merkle.edited_neighbours(docs).collect()), key=str)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert sorted(map(tuple, merkle.edited_neighbours(docs).collect()), key=str) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- periodic runs


def runs_of(w):
    """Every maximal stretch, period by period."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def expected_runs(i, t):
    w, h = words(t), zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = runs_of(w)
    top = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    milli = 1000 * top[1] // top[2] if found else None
    return (i, len(found), *top, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_runs_against_brute_force(docs):
    got = {r.doc_id: tuple(r) for r in periods.looped_runs(docs).collect()}
    expected = {r[0]: expected_runs(r[0], r[1]) for r in corpus()}
    assert got == expected
    assert sum(r[1] > 0 for r in got.values()) > 20 and max(r[1] for r in got.values()) > 1


def test_runs_of_small_alphabets():
    rng = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            d = [rng.randrange(rng.randint(1, 3)) for _ in range(rng.randint(0, 150))]
            unit = [rng.randrange(4) for _ in range(rng.randint(1, 30))]
            texts.append(d + unit * rng.randint(0, 9) + d[:9])
        flat = np.array([x for t in texts for x in t], np.int64)
        assert periods.runs(flat, np.array([len(t) for t in texts], np.int64)) == [runs_of(t) for t in texts]


def test_common_extensions():
    rng = random.Random(4)
    x = np.array([rng.randrange(2) for _ in range(60)] * 4 + [7] + [1] * 200 + [8], np.int64)
    e = periods.Extensions(x)
    pairs = [(rng.randrange(len(x)), rng.randrange(len(x))) for _ in range(3000)]
    i, j = (np.array(c) for c in zip(*[(a, b) for a, b in pairs if a != b], strict=True))
    expected = [next((k for k in range(len(x)) if max(a, b) + k >= len(x) or x[a + k] != x[b + k]), 0) for a, b in zip(i, j, strict=True)]
    assert e.common(i, j).tolist() == expected
    assert len(e.rank) - 1 <= 4 * (len(x) // 13 + 1)  # only positions of the cover are sorted


def test_runs_in_blocks_of_the_grid(docs, monkeypatch):
    w = np.array([int(hashlib.md5(x.encode()).hexdigest()[:6], 16) for x in words(corpus()[-4][1])] + [5, 6] * 40, np.int64)
    expected = periods.runs(w, np.array([len(w)]))
    monkeypatch.setattr(periods, "GRID_ROWS", 1000)
    assert periods.runs(w, np.array([len(w)])) == expected and expected[0]


def test_runs_collapse_texts(spark, odd, docs):
    rows = [(1, "say it say it say it say it now"), (2, None), (3, "a a a a a a b"), (4, "a a a a a")]
    got = {r.doc_id: (r.runs, r.collapsed) for r in periods.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert got == {1: ([[0, 8, 2]], "say it now"), 2: ([], ""), 3: ([[0, 6, 1]], "a b"), 4: ([], "a a a a a")}
    assert periods.looped_runs(docs.where("doc_id < 0")).count() == 0
    got = collections.Counter(map(tuple, periods.looped_runs(odd).collect()))
    assert got == collections.Counter(expected_runs(r.doc_id, r.text) for r in odd.collect())


# --- filter audit


def expected_audit(rows, labels):
    good, toxic = collections.defaultdict(int), collections.defaultdict(int)
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, _, source, *_ in rows:
        t = t or ""
        w = words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.append((source or "", {f for f, v in fails.items() if v}, i is not None and good[i], i is not None and toxic[i]))
    out = {}
    shapley = collections.Counter()
    for part in {d[0] for d in docs}:
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before, here = set(order[:k]), [d for d in docs if d[0] == part]
                removed = [d for d in here if f in d[1] and not d[1] & before]
                out[part, "".join(order), k + 1] = (
                    sum(not d[1] & (before | {f}) for d in here), len(removed), sum(f in d[1] and bool(d[1] & before) for d in here), sum(d[1] == {f} for d in here),
                    sum(bool(d[2]) for d in removed), sum(bool(d[3]) for d in removed),
                )
                shapley[part, f] += len(removed)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_audit_against_brute_force(request, labels, table):
    df = request.getfixturevalue(table)
    out = audit.interactions(df, labels).collect()
    expected = expected_audit([tuple(r) for r in df.collect()], [tuple(r) for r in labels.collect()])
    assert {tuple(r) for r in out} == expected and len(out) == len(expected) == 600 * 3
    assert out[0].asDict().keys() == {"part", "filter_order", "step", *audit.MEASURES}


def test_audit_of_empty_tables(spark, docs, labels):
    assert audit.interactions(docs.where("doc_id < 0"), labels).count() == 0
    out = audit.interactions(docs, labels.where("doc_id < 0"))
    assert out.count() == 1800 and out.where("good_lost > 0 or toxic_lost > 0").isEmpty()


def test_copies_of_a_hot_text_meet_in_slots(spark, monkeypatch):
    monkeypatch.setattr(audit, "SLOT_ROWS", 16)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same text").otherwise(F.concat(F.lit("text "), (F.col("id") / 4).cast("int"))).alias("text"), F.lit("s").alias("source"))
    rows = audit.measured(docs)
    found = {r.doc_id for r in audit.repeated(docs, rows).collect()}
    seen, expected = set(), set()
    for r in sorted(docs.collect()):
        expected |= {r.doc_id} if r.text in seen else set()
        seen.add(r.text)
    assert found == expected and len(found) > 299


def test_copies_are_told_by_text_not_by_hash(spark, monkeypatch):
    """All texts under one hash: the exact text still decides."""
    monkeypatch.setattr(audit.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    docs = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (7, "b"), (5, "c"), (None, "c")], "doc_id long, text string").withColumn("source", F.lit("s"))
    rows = audit.measured(docs)
    assert sorted(r.doc_id for r in audit.repeated(docs, rows).collect()) == [3, 7]
