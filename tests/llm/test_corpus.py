"""The corpus operators against brute force on small tables with nulls, ties, repeated rows, clashing columns and long texts."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from perilframe.llm import decontam, jaccard, langid, lm, mixing, quality, substring, suffix, toxicity, warc
from perilframe.llm.components import connected
from perilframe.llm.queries import ORACLES, QUERIES, QUALITY_SHARES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, score string"


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.randint(30, 160)) for _ in range(25)]
    out = list(base)
    for t in base[:12]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(1, 3)):
                v[rng.randrange(len(v))] = "edit"
            out.append(" ".join(v))
    out += base[:4] + ["", None, "one", "x y", " \n\t ", "A " * 300, "z" * 5000, text(5000), "IDIOT " + text(60), "line one two\nline one two\n7 8"]
    return [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], 0 if t is None else len(t), 1, "s") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, a shared id with two texts, null ids."""
    rows = corpus()
    t = rows[0][1]
    more = [rows[1], (2, rows[30][1], *rows[2][2:]), (None, t, None, None, None, None, None), (None, None, None, None, None, None, None), (None, t, None, None, None, None, None)]
    return spark.createDataFrame(rows + more, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(t):
    return [w for w in re.split("[ \t\n\v\f\r]+", t or "") if w]


def low(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def table(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select(*columns).collect()}


def test_substring_against_brute_force(docs):
    seen, expected = set(), {}
    for i, t, *_ in corpus():
        w = tokens(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            gram = tuple(w[s : s + 20])
            if gram in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(gram)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert table(substring.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == expected


@pytest.mark.parametrize("batches", [1, 5])
def test_suffix_against_brute_force(docs, batches):
    data = [(i, (t or "").encode()) for i, t, *_ in corpus()]
    starts = collections.Counter(t[s : s + 200] for _, t in data for s in range(len(t) - 199))
    expected = {}
    for i, t in data:
        gone = bytearray(len(t))
        for s in range(len(t) - 199):
            if starts[t[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        expected[i] = (len(t), sum(gone), sum(1 for g, _ in itertools.groupby(gone) if g), hashlib.sha256(kept).hexdigest())
    out = suffix.dedup(docs.select(F.col("doc_id").alias("key"), "text"), batches)
    assert table(out, "key", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected


class Plain:
    """Stands for a table: hands its batch to the function of a map."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return pa.Table.from_batches(run([self.batch])).to_pydict()


def test_suffix_hashes_little_at_once(monkeypatch):
    rng = random.Random(9)
    shared = ["".join(rng.choice("abcdef") for _ in range(400)) for _ in range(5)]
    texts = ["".join(rng.choice("abcdef") for _ in range(rng.randint(0, 900))) + rng.choice(shared) for _ in range(600)]
    found = Plain(pa.RecordBatch.from_pydict({"key": list(range(600)), "text": texts}))
    starts = collections.defaultdict(list)
    rows = suffix.entries(found)
    for key, start in zip(rows["key"], rows["start"], strict=True):
        starts[key].append(start)
    lists = {"starts": [starts[i] for i in range(600)], "first": [[0]] * 600, "n": [[max(0, len(t) - 199)] for t in texts], "cores": [[0, len(t) - 384] for t in texts]}
    kinds = {"first": pa.list_(pa.int32()), "n": pa.list_(pa.int32()), "cores": pa.list_(pa.int32()), "starts": pa.list_(pa.int32())}
    whole = pa.RecordBatch.from_arrays([*found.batch.columns, *(pa.array(v, kinds[k]) for k, v in lists.items())], names=["key", "text", *lists])
    steps = (suffix.entries, suffix.run_rows, suffix.core_rows, suffix.window_rows)
    sizes, hashed = [], suffix.rolling
    monkeypatch.setattr(suffix, "rolling", lambda data, *more: (sizes.append(len(data)), hashed(data, *more))[1])
    small = [f(Plain(whole)) for f in steps]
    assert max(sizes) < 1 << 17 < sum(map(len, texts))
    monkeypatch.setattr(suffix, "HASHED", 1 << 30)
    assert small == [f(Plain(whole)) for f in steps]  # and the rows do not depend on it
    assert all(len(x["key"]) > 600 for x in small)


def shingles(t):
    w = tokens(low(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_against_brute_force(docs):
    sets = {i: shingles(t) for i, t, *_ in corpus()}
    least = {i: i for i in sets}
    for _ in range(6):
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                least[a] = least[b] = min(least[a], least[b])
    expected = {i: (len(s), least[i]) for i, s in sets.items()}
    assert table(jaccard.near_copies(docs), "doc_id", "n_shingles", "component_id") == expected


def test_components(spark):
    edges = spark.createDataFrame([(5, 3), (3, 9), (9, 8), (1, 2), (7, 7)] + [(100 + i, 101 + i) for i in range(20)], "a long, b long")
    got = table(connected(edges), "key", "component")
    assert got[8] == (3,) and got[2] == (1,) and got[120] == (100,) and got[7] == (7,)


def test_decontamination_against_duckdb(spark, docs):
    rows = corpus()
    w = rows[3][1].split()
    items = [(1, " ".join(w[4:24])), (2, "One"), (3, None), (4, ""), (5, "not in any document at all, this is an item"), (6, " ".join(w[4:24])), (7, "x, Y")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    documents, benchmark_rows = docs.toPandas(), benchmark.toPandas()
    con.register("documents", documents)
    con.register("benchmark", benchmark_rows)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = {r[0]: tuple(r[1:]) for r in con.sql(f"SELECT {', '.join(names)} FROM ({decontam.ORACLE})").fetchall()}
    got = table(decontam.judge(docs, benchmark), *names)
    assert got == expected and got[3][2] == 2 and got[3][4]


def test_lm_base_and_distribution(docs):
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    rows = {i: [*tokens(low(t)), None] for i, t, *_ in corpus()}
    seen = collections.Counter(w for i, t in rows.items() if not held(i) for w in t)
    n, v = sum(seen.values()), len(seen)
    got = table(lm.scores(docs), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for i, t in rows.items():
        base = sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert got[i][:4] == (held(i), len(t), sum(w in seen for w in t), n) and got[i][4] == pytest.approx(base) and got[i][5] < 0


def test_lm_probabilities_add_up():
    import numpy as np

    counts = np.zeros((lm.CLASSES + 1) ** 2 * lm.CLASSES)
    counts[::1001] = 3
    assert np.allclose((10 ** lm.train(counts).astype(float)).sum(1), 1, atol=1e-4)


def test_lm_learns_words_beyond_the_frequent_ones(spark):
    """Each of 300 words is followed by one other of the same class: only a model that knows both tells a held-out text from its shuffle."""
    rng = random.Random(6)
    words = [f"ab{i:03}z" for i in range(300)]
    chain = lambda: [w for _ in range(20) for i in [rng.randrange(150)] for w in (words[i], words[150 + i])]
    ids = iter(range(10**6))
    held = (i for i in range(10**6, 2 * 10**6) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(next(ids), " ".join(chain())) for _ in range(4000)]
    pairs = []
    for _ in range(20):
        right = chain()
        wrong = [w for i in range(0, 40, 2) for w in (right[i], words[150 + rng.randrange(150)])]
        pairs.append((next(held), next(held)))
        rows += [(pairs[-1][0], " ".join(right)), (pairs[-1][1], " ".join(wrong))]
    got = table(lm.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)), "doc_id", "score")
    assert all(got[a][0] > got[b][0] + 2 for a, b in pairs)


def test_lm_words_of_a_class_add_up():
    import numpy as np

    n = 70
    v = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.arange(n, dtype=np.int32) % 2, np.arange(40, 40 + n), 0, 0, np.full(lm.RARE, 9.0), np.ones(lm.RARE))
    t = lm.tree(v)
    m = lm.WordModel(v, t)
    past, used = np.full(len(m.rows), 1e-8, np.float32), np.zeros(len(m.rows), np.int64)
    w = lm.CLASSES + np.arange(n)
    for _ in range(5):
        m.learn(t, w[::-1], w, w, past, used)
    own = np.concatenate([[lm.FREQUENT], w[::2]])  # class 0, its leaf below the floor first
    again = np.full(len(own), w[3])
    assert used.sum() > 0 and (10 ** m.logp(t, again, again, own)).sum() == pytest.approx(1, abs=1e-4)


def test_quality_against_brute_force(docs):
    got = table(quality.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t, *_ in corpus():
        w = tokens(t)
        grams = collections.Counter(tuple(w[s : s + 3]) for s in range(len(w) - 2))
        inside = {s + j for s in range(len(w) - 2) if grams[tuple(w[s : s + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if tokens(x)]
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        expected = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside), failed)
        assert got[i][:6] == expected and not (failed and got[i][6])


def test_quality_drops_documents_of_boilerplate(spark):
    rng = random.Random(1)
    own = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(20))
    shared = " ".join(f"Line{i}" for i in range(60))
    rows = [(i, f"{shared.upper() if i % 2 else shared}\n{own()}" if i < 40 else "\n".join(own() for _ in range(3)), None, "h", 0, 0, "") for i in range(80)]
    got = table(quality.judge(spark.createDataFrame(rows, SCHEMA)), "doc_id", "kept", "n_boilerplate")
    assert all(got[i] == (False, 60) for i in range(40)), got  # a quarter of the words is left
    assert all(got[i][1] == 0 for i in range(40, 80))


def test_quality_limits_hold_on_hot_and_small_hosts(spark):
    rng = random.Random(9)
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    shared, rows, expected = [own(60) for _ in range(4)], [], {}

    def add(host, text, kept, lost):
        expected[len(rows)] = (kept, lost)
        rows.append((len(rows), text, None, host, 0, 0, ""))

    for i in range(2500):  # 25 of them, one in a hundred, share a line
        add("hot", f"{shared[0]}\n{own(40)}" if i % 100 == 0 else own(60), i % 100 != 0, 60 * (i % 100 == 0))
    for i in range(10):
        add("small", f"{shared[1]}\n{own(40)}" if i < 5 else own(60), i >= 5, 60 * (i < 5))
    for i in range(10):
        add("pair", f"{shared[2]}\n{own(40)}" if i < 2 else own(60), True, 0)
    for i in range(60):  # copies of one document are one
        add("copies", shared[3] if i < 30 else own(60), True, 0)
    assert table(quality.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)), "doc_id", "kept", "n_boilerplate") == expected


def test_languages(spark):
    en, fr, ru = "the house and the garden with that thing", "le jardin et la maison avec une chose", "дом и сад с одной вещью"
    rows = [(i, " ".join([(en, fr, ru)[i % 3]] * 3), ("en", "fr", "ru")[i % 3], "a", 0, 0, "") for i in range(60)]
    rows += [(100, en + " " + ru, None, "a", 0, 0, ""), (101, None, "en", "a", 0, 0, ""), (102, "12 !?", "en", "a", 0, 0, "")]
    got = table(langid.languages(spark.createDataFrame(rows, SCHEMA)), "doc_id", "lang_pred", "score", "spans")
    assert all(got[i][0] == ("en", "fr", "ru")[i % 3] for i in range(60))
    assert got[101][:2] == ("und", 0.0) and got[102][:2] == ("und", 0.0)
    assert [s.lang for s in got[100][2]] == ["en", "ru"] and got[100][2][1].begin == len(en) + 1


def test_toxic_segments_against_brute_force():
    rng = random.Random(3)
    for _ in range(50):
        x = [rng.choice([-0.5, -0.2, 1.0, -1.5, 0.7]) for _ in range(30)]
        total = [0, *itertools.accumulate(x)]
        at = [i for i, v in enumerate(x) if v > 0]
        found = toxicity.segments(at, [total[i] for i in at], [total[i + 1] for i in at])
        best = max(total[b] - total[a] for a in range(30) for b in range(a + 1, 31))
        assert max(s for *_, s in found) == pytest.approx(best)
        assert all(total[e] - total[b] == pytest.approx(s) for b, e, s in found) and all(a[1] <= b[0] for a, b in itertools.pairwise(found))


def test_all_toxic_segments_against_brute_force():
    def best_first(x, shift=0):
        """The best stretch, then those left and right of it."""
        total = [0, *itertools.accumulate(x)]
        spans = [(total[b] - total[a], a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)]
        score, a, b = max(spans, default=(0, 0, 0))
        if score <= 0:
            return []
        return [*best_first(x[:a], shift), (a + shift, b + shift), *best_first(x[b:], shift + b)]

    rng = random.Random(8)
    for n in [1, 2, 3, 40] * 15:
        x = [rng.uniform(-1, 1) for _ in range(n)]
        total = [0, *itertools.accumulate(x)]
        at = [i for i, v in enumerate(x) if v > 0]
        found = toxicity.segments(at, [total[i] for i in at], [total[i + 1] for i in at])
        assert [(b, e) for b, e, _ in found] == best_first(x)


def test_toxic_scan_is_linear():
    """Totals that keep falling, and that fall and then rise above all: a scan that walks back over all segments would take hours."""
    n = 200_000
    falling = [-float(i) for i in range(n)]
    start = time.monotonic()
    assert len(toxicity.segments(list(range(n)), falling, [x + 0.5 for x in falling])) == n
    rising = [float(i) for i in range(n)]
    tops = [x + 0.5 for x in rising]
    assert toxicity.segments([*range(n), n, n + 1], [*rising, -1.0, -0.5], [*tops, -0.9, n + 1.0])[-1][1] == n + 2
    assert time.monotonic() - start < 20


def test_toxicity(spark):
    rng = random.Random(2)
    rows = [(i, " ".join([f"w{rng.randrange(50)}" for _ in range(80)] + ["idiot moron"] * (i % 4 == 0)), None, None, 0, 0, "") for i in range(200)]
    rows += [(900, None, None, None, 0, 0, ""), (901, "", None, None, 0, 0, ""), (902, "idiot moron", None, None, 0, 0, "")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = table(toxicity.toxic_documents(spark.createDataFrame(rows, SCHEMA), labels), "doc_id", "predicted", "score", "passages")
    assert all(got[i][0] == (i % 4 == 0) for i in range(200)) and got[900][0] == got[901][0] == 0 and got[902][0] == 1
    assert got[0][2][0].end == 82
    none = toxicity.toxic_documents(spark.createDataFrame(rows, SCHEMA), labels.where("toxic = 0"))
    assert none.where("predicted = 1").isEmpty()


def test_mixing_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"{'ab'[i % 3 == 0]}{rng.randrange(20)}" for _ in range(rng.randint(1, 60))), None, None, 0, 0, "") for i in range(120)] + [(500, None, None, None, 0, 0, "")]
    labels = spark.createDataFrame([(i, str(int(i % 3 == 0))) for i in range(60)] + [(None, "1"), (61, None)], "doc_id long, kind string")
    out = mixing.mixed(spark.createDataFrame(rows, SCHEMA), labels, "kind", {"0": 0.2, "1": 0.8}).collect()
    total = sum(r.llm_n_tokens for r in out)
    for d, share in enumerate((0.2, 0.8)):
        assert sum(r.llm_n_tokens * r.llm_rate * r.llm_posterior[d] for r in out) == pytest.approx(share * total, rel=1e-3)
    assert all(r.llm_rate >= 0 and sum(r.llm_posterior) == pytest.approx(1) for r in out) and len(out) == 121


def brute_posteriors(texts, train, domains):
    """Posteriors by plain counting: (lower-cased words by domain, 0.5 added over the hashed features, evidence of 40 words)."""
    counts = {d: collections.Counter(w for i in train[d] for w in texts[i].lower().split()) for d in domains}
    known = sum(len(v) for v in train.values())
    out = []
    for t in texts:
        words = t.lower().split()
        logs = []
        for d in domains:
            size = sum(counts[d].values()) + 0.5 * mixing.BUCKETS
            logs.append(math.log(len(train[d]) / known) + mixing.EVIDENCE * sum(math.log((counts[d][w] + 0.5) / size) for w in words) / max(1, len(words)))
        e = [math.exp(x - max(logs)) for x in logs]
        out.append([x / sum(e) for x in e])
    return np.array(out)


def test_mixing_against_brute_force(spark):
    rng = random.Random(12)
    domains = ["x", "y", "z"]
    own = {d: [f"{d}{i}" for i in range(12)] for d in domains}
    kinds = [rng.choice(domains) for _ in range(150)]
    texts = [" ".join(rng.choice(own[d] if rng.random() < 0.8 else own[rng.choice(domains)]) for _ in range(rng.randint(1, 40))) for d in kinds]
    docs = spark.createDataFrame([(i, t, None, None, 0, 0, "") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, d) for i, d in enumerate(kinds) if i < 90], "doc_id long, kind string")
    words = {w for ws in own.values() for w in ws}
    assert spark.createDataFrame([(w,) for w in words], "w string").select(mixing.bucket("w")).distinct().count() == len(words)  # none shares a feature
    p = brute_posteriors(texts, {d: [i for i in range(90) if kinds[i] == d] for d in domains}, domains)
    n = np.array([len(t.split()) for t in texts])
    for shares in ({"x": 0.2, "y": 0.5, "z": 0.3}, {"x": 0.9, "y": 0.05, "z": 0.05}):
        out = mixing.mixed(docs, labels, "kind", shares, keep=["doc_id"])
        assert out.columns == ["doc_id", "llm_n_tokens", "llm_posterior", "llm_rate"]
        got = sorted(out.collect())
        assert [r.llm_n_tokens for r in got] == n.tolist()
        np.testing.assert_allclose([r.llm_posterior for r in got], p, rtol=1e-6, atol=1e-9)
        t = np.array([shares[d] for d in domains])
        rate = np.array([r.llm_rate for r in got])
        assert rate.min() >= 0 and np.abs((n * rate) @ p / n.sum() - t).max() < 2e-6
        plain = np.ones(len(n))  # plain projected gradient, taken as far as it goes
        for _ in range(40_000):
            plain = np.maximum(0, plain - p @ ((n * plain) @ p / n.sum() - t))
        assert np.abs((n * plain) @ p / n.sum() - t).max() < 2e-6
        if plain.min() > 1e-3:  # nothing projected: the way from 1 is unique
            np.testing.assert_allclose(rate, plain, atol=1e-3)


def test_mixing_rates_are_projected_and_misses_told(spark):
    rng = random.Random(13)
    p0 = [rng.random() for _ in range(200)]
    n = [rng.randint(1, 50) for _ in p0]
    rows = spark.createDataFrame([(m, [x, 1 - x]) for m, x in zip(n, p0, strict=True)], "n long, p array<double>")
    p, n = np.array([[x, 1 - x] for x in p0]), np.array(n)
    for shares, reached in (([0.1, 0.9], True), ([0.0, 1.0], False)):
        steps, miss = mixing.fit_rates(rows, np.array(shares))
        got = np.array([r[0] for r in rows.select(mixing.rate("p", steps)).collect()])
        rate = np.ones(len(n))
        for v in steps:
            rate = np.maximum(0, rate - p @ v)
        np.testing.assert_allclose(np.sort(got), np.sort(rate), atol=1e-9)
        told = (n * rate) @ p / n.sum() - shares
        assert (rate == 0).any() and np.abs(told).max() == pytest.approx(miss, abs=1e-9) and (miss < mixing.CLOSE) == reached
        plain = np.ones(len(n))
        for _ in range(40_000):
            plain = np.maximum(0, plain - p @ ((n * plain) @ p / n.sum() - shares))
        best = np.abs((n * plain) @ p / n.sum() - shares).max()
        assert miss <= best + 1e-3
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id long, kind string")
    docs = spark.createDataFrame([(0, "u v", None, None, 0, 0, ""), (1, "w x", None, None, 0, 0, "")], SCHEMA)
    with pytest.warns(UserWarning, match="rates miss the targets"):
        mixing.mixed(docs, labels, "kind", {"a": 0.5, "b": 0.25, "c": 0.25})


def test_warc_round_trip(spark, tmp_path):
    big = "\r\n\r\nWARC/1.1 é" * 6000
    rows = [(1, "http://a b", big), (2, None, "x" * 150), (3, "u", "x" * 150), (4, "u", "y"), (5, "u", "y"), (6, "u", None), (7, "u", ""), (None, "u", "x" * 150), (2, None, "x" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.Counter(tuple(r) for r in warc.round_trip(pages).collect())
    expected = collections.Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = h == "x" * 150 and i != 2
        expected[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None)] += 1
    assert got == expected
    warc.write_archives(pages, str(tmp_path / "w"))
    back = {r.page_id: r for r in warc.read_pages(spark, str(tmp_path / "w")).where("record_type = 'response'").collect()}
    assert back[1].payload.decode() == big and back[1].complete
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.where("record_type = 'continuation'").count() > 3
    torn = warc.reassembled(records.where("segment is null or segment <> 2"))
    assert not torn.where("page_id = 1").first().complete


def test_warc_revisits_name_real_records(spark, tmp_path):
    body, other = "x" * 150, "z" * 40_000
    rows = [(3, "u", body), (2, "b", body), (2, "a", body), (2, "a", body), (9, "c", body), (5, None, other), (6, "u", other), (None, "u", other)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    records = warc.read_records(spark, path).cache()
    names = [r.record_id for r in records.collect()]
    assert len(names) == len(set(names))
    assert {r.refers for r in records.where("record_type = 'revisit'").collect()} <= set(names)
    pages = warc.read_pages(spark, path).collect()
    assert len(pages) == len(rows) and all(r.complete for r in pages)
    assert collections.Counter((r.page_id, r.refers_to, r.payload_bytes) for r in pages if r.record_type == "revisit") == {(3, 2, 150): 1, (9, 2, 150): 1, (6, 5, 40_000): 1, (None, 5, 40_000): 1}
    missing = warc.resolved(warc.decoded(records.where("page_id is null or page_id <> 2 or record_type <> 'response'")))
    torn = warc.resolved(warc.decoded(records.where("segment is null or segment <> 2")))
    for left, lost in ((missing, {3, 9}), (torn, {5, 6, None})):
        assert {r.page_id for r in left.where("not complete").select("page_id").collect()} == lost
        with pytest.raises(Exception, match="broken record of page"):
            warc.checked(left).collect()
    records.unpersist()


def test_warc_large_page_comes_back(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([(1, "u", "é" * (12 << 20))], "page_id long, url string, html string"), path)
    page = warc.read_pages(spark, path).drop("payload").first()
    assert page.complete and page.payload_bytes == 24 << 20


def test_odd_rows(odd):
    n = odd.count()
    for out in (substring.remove_repeats(odd), suffix.remove_repeats(odd), jaccard.near_copies(odd), quality.judge(odd), langid.languages(odd), lm.scores(odd)):
        assert out.count() == n
    near = jaccard.near_copies(odd)
    assert {r.component_id for r in near.where("doc_id is null and n_shingles > 0").collect()} == {0}
    assert substring.remove_repeats(odd).where("doc_id = 1").select("n_removed", "kept_sha256").distinct().count() == 1


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items, pages = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        substring.remove_repeats(empty), suffix.remove_repeats(empty), jaccard.near_copies(empty), quality.judge(empty), langid.languages(empty), lm.scores(empty),
        decontam.judge(empty, items), toxicity.toxic_documents(empty, labels), mixing.mixed(empty, labels, "quality", QUALITY_SHARES), warc.round_trip(pages),
    ):
        assert out.count() == 0


def test_native_plans_have_no_python(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("op1_decontamination", "op7_mixing"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_registered(spark):
    assert set(ORACLES) <= set(QUERIES) and {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_pipeline_stages_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    expected = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out = spark.createDataFrame(out.toPandas(), out.schema)
        assert out.columns[: len(columns)] == columns and 0 < out.count() <= docs.count()
        if name == "n-gram Jaccard join":
            near = table(jaccard.near_copies(docs), "doc_id", "component_id")
            expected = {i for i, (c,) in near.items() if i == c}
            assert {r.doc_id for r in out.collect()} == expected
        if name == "substring dedup":
            again = table(substring.remove_repeats(out), "doc_id", "n_removed")
            assert sum(n for (n,) in again.values()) <= 20 * len(again)
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and "rate" in docs.columns
