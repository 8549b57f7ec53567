"""Language-model scores: a two-level log-bilinear model over a vocabulary that grows with the corpus, and the unigram base.

Tokens are words, A-Z lower-cased, and one end for each text. Every token seen LEAST times in training (and once in 1 /
WORD_SHARE of all tokens, so WORD_SHARE of them at most) is a word of the model. The FREQUENT words seen most often are
classes of their own; the others, and all tokens below the floor, fall into RARE classes by their first two bytes and
their last one. The first level predicts the class from the two classes before it: the context matrices map their vectors
to a predicted vector, whose products with all class vectors, plus biases, are the scores. It is trained by
noise-contrastive estimation in PASSES full passes over the counts of class triples of the whole training part: each pass
takes the gradient of every counted triple, with its count, and the expected gradient of NOISE noise classes for each.
One batched product over all contexts then gives normalised log-probabilities for every context, and scoring looks them up.

The second level predicts the word within a rare class from the two words before it: the words of a class, and one leaf
for its tokens below the floor, are the leaves of a Huffman tree, whose nodes decide by the product of their vector with
the vector predicted from the context words, plus a bias. Biases start at the log-odds of the counts, so it starts as the
unigram share. WORD_PASSES times, every training token is learned from once: tasks run through their texts from the same
weights, and a row of the weights becomes the mean of the tasks' rows, weighted by how often each used it. Below the floor
a token has the smoothed share of its count, so the model is a distribution over all tokens, unseen ones included.

Counts cover the whole training part. Tokens seen at least once in 1 / HOT_SHARE of all tokens (so HOT_SHARE of them at
most) are sent to the tasks as sorted hashes; all others are looked up by a shuffled join, so no frequent token ever
gathers its rows. Tokens are compared by 64-bit hashes. Null texts are empty: one end token. Rows are scored one by one,
whatever their ids; rows with a null id are trained on.
"""

from __future__ import annotations

import copy
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import held_out, stored
from .textio import Texts, Words, longs, mix, pieces, table

FREQUENT = 96
RARE = 32
CLASSES = FREQUENT + RARE
START = CLASSES  # context only
HOT_SHARE = 1 << 21
DIMENSIONS, NOISE, PASSES, RATE = 24, 32, 300, 0.25
LEAST = 32  # times that a word is seen in training
WORD_SHARE = 1 << 19
WORD_DIMENSIONS, WORD_PASSES, WORD_BATCH, WORD_RATE = 16, 1, 4096, 0.1
FLUSH = 1 << 21  # distinct tokens that a task holds before it sends their counts
END = np.uint64(0x656E64)  # the end token's hash
BASE = 0.1


class Tokens:
    """Tokens of texts: their hashes and rare classes, each text followed by an end."""

    def __init__(self, texts: Texts):
        w = Words(texts, lower=True)
        n = w.count + 1
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.n, self.doc = n, np.repeat(np.arange(texts.n), n)
        word = np.ones(len(self.doc), bool)
        word[self.first[1:] - 1] = False
        self.hash = np.full(len(self.doc), END)
        self.hash[word] = w.hashes()
        self.rare = np.zeros(len(self.doc), np.int64)
        if len(w.start):
            a, b, c = w.data[w.start], w.data[np.minimum(w.start + 1, w.end - 1)], w.data[w.end - 1]
            self.rare[word] = mix(a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64) << np.uint64(8) | c).astype(np.int64) & (RARE - 1)


def folded(hashes: np.ndarray, weights: list[np.ndarray], rare: np.ndarray):
    """Distinct hashes with their rare class and summed weights."""
    own, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    return own, [np.bincount(back, weights=x, minlength=len(own)).astype(np.int64) for x in weights], rare[at]


def count_tokens(docs: DataFrame) -> DataFrame:
    """token (hash), rare (class), seen (in training), total."""

    def count(batches):
        held: list = []

        def flush():
            own, (seen, total), rare = folded(np.concatenate([x[0] for x in held]), [np.concatenate([x[1][i] for x in held]) for i in (0, 1)], np.concatenate([x[2] for x in held]))
            held.clear()
            return own, (seen, total), rare

        for batch in batches:
            for part in pieces(batch):
                t = Tokens(Texts(part.column("text")))
                train = ~part.column("held").to_numpy(zero_copy_only=False)
                held.append(folded(t.hash, [train[t.doc], np.ones(len(t.doc))], t.rare))
                if sum(len(x[0]) for x in held) > FLUSH:
                    held.append(flush())
                    if len(held[0][0]) > FLUSH // 2:
                        own, (seen, total), rare = held.pop()
                        yield table(token=longs(own), rare=rare.astype(np.int32), seen=seen, total=total)
        if held:
            own, (seen, total), rare = flush()
            yield table(token=longs(own), rare=rare.astype(np.int32), seen=seen, total=total)

    parts = docs.mapInArrow(count, "token long, rare int, seen long, total long")
    return stored(parts.groupBy("token", "rare").agg(F.sum("seen").alias("seen"), F.sum("total").alias("total")))


@dataclass
class Vocabulary:
    hashes: np.ndarray  # of hot tokens, sorted
    seen: np.ndarray
    word: np.ndarray  # of a hot token: its class if it has its own, CLASSES and on for the other words of the model, else -1
    rare: np.ndarray  # class of words CLASSES and on
    word_seen: np.ndarray
    train: int  # N
    kinds: int  # V
    rare_seen: np.ndarray  # training tokens and distinct tokens of each rare class below the floor
    rare_kinds: np.ndarray

    @property
    def size(self) -> int:
        return CLASSES + len(self.rare)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, whether it is hot) of each hash."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return i, self.hashes[i] == h

    def words(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, position, whether hot) of each token; below the floor the word is the rare class."""
        i, hot = self.find(t.hash)
        word = np.where(hot, self.word[i], -1) if len(self.hashes) else np.full(len(t.hash), -1)
        return np.where(word >= 0, word, FREQUENT + t.rare).astype(np.int32), i, hot

    def classes(self) -> np.ndarray:
        """Class of each word, and of the start."""
        return np.concatenate([np.arange(CLASSES), FREQUENT + self.rare, [START]]).astype(np.int32)


def vocabulary(counts: DataFrame) -> Vocabulary:
    known = F.col("seen") > 0
    total = counts.agg(F.coalesce(F.sum("seen"), F.lit(0)).alias("n"), F.count(F.when(known, 1)).alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("all")).first()
    top = counts.where(known).orderBy(F.desc("seen"), "token").limit(FREQUENT).toPandas()
    hot = counts.where(F.col("total") >= max(2, -(-total["all"] // HOT_SHARE))).select("token", "seen", "rare").toArrow()  # HOT_SHARE rows at most
    hot = {c: hot[c].to_numpy() for c in hot.column_names}
    missing = top[~np.isin(top["token"], hot["token"])]  # in a small corpus a frequent token may be seen once
    token = np.concatenate([hot["token"], missing["token"].to_numpy(np.int64)]).view(np.uint64)
    seen = np.concatenate([hot["seen"], missing["seen"].to_numpy(np.int64)])
    rare = np.concatenate([hot["rare"], missing["rare"].to_numpy(np.int32)])
    order = np.argsort(token)
    word = np.full(len(token), -1)
    token, seen, rare = token[order], seen[order], rare[order]
    word[np.searchsorted(token, top["token"].to_numpy(np.int64).view(np.uint64))] = np.arange(len(top))
    more = np.flatnonzero((word < 0) & (seen >= max(LEAST, -(-total["all"] // WORD_SHARE))))  # at least as often as a hot token
    word[more] = CLASSES + np.arange(len(more))
    rest = counts.where(known).groupBy("rare").agg(F.sum("seen").alias("n"), F.count("*").alias("v")).toPandas()
    n, v = np.zeros(RARE), np.zeros(RARE)
    n[rest["rare"]], v[rest["rare"]] = rest["n"], rest["v"]
    own = word >= 0
    np.subtract.at(n, rare[own], seen[own].astype(float))
    np.subtract.at(v, rare[own], 1.0)
    return Vocabulary(token, seen, word, rare[more], seen[more], int(total["n"]), int(total["v"]), n, v)


def before(w: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Words two before and one before each token; ``start`` before a text."""
    one, two = np.empty_like(w), np.empty_like(w)
    one[1:], two[2:] = w[:-1], w[:-2]
    two[: min(2, len(w))] = start
    one[first[:-1]] = start
    two[first[:-1]] = start
    second = first[:-1] + 1
    two[second[second < first[1:]]] = start
    return two, one


def coded(docs: DataFrame, shared) -> DataFrame:
    """words: those of each training text, as 32-bit numbers."""

    def code(batches):
        for batch in batches:
            for part in pieces(batch):
                t = Tokens(Texts(part.column("text")))
                w, _, _ = shared.value.words(t)
                texts = pa.Array.from_buffers(pa.large_binary(), t.n.size, [None, pa.py_buffer((4 * t.first).astype(np.int64)), pa.py_buffer(w)])
                yield pa.RecordBatch.from_arrays([texts.cast(pa.binary())], names=["words"])

    return stored(docs.where(~F.col("held")).select("text").mapInArrow(code, "words binary"))


def decoded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(words, first of each text) of rows of ``coded``."""
    texts = batch.column("words").cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]]
    return np.frombuffer(data.tobytes(), np.int32), (at - at[0]) // 4


def triples(texts: DataFrame, shared) -> np.ndarray:
    """Counts (before, last, class) over the whole training part."""
    size = (CLASSES + 1) ** 2 * CLASSES

    def count(batches):
        sums = np.zeros(size, np.int64)
        of = shared.value.classes()
        for batch in batches:
            if len(batch):
                w, first = decoded(batch)
                c = of[w].astype(np.int64)
                two, one = before(c, first, START)
                cells, n = np.unique((two * (CLASSES + 1) + one) * CLASSES + c, return_counts=True)
                sums[cells] += n
        cells = np.flatnonzero(sums)
        yield table(cell=cells.astype(np.int32), n=sums[cells])

    rows = texts.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def train(counts: np.ndarray) -> np.ndarray:
    """Log10-probabilities (context, class) of a log-bilinear model fitted to triple counts."""
    rng = np.random.default_rng(7)
    normal = lambda n: rng.normal(0, 0.1, (n, DIMENSIONS)).astype(np.float32)
    own, seen = normal(CLASSES), normal(CLASSES + 1)
    maps = [np.eye(DIMENSIONS, dtype=np.float32) * np.float32(0.5) for _ in range(2)]
    unigram = counts.reshape(-1, CLASSES).sum(0) + 0.5
    noise = (unigram / unigram.sum()).astype(np.float32)
    bias = np.log(noise)
    grid = (CLASSES + 1, CLASSES + 1, DIMENSIONS)

    def predicted():
        return ((seen @ maps[0])[:, None, :] + (seen @ maps[1])[None, :, :]).reshape(-1, DIMENSIONS)

    if counts.sum() > 0:
        share = (counts / counts.sum()).astype(np.float32).reshape(-1, CLASSES)
        at = np.flatnonzero(share.sum(1))
        share = share[at]
        fake = share.sum(1, keepdims=True) * (NOISE * noise)  # expected noise of each context
        weights = [own, seen, maps[0], maps[1], bias]
        past = [np.full_like(x, 1e-8) for x in weights]
        logk = np.log(NOISE * noise)
        for _ in range(PASSES):
            q = predicted()[at]
            s = q @ own.T
            s += bias - logk
            np.clip(s, -30, 30, out=s)
            up = share - (share + fake) / (1 + np.exp(-s))  # true triples up, noise down
            dq = np.zeros((grid[0] * grid[1], DIMENSIONS), np.float32)
            dq[at] = up @ own
            dq = dq.reshape(grid)
            two, one = dq.sum(1), dq.sum(0)
            grads = [up.T @ q, two @ maps[0].T + one @ maps[1].T, seen.T @ two, seen.T @ one, up.sum(0)]
            for x, g, p in zip(weights, grads, past, strict=True):  # Adagrad
                p += g * g
                x += RATE * g / np.sqrt(p)
    s = predicted() @ own.T + bias
    s -= s.max(1, keepdims=True)
    return ((s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)).astype(np.float32)


@dataclass
class Tree:
    """Paths of words to their leaves: steps first[w]:first[w + 1], each a node and whether its first branch is taken."""

    first: np.ndarray
    node: np.ndarray
    yes: np.ndarray
    bias: np.ndarray  # log-odds of the counts at each node

    def paths(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, node, whether its first branch is taken) of each step of the tokens' paths."""
        n = self.first[w + 1] - self.first[w]
        at = np.arange(n.sum()) + np.repeat(self.first[w] - np.cumsum(n) + n, n)
        return np.repeat(np.arange(len(w)), n), self.node[at], self.yes[at]


def tree(v: Vocabulary) -> Tree:
    """Huffman trees of the rare classes' words; the class itself is the leaf of its tokens below the floor."""
    up, side, bias = np.full(v.size, -1), np.zeros(v.size, bool), []
    ends: list = []  # node above each node, and whether it is its first branch
    below = v.rare_seen + BASE * (v.rare_kinds + 1)
    for r in range(RARE):
        leaves = [(float(below[r]), ~(FREQUENT + r))]
        leaves += [(float(n), ~int(w)) for w, n in zip(CLASSES + np.flatnonzero(v.rare == r), v.word_seen[v.rare == r], strict=True)]
        heapq.heapify(leaves)
        while len(leaves) > 1:
            a, b = heapq.heappop(leaves), heapq.heappop(leaves)
            node = len(bias)
            for (_, x), first in ((a, True), (b, False)):
                if x < 0:
                    up[~x], side[~x] = node, first
                else:
                    ends[x] = (node, first)
            ends.append((-1, False))
            bias.append(np.log(a[0] / b[0]))
            heapq.heappush(leaves, (a[0] + b[0], node))
    above = np.array([x for x, _ in ends] + [-1])
    turn = np.array([x for _, x in ends] + [False])
    words, nodes, sides = [], [], []
    at, flag = up, side
    own = np.arange(v.size)
    while len(own := own[at >= 0]):  # one level up at a time
        flag, at = flag[at >= 0], at[at >= 0]
        words.append(own)
        nodes.append(at)
        sides.append(flag)
        at, flag = above[at], turn[at]
    words = np.concatenate([*words, np.zeros(0, int)])
    order = np.argsort(words, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=v.size))])
    pick = lambda x, kind: np.concatenate([*x, np.zeros(0, kind)])[order].astype(kind)
    return Tree(first, pick(nodes, np.int32), pick(sides, np.float32), np.array(bias, np.float32))


class WordModel:
    """Weights of the second level: rows of word vectors (and the start's), of nodes, of two maps. The last column is a node's bias."""

    def __init__(self, v: Vocabulary, t: Tree):
        d = WORD_DIMENSIONS
        self.nodes, self.maps = v.size + 1, v.size + 1 + len(t.bias)
        self.rows = np.zeros((self.maps + 2 * d, d), np.float32)
        self.rows[: self.nodes, :-1] = np.random.default_rng(11).normal(0, 0.1, (self.nodes, d - 1))
        self.rows[self.nodes : self.maps, -1] = t.bias
        self.rows[self.maps :] = np.tile(np.diag([0.5] * (d - 1) + [0]), (2, 1))

    def copy(self) -> WordModel:
        out = copy.copy(self)
        out.rows = self.rows.copy()
        return out

    def predicted(self, two: np.ndarray, one: np.ndarray):
        """(the context's vectors, the predicted vector, whose last column is 1 for the bias)."""
        both = np.concatenate([self.rows.take(two, 0), self.rows.take(one, 0)], axis=1)
        q = both @ self.rows[self.maps :]
        q[:, -1] = 1
        return both, q

    def logp(self, t: Tree, two: np.ndarray, one: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Log10-probability of each word within its class."""
        out = np.zeros(len(w))
        own = np.flatnonzero(t.first[w + 1] > t.first[w])
        for i in range(0, len(own), WORD_BATCH):
            at = own[i : i + WORD_BATCH]
            _, q = self.predicted(two[at], one[at])
            token, node, yes = t.paths(w[at])
            s = np.einsum("ij,ij->i", q.take(token, 0), self.rows.take(self.nodes + node, 0)) * (1 - 2 * yes)
            out[at] = np.bincount(token, weights=-(np.maximum(s, 0) + np.log1p(np.exp(-np.abs(s)))), minlength=len(at))
        return out / np.log(10)

    def learn(self, t: Tree, two: np.ndarray, one: np.ndarray, w: np.ndarray, past: np.ndarray, used: np.ndarray) -> None:
        """One step from the paths of some words; ``past`` sums squared gradients and ``used`` counts the uses of each row."""
        d = WORD_DIMENSIONS
        n = t.first[w + 1] - t.first[w]
        order = np.argsort(-n, kind="stable")  # longest paths first: each depth is a prefix
        two, one, at = two[order], one[order], t.first[w[order]]
        deep = np.searchsorted(-n[order], -np.arange(1, n.max(initial=0) + 1), side="right")
        both, q = self.predicted(two, one)
        dq, nodes, grads = np.zeros_like(q), [], []
        for depth, m in enumerate(deep):
            node = self.nodes + t.node[at[:m] + depth]
            row = self.rows.take(node, 0)
            err = t.yes[at[:m] + depth] - 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", q[:m], row), -30, 30)))
            row *= err[:, None]
            dq[:m] += row
            nodes.append(node)
            grads.append(q[:m] * err[:, None])
        dq[:, -1] = 0
        dx = dq @ self.rows[self.maps :].T
        self.step(np.concatenate(nodes), np.concatenate(grads), past, used)
        self.step(np.concatenate([two, one]), np.concatenate([dx[:, :d], dx[:, d:]]), past, used)
        self.step(np.arange(self.maps, len(self.rows)), both.T @ dq, past, used)

    def step(self, at: np.ndarray, grads: np.ndarray, past: np.ndarray, used: np.ndarray) -> None:
        hit = np.zeros(len(self.rows), bool)
        hit[at] = True
        own = np.flatnonzero(hit)
        place = np.empty(len(self.rows), np.uint16 if len(own) <= 1 << 16 else np.int64)
        place[own] = np.arange(len(own))
        at = place[at]
        times = np.bincount(at, minlength=len(own))
        g = np.add.reduceat(grads.take(np.argsort(at, kind="stable"), 0), np.cumsum(times) - times)
        used[own] += times
        past[own] += np.einsum("ij,ij->i", g, g) / g.shape[1]  # Adagrad, by row
        self.rows[own] += g * (WORD_RATE / np.sqrt(past[own]))[:, None]


def train_words(texts: DataFrame, v: Vocabulary, t: Tree) -> WordModel:
    """The second level, learned from every training token WORD_PASSES times."""
    model = WordModel(v, t)
    if not len(t.bias):
        return model
    spark = texts.sparkSession
    names = [f"x{i}" for i in range(WORD_DIMENSIONS)]
    shared = spark.sparkContext.broadcast(t)
    start = v.size
    for _ in range(WORD_PASSES):
        now = spark.sparkContext.broadcast(model)

        def run(batches, now=now):
            own, paths = now.value, shared.value
            own = own.copy()
            past, used = np.full(len(own.rows), 1e-8, np.float32), np.zeros(len(own.rows), np.int64)
            for batch in batches:
                if not len(batch):
                    continue
                w, first = decoded(batch)
                two, one = before(w, first, start)
                at = np.flatnonzero(paths.first[w + 1] > paths.first[w])
                for i in range(0, len(at), WORD_BATCH):
                    x = at[i : i + WORD_BATCH]
                    own.learn(paths, two[x], one[x], w[x], past, used)
            at = np.flatnonzero(used)
            yield table(row=at.astype(np.int32), used=used[at], **{n: own.rows[at, i] * used[at].astype(np.float64) for i, n in enumerate(names)})

        parts = texts.coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(run, "row int, used long, " + ", ".join(f"{n} double" for n in names))
        mean = parts.groupBy("row").agg(*((F.sum(n) / F.sum("used")).cast("float").alias(n) for n in names)).toArrow()
        model = model.copy()
        at = mean["row"].to_numpy()
        for i, n in enumerate(names):
            model.rows[at, i] = mean[n].to_numpy()
        now.unpersist()
    return model


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, a row for each input row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(10).alias("held"))
    counts = count_tokens(rows.select("text", "held"))
    words = vocabulary(counts)
    shared = spark.sparkContext.broadcast(words)
    texts = coded(rows, shared)
    model = spark.sparkContext.broadcast(train(triples(texts, shared)))
    paths = tree(words)
    second = spark.sparkContext.broadcast((paths, train_words(texts, words, paths)))
    within = np.log10(words.rare_seen + BASE * (words.rare_kinds + 1))

    def score(batches):
        of = shared.value.classes()
        for batch in batches:
            for part in pieces(batch):
                t, v, m = Tokens(Texts(part.column("text"))), shared.value, len(part)
                w, i, hot = v.words(t)
                two, one = before(w, t.first, v.size)
                c = of[w]
                logp = model.value[of[two] * (CLASSES + 1) + of[one], c].astype(float)
                logp += second.value[1].logp(second.value[0], two, one, w)
                alone = (w < FREQUENT) | (w >= CLASSES)
                logp[~alone] -= within[c[~alone] - FREQUENT]
                count = np.where(hot, v.seen[i], 0) if len(v.seen) else np.zeros(len(c))
                logc = np.where(hot, np.log10(count + BASE), 0.0)
                far = ~hot
                key = mix(t.hash[far] ^ (t.doc[far].astype(np.uint64) << np.uint64(32)))
                _, at, times = np.unique(key, return_index=True, return_counts=True)
                doc = t.doc[far][at]
                order = np.argsort(doc, kind="stable")
                offsets = np.searchsorted(doc[order], np.arange(m + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(offsets, pa.array(longs(t.hash[far][at][order])))
                often = pa.ListArray.from_arrays(offsets, pa.array(times[order].astype(np.int32)))
                add = lambda x: np.bincount(t.doc, weights=x, minlength=m)
                names = ["doc_id", "held", "n_tokens", "hot_known", "hot_logc", "model", "rare", "often"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held"), pa.array(t.n.astype(np.int64)), pa.array(add(hot & (count > 0)).astype(np.int64)), pa.array(add(logc)), pa.array(add(logp + np.where(alone, 0.0, logc))), rare, often], names=names)

    kind = dict(docs.dtypes)["doc_id"]
    scored = rows.mapInArrow(score, f"doc_id {kind}, held boolean, n_tokens long, hot_known long, hot_logc double, model double, rare array<long>, often array<int>")
    done = stored(scored.withColumn("row", F.monotonically_increasing_id()))  # row numbers are fixed once written
    pairs = done.select("row", F.explode(F.arrays_zip("rare", "often")).alias("x")).select("row", F.col("x.rare").alias("token"), F.col("x.often").alias("times"))
    looked = pairs.join(counts.select("token", "seen"), "token")
    per = looked.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("seen") + BASE)).alias("logc"), F.sum(F.when(F.col("seen") > 0, F.col("times")).otherwise(0)).alias("known"))
    out = done.drop("rare", "often").join(per, "row", "left")
    logc, known = F.coalesce("logc", F.lit(0.0)), F.coalesce("known", F.lit(0))
    base = F.col("hot_logc") + logc - F.col("n_tokens") * float(np.log10(words.train + BASE * (words.kinds + 1)))
    return out.select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("hot_known") + known).cast("long").alias("n_known"),
        F.lit(words.train).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") + logc).alias("score"),
    )
