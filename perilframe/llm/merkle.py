"""Document fingerprints: a Merkle tree over the paragraphs and sections of a text.

Leaves are paragraphs: lines with their line break, long lines cut behind words whose hash is 0 modulo LEAF_WORDS, so
that cuts depend on the words beside them alone and an edit moves none elsewhere; where no such word comes for MOST_BYTES, that
many bytes are a leaf. A section ends behind a blank line, or
behind a leaf whose digest is 0 modulo SECTION_LEAVES. Leaves are digests of their bytes, sections of their leaves, the root of its
sections. Leaves cover every byte, so equal roots mean equal texts. Where roots differ, sections equal on both sides are
skipped whole, and the leaves of the others tell which parts are edited.

A fingerprint is text: the root, then each section as the first LEAF_HEX digits of each of its leaves, behind a colon. The
likeness of two fingerprints is the share of their leaves that both have, 2 * common / (all of one + all of the other).

``edited_neighbours`` needs the document that follows by doc_id: texts are dealt by ranges of doc_id, once, and each task goes through
its rows in order. Only the last text of each task waits for the first of the next one; these two a task are kept with the
stored fingerprints and joined by task number.

Odd input. A null text is empty: its tree has no leaves, two empty fingerprints have likeness 1. Rows are ordered by doc_id, nulls
first, then by the text's hash; repeated rows follow each other. A table of one row is its own next document; an empty table gives
no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored
from .textio import SPACE, Texts, Words, pieces

LEAF_WORDS = 8  # words a leaf, on average
SECTION_LEAVES = 8  # leaves a section, on average
MOST_BYTES = 512  # of a leaf
LEAF_HEX = 6
DIGEST = 16  # bytes

FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_begin long, edit_end long"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


class Tree:
    """Sections of a text as (digest, leaf digests, leaf lengths in bytes), and the root."""

    __slots__ = ("sections", "root")

    def __init__(self, leaves: list[bytes]):
        self.sections, run, size = [], [], []
        for leaf in leaves:
            d = digest(leaf)
            run.append(d)
            size.append(len(leaf))
            if d[0] % SECTION_LEAVES == 0 or not leaf.strip():
                self.sections.append((digest(b"".join(run)), run, size))
                run, size = [], []
        if run:
            self.sections.append((digest(b"".join(run)), run, size))
        self.root = digest(b"".join(s[0] for s in self.sections))

    def fingerprint(self) -> str:
        return ":".join([self.root.hex(), *("".join(d.hex()[:LEAF_HEX] for d in leaves) for _, leaves, _ in self.sections)])


def trees(texts: Texts) -> list[Tree]:
    """The trees of a piece of texts; cuts are found for all of them together."""
    w = Words(texts)
    end = np.flatnonzero(w.hashes() % np.uint64(LEAF_WORDS) == 0)
    end = end[end + 1 < len(w.start)]
    cuts = np.concatenate([w.start[end + 1], np.flatnonzero(texts.data == 10) + 1, texts.at])
    cuts = np.unique(cuts)
    n = 1 + (np.diff(cuts, append=cuts[-1] + 1) - 1) // MOST_BYTES
    cuts = np.repeat(cuts, n) + MOST_BYTES * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    raw, place = texts.data.tobytes(), np.searchsorted(cuts, texts.at).tolist()
    cuts = cuts.tolist()
    return [Tree([raw[a:b] for a, b in zip(cuts[lo:hi], cuts[lo + 1 : hi + 1], strict=True)]) for lo, hi in zip(place[:-1], place[1:], strict=True)]


def likeness(a: str, b: str) -> float:
    """Share of leaves that two fingerprints have in common, from 0 to 1."""
    root, *mine = a.split(":")
    other, *theirs = b.split(":")
    if root == other:
        return 1.0
    total = sum(map(len, mine)) + sum(map(len, theirs))
    mine, theirs = Counter(mine), Counter(theirs)
    same = mine & theirs
    common = sum(len(s) * n for s, n in same.items())
    cut = lambda sections: Counter(s[i : i + LEAF_HEX] for s, n in sections.items() for _ in range(n) for i in range(0, len(s), LEAF_HEX))
    common += LEAF_HEX * (cut(mine - same) & cut(theirs - same)).total()
    return 2 * common / total if total else 0.0


def edited_span(a: Tree, b: Tree) -> tuple[int, int] | None:
    """(begin, end) in bytes of ``a``: outside, ``a`` and ``b`` have the same leaves; None if the roots are equal."""
    if a.root == b.root:
        return None

    def equal_bytes(step: int) -> int:
        total = 0
        for x, y in zip_longest(a.sections[::step], b.sections[::step]):
            if x and y and x[0] == y[0]:
                total += sum(x[2])
                continue
            if x and y:
                for d, e, n in zip(x[1][::step], y[1][::step], x[2][::step], strict=False):
                    if d != e:
                        break
                    total += n
            return total
        return total

    size = sum(sum(s[2]) for s in a.sections)
    begin = equal_bytes(1)
    return begin, size - min(equal_bytes(-1), size - begin)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, root, fingerprint and sections (leaf digests) of each text."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                made = trees(Texts(part.column("text")))
                leaves = [[[d.hex() for d in s[1]] for s in t.sections] for t in made]
                columns = [part.column("doc_id"), pa.array([t.root.hex() for t in made], pa.string()), pa.array([t.fingerprint() for t in made], pa.string()), pa.array(leaves, pa.list_(pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "root", "fingerprint", "sections"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, root string, fingerprint string, sections array<array<string>>")


def compared(ids: list, own: list[str], following: list[str]) -> list[tuple]:
    """Rows of FIELDS: each text against its edit and against the text that follows it."""
    changed = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(own, following, strict=True)]
    made = trees(Texts(pa.array([*own, *changed, *following], pa.large_string())))
    k = len(own)
    prints = [t.fingerprint() for t in made]
    rows = []
    for i, (doc_id, text, edit) in enumerate(zip(ids, own, changed, strict=True)):
        span = edited_span(made[i], made[k + i])
        if span:
            raw = text.encode()
            span = tuple(len(raw[:b].decode(errors="ignore")) for b in span)
        hashed = hashlib.sha256(edit.encode()).hexdigest()
        rows.append((doc_id, len(text), hashed, prints[i], prints[k + i], likeness(prints[i], prints[k + i]), likeness(prints[i], prints[2 * k + i]), *(span or (None, None))))
    return rows


KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def as_batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """FIELDS, a row for each document: its fingerprint, that of its edit, and their likenesses.

    The edit replaces the last half of the code points (rounded down) by as many, or all, from the beginning of the next
    document by doc_id; the first document follows the last. edit_begin and edit_end are where the trees of the text and its edit
    differ, in code points of the text; null where they are equal.
    """
    edge_kinds, edge_names = [*KINDS, pa.int32(), pa.string(), pa.string()], [*NAMES, "task", "head", "tail"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), "llm_h", "llm_row"]
    dealt = rows.withColumns({"llm_h": F.xxhash64("text"), "llm_row": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)

    def inner(batches):
        """Finished rows; one row with the first text and one with the last, unfinished, of the task."""
        task, held, head = TaskContext.get().partitionId(), None, None
        blank = (None,) * 8
        for batch in batches:
            for part in pieces(batch):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                if held:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                else:
                    head = texts[0]
                held = ids[-1], texts[-1]
                if len(ids) > 1:
                    yield as_batch([(*r, task, None, None) for r in compared(ids[:-1], texts[:-1], texts[1:])], edge_kinds, edge_names)
        if held:
            yield as_batch([(held[0], *blank, task, head, held[1])], edge_kinds, edge_names)

    def joined(batches):
        for batch in batches:
            for part in pieces(batch, "tail"):
                yield as_batch(compared(*(part.column(c).to_pylist() for c in ("doc_id", "tail", "following"))), KINDS, NAMES)

    done = stored(dealt.select("doc_id", "text").mapInArrow(inner, f"{FIELDS}, task int, head string, tail string"), compression="zstd")
    edges = done.where(F.col("head").isNotNull())
    number = Window.orderBy("task")  # a row for each task
    after = edges.select("task").withColumn("next", F.coalesce(F.lead("task").over(number), F.min("task").over(Window.partitionBy())))
    last = edges.select("doc_id", "task", "tail").join(after, "task")
    open_rows = last.join(edges.select(F.col("task").alias("next"), F.col("head").alias("following")), "next")
    return done.where(F.col("head").isNull()).select(*NAMES).unionByName(open_rows.select("doc_id", "tail", "following").mapInArrow(joined, FIELDS))
