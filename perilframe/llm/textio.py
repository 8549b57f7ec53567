"""Texts of an Arrow batch as numpy arrays: bytes, words, hashes of words and of windows of words.

Word hashes have 64 bits and depend on the bytes alone, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

PIECE_BYTES = 4 << 20  # text worked on at once; one longer text is a piece of its own
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACE
_b = np.arange(256)
ALNUM = ((_b >= 48) & (_b <= 57)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)  # of lower-cased bytes
LOWER = np.where((_b >= 65) & (_b <= 90), _b + 32, _b).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


BYTE = numbers(256, 1)
_place = numbers(1 << 12, 2)


def place(n: int) -> np.ndarray:
    global _place
    if n > len(_place):
        _place = numbers(2 * n, 2)
    return _place


class Texts:
    """Bytes of a column of strings, nulls as empty texts."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        n, width = len(column), np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
        _, at, data = column.buffers()
        at = np.frombuffer(at, width)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)
        self.at = at - at[0]
        self.n = n


class Words:
    """Words: maximal runs of member bytes within one text. ``first[i]:first[i + 1]`` are those of text i."""

    def __init__(self, texts: Texts, lower: bool = False, member: np.ndarray = NOT_SPACE):
        data = LOWER[texts.data] if lower else texts.data
        inside = member[data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = texts.at[texts.at < len(data)]
        before[edge] = False
        edge = texts.at[texts.at > 0]
        after[edge - 1] = False
        self.texts, self.data, self.inside = texts, data, inside
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, texts.at)
        self.count = np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.count)

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        at = np.concatenate([[0], np.cumsum(length)[:-1]])
        pos = np.arange(at[-1] + length[-1]) - np.repeat(at, length)
        value = BYTE[self.data[self.inside]]
        value *= place(int(length.max()))[pos]
        return mix(np.add.reduceat(value, at) + length.astype(np.uint64))


def windows(h: np.ndarray, first: np.ndarray, k: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each word on, whether all of them are of one text)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(m, np.uint64)
    for c, j in zip(numbers(k, seed), range(k), strict=True):
        out += h[j : j + m] * c
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return mix(out), doc[:m] == doc[k - 1 :]


def sliding(op, x: np.ndarray, w: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over each w neighbours, by doubling."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = op(x[:-step], x[step:])
        done += step
    return x


def anchors(h: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the least of some w neighbouring valid ones: equal stretches have equal anchors."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    h = h | np.uint64(1)  # 0 marks stretches that are not valid
    low = np.where(valid, h, np.uint64(0))
    low = sliding(np.minimum, low, w)  # 0 as soon as one is not valid
    pad = np.zeros(w - 1, np.uint64)
    high = sliding(np.maximum, np.concatenate([pad, low, pad]), w)
    return np.flatnonzero((high == h) & valid)


def pieces(batch: pa.RecordBatch, text: str = "text", size: int = PIECE_BYTES):
    """The batch in slices of about ``size`` bytes of text."""
    at = Texts(batch.column(text)).at
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def append_columns(df: DataFrame, text: str, fields: str, work) -> DataFrame:
    """``df`` with further columns; ``work(Texts)`` returns their arrays for a piece of the rows."""
    extra = StructType.fromDDL(fields)
    schema = StructType(df.schema.fields + extra.fields)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, work(Texts(part.column(text))))], names=schema.names)

    return df.mapInArrow(run, schema)


def longs(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers as Spark's longs."""
    return x.view(np.int64)


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def column(batches, name: str) -> np.ndarray:
    return np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in batches])
