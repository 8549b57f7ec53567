"""Reproducible pseudo-random numbers from integer arithmetic.

The same formulas run in any SQL engine with 64-bit integers, do not depend on
partitioning or retries, and need no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS = 2147483647


def key_number(df: DataFrame, key: str) -> Column:
    """An integer for each key: integers as they are, other types by hash."""
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    return F.col(key).cast("long") if whole else F.xxhash64(key)


def order_hash(key: Column, seed: int) -> Column:
    """A shuffled order of integer keys."""
    m = F.lit(MODULUS)
    return F.pmod(F.pmod(key.cast("long"), m) * F.lit(48271) + F.lit(seed * 69621), m)


def mixed(a: Column, b: Column, seed: int) -> Column:
    """Integer in [0, MODULUS) from two integer keys and a seed.

    Two quadratic rounds break the lock-step that a linear rule would leave
    between neighbouring keys.
    """
    m = F.lit(MODULUS)
    start = F.pmod(F.pmod(a.cast("long"), m) * F.lit(48271) + F.pmod(b.cast("long"), m) * F.lit(69621) + F.lit(seed * 40692), m)
    once = F.pmod(start * (start + F.lit(16807)), m)
    return F.pmod(once * (once + F.lit(48271)) + start, m)


def uniform(a: Column, b: Column, seed: int) -> Column:
    """Uniform in [0, 1)."""
    return mixed(a, b, seed) / F.lit(float(MODULUS))


def mixed_sql(a: str, b: str, seed: int) -> str:
    """The text of ``mixed`` for an engine that takes SQL (keys must be >= 0)."""
    m = MODULUS
    start = f"((({a}) % {m}) * 48271 + (({b}) % {m}) * 69621 + {seed * 40692}) % {m}"
    once = f"(({start}) * (({start}) + 16807)) % {m}"
    return f"((({once}) * (({once}) + 48271) + ({start})) % {m})"
