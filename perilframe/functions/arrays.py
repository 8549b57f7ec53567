"""Array-valued scores: softmax, argmax, dot products."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(scores: Column) -> Column:
    """Stable softmax of an array of doubles."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(powers, lambda v: v / total)


def argmax(scores: Column) -> Column:
    """Zero-based position of the largest element, first on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )
