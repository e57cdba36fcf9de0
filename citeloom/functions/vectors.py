"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def unit_score(cosine: Column) -> Column:
    """A cosine moved to 0..1; null, as of a zero vector, counts as 0."""
    return (F.coalesce(cosine, F.lit(0.0)) + 1) / 2


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
