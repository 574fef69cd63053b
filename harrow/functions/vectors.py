"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(row: Column, query: Column, query_norm: Column | None = None) -> Column:
    """Cosine; a zero row scores 0, a score that is not finite is an error."""
    size = norm(row) * (norm(query) if query_norm is None else query_norm)
    score = F.when(size == 0, F.lit(0.0)).otherwise(dot(row, query) / size)
    bad = F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a similarity score is not finite")).cast("double")).otherwise(score)
