"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is zero; an error for unequal lengths."""
    size = norm(a) * norm(b)
    value = F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors have unequal lengths")).cast("double")).otherwise(value)


def strict_cosine(a: Column, b: Column) -> Column:
    """An error for empty, unequal, non-finite or zero vectors."""
    wrong = lambda v: F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    bad = (F.size(a) == 0) | (F.size(a) != F.size(b)) | wrong(a) | wrong(b) | (norm(a) == 0) | (norm(b) == 0)
    return F.when(bad, F.raise_error(F.lit("cosine needs finite non-zero vectors of one length")).cast("double")).otherwise(dot(a, b) / (norm(a) * norm(b)))
