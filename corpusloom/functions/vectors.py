"""Vector and number functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if the lengths differ or a norm is 0; null for a null vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def euclid(a: Column, b: Column) -> Column:
    """Over the common components."""
    n = F.least(F.size(a), F.size(b))
    square = F.zip_with(F.slice(_doubles(a), F.lit(1), n), F.slice(_doubles(b), F.lit(1), n), lambda x, y: (x - y) * (x - y))
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x)))


def mean_over(vectors: Column, query: Column, of) -> Column:
    """The mean of of(vector, query) over an array of vectors; null if there is none."""
    total = F.aggregate(vectors, F.lit(0.0), lambda s, v: s + of(v, query))
    return F.try_divide(total, F.size(vectors).cast("double"))


def truncated(x: Column) -> Column:
    """To two decimals, toward zero."""
    return F.when(x >= 0, F.floor(x * 100)).otherwise(F.ceil(x * 100)) / 100.0
