"""Vector functions as Column expressions, accumulated in double precision from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - similarity; 1 where a norm is 0."""
    return 1 - cosine_similarity(a, b)


def squared_euclidean(a: Column, b: Column) -> Column:
    """Over the common length."""
    return _sum(F.transform(F.filter(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), lambda d: d.isNotNull()), lambda d: d * d))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(doubles(v))


def is_zero(v: Column) -> Column:
    return F.forall(v, lambda x: x == 0)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of small integers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def compression_ratio(dim: int, subspaces: int) -> float:
    return dim * 4 / subspaces
