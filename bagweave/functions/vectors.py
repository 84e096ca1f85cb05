"""Vector functions over arrays of numbers; arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """``v`` at unit length; zero vectors stay zero."""
    return F.transform(F.array(F.greatest(norm(v), F.lit(1e-12))), lambda n: F.transform(doubles(v), lambda x: x / n))[0]


def cosine(a: Column, b: Column) -> Column:
    """The dot of unit vectors; both null 1.0, one null 0.0."""
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(dot(a, b))


def geodesic(cos: Column) -> Column:
    """The angle as a share of the half turn; null for null (the largest and least of values pass nulls over)."""
    return F.when(cos.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))) / F.pi())


def l2_of_cosine(cos: Column) -> Column:
    return F.when(cos.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * cos)))


def l2(a: Column, b: Column) -> Column:
    """Both null 0.0, one null 2.0."""
    d = F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)
    return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull() | b.isNull(), 2.0).otherwise(norm(d))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is 1, by dimension; the count is at least 1."""
    kept = F.filter(F.zip_with(vectors, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda x: x["m"] == 1)
    width = F.size(vectors[0])
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(kept, zero, lambda s, x: F.zip_with(s, doubles(x["v"]), lambda p, q: p + q))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))
