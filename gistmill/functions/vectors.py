"""Dense vector columns (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gistmill.functions.arrays import let


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    v = as_double(v)
    return let(norm(v), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: F.try_divide(x, n))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector is all zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
