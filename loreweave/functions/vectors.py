"""Vector functions over array<float> columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of different size or of no length."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)


def truncated(a: Column, dims: int) -> Column:
    """The first ``dims`` numbers (missing ones are 0), scaled to length 1."""
    head = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.get(a, i).cast("double"), F.lit(0.0)))
    length = F.sqrt(F.aggregate(head, F.lit(0.0), lambda t, x: t + x * x))
    return F.transform(head, lambda x: F.when(length > 0, x / length).otherwise(x))
