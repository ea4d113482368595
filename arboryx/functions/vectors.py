"""Vector functions over array<double> columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product over the common prefix."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def l2_normalise(a: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for empty vectors, unequal lengths or a zero norm."""
    lengths = norm(a) * norm(b)
    fit = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (lengths > 0)
    return F.when(fit, dot(a, b) / lengths).otherwise(0.0)


def frame_cosine(a: Column, b: Column) -> Column:
    """Cosine over the common prefix; 1 if either vector is zero (a neutral frame fits all)."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    lengths = norm(x) * norm(y)
    return F.when(lengths > 0, dot(x, y) / lengths).otherwise(1.0)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def midpoint(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)
