"""Vector expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; a missing place of the shorter vector is zero."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).cast("double") * F.coalesce(y, F.lit(0)).cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x / n))


def fits(a: Column, dim: int) -> Column:
    """Has ``dim`` places, all of them finite."""
    return (F.size(a) == dim) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def literal(a: Column) -> Column:
    """The text form ``[a,b,...]``."""
    return F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ","), F.lit("]"))


def topic_vector(question: Column, topics: list[list[str]]) -> Column:
    """How many words of each topic the question contains, scaled to length one."""
    q = F.lower(question)
    counts = F.array(*(sum((F.contains(q, F.lit(w)).cast("double") for w in words), F.lit(0.0)) for words in topics))
    return normalised(counts)
