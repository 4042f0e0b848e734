"""Vector expressions in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order; arrays of different lengths give null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either has no direction."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def _sum(terms: list[Column]) -> Column:
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def cosine_to(a: Column, query: list[float]) -> Column:
    """The cosine of a vector, which must have the query's length, to a literal query: one expression a dimension, which compiles where array lambdas don't."""
    size = sum(x * x for x in query) ** 0.5
    parts = [F.get(a, F.lit(i)).cast("double") for i in range(len(query))]
    norm = F.sqrt(_sum([p * p for p in parts]))
    return F.when(norm * F.lit(size) > 0, _sum([p * F.lit(float(x)) for p, x in zip(parts, query)]) / (norm * F.lit(size))) if query else F.lit(None).cast("double")


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def normalised(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size))
