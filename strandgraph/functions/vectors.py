"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, z: s + z)


def norm(a: Column) -> Column:
    """The Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def normalise(a: Column, eps: float = 0.0) -> Column:
    """The vector over its length (plus ``eps``)."""
    # the length is bound once; inside the inner lambda it would be computed again for every component
    return F.transform(F.array(norm(a) + eps), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    """The cosine of two arrays."""
    return dot(a, b) / (norm(a) * norm(b) + eps)


def l2_squared(a: Column, b: Column) -> Column:
    """The squared distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, z: s + z)


def literal(vector: list[float]) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(x)) for x in vector])
