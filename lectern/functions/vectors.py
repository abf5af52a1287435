"""Vector scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 where either norm is under 1e-10, null for null or unequal lengths."""
    na, nb = norm(a), norm(b)
    value = F.when(F.least(na, nb) < 1e-10, F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
    return F.when(F.size(a) == F.size(b), value)
