"""Vector expressions in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Scalar product; null if a vector is null, the lengths differ or a component is null."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), product)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Scalar product over both norms; 0 if a norm is 0, null as for ``dot``."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).when(F.size(a) == F.size(b), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector over its norm, which is worked out once a row; null for a zero norm."""
    scaled = F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)))
    return F.element_at(scaled, 1)


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def searchable(v: Column, size: int) -> Column:
    """Whether a vector has the index's size and only finite components."""
    return F.coalesce((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
