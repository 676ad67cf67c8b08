"""Vector expressions over arrays, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squares(v: Column) -> Column:
    return _sum(F.transform(v, lambda x: x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(squares(a) * squares(b)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


#: Score by distance name, and whether larger is better.
METRICS = {"cosine": (cosine, True), "euclidean": (euclidean, False), "manhattan": (manhattan, False)}


def normalized(v: Column) -> Column:
    """Unit length; a zero vector becomes null."""
    size = F.sqrt(squares(v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size))
