"""Vector arithmetic on ARRAY<DOUBLE> columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: added to the denominator of the image cosine.
IMAGE_EPSILON = 1e-8

# Metric names a caller may ask for; True where a larger value is closer.
METRICS = {"cosine": True, "euclidean": False, "manhattan": False, "dot_product": True}


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """Cosine; 0 where either vector is all zeros, missing or holds a NaN."""
    length = norm(b) if b_norm is None else b_norm
    return F.nanvl(F.coalesce(F.try_divide(dot(a, b), norm(a) * length), F.lit(0.0)), F.lit(0.0))


def image_cosine(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """Cosine with the epsilon in the denominator; 0 for a missing image."""
    length = norm(b) if b_norm is None else b_norm
    return F.nanvl(F.coalesce(dot(a, b) / (norm(a) * length + F.lit(IMAGE_EPSILON)), F.lit(0.0)), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def closeness(metric: str, a: Column, b: Column, image: bool = False, b_norm: Column | None = None) -> Column:
    """The metric's value for one modality.

    Where either vector is missing a similarity is 0.  A distance of 0 would be the best
    there is: an item without the vector is infinitely far instead, unless the query
    ``b`` lacks it too, which then says nothing about any item.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose one of {sorted(METRICS)}")
    if metric == "cosine":
        return image_cosine(a, b, b_norm) if image else cosine(a, b, b_norm)
    body = {"euclidean": euclidean, "manhattan": manhattan, "dot_product": dot}[metric]
    none = F.lit(0.0) if METRICS[metric] else F.when(b.isNotNull(), F.lit(float("inf"))).otherwise(F.lit(0.0))
    return F.coalesce(body(a, b), none)
