"""Histogram expressions: cumulative bucket counts and quantiles read from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds in seconds; the +Inf bucket is implied.
REQUEST_BOUNDS = [0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
RECOMMENDATION_BOUNDS = [0.5, 1.0, 2.0, 5.0, 10.0, 30.0]
QUERY_BOUNDS = [0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0]


def bucket_column(bound: float) -> str:
    return "le_" + str(bound).replace(".", "_")


def cumulative_counts(value: Column, bounds: list[float]) -> list[Column]:
    """One conditional count per bound plus total and sum; no row is exploded."""
    per_bound = [F.count_if(value <= F.lit(b)).alias(bucket_column(b)) for b in bounds]
    return per_bound + [F.count(value).alias("n"), F.sum(value).alias("total")]


def quantile(q: float, counts: list[Column], n: Column, bounds: list[float]) -> Column:
    """Linear interpolation inside the first bucket that reaches ``q * n``.

    The lowest bucket starts at 0; a rank above every finite bound answers the
    largest one; an empty histogram answers null.
    """
    rank = F.lit(q) * n
    branches = F.when(n == 0, F.lit(None).cast("double"))
    low, below = 0.0, F.lit(0)
    for bound, count in zip(bounds, counts):
        inside = F.try_divide(rank - below, (count - below).cast("double"))
        branches = branches.when(count >= rank, F.lit(low) + F.lit(bound - low) * F.coalesce(inside, F.lit(0.0)))
        low, below = bound, count
    return branches.otherwise(F.lit(bounds[-1]))
