"""Counters and histograms over a request log; batch and streaming alike.

Every function is one grouped aggregate whose partial sums are made before the
shuffle, so a method, endpoint or user that holds most of the log is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import bucket_column, cumulative_counts, quantile

# Suffix of a failed call's type, and the user when none is known.
ERROR_SUFFIX = "_error"
UNKNOWN_USER = "unknown"

# Activities that are counted, by counter name.
ACTIVITIES = {"experiments_logged": "experiment_logged", "models_saved": "model_saved"}


def time_windows(window_s: int | None, slide_s: int | None = None) -> list[Column]:
    """The grouping column of a tumbling or sliding window; none without a length."""
    if window_s is None:
        return []
    return [F.window("ts", f"{window_s} seconds", f"{slide_s or window_s} seconds").alias("window")]


def flat_window(df: DataFrame) -> DataFrame:
    """Window start and end as two plain columns."""
    if "window" not in df.columns:
        return df
    others = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *others)


def type_or_error(kind: str, error: str = "error") -> Column:
    return F.when(F.col(error), F.concat(F.col(kind), F.lit(ERROR_SUFFIX))).otherwise(F.col(kind))


def request_counts(log: DataFrame, window_s: int | None = None, slide_s: int | None = None) -> DataFrame:
    keys = ["method", "endpoint", "status_code"]
    return windowed_sums(log, keys, [F.count("*").alias("requests")], window_s, slide_s)


def recommendation_counts(log: DataFrame) -> DataFrame:
    user = F.coalesce("user_id", F.lit(UNKNOWN_USER)).alias("user_id")
    return log.groupBy(user, type_or_error("rec_type").alias("recommendation_type")).agg(F.count("*").alias("recommendations"))


def activity_counts(activities: DataFrame, kind: str = "activity") -> DataFrame:
    """One row; kinds that no counter knows are ignored."""
    return activities.agg(*[F.count_if(F.col(kind) == v).alias(c) for c, v in ACTIVITIES.items()])


def windowed_sums(
    log: DataFrame, keys: list[str | Column], sums: list[Column], window_s: int | None = None, slide_s: int | None = None
) -> DataFrame:
    """One grouped aggregate of counts and sums, ``sums``, per window and ``keys``.

    Sliding windows are made of slots as long as the slide: rows are summed per slot,
    and only the few slot rows are copied to the windows they lie in.  A stream, which
    keeps one aggregate, and a window that is no multiple of its slide copy the rows.
    """
    whole_slots = window_s and slide_s and slide_s < window_s and window_s % slide_s == 0
    if not whole_slots or log.isStreaming:
        return flat_window(log.groupBy(*time_windows(window_s, slide_s), *keys).agg(*sums))
    slots = log.groupBy(*time_windows(slide_s), *keys).agg(*sums)
    names = slots.columns[1 : 1 + len(keys)]
    added = slots.columns[1 + len(keys) :]
    slots = slots.withColumn("ts", F.col("window.start")).drop("window")
    return flat_window(slots.groupBy(*time_windows(window_s, slide_s), *names).agg(*[F.sum(c).alias(c) for c in added]))


def histogram(
    log: DataFrame,
    keys: list[str | Column],
    bounds: list[float],
    value: str = "duration_s",
    window_s: int | None = None,
    slide_s: int | None = None,
) -> DataFrame:
    """One row per group: cumulative count per bound, count ``n``, sum ``total``."""
    return windowed_sums(log, keys, cumulative_counts(F.col(value), bounds), window_s, slide_s)


def histogram_rows(wide: DataFrame, keys: list[str], bounds: list[float]) -> DataFrame:
    """(keys, le, n, total): one row per bucket, +Inf last."""
    ends = [(str(b), F.col(bucket_column(b))) for b in bounds] + [("+Inf", F.col("n"))]
    entries = F.array(*[F.struct(F.lit(le).alias("le"), count.alias("n")) for le, count in ends])
    return wide.select(*keys, "total", F.inline(entries))


def histogram_quantiles(wide: DataFrame, bounds: list[float], quantiles: dict[str, float]) -> DataFrame:
    """Add a column per quantile name, read from the buckets of each group."""
    counts = [F.col(bucket_column(b)) for b in bounds]
    return wide.withColumns({name: quantile(q, counts, F.col("n"), bounds) for name, q in quantiles.items()})
