"""Gauges: values in force at a moment rather than counted up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import moment, running_total, step_down

# Lower bounds of the colour bands per gauge, ascending.
THRESHOLDS = {
    "cpu_percent": [(0, "green"), (70, "yellow"), (90, "red")],
    "memory_percent": [(0, "green"), (80, "yellow"), (95, "red")],
    "up": [(0, "red"), (1, "green")],
}


def in_progress(log: DataFrame, window_s: int = 3600, slot_s: int = 60) -> DataFrame:
    """Most requests under way at once, per method, endpoint and window.

    A request is under way from its start up to, not including, its end; without a
    duration it has not ended.  A window counts what was carried into it, and every
    window from the first start to the last end has a row.

    Moves at the same moment are added up first.  The running sum is taken slot by slot
    with the net total of the slots before as offset, so a busy endpoint is spread over
    as many tasks as it has slots; carrying over windows only sees one row per window.
    """
    series = ["method", "endpoint"]
    begun = F.unix_micros("ts")
    lasts = F.round(F.col("duration_s") * 1_000_000).cast("long")
    ended = begun + F.when(lasts.isNotNull(), F.greatest(F.lit(0), lasts))
    steps = F.array(
        F.struct(begun.alias("at"), F.lit(1).alias("delta")), F.struct(ended.alias("at"), F.lit(-1).alias("delta"))
    )
    moves = log.filter("ts is not null").select(*series, F.inline(steps)).filter("at is not null")
    moves = moves.groupBy(*series, "at").agg(F.sum("delta").alias("delta"))
    slot = step_down(F.col("at"), slot_s * 1_000_000)
    gauge = running_total(moves, series, ["at"], "delta", slot, "open")
    width = window_s * 1_000_000
    windows = gauge.groupBy(*series, step_down(F.col("at"), width).alias("start")).agg(
        F.max("open").alias("peak"), F.sum("delta").alias("net"), F.min("at").alias("first")
    )
    ordered = Window.partitionBy(*series).orderBy("start")
    before = F.coalesce(F.sum("net").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    following = F.coalesce(F.lead("start").over(ordered), F.col("start") + width)
    carried = windows.withColumns({"carried": before, "following": following})
    # A quiet stretch up to the next window with moves holds what was open at its start.
    most = F.when(F.col("first") > F.col("start"), F.greatest("carried", "peak")).otherwise(F.col("peak"))
    own = F.struct(F.col("start").alias("at"), most.alias("most_in_progress"))
    gap = F.when(
        F.col("following") > F.col("start") + width,
        F.transform(
            F.sequence(F.col("start") + width, F.col("following") - width, F.lit(width)),
            lambda at: F.struct(at.alias("at"), (F.col("carried") + F.col("net")).alias("most_in_progress")),
        ),
    )
    rows = carried.select(*series, F.inline(F.concat(F.array(own), F.coalesce(gap, F.array()))))
    return rows.select(
        F.timestamp_micros("at").alias("window_start"), F.timestamp_micros(F.col("at") + width).alias("window_end"), *series, "most_in_progress"
    )


def last_values(df: DataFrame, keys: list[str | Column], value: str = "value", tie: str = "event_id") -> DataFrame:
    """The latest value that is not null, per series."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.max_by(value, moment(tie=tie)).alias(value), F.max("ts").alias("ts"))
    )


def service_status(scrapes: DataFrame, jobs: DataFrame, as_of: Column, tie: str = "event_id") -> DataFrame:
    """(job, up, status) for every known job.

    A job is UP when its last scrape said so and is no older than the job's scrape
    interval; a job that never answered is DOWN.  ``jobs`` has (job, interval_s).
    """
    last = scrapes.filter(F.col("ts") <= as_of).groupBy("job").agg(
        F.max_by("up", moment(tie=tie)).alias("last_up"), F.max("ts").alias("last_ts")
    )
    fresh = F.unix_micros(as_of) - F.unix_micros("last_ts") <= F.col("interval_s") * 1_000_000
    up = F.when(fresh & (F.col("last_up") == 1), 1).otherwise(0)
    return (
        jobs.join(last, "job", "left")
        .withColumn("up", F.coalesce(up, F.lit(0)))
        .select("job", "up", F.when(F.col("up") == 1, "UP").otherwise("DOWN").alias("status"))
    )


def colour_bands(values: DataFrame, thresholds: dict[str, list[tuple[float, str]]] = THRESHOLDS) -> DataFrame:
    """Add the colour of the highest bound a (metric, value) row reaches; else null."""
    colour = F.lit(None).cast("string")
    for metric, steps in thresholds.items():
        for bound, name in steps:
            reached = (F.col("metric") == metric) & (F.col("value") >= F.lit(float(bound)))
            colour = F.when(reached, F.lit(name)).otherwise(colour)
    return values.withColumn("colour", colour)
