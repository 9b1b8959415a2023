"""Live metrics: the batch operators behind a watermark, over a file stream.

Late rows beyond the watermark and repeated event ids are dropped.  In append mode a
window is written once, when the watermark has passed its end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.buckets import REQUEST_BOUNDS
from ..operators.counters import flat_window, histogram, request_counts, time_windows
from ..operators.rates import event_rate, mean_duration
from . import stateful

LATENESS = "10 minutes"
WINDOW_S = 300


def read_log(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def once_per_event(log: DataFrame, lateness: str = LATENESS, event_id: str = "event_id") -> DataFrame:
    """The log with a watermark on ts and each event id at most once within it."""
    return log.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([event_id])


def live_request_counts(log: DataFrame, window_s: int = WINDOW_S, lateness: str = LATENESS) -> DataFrame:
    return request_counts(once_per_event(log, lateness), window_s)


def live_durations(log: DataFrame, window_s: int = WINDOW_S, lateness: str = LATENESS) -> DataFrame:
    return histogram(once_per_event(log, lateness), ["method", "endpoint"], REQUEST_BOUNDS, window_s=window_s)


def live_rates(log: DataFrame, window_s: int = WINDOW_S, slide_s: int = 60, lateness: str = LATENESS) -> DataFrame:
    return event_rate(once_per_event(log, lateness), ["method", "endpoint", "status_code"], window_s, slide_s)


def live_mean_durations(log: DataFrame, window_s: int = WINDOW_S, slide_s: int = 60, lateness: str = LATENESS) -> DataFrame:
    return mean_duration(once_per_event(log, lateness), ["method", "endpoint"], window_s, slide_s)


def live_in_progress(log: DataFrame, window_s: int = 3600, lateness: str = LATENESS) -> DataFrame:
    return stateful.live_in_progress(once_per_event(log, lateness), window_s)


def live_counter_rates(
    samples: DataFrame, keys: list[str], window_s: int = WINDOW_S, slide_s: int = 60, lateness: str = LATENESS
) -> DataFrame:
    return stateful.live_counter_rate(once_per_event(samples, lateness), keys, window_s, slide_s)


def live_status_shares(log: DataFrame, window_s: int = WINDOW_S, slide_s: int = 60, lateness: str = LATENESS) -> DataFrame:
    """Rate per status code and its share of the window: counts per code, then the codes of a window together.

    Two aggregates behind one watermark; the second one holds a row per code.
    """
    coded = once_per_event(log, lateness).groupBy(*time_windows(window_s, slide_s), "status_code").agg(F.count("*").alias("events"))
    codes = F.collect_list(F.struct("status_code", "events", (F.col("events") / F.lit(float(window_s))).alias("rate"))).alias("codes")
    whole = flat_window(coded.groupBy("window").agg(F.sum("events").alias("whole"), codes))
    each = whole.select("window_start", "window_end", "whole", F.inline("codes"))
    return each.withColumn("share", F.col("events") / F.col("whole")).drop("whole")


def to_table(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append closed windows to parquet; without ``every``, drain what is there and stop."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def to_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], every: str = "5 seconds") -> StreamingQuery:
    """Hand every refresh to ``write`` in update mode, as a dashboard needs it."""
    return (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=every)
        .foreachBatch(write)
        .start()
    )
