"""Rates over sliding windows, from events or from sampled counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .counters import windowed_sums
from .numbering import hour_bucket, previous_value

WINDOW_S = 300  # fixed value: the five minutes the dashboards look back


def event_rate(log: DataFrame, keys: list[str], window_s: int = WINDOW_S, slide_s: int = 60) -> DataFrame:
    """Events per second and series in each window."""
    counted = windowed_sums(log, keys, [F.count("*").alias("events")], window_s, slide_s)
    return counted.withColumn("rate", F.col("events") / F.lit(float(window_s)))


def counter_increases(samples: DataFrame, keys: list[str], tie: str = "event_id") -> DataFrame:
    """Per sample, how much the counter grew since the one before.

    A value below its predecessor means the counter restarted from 0; the first
    sample of a series has no predecessor and grows by nothing.
    """
    previous = previous_value(samples, keys, "ts", "value", tie, hour_bucket())
    grown = (
        F.when(F.col("previous").isNull(), F.lit(0.0))
        .when(F.col("value") < F.col("previous"), F.col("value"))
        .otherwise(F.col("value") - F.col("previous"))
    )
    return previous.withColumn("increase", grown).drop("previous")


def counter_rate(samples: DataFrame, keys: list[str], window_s: int = WINDOW_S, slide_s: int = 60, tie: str = "event_id") -> DataFrame:
    grown = counter_increases(samples, keys, tie)
    summed = windowed_sums(grown, keys, [F.sum("increase").alias("increase")], window_s, slide_s)
    return summed.withColumn("rate", F.col("increase") / F.lit(float(window_s)))


def status_shares(log: DataFrame, window_s: int = WINDOW_S, slide_s: int = 60) -> DataFrame:
    """Rate per status code and its share of the window; a window has few codes."""
    rates = event_rate(log, ["status_code"], window_s, slide_s)
    whole = Window.partitionBy("window_start")
    return rates.withColumn("share", F.col("rate") / F.sum("rate").over(whole))


def mean_duration(log: DataFrame, keys: list[str], window_s: int = WINDOW_S, slide_s: int = 60) -> DataFrame:
    """Rate of the duration sum over rate of the count: the window's mean duration."""
    sums = [F.sum("duration_s").alias("total"), F.count("duration_s").alias("n")]
    summed = windowed_sums(log, keys, sums, window_s, slide_s)
    return summed.withColumn("mean_s", F.try_divide(F.col("total"), F.col("n")))


def recent(df: DataFrame, as_of: Column, seconds: int = 3600, ts: str = "ts") -> DataFrame:
    """Rows of the last hour (or ``seconds``) up to ``as_of``."""
    start = F.timestamp_micros(F.unix_micros(as_of) - F.lit(seconds * 1_000_000))
    return df.filter((F.col(ts) >= start) & (F.col(ts) <= as_of))


def retained(df: DataFrame, as_of: Column, days: int = 15, ts: str = "ts") -> DataFrame:
    """Rows young enough to keep."""
    return df.filter(F.col(ts) >= F.timestamp_micros(F.unix_micros(as_of) - F.lit(days * 86_400_000_000)))


def write_retained(df: DataFrame, path: str, as_of: Column, days: int = 15, ts: str = "ts") -> None:
    """Store the rows to keep, a folder per day.

    Only the days that ``df`` holds are written anew; folders of days that have expired
    are dropped after the write, also by an empty batch, all others stay as they are.
    ``as_of`` is a value: a literal or a scalar subquery.
    """
    kept = retained(df, as_of, days, ts).withColumn("day", F.to_date(ts))
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    first_day = F.to_date(F.timestamp_micros(F.unix_micros(as_of) - F.lit(days * 86_400_000_000)))
    _drop_expired_days(df.sparkSession, path, df.sparkSession.range(1).select(first_day))


def _drop_expired_days(spark: SparkSession, path: str, first_day: DataFrame) -> None:
    """Delete the day folders before the first day to keep; one small row reaches the driver."""
    row = first_day.first()
    if row[0] is None:
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("day=") and name < f"day={row[0].isoformat()}":
            files.delete(status.getPath(), True)
