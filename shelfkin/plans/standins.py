"""How the test tables stand in for the tables this library works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import REQUEST_BOUNDS
from ..operators.counters import histogram, histogram_rows
from ..operators.generating import fill_template
from ..operators.numbering import hour_bucket, running_total

PART_TEMPLATE = "brand [p_brand]\nsize [p_size]\nprice [p_retailprice]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("p_retailprice", F.format_string("%.2f", "p_retailprice"))
    filled = fill_template(part, PART_TEMPLATE, ["p_brand", "p_size", "p_retailprice"])
    path = F.concat(F.lit("img/"), F.lower("p_type"), F.lit("_"), (F.col("p_partkey") % 5).cast("string"), F.lit(".jpg"))
    return filled.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_name").alias("name"),
        "description", path.alias("image_path"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of products: first half text, second half image, some images missing."""
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.slice(e, 1, 32).alias("text"),
        F.when(F.col("vec_id") % 17 != 0, F.slice(e, 33, 32)).alias("image"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_from_events(table(spark, sf_dir, "events"))


def product_vectors(spark: SparkSession, sf_dir: str, shuffled: bool = False) -> DataFrame:
    """Vectors that have a product; the smallest table set has some that have none.

    ``shuffled`` keeps Spark from sending the ids of a large table through the driver.
    """
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return vectors(spark, sf_dir).join(ids.hint("merge") if shuffled else ids, "id", "left_semi")


def log_from_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind.isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/"), kind).alias("endpoint"),
        F.when(kind == "error", 500).otherwise(200).alias("status_code"),
        (F.col("value") / 100).alias("duration_s"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).alias("user_id"),
        F.when(kind == "error", F.lit("view")).otherwise(kind).alias("rec_type"),
        (kind == "error").alias("error"),
    )


def samples_from_events(events: DataFrame) -> DataFrame:
    """Samples of a counter per event type and device, with the device as a column."""
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("metric"),
        F.concat(F.lit("disk"), (F.col("user_id") % 4).cast("string")).alias("device"),
        "value",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("metric"),
        F.create_map(F.lit("device"), F.concat(F.lit("disk"), (F.col("user_id") % 4).cast("string"))).alias("labels"),
        "value",
    )


def scraped_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket counters of the request log, scraped each minute that had requests.

    They start again from 0 every day; one endpoint has no 0.5 bucket, and every third
    minute the scrape misses the 0.25 bucket, so that buckets disagree.
    """
    keys = ["method", "endpoint"]
    minutes = histogram(request_log(spark, sf_dir), keys, REQUEST_BOUNDS, window_s=60)
    rows = histogram_rows(minutes, ["window_end", *keys], REQUEST_BOUNDS).withColumnRenamed("window_end", "ts")
    day = F.date_trunc("day", F.timestamp_micros(F.unix_micros("ts") - 60_000_000))
    minute = F.floor(F.unix_seconds("ts") / 60)
    counted = running_total(rows.withColumn("day", day), [*keys, "le", "day"], ["ts"], "n", hour_bucket(), "value")
    missed = ((F.col("le") == "0.5") & (F.col("endpoint") == "/view")) | ((F.col("le") == "0.25") & (minute % 3 == 0))
    return counted.filter(~missed).select(minute.alias("event_id"), "ts", *keys, "le", F.col("value").cast("double").alias("value"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")
