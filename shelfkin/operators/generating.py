"""Synthetic products: repeatable features, filled descriptions, matching images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_int, in_range, pick
from ..functions.text import filled
from .numbering import numbered

# What a generated product may be made of.
CATEGORIES = ["smartphone", "laptop", "smartwatch", "tablet"]
BRANDS = ["Samsung", "Apple", "Huawei", "Xiaomi", "Lenovo", "Dell", "Sony"]
MODELS = ["Pro", "Max", "Ultra", "Galaxy", "X", "Elite", "Titan"]
OPERATING_SYSTEMS = ["Android", "iOS", "Windows 11", "macOS"]
SCREEN_TENTHS = (50, 156)
MEMORY_GB = (4, 32)
BATTERY_MAH = (2000, 10000)
DESCRIPTION_TEMPLATE = (
    "screen [screen] inch\nmemory [memory] GB\nbattery [battery] mAh\noperating system [operating_system]"
)


def product_ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1)


def generate_products(ids: DataFrame, seed: str = "0", template: str = DESCRIPTION_TEMPLATE) -> DataFrame:
    """One product per id; the same id and seed always give the same product."""
    key = F.col("id")
    features = ids.select(
        "id",
        pick(CATEGORIES, key, "category", seed).alias("category"),
        pick(BRANDS, key, "brand", seed).alias("brand"),
        pick(MODELS, key, "model", seed).alias("model"),
        (in_range(*SCREEN_TENTHS, key, "screen", seed) / 10).alias("screen"),
        in_range(*MEMORY_GB, key, "memory", seed).alias("memory"),
        in_range(*BATTERY_MAH, key, "battery", seed).alias("battery"),
        pick(OPERATING_SYSTEMS, key, "operating_system", seed).alias("operating_system"),
    )
    described = fill_template(features, template, [c for c in features.columns if c != "id"])
    return described.select(
        "id",
        F.initcap("category").alias("category"),
        F.concat_ws(" ", "brand", "model").alias("name"),
        "description",
    )


def fill_template(df: DataFrame, template: str | Column, columns: list[str], out: str = "description") -> DataFrame:
    """Add ``out``: the template with each ``[column]`` replaced by the row's value."""
    text = F.lit(template) if isinstance(template, str) else template
    return df.withColumn(out, filled(text, {c: F.col(c) for c in columns}))


def matching_files(categories: DataFrame, files: DataFrame) -> DataFrame:
    """(category, file_name) wherever a .jpg name contains the lower-cased category.

    Containment becomes an equi-join: each name is cut into its substrings of the
    lengths that categories have, and those are joined to the categories.  Names are
    at most 255 characters, so a file makes a bounded number of rows.
    """
    wanted = categories.select("category", F.lower("category").alias("piece")).filter(F.col("piece") != "").distinct()
    lengths = wanted.select(F.array_sort(F.collect_set(F.char_length("piece"))).alias("lengths")).scalar()
    jpgs = files.filter(F.col("file_name").endswith(".jpg")).select("file_name").withColumn("lengths", lengths)
    pieces = F.flatten(
        F.transform(
            "lengths",
            lambda size: F.transform(
                F.when(
                    F.char_length("file_name") >= size,
                    F.sequence(F.lit(1), F.char_length("file_name") - size + 1),
                ).otherwise(F.array().cast("array<int>")),
                lambda start: F.substring(F.col("file_name"), start, size),
            ),
        )
    )
    cut = jpgs.select("file_name", F.explode(F.array_distinct(pieces)).alias("piece"))
    return cut.join(wanted, "piece").select("category", "file_name")


def assign_images(products: DataFrame, files: DataFrame, folder: str, seed: str = "0") -> DataFrame:
    """Give each product one matching image, chosen by a hash of its id.

    Files are numbered within their category in md5 order, so the choice is an
    equi-join on (category, number).  A category without files gives a null path.
    """
    matches = matching_files(products.select("category").distinct(), files).withColumn(
        "digest", F.md5("file_name")
    )
    bucket = F.conv(F.substring("digest", 1, 3), 16, 10).cast("int")
    choices = numbered(matches, ["category"], ["digest", "file_name"], bucket).drop("digest")
    counts = matches.groupBy("category").agg(F.count("*").alias("file_count"))
    return (
        products.join(counts, "category", "left")
        .withColumn("n", hash_int(F.col("id"), "image", seed) % F.col("file_count") + 1)
        .join(choices, ["category", "n"], "left")
        .withColumn("image_path", F.concat(F.lit(folder.rstrip("/") + "/"), F.col("file_name")))
        .drop("n", "file_count", "file_name")
    )
