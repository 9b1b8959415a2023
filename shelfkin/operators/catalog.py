"""Lookups a shopper's screen needs: one product, one category, numbered options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import markdown_lines, one_line
from .numbering import ID_BUCKET, id_bucket, numbered

# Texts standing in for missing fields, and the heading of a request.
UNKNOWN_NAME = "Unknown Product"
UNKNOWN_CATEGORY = "Unknown"
NO_DESCRIPTION = "No description available"
REQUEST_HEADING = "Generate recommendations for product:  \n"


def find_product(products: DataFrame, product_id: int) -> DataFrame:
    return products.filter(F.col("id") == F.lit(product_id))


def by_category(products: DataFrame, category: str) -> DataFrame:
    return products.filter(F.col("category") == F.lit(category))


def list_categories(products: DataFrame) -> DataFrame:
    """Categories in the order they first appear, which is by lowest id."""
    return products.groupBy("category").agg(F.min("id").alias("first_id")).orderBy("first_id")


def product_options(products: DataFrame, bucket_width: int = ID_BUCKET) -> DataFrame:
    """(category, n, id, label) with n counted from 1 within the category."""
    slim = products.select("category", "id", "name", "description")
    options = numbered(slim, ["category"], ["id"], id_bucket("id", bucket_width))
    label = F.format_string("%d. %s (%s)", "n", "name", one_line(F.col("description")))
    return options.select("category", "n", "id", label.alias("label"))


def chosen_number(label: Column) -> Column:
    """The ordinal an option label starts with."""
    return F.split(label, r"\.")[0].cast("int")


def nth_products(products: DataFrame, choices: DataFrame, bucket_width: int = ID_BUCKET) -> DataFrame:
    """Products named by (category, label) rows of ``choices``."""
    wanted = choices.select("category", chosen_number(F.col("label")).alias("n"))
    slots = numbered(products, ["category"], ["id"], id_bucket("id", bucket_width))
    return wanted.join(slots, ["category", "n"])


def product_details(products: DataFrame) -> DataFrame:
    """What a detail panel shows: defaults filled in, Markdown line breaks."""
    return products.select(
        "id",
        F.coalesce("name", F.lit(UNKNOWN_NAME)).alias("title"),
        markdown_lines(F.coalesce("description", F.lit(NO_DESCRIPTION))).alias("body"),
        F.col("image_path").isNotNull().alias("has_image"),
    )


def system_message(category: Column, name: Column, description: Column) -> Column:
    return F.concat(
        F.lit(REQUEST_HEADING),
        F.coalesce(category, F.lit(UNKNOWN_CATEGORY)),
        F.lit(" "),
        F.coalesce(name, F.lit(UNKNOWN_NAME)),
        F.lit(" ("),
        one_line(F.coalesce(description, F.lit(""))),
        F.lit(")"),
    )
