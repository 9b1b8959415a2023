"""Checks and cleaning between reading a product file and storing it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview
from ..schema import PRODUCT_COLUMNS, VARCHAR_COLUMNS, VARCHAR_LIMIT

# Cell texts the CSV reader takes for "no value".
NA_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def require_columns(df: DataFrame, columns: list[str] = PRODUCT_COLUMNS) -> DataFrame:
    """The frame itself, or ValueError naming what is missing; starts no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def clean_products(df: DataFrame, na_spellings: list[str] | None = None) -> DataFrame:
    """Drop rows without id or name; other missing texts become empty strings."""
    if na_spellings:
        texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
        df = df.withColumns({c: F.when(~F.col(c).isin(*na_spellings), F.col(c)) for c in texts})
    return df.dropna(subset=["id", "name"]).fillna("")


def check_products(df: DataFrame) -> DataFrame:
    """One row of rule violations: duplicate ids, missing ids, over-long texts."""
    per_id = df.groupBy("id").agg(
        F.count("*").alias("copies"),
        *[F.count_if(F.char_length(c) > VARCHAR_LIMIT).alias(c) for c in VARCHAR_COLUMNS],
    )
    return per_id.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("copies") - 1)), F.lit(0)).alias("duplicate_ids"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("copies"))), F.lit(0)).alias("missing_ids"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"long_{c}") for c in VARCHAR_COLUMNS],
    )


def duplicated_ids(df: DataFrame) -> DataFrame:
    """Ids that break the primary key, with how often each occurs."""
    counts = df.groupBy("id").agg(F.count("*").alias("copies"))
    return counts.filter((F.col("copies") > 1) & F.col("id").isNotNull())


def verify_load(table: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows with a short description, and the table's row count."""
    total = table.select(F.count("*").alias("row_count")).scalar()
    return (
        table.orderBy("id")
        .limit(rows)
        .select("id", "name", preview(F.col("description")).alias("description_preview"))
        .withColumn("row_count", total)
    )
