"""The vector store: parquet rows (id, text, image), a column per modality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import read_version, write_version

TEXT, IMAGE = "text", "image"
WIDE_SCHEMA = "id bigint, text array<double>, image array<double>"


def long_vectors(wide: DataFrame) -> DataFrame:
    """(id, text, image) to (id, modality, vector); a missing vector makes no row."""
    return (
        wide.select("id", F.explode(F.create_map(F.lit(TEXT), "text", F.lit(IMAGE), "image")).alias("modality", "vector"))
        .filter(F.col("vector").isNotNull())
    )


def write_vectors(wide: DataFrame, path: str) -> None:
    """One row per product, as a new version; a filter on the id is pushed down to row groups."""
    write_version(wide.select("id", "text", "image"), path)


def read_modality(spark: SparkSession, path: str, modality: str) -> DataFrame:
    """(id, vector) of one modality; the other column is not read."""
    stored = read_version(spark, path, WIDE_SCHEMA)
    return stored.select("id", F.col(modality).alias("vector")).filter(F.col("vector").isNotNull())


def read_vectors(spark: SparkSession, path: str, use_text: bool = True, use_image: bool = True) -> DataFrame:
    """(id, text, image) rows; a modality that is switched off is not scanned."""
    if not (use_text or use_image):
        use_text = True
    stored = read_version(spark, path, WIDE_SCHEMA)
    none = F.lit(None).cast("array<double>")
    return stored.select("id", F.col("text") if use_text else none.alias("text"), F.col("image") if use_image else none.alias("image"))


def valid_vectors(vectors: DataFrame, column: str = "image") -> DataFrame:
    return vectors.filter(F.col(column).isNotNull())
