"""Explicit schemas of the tables this library reads and writes."""

from pyspark.sql import types as T

# The columns a product table must have, in file order.
PRODUCT_COLUMNS = ["id", "category", "name", "description", "image_path"]
VARCHAR_COLUMNS = ["category", "name", "image_path"]
VARCHAR_LIMIT = 255

# Ids are BIGINT: a large catalogue outgrows a 32-bit key.
PRODUCT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("category", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("image_path", T.StringType()),
    ]
)

VECTOR_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("vector", T.ArrayType(T.DoubleType())),
        T.StructField("modality", T.StringType()),
    ]
)

TIMING_COLUMNS = "query_type string, duration_s double, outcome string"
