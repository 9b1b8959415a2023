"""Product tables as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.loading import NA_SPELLINGS, require_columns
from ..schema import PRODUCT_SCHEMA


def _reader(spark: SparkSession) -> DataFrameReader:
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
    )


def read_products_csv(spark: SparkSession, path: str, schema: T.StructType = PRODUCT_SCHEMA) -> DataFrame:
    """Read CSV with a header and quoted line breaks; columns are found by name.

    ValueError names columns the header lacks; columns the schema lacks stay, as texts.
    A key spelled as "no value" is null, any other text that is no number is an error.
    Quoted line breaks make a file unsplittable, so parallelism comes from the number
    of files; keep each file to the size of one task's input.
    """
    header = require_columns(_reader(spark).csv(path), schema.names).columns
    texts = T.StructType([T.StructField(name, T.StringType()) for name in header])
    rows = _reader(spark).schema(texts).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)

    def typed(name: str):
        field = schema[name]
        if field.dataType == T.StringType():
            return F.col(name)
        return F.when(~F.col(name).isin(*NA_SPELLINGS), F.col(name)).cast(field.dataType).alias(name)

    return rows.select(*[typed(n) for n in schema.names], *[n for n in header if n not in schema.names])


def write_products_csv(products: DataFrame, path: str) -> None:
    products.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
