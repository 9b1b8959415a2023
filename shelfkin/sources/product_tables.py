"""Product tables in parquet and behind JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import PRODUCT_SCHEMA
from .versions import read_version, write_version

# Fixed value: rows sent per insert statement.
INSERT_PAGE = 100


def replace_table(products: DataFrame, path: str) -> None:
    """Replace the stored table by a new version; a failed job leaves the old one whole."""
    write_version(products, path)


def read_products_parquet(spark: SparkSession, path: str) -> DataFrame:
    return read_version(spark, path, PRODUCT_SCHEMA)


def replace_jdbc_table(products: DataFrame, url: str, table: str, connections: int = 8, **options: str) -> None:
    """Empty the database table, keep its definition, insert in pages.

    ``connections`` bounds the tasks that write at once, so a wide cluster does not
    flood the database.
    """
    (
        products.repartition(connections)
        .write.format("jdbc")
        .mode("overwrite")
        .option("url", url)
        .option("dbtable", table)
        .option("truncate", True)
        .option("batchsize", INSERT_PAGE)
        .options(**options)
        .save()
    )


def jdbc_scan_options(url: str, table: str, lowest_id: int, highest_id: int, partitions: int) -> dict[str, str]:
    """Options of a scan split into id ranges; the bounds place the cuts, they drop no row."""
    if partitions < 1 or lowest_id > highest_id:
        raise ValueError("need at least one partition and lowest_id <= highest_id")
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": "id",
        "lowerBound": str(lowest_id),
        "upperBound": str(highest_id),
        "numPartitions": str(partitions),
        "fetchsize": "10000",
    }


def read_products_jdbc(
    spark: SparkSession, url: str, table: str, lowest_id: int, highest_id: int, partitions: int = 32, **options: str
) -> DataFrame:
    """Scan a database table in parallel id ranges; a failure raises."""
    plan = jdbc_scan_options(url, table, lowest_id, highest_id, partitions)
    return spark.read.format("jdbc").options(**plan).options(**options).load()
