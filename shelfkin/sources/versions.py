"""Parquet tables that are replaced whole: versions in folders of their own, switched last.

    path/v00000001-<id>/…   the rows of a version
    path/_manifest/…        a row (version, folder) per finished version

A version is written beside the others and becomes the table with one more file of the
manifest, which appears whole or not at all.  A job that fails leaves the table as it was;
a reader in between sees the version before; a table can be replaced by what was read
from it.  An object store needs a committer that makes files visible on commit.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "_manifest"
MANIFEST_SCHEMA = "version bigint, folder string"
KEPT_VERSIONS = 2


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The finished versions, or None for a folder that has none."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/{MANIFEST}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_version(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(version, folder) of the table as it is now; of equal versions the last folder by name."""
    manifest = _manifest(spark, path)
    row = manifest.agg(F.max(F.struct("version", "folder")).alias("last")).first() if manifest else None
    return tuple(row["last"]) if row and row["last"] else None


def write_version(df: DataFrame, path: str, keep: int = KEPT_VERSIONS) -> int:
    """Make the rows of ``df`` the table at ``path``; returns the number of the version.

    The last ``keep`` versions stay readable for those who opened them; what is older
    is emptied after the switch.
    """
    if keep < 1:
        raise ValueError("keep must be 1 or more")
    spark = df.sparkSession
    before = current_version(spark, path)
    version = before[0] + 1 if before else 1
    folder = f"v{version:08d}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path}/{folder}")
    entry = spark.createDataFrame([(version, folder)], MANIFEST_SCHEMA)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    _empty_version(spark, path, version - keep, df.schema)
    return version


def _empty_version(spark: SparkSession, path: str, version: int, schema: StructType) -> None:
    """Drop the rows of one old version; its manifest row is only a number and a name."""
    old = _manifest(spark, path).filter(F.col("version") == version).collect()
    for row in old:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{row['folder']}")


def read_version(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of the table as it is now; a plain parquet folder is read as it is."""
    current = current_version(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{current[1]}" if current else path)
