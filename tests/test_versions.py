"""Tables replaced whole: failures, readers in between, old versions."""

import pytest
from pyspark.sql import functions as F

from shelfkin.sources import product_tables, vector_store, versions

SCHEMA = "id bigint, name string"


def rows(df):
    return sorted(r["id"] for r in df.collect())


def test_a_failing_job_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.write_version(spark.range(5).withColumn("name", F.lit("a")), path)
    failing = spark.range(100, 200, numPartitions=4).withColumn("name", F.when(F.col("id") == 180, F.raise_error(F.lit("no"))).otherwise("b"))
    with pytest.raises(Exception, match="no"):
        versions.write_version(failing, path)
    assert rows(versions.read_version(spark, path, SCHEMA)) == [0, 1, 2, 3, 4]
    assert versions.write_version(spark.range(7, 9).withColumn("name", F.lit("c")), path) == 2
    assert rows(versions.read_version(spark, path, SCHEMA)) == [7, 8]


def test_a_reader_in_between_sees_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.write_version(spark.range(3).withColumn("name", F.lit("a")), path)
    opened = versions.read_version(spark, path, SCHEMA)
    # Written, but not switched to.
    spark.range(50).withColumn("name", F.lit("b")).write.parquet(f"{path}/v00000002-unfinished")
    assert rows(versions.read_version(spark, path, SCHEMA)) == [0, 1, 2]
    versions.write_version(opened.withColumn("id", F.col("id") + 10), path)
    assert rows(opened) == [0, 1, 2]
    assert rows(versions.read_version(spark, path, SCHEMA)) == [10, 11, 12]


def test_old_versions_are_emptied(spark, tmp_path):
    path = str(tmp_path / "t")
    folders = []
    for k in range(4):
        versions.write_version(spark.range(k + 1).withColumn("name", F.lit("a")), path)
        folders.append(versions.current_version(spark, path)[1])
    assert [spark.read.schema(SCHEMA).parquet(f"{path}/{f}").count() for f in folders] == [0, 0, 3, 4]
    with pytest.raises(ValueError):
        versions.write_version(spark.range(1), path, keep=0)


def test_plain_folders_and_missing_ones(spark, tmp_path):
    plain = str(tmp_path / "plain")
    spark.range(2).withColumn("name", F.lit("a")).write.parquet(plain)
    assert versions.current_version(spark, plain) is None
    assert rows(versions.read_version(spark, plain, SCHEMA)) == [0, 1]
    versions.write_version(spark.range(5, 6).withColumn("name", F.lit("b")), plain)
    assert rows(versions.read_version(spark, plain, SCHEMA)) == [5]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        versions.read_version(spark, str(tmp_path / "none"), SCHEMA).count()


def test_products_and_vectors_survive_a_failed_replace(spark, tmp_path):
    products = spark.createDataFrame([(1, "a", "b", "c", "d")], "id int, category string, name string, description string, image_path string")
    path = str(tmp_path / "p")
    product_tables.replace_table(products, path)
    with pytest.raises(Exception, match="broken"):
        product_tables.replace_table(products.withColumn("name", F.raise_error(F.lit("broken"))), path)
    assert product_tables.read_products_parquet(spark, path).collect() == products.collect()
    wide = spark.createDataFrame([(1, [1.0], None)], "id bigint, text array<double>, image array<double>")
    path = str(tmp_path / "v")
    vector_store.write_vectors(wide, path)
    with pytest.raises(Exception, match="broken"):
        vector_store.write_vectors(wide.withColumn("id", F.raise_error(F.lit("broken")).cast("bigint")), path)
    assert vector_store.read_vectors(spark, path).collect() == wide.collect()
