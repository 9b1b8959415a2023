"""Product pictures as files: decoded by Spark's image source, keyed by product."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLOUR, GREY = 16, 0  # OpenCV type codes used in Spark's image struct


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, image) of every file that decodes; others are left out.

    ``file_name`` is the path below ``folder``, so files of the same name in two folders
    stay apart.
    """
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(folder)
    top = re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", folder).rstrip("/") + "/"
    return images.select(F.substring_index("image.origin", top, -1).alias("file_name"), "image")


def file_name(image_path: Column, root: str = "") -> Column:
    """The path of a product's picture below the folder its paths start from, ``root``."""
    start = root.rstrip("/") + "/" if root else ""
    return F.when(image_path.startswith(start), image_path.substr(F.lit(len(start) + 1), F.length(image_path))).otherwise(image_path)


def with_images(products: DataFrame, images: DataFrame, root: str = "") -> DataFrame:
    """Products with their picture, matched by path; a missing or broken file leaves a null picture."""
    named = products.withColumn("file_name", file_name(F.col("image_path"), root))
    return named.join(images, "file_name", "left").drop("file_name")


def image_struct(height: Column, width: Column, pixels: Column, origin: Column) -> Column:
    """Spark's image struct from BGR bytes, top row first."""
    return F.struct(
        origin.alias("origin"),
        height.cast("int").alias("height"),
        width.cast("int").alias("width"),
        F.lit(3).alias("nChannels"),
        F.lit(COLOUR).alias("mode"),
        pixels.alias("data"),
    )


def write_files(contents: DataFrame, folder: str) -> DataFrame:
    """Tasks write (file_name, content) rows into a shared folder; returns names and sizes.

    A folder without a scheme lies in the cluster's default file system, as for Spark's
    own writers.
    """
    if not re.match(r"[A-Za-z][\w+.-]*:", folder):
        default = contents.sparkSession._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        folder = f"file://{folder}" if default.startswith("file:") else default.rstrip("/") + folder

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        for batch in batches:
            names = batch.column("file_name").to_pylist()
            for name, data in zip(names, batch.column("content")):
                with target.open_output_stream(f"{root}/{name}") as out:
                    out.write(data.as_buffer())
            sizes = [len(d.as_buffer()) for d in batch.column("content")]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], ["file_name", "bytes"])

    return contents.select("file_name", "content").mapInArrow(write, "file_name string, bytes long")
