"""Both vectors of every product, written to the vector store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embedding import TEXT_WIDTH, embed_images, embed_text
from ..operators.words import plural_lemmas
from ..sources.image_files import file_name
from ..sources.vector_store import read_vectors, write_vectors


def build_vectors(products: DataFrame, images: DataFrame, text_width: int = TEXT_WIDTH, root: str = "") -> DataFrame:
    """(id, text, image); a product without a picture keeps a null image vector.

    ``images`` has (file_name, image) rows; products name their file in image_path, below
    ``root``.  A picture is encoded once, however many products share it; only its vector
    is joined to them.
    """
    text = embed_text(products, "id", "description", text_width, lemmas=plural_lemmas).withColumnRenamed("vector", "text")
    named = products.select("id", file_name(F.col("image_path"), root).alias("file_name"))
    wanted = images.filter("image is not null").join(named.select("file_name").distinct(), "file_name", "left_semi")
    vectors = embed_images(wanted, "file_name").withColumnRenamed("vector", "image")
    return text.join(named.join(vectors, "file_name").select("id", "image"), "id", "left")


def store_vectors(spark: SparkSession, products: DataFrame, images: DataFrame, path: str, text_width: int = TEXT_WIDTH, root: str = "") -> DataFrame:
    write_vectors(build_vectors(products, images, text_width, root), path)
    return read_vectors(spark, path)
