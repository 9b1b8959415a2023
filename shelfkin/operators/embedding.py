"""Vectors from texts and pictures, and hooks for a caller's own encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, clean_words
from ..session import materialize
from .pictures import colour_grid, standard_tensor
from .words import Lemmas, base_words

TextEncoder = Callable[[list[str]], np.ndarray]
ImageEncoder = Callable[[np.ndarray], np.ndarray]

TEXT_WIDTH = 256
OUTPUT_BYTES = 8 << 20


def apply_series(df: DataFrame, column: str, fn: Callable[[pd.Series], pd.Series], out: str, type_: str = "string") -> DataFrame:
    """Add ``fn`` of a column, called with whole batches of values."""

    def call(values: pd.Series) -> pd.Series:
        return fn(values)

    call.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return df.withColumn(out, F.pandas_udf(call, type_)(F.col(column)))


def encode_batches(df: DataFrame, key: str, column: str, make_encoder: Callable[[], TextEncoder]) -> DataFrame:
    """(key, vector) from a caller's batch encoder.

    ``make_encoder`` runs once per task, so a model is loaded once, not per batch.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            if len(batch):
                vectors = np.asarray(encoder(batch[column].fillna("").tolist()), dtype=np.float64)
                yield pd.DataFrame({key: batch[key], "vector": list(vectors)})

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, column).mapInPandas(encode, f"{key} {key_type}, vector array<double>")


def embed_text(
    df: DataFrame, key: str, column: str, width: int = TEXT_WIDTH, make_encoder: Callable[[], TextEncoder] | None = None,
    lemmas: Lemmas | None = None,
) -> DataFrame:
    """(key, vector): hashed word counts, weighted by rarity, scaled to length 1.

    The text is cleaned here, and its words replaced by ``lemmas`` if given.  The counts
    are stored: fitting the weights is one distributed pass over them that keeps
    ``width`` counters, and the texts are not cleaned again.
    """
    cleaned = df.select(key, clean_words(F.col(column), STOP_WORDS).alias("words"))
    if lemmas is not None:
        cleaned = base_words(cleaned, "words", lemmas)
    if make_encoder is not None:
        return encode_batches(cleaned.select(key, F.array_join("words", " ").alias(column)), key, column, make_encoder)
    counted = HashingTF(inputCol="words", outputCol="counts", numFeatures=width).transform(
        cleaned.select(key, F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    )
    counted = materialize(counted.select(key, "counts"), "word-counts")
    weighted = IDF(inputCol="counts", outputCol="weighted").fit(counted.select("counts")).transform(counted)
    scaled = Normalizer(inputCol="weighted", outputCol="scaled", p=2.0).transform(weighted)
    return scaled.select(key, vector_to_array("scaled").alias("vector"))


def per_image(images: DataFrame, key: str, fn_maker: Callable[[], Callable[[dict], np.ndarray]], out: str, element: str) -> DataFrame:
    """(key, out): a function of each picture, null without one.

    Pictures are decoded one after the other; results leave in batches of a few
    megabytes, so a task holds some tensors, not those of a whole input batch.
    """
    value_type = pa.list_(pa.float32() if element == "float" else pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = fn_maker()
        for batch in batches:
            keys, results, held, at = batch.column(key), [], 0, 0
            for i, picture in enumerate(batch.column("image")):
                results.append(fn(picture.as_py()) if picture.is_valid else None)
                held += 0 if results[-1] is None else results[-1].nbytes
                if held >= OUTPUT_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([keys.slice(at, len(results)), pa.array(results, value_type)], [key, out])
                    results, held, at = [], 0, i + 1

    key_type = images.schema[key].dataType.simpleString()
    return images.select(key, "image").mapInArrow(run, f"{key} {key_type}, {out} array<{element}>")


def image_tensors(images: DataFrame, key: str) -> DataFrame:
    """(key, tensor): the standard 3 x 224 x 224 input of an image model, flattened."""
    pictured = images.filter(F.col("image").isNotNull())
    return per_image(pictured, key, lambda: lambda image: standard_tensor(image).ravel(), "tensor", "float")


def embed_images(images: DataFrame, key: str, make_encoder: Callable[[], ImageEncoder] = lambda: colour_grid) -> DataFrame:
    """(key, vector) for every row; a row without a picture keeps a null vector."""

    def maker() -> Callable[[dict], np.ndarray]:
        encoder = make_encoder()
        return lambda image: np.asarray(encoder(standard_tensor(image)), dtype=np.float64)

    return per_image(images, key, maker, "vector", "double")
