"""Token ids as ORC files: stripes with run-length coded integers, row indexes and Bloom filters.

Documents are dealt out by ranges of their id, sorted, encoded, and written one row per
document: position, doc_id, ids.  ORC codes the ids as run-length coded integers; row
indexes and stripe footers keep the range of ``doc_id`` and Bloom filters, so that a
reader of few documents skips stripes and row groups, and stripes of one file are read by
several tasks.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import UNICODE_SPLIT, byte_characters
from .common import append_columns, held, lists, texts

END_ID = 0
OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


class RankEncoder:
    """A byte-level vocabulary file of the tokenizers library, encoded through tiktoken.

    Both give the same ids (tests compare them); the tokenizers library needs four times
    the CPU for texts with many different words.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        bytes_of = byte_characters()
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        ranks = {bytes(bytes_of[c] for c in word): i for word, i in data["model"]["vocab"].items() if word not in special}
        cut = data.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not data.get("normalizer")
        if not plain or any(ranks.get(bytes([b]), 256) > 255 for b in range(256)):
            raise ValueError(f"{path} is not a plain byte-level vocabulary with ids in merge order")
        self.encoding = tiktoken.Encoding("file", pat_str=UNICODE_SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each whole text."""
        return [self.encoding.encode_to_numpy(t, allowed_special="all").astype("<u4", copy=False).tobytes() for t in batch]


@lru_cache(2)
def encoder(path: str) -> RankEncoder:
    return RankEncoder(path)


def write_ids(documents: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Write (position, doc_id, ids) of every document to ORC files in ascending id order.

    Null and empty texts have the end id only.  Null ids come first; rows of equal id are
    ordered by their text.  Only the two columns are read.  An empty table gives files
    without rows.
    """
    rows = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batch: pa.RecordBatch) -> list[pa.Array]:
        end = np.array([end_id], "<u4").tobytes()
        ids = [x + end for x in encoder(tokenizer).encode(texts(batch, "text"))]
        return [lists(np.frombuffer(b"".join(ids), "<i4"), np.array([len(x) // 4 for x in ids], np.int64))]

    encoded = append_columns(ordered, [T.StructField("ids", T.ArrayType(T.IntegerType()))], encode)
    # Partition number above the row number: rises with the id.
    encoded.select(F.monotonically_increasing_id().alias("position"), "doc_id", "ids").write.options(**OPTIONS).orc(path)


SCHEMA = "position bigint, doc_id bigint, ids array<int>"


def read_ids(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The written rows; bounds on ``doc_id`` are pushed down to stripe and row-group statistics."""
    df = spark.read.schema(SCHEMA).orc(path)
    if low is not None:
        df = df.where(F.col("doc_id") >= low)
    return df.where(F.col("doc_id") <= high) if high is not None else df


def find_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; row groups without them are skipped by their Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids))


def file_report(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every written row, read back from the files.

    ``start`` counts the ids of all documents before: sums per writing task, added up
    over the tasks (one number each), plus a running sum inside a task's rows.
    """

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            offsets = column.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(column.values.to_numpy(), "<i4").view(np.uint8))
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["position", "doc_id", "n_tokens", "ids_crc32"],
            )

    rows = read_ids(spark, path).mapInArrow(sums, "position bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    rows = rows.withColumn("part", F.shiftright("position", 33))
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(held(offsets), "part")
    return placed.select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
