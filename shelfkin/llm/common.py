"""Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_BYTES = 8 << 20

# A-Z to a-z, every other byte as it is.
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about ``limit`` bytes; a longer row is a slice of its own."""
    if not batch.num_rows:
        return
    rows = max(1, int(batch.num_rows * limit / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The strings of a column; null is the empty string."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def encoded_texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The strings of a column as UTF-8; null is empty."""
    return [x.encode() for x in texts(batch, name)]


def append_columns(
    df: DataFrame,
    fields: list[T.StructField],
    compute: Callable[[pa.RecordBatch], list[pa.Array]],
    keep: Callable[[list[pa.Array]], pa.Array] | None = None,
    limit: int = PIECE_BYTES,
) -> DataFrame:
    """``df`` with columns computed from Arrow slices of about ``limit`` bytes.

    Columns of ``df`` that are named like a new one are replaced.  With ``keep``, only
    the rows it marks stay, and the computed columns are left out.
    """
    names = [f.name for f in fields]
    base = df if keep else df.drop(*names)
    schema = base.schema if keep else T.StructType([*base.schema.fields, *fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, limit):
                new = compute(part)
                if keep:
                    yield part.filter(keep(new))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    return base.mapInArrow(run, schema)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list array out of flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def table(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column can clash or be read."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def beside(df: DataFrame, names: Iterable[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` on ``df`` while columns of ``df`` that clash with ``names`` bear other names.

    The result has exactly the columns of ``df``.
    """
    taken = {n.lower() for n in names}
    away = {c: f"__beside_{k}" for k, c in enumerate(df.columns) if c.lower() in taken}
    moved = df.select(*[F.col(f"`{c}`").alias(away.get(c, c)) for c in df.columns])
    return run(moved).select(*[F.col(f"`{away.get(c, c)}`").alias(c) for c in df.columns])


BROADCAST_ROWS = 1_000_000


def held(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it was counted and has few rows; else joined by shuffling.

    For narrow tables (ids and numbers): the bound stands for some ten megabytes.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
