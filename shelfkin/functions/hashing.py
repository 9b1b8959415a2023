"""Repeatable choices: the same id and seed give the same value in any run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_int(*parts: Column | str) -> Column:
    """A non-negative 32-bit number from the md5 of the parts joined by ':'."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def pick(values: list[str], *parts: Column | str) -> Column:
    choices = F.array(*[F.lit(v) for v in values])
    return F.element_at(choices, (hash_int(*parts) % len(values) + 1).cast("int"))


def in_range(low: int, high: int, *parts: Column | str) -> Column:
    """A whole number between low and high, both included."""
    return hash_int(*parts) % (high - low + 1) + low
