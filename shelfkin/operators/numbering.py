"""Row numbers and running values that never put a whole group in one task.

A plain ``row_number() over (partition by key order by x)`` sends all rows of a key to
one task.  Here a key is cut into ordered buckets: each bucket is numbered by itself,
and the few bucket totals give the offset.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID_BUCKET = 1_000_000
HOUR_MICROS = 3_600_000_000
TIE_SPAN = Decimal(10**19)  # wider than any 64-bit tie


def step_down(value: Column, width: int) -> Column:
    """The largest multiple of ``width`` that is not above a whole number, exactly."""
    return value - F.pmod(value, F.lit(width))


def id_bucket(col: str, width: int = ID_BUCKET) -> Column:
    return step_down(F.col(col).cast("bigint"), width)


def hour_bucket(ts: str = "ts") -> Column:
    return step_down(F.unix_micros(ts), HOUR_MICROS)


def ordered_by(first: Column, tie: Column) -> Column:
    """Two whole numbers as one that sorts like the pair.

    max_by over a pair would sort all rows before it aggregates; over one number it
    aggregates in a hash table.
    """
    return first.cast("decimal(19,0)") * F.lit(TIE_SPAN) + tie.cast("decimal(19,0)")


def moment(ts: str = "ts", tie: str = "event_id") -> Column:
    return ordered_by(F.unix_micros(ts), F.col(tie))


def _with_totals(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Add the columns of a bucket's one total row; null keys are groups like any other."""
    totals = totals.withColumnsRenamed({k: f"_total_{k}" for k in keys})
    same = [rows[k].eqNullSafe(totals[f"_total_{k}"]) for k in keys]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return rows.join(totals, condition).drop(*[f"_total_{k}" for k in keys])


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str = "n") -> DataFrame:
    """Add ``out`` = 1, 2, 3 ... in ``order`` within ``keys``.

    ``bucket`` must grow with ``order`` (equal buckets are neighbours), e.g. a whole
    division of the ordering id.
    """
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.count("*").alias("_size"))
        .withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    placed = rows.withColumn("_inside", F.row_number().over(inside))
    return (
        _with_totals(placed, offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_offset", "_inside")
    )


def previous_value(
    df: DataFrame, keys: list[str], ts: str, value: str, tie: str, bucket: Column, out: str = "previous"
) -> DataFrame:
    """Add the value of the sample before, per series, also across time buckets."""
    rows = df.withColumn("_bucket", bucket)
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carried = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.max_by(value, moment(ts, tie)).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(across))
        .drop("_last")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts, tie)
    lagged = rows.withColumn("_inside", F.lag(value).over(inside))
    return (
        _with_totals(lagged, carried, [*keys, "_bucket"])
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .drop("_bucket", "_inside", "_carried")
    )


def running_total(
    df: DataFrame, keys: list[str], order: list[str], delta: str, bucket: Column, out: str = "running"
) -> DataFrame:
    """Add the running sum of ``delta`` in ``order`` within ``keys``."""
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.sum(delta).alias("_net"))
        .withColumn("_offset", F.coalesce(F.sum("_net").over(before), F.lit(0)))
        .drop("_net")
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = rows.withColumn("_inside", F.sum(delta).over(inside))
    return (
        _with_totals(summed, offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_offset", "_inside")
    )
