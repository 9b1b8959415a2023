"""Metric tables as lines of the public text exposition format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(value: Column) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit('"'), F.lit('\\"'))


def number(value: Column) -> Column:
    """A value at full precision; whole numbers without a fraction."""
    v = value.cast("double")
    special = F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf")
    return special.when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("decimal(20,0)").cast("string")).otherwise(v.cast("string"))


def exposition_lines(df: DataFrame, metric: str, labels: list[str], value: str, part: int = 0) -> DataFrame:
    """(metric, line, place) with one sample line per row.

    ``place`` sorts the lines of a metric: by series, then part, then rising ``le``.
    """
    pairs = [
        F.concat(F.lit(f'{name}="'), escaped(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit('"'))
        for name in labels
    ]
    head = F.concat(F.lit(f"{metric}{{"), F.concat_ws(",", *pairs), F.lit("} ")) if labels else F.lit(f"{metric} ")
    series = F.concat_ws(",", F.lit(""), *[p for p, name in zip(pairs, labels) if name != "le"])
    le = F.when(F.col("le") == "+Inf", float("inf")).otherwise(F.col("le").cast("double")) if "le" in labels else F.lit(0.0)
    place = F.struct(series.alias("series"), F.lit(part).alias("part"), le.alias("le"))
    return df.select(F.lit(metric).alias("metric"), F.concat(head, number(F.col(value))).alias("line"), place.alias("place"))


def histogram_lines(rows: DataFrame, metric: str, labels: list[str]) -> DataFrame:
    """(metric, line, place) of (labels, le, n, total) bucket rows: per series the buckets, the sum and the count."""
    whole = rows.filter(F.col("le") == "+Inf")
    buckets = exposition_lines(rows, f"{metric}_bucket", [*labels, "le"], "n")
    sums = exposition_lines(whole, f"{metric}_sum", labels, "total", 1)
    counts = exposition_lines(whole, f"{metric}_count", labels, "n", 2)
    return buckets.unionByName(sums).unionByName(counts).withColumn("metric", F.lit(metric))


def write_exposition(lines: DataFrame, types: dict[str, str], path: str) -> None:
    """Text files in metric order, each family's TYPE line ahead of its samples, histograms by rising bucket."""
    spark = lines.sparkSession
    heads = spark.createDataFrame(
        [(m, f"# TYPE {m} {kind}", None) for m, kind in types.items()],
        "metric string, line string, place struct<series:string,part:int,le:double>",
    )
    rows = heads.unionByName(lines.select("metric", "line", "place"))
    rows.orderBy("metric", "place", "line").select("line").write.mode("overwrite").text(path)
