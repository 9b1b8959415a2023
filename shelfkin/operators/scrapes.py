"""Quantiles over scraped histograms: cumulative bucket counters, sampled from time to time.

Unlike a histogram made from a log, the buckets of a scrape are counters that grow, start
again from 0, may be missing and may disagree with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counters import windowed_sums
from .rates import WINDOW_S, counter_increases


def bucket_increases(
    samples: DataFrame, keys: list[str], window_s: int = WINDOW_S, slide_s: int = 60, tie: str = "event_id"
) -> DataFrame:
    """(window_start, window_end, keys, buckets): increase per bound in each window, by rising bound.

    ``samples`` has (ts, keys, le, value); bounds spelled differently are one bucket,
    rows without a readable bound are left out.  Each counter is compared with itself,
    so one that restarts from 0 adds what it has counted since.  A list has as many
    entries as the histogram has bounds.
    """
    bound = F.col("le").try_cast("double")
    grown = counter_increases(samples.withColumn("bound", bound).filter("bound is not null and not isnan(bound)"), [*keys, "le"], tie)
    summed = windowed_sums(grown, [*keys, "bound"], [F.sum("increase").alias("increase")], window_s, slide_s)
    buckets = F.array_sort(F.collect_list(F.struct("bound", "increase"))).alias("buckets")
    return summed.groupBy("window_start", "window_end", *keys).agg(buckets)


def monotone(buckets: Column) -> Column:
    """Buckets that never fall: each holds at least what a lower bound holds."""
    upto = lambda i: F.array_max(F.transform(F.slice(buckets, 1, i + 1), lambda b: b["increase"]))
    return F.transform(buckets, lambda b, i: F.struct(b["bound"].alias("bound"), upto(i).alias("increase")))


def bucket_quantile(q: float, buckets: Column) -> Column:
    """The q-quantile of monotone buckets, interpolated linearly inside one bucket.

    Null without the infinite bucket, without any finite one, or without observations.
    The lowest bucket starts at 0, or is answered by its bound if that is not above 0;
    a rank above every finite bound answers the largest one; q below 0 is minus
    infinity and above 1 infinity.
    """
    last = F.try_element_at(buckets, F.lit(-1))
    rank = F.lit(q) * last["increase"]
    finite = F.slice(buckets, 1, F.greatest(F.size(buckets) - 1, F.lit(0)))
    reached = F.try_element_at(F.filter(finite, lambda b: b["increase"] >= rank), F.lit(1))
    below = F.try_element_at(F.filter(finite, lambda b: b["increase"] < rank), F.lit(-1))
    low, beneath = F.coalesce(below["bound"], F.lit(0.0)), F.coalesce(below["increase"], F.lit(0.0))
    share = F.coalesce(F.try_divide(rank - beneath, reached["increase"] - beneath), F.lit(0.0))
    inside = F.when(below.isNull() & (reached["bound"] <= 0), reached["bound"]).otherwise(low + (reached["bound"] - low) * share)
    known = (F.size(buckets) >= 2) & (last["bound"] == F.lit(float("inf"))) & (last["increase"] > 0)
    if not 0 <= q <= 1:
        return F.when(known, F.lit(float("-inf") if q < 0 else float("inf")))
    return F.when(known, F.when(reached.isNull(), F.try_element_at(finite, F.lit(-1))["bound"]).otherwise(inside))


def scraped_quantiles(
    samples: DataFrame,
    keys: list[str],
    quantiles: dict[str, float],
    window_s: int = WINDOW_S,
    slide_s: int = 60,
    tie: str = "event_id",
) -> DataFrame:
    """(window_start, window_end, keys, n, a column per quantile name) from scraped buckets."""
    grown = bucket_increases(samples, keys, window_s, slide_s, tie).withColumn("buckets", monotone(F.col("buckets")))
    last = F.try_element_at("buckets", F.lit(-1))
    n = F.when(last["bound"] == F.lit(float("inf")), last["increase"]).alias("n")
    read = [bucket_quantile(q, F.col("buckets")).alias(name) for name, q in quantiles.items()]
    return grown.select("window_start", "window_end", *keys, n, *read)
