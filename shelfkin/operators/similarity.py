"""Similarity of one product to all others, and entries of the similarity matrix.

``vectors`` has (id, text, image); image may be null.  One query is a scalar subquery
whose single row is folded into the scan, so no vector is shuffled and no join is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import METRICS, closeness, cosine, norm
from ..functions.weights import DEFAULT_WEIGHT, switched_weights

DECIMALS = 6


def with_query(vectors: DataFrame, query_id: int) -> DataFrame:
    """Every row plus struct ``q`` of the query row with its norms; no rows for an unknown id."""
    lengths = [norm(F.col(c)).alias(f"{c}_norm") for c in vectors.columns if c != "id"]
    query = vectors.filter(F.col("id") == F.lit(query_id)).select(F.struct(*vectors.columns, *lengths).alias("q"))
    return vectors.withColumn("q", query.scalar()).filter(F.col("q").isNotNull())


def text_scores(vectors: DataFrame, query_id: int, weight: float = DEFAULT_WEIGHT, metric: str = "cosine") -> DataFrame:
    value = closeness(metric, F.col("text"), F.col("q.text"), b_norm=F.col("q.text_norm"))
    return with_query(vectors.select("id", "text"), query_id).select(
        "id", F.round(value * F.lit(float(weight)), DECIMALS).alias("text_score")
    )


def image_scores(vectors: DataFrame, query_id: int, weight: float = DEFAULT_WEIGHT, metric: str = "cosine") -> DataFrame:
    value = closeness(metric, F.col("image"), F.col("q.image"), image=True, b_norm=F.col("q.image_norm"))
    return with_query(vectors.select("id", "image"), query_id).select(
        "id", F.round(value * F.lit(float(weight)), DECIMALS).alias("image_score")
    )


def blended(metric: str, text_weight: float, image_weight: float) -> Column:
    """Weighted sum of the modalities that weigh something."""
    score = F.lit(0.0)
    if text_weight:
        score = score + closeness(metric, F.col("text"), F.col("q.text"), b_norm=F.col("q.text_norm")) * F.lit(float(text_weight))
    if image_weight:
        score = score + closeness(metric, F.col("image"), F.col("q.image"), image=True, b_norm=F.col("q.image_norm")) * F.lit(float(image_weight))
    return F.round(score, DECIMALS)


def score_all(
    vectors: DataFrame,
    query_id: int,
    use_text: bool = True,
    use_image: bool = True,
    text_weight: float = DEFAULT_WEIGHT,
    image_weight: float = DEFAULT_WEIGHT,
    metric: str = "cosine",
    strict_weights: bool = False,
) -> DataFrame:
    """(id, score) for every product, the query included."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose one of {sorted(METRICS)}")
    wt, wi = switched_weights(use_text, use_image, text_weight, image_weight, strict_weights)
    needed = ["id"] + (["text"] if wt else []) + (["image"] if wi else [])
    return with_query(vectors.select(*needed), query_id).select("id", blended(metric, wt, wi).alias("score"))


def closest_first(metric: str = "cosine") -> list[Column]:
    score = F.col("score").desc() if METRICS[metric] else F.col("score").asc()
    return [score, F.col("id").asc()]


def ranked(scores: DataFrame, metric: str = "cosine") -> DataFrame:
    """All scores, closest first; equal scores by id."""
    return scores.orderBy(*closest_first(metric))


def without_query(scores: DataFrame, query_id: int) -> DataFrame:
    return scores.filter(F.col("id") != F.lit(query_id))


def top_n(scores: DataFrame, query_id: int, n: int, metric: str = "cosine") -> DataFrame:
    """(query_id, rank, id, score) of the n closest other products."""
    if n is None or n < 1:
        raise ValueError("n must be 1 or more")
    best = ranked(without_query(scores, query_id), metric).limit(n)
    place = Window.partitionBy("query_id").orderBy(*closest_first(metric))
    return (
        best.withColumn("query_id", F.lit(query_id).cast("long"))
        .withColumn("rank", F.row_number().over(place))
        .select("query_id", "rank", "id", "score")
    )


def similarity_row(vectors: DataFrame, query_id: int, column: str = "text") -> DataFrame:
    """One whole row of the cosine matrix, the diagonal entry included."""
    rows = with_query(vectors.select("id", F.col(column).alias("vector")), query_id)
    score = F.round(cosine(F.col("vector"), F.col("q.vector"), F.col("q.vector_norm")), DECIMALS)
    return rows.select(F.col("q.id").alias("id_a"), F.col("id").alias("id_b"), score.alias("score"))


def similarity_entries(vectors: DataFrame, pairs: DataFrame, column: str = "text", metric: str = "cosine") -> DataFrame:
    """The matrix entries named by (id_a, id_b) rows of ``pairs``.

    The n x n matrix itself is never stored: its factor, the vectors, answers any
    entry with two key joins, any row with ``similarity_row`` and the best entries of
    every row with ``matches.top_matches``.  Pairs are made distinct first.
    """
    side = vectors.select("id", F.col(column).alias("vector"))
    a = side.select(F.col("id").alias("id_a"), F.col("vector").alias("a"))
    b = side.select(F.col("id").alias("id_b"), F.col("vector").alias("b"))
    score = closeness(metric, F.col("a"), F.col("b"))
    return (
        pairs.select("id_a", "id_b")
        .distinct()
        .join(a, "id_a")
        .join(b, "id_b")
        .select("id_a", "id_b", F.round(score, DECIMALS).alias("score"))
    )
