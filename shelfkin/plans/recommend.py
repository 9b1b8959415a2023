"""Recommendation jobs: one product, all products, a table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weights import DEFAULT_WEIGHT, resolve_weights, switched_weights
from ..operators.matches import MAX_PIVOTS, top_matches
from ..operators.similarity import score_all, top_n as top_scores
from ..session import materialize

BROADCAST_WINNERS = 100_000  # rows of 32 bytes; beyond it Spark picks the join itself
DETAILS = ["name", "category", "description", "image_path"]


def with_details(hits: DataFrame, products: DataFrame, columns: list[str] = DETAILS, few: bool = False) -> DataFrame:
    """Add product columns to (.., id, ..) hits; a hit without a product row stays.

    Unless they are ``few``, products are joined by a shuffle: their texts are larger than
    the files Spark judges them by, and a broadcast would send all of them to the driver.
    """
    side = products.select("id", *columns)
    return hits.join(side if few else side.hint("merge"), "id", "left").select(
        "query_id", "rank", "id", *columns, "score"
    )


def recommend(
    products: DataFrame,
    vectors: DataFrame,
    product_id: int,
    top_n: int,
    use_text: bool = True,
    use_image: bool = True,
    text_weight: float = DEFAULT_WEIGHT,
    image_weight: float = DEFAULT_WEIGHT,
    metric: str = "cosine",
    strict_weights: bool = False,
) -> DataFrame:
    """The ``top_n`` products most like one product; no rows for an unknown id.

    Scores are made where the vectors are read; only the ``top_n`` winners are sent to
    the product table, whose rows are not shuffled.  A winner without a product row stays,
    with null details, as in ``with_details``.
    """
    if product_id is None or top_n is None:
        raise ValueError("product_id and top_n are both needed")
    scores = score_all(
        vectors, product_id, use_text, use_image, text_weight, image_weight, metric, strict_weights
    )
    winners = top_scores(scores, product_id, top_n, metric)
    few = F.broadcast(winners) if top_n <= BROADCAST_WINNERS else winners
    named = products.select("id", *DETAILS).join(few.select("id"), "id", "left_semi")
    if top_n > BROADCAST_WINNERS:
        return with_details(winners, named)
    return with_details(winners, F.broadcast(named), few=True)


def chosen_product(products: DataFrame, recommendations: DataFrame) -> DataFrame:
    """One row per query: the product asked about and its recommendations in order."""
    listed = recommendations.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("recommended_products")
    )
    chosen = F.struct(*[F.col(c) for c in ["id", *DETAILS]]).alias("chosen_product")
    return listed.join(products.select(F.col("id").alias("query_id"), chosen), "query_id")


def recommend_all(
    vectors: DataFrame,
    top_n: int,
    query_ids: DataFrame | None = None,
    use_text: bool = True,
    use_image: bool = True,
    text_weight: float = DEFAULT_WEIGHT,
    image_weight: float = DEFAULT_WEIGHT,
    strict_weights: bool = False,
    tile: int | None = None,
    metric: str = "cosine",
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """(query_id, rank, id, score) for every product, or for the ids given."""
    wt, wi = switched_weights(use_text, use_image, text_weight, image_weight, strict_weights)
    none = F.lit(None).cast("array<double>")
    items = vectors.select(
        "id", F.col("text") if wt else none.alias("text"), F.col("image") if wi else none.alias("image")
    )
    asked = items if query_ids is None else items.join(query_ids.select("id").distinct(), "id", "left_semi")
    queries = asked.select(
        F.col("id").alias("query_id"), F.col("id").alias("self_id"), "text", "image",
        F.lit(float(wt)).alias("text_weight"), F.lit(float(wi)).alias("image_weight"),
    )
    return top_matches(queries, items, top_n, tile, max_pivots, metric, mutual=(float(wt), float(wi)) if query_ids is None else None)


def recommend_requests(vectors: DataFrame, requests: DataFrame, top_n: int, tile: int | None = None) -> DataFrame:
    """Answer (request_id, product_id, use_text, use_image, percent) rows in one job.

    Requests for the same product with the same weights are answered once: they are
    made distinct before any product is looked up, and joined to the answers at the end.
    """
    settings = resolve_weights(F.col("use_text"), F.col("use_image"), F.col("percent"))
    asked = requests.select("request_id", "product_id", settings.alias("w")).select("request_id", "product_id", "w.*")
    same = ["product_id", "text_weight", "image_weight"]
    different = materialize(asked.select(*same).distinct(), "distinct-requests")
    queries = different.select(F.struct(*same).alias("query_id"), F.col("product_id").alias("self_id"), "text_weight", "image_weight")
    found = top_matches(queries, vectors, top_n, tile).select("query_id.*", "rank", "id", "score")
    return asked.join(found, same).select("request_id", "rank", "id", "score")
