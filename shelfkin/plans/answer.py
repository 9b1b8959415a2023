"""From a table of queries to response rows and their run records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators.matches import top_matches
from ..operators.runs import recommendation_runs


def answer(recs: DataFrame, products: DataFrame, make_generator: Callable[[], A.Generator] | None = None) -> DataFrame:
    """(query_id, text, images, product_count, error): generate, then add the images."""
    if make_generator is None:
        return A.template_answers(recs)
    return A.formatted(A.generate(A.prompts(recs, products), make_generator), recs)


def record_runs(answered: DataFrame, histories: DataFrame | None = None, products: DataFrame | None = None) -> DataFrame:
    """Run rows of answers; ``histories`` has (query_id, history_length).

    The seconds are those the generator took; the built-in one takes none of its own.
    With ``products`` the name and category asked about are added.
    """
    if "generation_s" not in answered.columns:
        answered = answered.withColumn("generation_s", F.lit(0.0))
    if products is not None:
        asked = products.select(F.col("id").alias("query_id"), F.col("name").alias("original_product_name"), F.col("category").alias("original_product_category"))
        answered = answered.join(asked.hint("merge"), "query_id", "left")
    if histories is None:
        answered = answered.withColumn("history_length", F.lit(0))
    else:
        answered = answered.join(histories.hint("merge"), "query_id", "left").withColumn(
            "history_length", F.coalesce("history_length", F.lit(0))
        )
    return recommendation_runs(answered, A.NO_TEXT)


def knowledge_prompts(prompt_rows: DataFrame, queries: DataFrame, knowledge: DataFrame, k: int) -> DataFrame:
    """Prompts with the ``k`` closest knowledge texts of each query appended.

    ``queries`` has (query_id, vector); ``knowledge`` has (id, vector, passage).
    """
    none = F.lit(None).cast("array<double>").alias("image")
    asked = queries.select(
        "query_id", F.lit(None).cast("long").alias("self_id"), F.col("vector").alias("text"), none,
        F.lit(1.0).alias("text_weight"), F.lit(0.0).alias("image_weight"),
    )
    hits = top_matches(asked, knowledge.select("id", F.col("vector").alias("text"), none), k)
    passages = (
        hits.join(knowledge.select("id", "passage"), "id")
        .groupBy("query_id")
        .agg(F.array_join(A.in_rank_order(F.col("passage")), "\n").alias("passages"))
    )
    return prompt_rows.join(passages, "query_id", "left").select(
        "query_id",
        F.concat("prompt", F.coalesce(F.concat(F.lit("\nBackground:\n"), "passages"), F.lit(""))).alias("prompt"),
    )
