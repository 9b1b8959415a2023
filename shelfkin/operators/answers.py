"""Prompts and response rows around a table of recommendations.

``recs`` has (query_id, rank, id, name, category, description, image_path, score).
A query has at most top_n rows, so lists per query stay short.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, one_line
from .catalog import UNKNOWN_CATEGORY, UNKNOWN_NAME, system_message

PRODUCT_TEMPLATE = "* [name], a [category]: [description]\n"
SYSTEM_TEXT = "Suggest products to a shopper. Open with one sentence, then give each product its own paragraph starting with 🔸."
REQUEST_TEMPLATE = (
    "The shopper looked at [original_product_name] ([original_product_category]).\n"
    "About it: [original_product_description]\n\nProducts to suggest, best first:\n[recommended_products]"
)

# The mark between paragraphs and the texts of answers without products.
MARKER = "🔸"
NOTHING_FOUND = "Unable to find recommendations"
NO_TEXT = "No recommendations available"
GENERATION_FAILED = "Error generating recommendations"

Generator = Callable[[list[str]], list[str]]


def in_rank_order(value: Column) -> Column:
    """All values of a group as an array by rank."""
    return F.transform(F.sort_array(F.collect_list(F.struct("rank", value.alias("v")))), lambda e: e["v"])


def product_block(template: str = PRODUCT_TEMPLATE) -> Column:
    return filled(
        F.lit(template),
        {
            "name": F.coalesce("name", F.lit(UNKNOWN_NAME)),
            "category": F.coalesce("category", F.lit(UNKNOWN_CATEGORY)),
            "description": one_line(F.coalesce("description", F.lit(""))),
            "image_path": F.coalesce("image_path", F.lit("")),
        },
    )


def product_blocks(recs: DataFrame, template: str = PRODUCT_TEMPLATE) -> DataFrame:
    """(query_id, recommended_products): the products of a query as one text."""
    return recs.groupBy("query_id").agg(
        F.array_join(in_rank_order(product_block(template)), "").alias("recommended_products")
    )


def original_fields(products: DataFrame) -> DataFrame:
    """(query_id, original_product_*) with defaults and a one-line description."""
    return products.select(
        F.col("id").alias("query_id"),
        F.coalesce("name", F.lit(UNKNOWN_NAME)).alias("original_product_name"),
        F.coalesce("category", F.lit(UNKNOWN_CATEGORY)).alias("original_product_category"),
        one_line(F.coalesce("description", F.lit(""))).alias("original_product_description"),
    )


def prompts(recs: DataFrame, products: DataFrame, system_text: str = SYSTEM_TEXT, template: str = REQUEST_TEMPLATE) -> DataFrame:
    """(query_id, prompt): the system text, a blank line, the filled request."""
    slots = ["original_product_name", "original_product_category", "original_product_description", "recommended_products"]
    text = filled(F.lit(f"{system_text}\n\n{template}"), {s: F.col(s) for s in slots})
    # By a shuffle, as in with_details: every product may ask, and none of it goes through the driver.
    return product_blocks(recs).join(original_fields(products).hint("merge"), "query_id").select("query_id", text.alias("prompt"))


def _image() -> Column:
    return F.struct(
        F.coalesce("name", F.lit("")).alias("product_name"),
        F.coalesce("image_path", F.lit("")).alias("image_path"),
        F.coalesce("category", F.lit("")).alias("category"),
    )


def image_lists(recs: DataFrame) -> DataFrame:
    """(query_id, images, product_count) with images in rank order."""
    listed = recs.groupBy("query_id").agg(in_rank_order(_image()).alias("images"))
    return listed.withColumn("product_count", F.size("images"))


def _template_text() -> Column:
    """Aggregate of a query's recommendations: a plain sentence per product."""
    line = F.concat(
        F.lit(f"\n{MARKER} "), F.coalesce("name", F.lit(UNKNOWN_NAME)), F.lit(": "),
        one_line(F.coalesce("description", F.lit(""))),
    )
    return F.concat(F.lit("Similar products:"), F.array_join(in_rank_order(line), "")).alias("text")


def template_texts(recs: DataFrame) -> DataFrame:
    """(query_id, text): the built-in generator."""
    return recs.groupBy("query_id").agg(_template_text())


def template_answers(recs: DataFrame) -> DataFrame:
    """(query_id, text, images, product_count, error) of the built-in generator, in one aggregate."""
    both = recs.groupBy("query_id").agg(_template_text(), in_rank_order(_image()).alias("images"))
    return both.select("query_id", "text", "images", F.size("images").alias("product_count"), F.lit(None).cast("string").alias("error"))


def generate(prompt_rows: DataFrame, make_generator: Callable[[], Generator]) -> DataFrame:
    """(query_id, text, error, generation_s) from a caller's batch generator, made once per task.

    If a batch fails, its prompts are tried one by one; only those that fail again
    get the fixed error text.  ``generation_s`` is measured: the seconds of the call, or
    an equal share of a batch's seconds.
    """

    def one(generator: Generator, prompt: str) -> tuple[str, str | None, float]:
        began = time.perf_counter()
        try:
            text, error = generator([prompt])[0], None
        except Exception as problem:
            text, error = GENERATION_FAILED, str(problem)
        return text, error, time.perf_counter() - began

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make_generator()
        for batch in batches:
            asked, began = batch["prompt"].tolist(), time.perf_counter()
            try:
                made = list(generator(asked)) if asked else []
                share = (time.perf_counter() - began) / max(1, len(asked))
                answers = [(text, None, share) for text in made]
                if len(answers) != len(asked):
                    raise ValueError("the generator must answer every prompt")
            except Exception:
                answers = [one(generator, prompt) for prompt in asked]
            yield pd.DataFrame(
                {"query_id": batch["query_id"], "text": [a[0] for a in answers], "error": [a[1] for a in answers], "generation_s": [a[2] for a in answers]}
            )

    return prompt_rows.select("query_id", "prompt").mapInPandas(run, "query_id long, text string, error string, generation_s double")


def formatted(texts: DataFrame, recs: DataFrame) -> DataFrame:
    """Texts with their images; a failed text has no images and count 0."""
    if "error" not in texts.columns:
        texts = texts.withColumn("error", F.lit(None).cast("string"))
    joined = texts.join(image_lists(recs).hint("merge"), "query_id", "left")
    shown = F.col("error").isNull() & F.col("images").isNotNull()
    none = F.slice("images", 1, 0)
    return joined.select(
        "query_id", "text",
        F.when(shown, F.col("images")).otherwise(F.coalesce(none, F.array().cast(joined.schema["images"].dataType))).alias("images"),
        F.when(shown, F.col("product_count")).otherwise(0).alias("product_count"),
        "error", *[c for c in ["generation_s"] if c in texts.columns],
    )


def responses(queries: DataFrame, products: DataFrame, answers: DataFrame) -> DataFrame:
    """One response row per (query_id); a query without an answer is a failure row."""
    asked = queries.select("query_id").join(products.withColumnRenamed("id", "query_id").hint("merge"), "query_id", "left")
    joined = asked.join(answers.select("query_id", "text", "images", "product_count").hint("merge"), "query_id", "left")
    found = F.col("images").isNotNull()
    return joined.select(
        "query_id",
        found.alias("success"),
        system_message(F.col("category"), F.col("name"), F.col("description")).alias("system_message"),
        F.when(found, F.col("text")).otherwise(NOTHING_FOUND).alias("recommendations_text"),
        F.coalesce("images", F.array().cast(answers.schema["images"].dataType)).alias("images"),
        F.coalesce("product_count", F.lit(0)).alias("product_count"),
    )


def paragraphs(response_rows: DataFrame) -> DataFrame:
    """(query_id, position, text, product_name, image_path) of a response's text.

    Position 0 is the introduction; paragraph i goes with image i.  Blank paragraphs
    are dropped but keep their place.  A text without marks is shown whole, followed
    by the images alone.
    """
    parts = F.split("recommendations_text", MARKER)
    marked = F.size(parts) > 1
    lone = F.transform("images", lambda image, at: F.struct((at + 1).alias("position"), F.lit(None).cast("string").alias("text")))
    cut = F.transform(
        parts,
        lambda part, at: F.struct(
            at.alias("position"), F.when(marked & (F.trim(_plain(part)) == ""), None).otherwise(
                F.when(~marked, part).when(at == 0, _stripped(part)).otherwise(F.concat(F.lit(MARKER), _stripped(part)))
            ).alias("text"),
        ),
    )
    shown = F.when(marked, F.filter(cut, lambda p: p["text"].isNotNull())).otherwise(F.concat(cut, lone))
    rows = response_rows.select("query_id", "images", F.inline(shown))
    image = F.when(F.col("position") > 0, F.try_element_at("images", F.when(F.col("position") > 0, F.col("position")).otherwise(1)))
    return rows.select(
        "query_id", "position", "text",
        image["product_name"].alias("product_name"), image["image_path"].alias("image_path"),
    )


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")
