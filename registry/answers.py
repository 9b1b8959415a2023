"""Prompts, generated texts and response rows, for every product at once."""

from pyspark.sql import functions as F

from shelfkin.operators import answers as A
from shelfkin.operators import runs as X
from shelfkin.plans import answer as P
from shelfkin.plans import standins as S
from shelfkin.plans.recommend import recommend_all, with_details

from .sql import PRODUCTS, VECTORS, recommendations, text_cosine

N = 3


def recs(spark, sf):
    hits = recommend_all(S.product_vectors(spark, sf, shuffled=True), N, text_weight=0.7, image_weight=0.3)
    return with_details(hits, S.products(spark, sf))


def blocks(spark, sf):
    return A.product_blocks(recs(spark, sf))


def originals(spark, sf):
    return A.original_fields(S.products(spark, sf))


def prompts(spark, sf):
    return A.prompts(recs(spark, sf), S.products(spark, sf))


def _flat(images):
    return F.array_join(
        F.transform(images, lambda i: F.concat_ws("|", i["product_name"], i["image_path"], i["category"])), ";"
    )


def image_lists(spark, sf):
    return A.image_lists(recs(spark, sf)).select("query_id", _flat(F.col("images")).alias("images"), "product_count")


def responses(spark, sf):
    """Every product asks; those without a vector get the failure row."""
    products = S.products(spark, sf)
    answered = P.answer(recs(spark, sf), products)
    rows = A.responses(products.select(F.col("id").alias("query_id")), products, answered)
    return rows.withColumn("images", _flat(F.col("images")))


def paragraphs(spark, sf):
    products = S.products(spark, sf)
    answered = P.answer(recs(spark, sf), products)
    return A.paragraphs(A.responses(products.select(F.col("id").alias("query_id")), products, answered))


def counting_generator():
    """Answers with the length of the prompt; refuses prompts about plates."""

    def generate(prompts):
        if any("plate" in p for p in prompts):
            raise ValueError("no plates")
        return [f"{len(p)} characters" for p in prompts]

    return generate


def generated(spark, sf):
    made = P.answer(recs(spark, sf), S.products(spark, sf), lambda: counting_generator())
    return made.select("query_id", "text", _flat(F.col("images")).alias("images"), "product_count", "error")


def histories(spark, sf):
    return S.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.count("*").alias("history_length")
    )


def run_records(spark, sf):
    made = P.answer(recs(spark, sf), S.products(spark, sf), lambda: counting_generator())
    return P.record_runs(made, histories(spark, sf)).drop("generation_time_seconds")


def logged_runs(spark, sf):
    """Run records as rows of the parameter and metric tables; the seconds differ from run to run."""
    made = P.answer(recs(spark, sf), S.products(spark, sf), lambda: counting_generator())
    runs = P.record_runs(made, histories(spark, sf), S.products(spark, sf)).withColumns(
        {"experiment_id": F.lit("answers"), "step": F.lit(0), "ts": F.lit("2024-01-01 00:00:00").cast("timestamp")}
    )
    params = X.param_rows(runs, [*X.RUN_PARAMS, "error"]).withColumn("kind", F.lit("param"))
    metrics = X.metric_rows(runs, X.RUN_METRICS).withColumn("kind", F.lit("metric"))
    value = F.when(F.col("key") != "generation_time_seconds", F.col("value")).otherwise(F.least(F.floor("value"), F.lit(0)).cast("double"))
    metrics = metrics.withColumn("value", value.cast("string"))
    return params.select("run_id", "kind", "key", "value").unionByName(metrics.select("run_id", "kind", "key", "value"))


def knowledge(spark, sf):
    """Passages of documents, each with a vector of its own."""
    vectors = S.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.slice(F.col("embedding").cast("array<double>"), 33, 32).alias("vector")
    )
    passages = S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("passage"))
    return vectors.join(passages, "id")


def with_knowledge(spark, sf):
    queries = S.vectors(spark, sf).select(F.col("id").alias("query_id"), F.col("text").alias("vector"))
    asked = S.products(spark, sf).select(F.col("id").alias("query_id"), F.col("name").alias("prompt"))
    full = P.knowledge_prompts(asked, queries, knowledge(spark, sf), 2)
    return full.select("query_id", F.md5("prompt").alias("digest"), F.char_length("prompt").alias("chars"))


QUERIES = {
    "r1_product_blocks": blocks,
    "r2_original_fields": originals,
    "r3_prompts": prompts,
    "r4_image_lists": image_lists,
    "r5_responses": responses,
    "r6_paragraphs": paragraphs,
    "r7_generate": generated,
    "x6_recommendation_runs": run_records,
    "x6_logged_runs": logged_runs,
    "rag1_knowledge_prompts": with_knowledge,
}

_RECS = recommendations(N, 0.7, 0.3, "JOIN part ON vec_id = p_partkey")
_LINE = "replace(coalesce(description, ''), chr(10), ', ')"
_BLOCKS = f"""
  blocks AS (SELECT query_id, string_agg('* ' || name || ', a ' || category || ': ' || {_LINE} || chr(10), '' ORDER BY rank) AS recommended_products
             FROM recs GROUP BY query_id)"""
_IMAGES = """
  lists AS (SELECT query_id, string_agg(name || '|' || image_path || '|' || category, ';' ORDER BY rank) AS images,
                   count(*)::INT AS product_count FROM recs GROUP BY query_id)"""


def _quoted(text):
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _filled(template, slots):
    text = _quoted(template)
    for name, value in slots.items():
        text = f"replace({text}, '[{name}]', {value})"
    return text


_PROMPTS = f"""
  asked AS (SELECT query_id, {_filled(A.SYSTEM_TEXT + chr(10) * 2 + A.REQUEST_TEMPLATE, {
    'original_product_name': 'name', 'original_product_category': 'category',
    'original_product_description': _LINE, 'recommended_products': 'recommended_products'})} AS prompt
            FROM blocks JOIN products ON id = query_id)"""
_TEXTS = f"""
  texts AS (SELECT query_id, 'Similar products:' || string_agg(chr(10) || '🔸 ' || name || ': ' || {_LINE}, '' ORDER BY rank) AS text
            FROM recs GROUP BY query_id)"""
_GENERATED = """
  made AS (SELECT query_id, CASE WHEN contains(prompt, 'plate') THEN 'Error generating recommendations'
                                 ELSE length(prompt) || ' characters' END AS text,
                  CASE WHEN contains(prompt, 'plate') THEN 'no plates' END AS error FROM asked)"""

SQL = {
    "r1_product_blocks": f"WITH {_RECS},{_BLOCKS} SELECT * FROM blocks",
    "r2_original_fields": f"""WITH {PRODUCTS} SELECT id AS query_id, name AS original_product_name, category AS original_product_category,
        {_LINE} AS original_product_description FROM products""",
    "r3_prompts": f"WITH {_RECS},{_BLOCKS},{_PROMPTS} SELECT * FROM asked",
    "r4_image_lists": f"WITH {_RECS},{_IMAGES} SELECT * FROM lists",
    "r5_responses": f"""WITH {_RECS},{_IMAGES},{_TEXTS}
        SELECT id AS query_id, l.query_id IS NOT NULL AS success,
               'Generate recommendations for product:  ' || chr(10) || category || ' ' || name || ' (' || {_LINE} || ')' AS system_message,
               coalesce(text, 'Unable to find recommendations') AS recommendations_text,
               coalesce(images, '') AS images, coalesce(product_count, 0) AS product_count
        FROM products p LEFT JOIN lists l ON l.query_id = id LEFT JOIN texts t ON t.query_id = id""",
    "r6_paragraphs": f"""WITH {_RECS}
        SELECT query_id, rank::INT AS position, '🔸' || name || ': ' || {_LINE} AS text, name AS product_name, image_path FROM recs
        UNION ALL SELECT DISTINCT query_id, 0, 'Similar products:', NULL, NULL FROM recs
        UNION ALL SELECT id, 0, 'Unable to find recommendations', NULL, NULL FROM products WHERE id NOT IN (SELECT query_id FROM recs)""",
    "r7_generate": f"""WITH {_RECS},{_BLOCKS},{_PROMPTS},{_GENERATED},{_IMAGES}
        SELECT query_id, text, CASE WHEN error IS NULL THEN images ELSE '' END AS images,
               CASE WHEN error IS NULL THEN product_count ELSE 0 END AS product_count, error
        FROM made JOIN lists USING (query_id)""",
    "x6_recommendation_runs": f"""WITH {_RECS},{_BLOCKS},{_PROMPTS},{_GENERATED},
        counts AS (SELECT conv_id AS query_id, count(*) AS n FROM conversations GROUP BY ALL)
        SELECT query_id::VARCHAR AS run_id,
               CASE WHEN error IS NULL THEN 'recommendation_generation' ELSE 'recommendation_generation_failed' END AS run_name,
               CASE WHEN error IS NULL THEN {N} END AS output_product_count,
               CASE WHEN error IS NULL THEN coalesce(n, 0) END AS chat_history_length,
               CASE WHEN error IS NULL THEN length(text)::INT END AS response_length_chars,
               CASE WHEN error IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS success, error
        FROM made LEFT JOIN counts USING (query_id)""",
    "rag1_knowledge_prompts": f"""WITH {VECTORS},{PRODUCTS},
        known AS (SELECT vec_id AS id, list_slice(embedding::DOUBLE[], 33, 64) AS text, documents.text AS passage
                  FROM embeddings JOIN documents ON doc_id = vec_id),
        scored AS (SELECT a.id AS query_id, b.id, passage, round({text_cosine('a.text', 'b.text')}, 6) + 0.0 AS score FROM vectors a, known b),
        placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored),
        joined AS (SELECT query_id, string_agg(passage, chr(10) ORDER BY rank) AS passages FROM placed WHERE rank <= 2 GROUP BY query_id),
        full_text AS (SELECT id AS query_id, name || coalesce(chr(10) || 'Background:' || chr(10) || passages, '') AS prompt
                      FROM products LEFT JOIN joined ON query_id = id)
        SELECT query_id, md5(prompt) AS digest, length(prompt)::INT AS chars FROM full_text""",
}
SQL["x6_logged_runs"] = f"""
    WITH runs AS ({SQL['x6_recommendation_runs']}),
    named AS (SELECT runs.*, p_name, p_type FROM runs LEFT JOIN part ON p_partkey::VARCHAR = run_id)
    SELECT run_id, 'param' AS kind, unnest(['original_product_name', 'original_product_category', 'error']) AS key, unnest([p_name, p_type, error]) AS value FROM named
    UNION ALL
    SELECT * FROM (
        SELECT run_id, 'metric', unnest(['output_product_count', 'chat_history_length', 'response_length_chars', 'generation_time_seconds', 'success']) AS key,
               unnest([output_product_count::DOUBLE, chat_history_length, response_length_chars, 0, success])::VARCHAR AS value FROM named)
    WHERE value IS NOT NULL"""
