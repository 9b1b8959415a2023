"""Similarity and recommendation."""

from pyspark.sql import functions as F

from shelfkin.operators import neighbours as N
from shelfkin.operators import similarity as M
from shelfkin.operators.embedding import embed_text
from shelfkin.plans import recommend as R
from shelfkin.plans import standins as S
from shelfkin.session import scratch_dir
from shelfkin.sources.vector_store import read_vectors, write_vectors

from .sql import PRODUCTS, VECTORS, blend, image_cosine, recommendations, text_cosine

QUERY = 1


def vectors(spark, sf):
    return S.vectors(spark, sf)


def matrix_row(spark, sf):
    return M.similarity_row(vectors(spark, sf), QUERY)


def matrix_entries(spark, sf):
    """Entries for the (part, supplier) pairs of all order lines, and the diagonal."""
    v = vectors(spark, sf)
    lines = S.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id_a"), F.col("l_suppkey").alias("id_b"))
    diagonal = v.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"))
    return M.similarity_entries(v, lines.unionByName(diagonal))


def score(**settings):
    return lambda spark, sf: M.score_all(vectors(spark, sf), QUERY, **settings)


def ranked(spark, sf):
    return M.ranked(M.score_all(vectors(spark, sf), QUERY))


def others(spark, sf):
    return M.without_query(M.score_all(vectors(spark, sf), QUERY), QUERY)


def best(spark, sf):
    return M.top_n(M.score_all(vectors(spark, sf), QUERY), QUERY, 10)


def one_product(spark, sf):
    return R.recommend(S.products(spark, sf), S.product_vectors(spark, sf), QUERY, 5, text_weight=0.7, image_weight=0.3)


def stored_product(spark, sf):
    """The same through the vector store; vectors without a product row keep their place."""
    path = scratch_dir(spark, "vectors")
    write_vectors(vectors(spark, sf), path)
    few = S.products(spark, sf).filter("id % 3 <> 0")
    return R.recommend(few, read_vectors(spark, path), QUERY, 5, text_weight=0.7, image_weight=0.3)


def odd_requests(spark, sf):
    """Requests in which switches and the slider may be null."""
    settings = requests(spark, sf).withColumns({
        "use_text": F.when(F.col("request_id") % 3 != 0, F.col("use_text")),
        "use_image": F.when(F.col("request_id") % 5 != 0, F.col("use_image")),
        "percent": F.when(F.col("request_id") % 2 != 0, F.col("percent")),
    })
    return R.recommend_requests(vectors(spark, sf), settings, 3)


def unknown_product(spark, sf):
    return R.recommend(S.products(spark, sf), vectors(spark, sf), 1_000_000_000, 5)


def every_product(spark, sf):
    return R.recommend_all(vectors(spark, sf), 5, text_weight=0.7, image_weight=0.3)


def chosen(spark, sf):
    found = R.chosen_product(S.products(spark, sf), every_product(spark, sf))
    return found.select(
        "query_id", F.col("chosen_product.name").alias("name"), F.col("chosen_product.category").alias("category"),
        F.array_join(F.transform("recommended_products", lambda r: r["id"].cast("string")), ",").alias("ids"),
    )


def requests(spark, sf):
    """One request per event: who asks, what for, with which settings."""
    return S.table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("product_id"),
        F.col("event_type").isin("view", "click", "purchase").alias("use_text"),
        F.col("event_type").isin("view", "click", "signup").alias("use_image"),
        F.when(F.col("value") < 20, 30).otherwise(70).alias("percent"),
    )


def answered_requests(spark, sf):
    return R.recommend_requests(vectors(spark, sf), requests(spark, sf), 3)


def other_metric(metric):
    def query(spark, sf):
        return R.recommend(
            S.products(spark, sf), S.product_vectors(spark, sf), QUERY, 10, text_weight=0.6, image_weight=0.4, metric=metric
        ).select("query_id", "rank", "id", "score")

    return query


def other_metric_everywhere(metric):
    return lambda spark, sf: R.recommend_all(vectors(spark, sf), 5, text_weight=0.6, image_weight=0.4, metric=metric)


def strict(spark, sf):
    return M.score_all(vectors(spark, sf), QUERY, text_weight=0.25, image_weight=0.75, strict_weights=True)


def from_descriptions(spark, sf):
    """Text-only run: descriptions to vectors to the products most like the first one."""
    products = S.products(spark, sf)
    text = embed_text(products, "id", "description").withColumnRenamed("vector", "text")
    return R.recommend(
        products, text.withColumn("image", F.lit(None).cast("array<double>")), QUERY, 3, use_image=False, text_weight=1.0
    ).select("query_id", "rank", "id", "name", "score")


def similar(spark, sf):
    """All entries of 0.3 or more, between classes of equal vectors."""
    return N.similar_classes(vectors(spark, sf), 0.3, 0.7, 0.3)[0]


def similar_by_distance(spark, sf):
    return N.similar_classes(vectors(spark, sf).withColumn("image", F.lit(None).cast("array<double>")), 0.8, metric="euclidean")[0]


def class_members(spark, sf):
    """Classes of vectors that hold only their signs, so that several are equal."""
    signs = vectors(spark, sf).select("id", F.transform(F.slice("text", 1, 6), F.signum).alias("text"), F.lit(None).cast("array<double>").alias("image"))
    return N.vector_classes(signs)[1]


QUERIES = {
    "v1_similarity_row": matrix_row,
    "v1_similarity_entries": matrix_entries,
    "v1_similar_classes": similar,
    "v1_similar_by_distance": similar_by_distance,
    "v1_class_members": class_members,
    "v2_text_score": lambda spark, sf: M.text_scores(vectors(spark, sf), QUERY, 0.7),
    "v3_image_score": lambda spark, sf: M.image_scores(vectors(spark, sf), QUERY, 0.3),
    "v4_blend": score(text_weight=0.7, image_weight=0.3),
    "v5_default_weights": score(),
    "v5_text_only": score(use_image=False),
    "v5_image_only": score(use_text=False),
    "v5_no_modality": score(use_text=False, use_image=False),
    "v6_rank": ranked,
    "v7_exclude_query": others,
    "v8_top_n": best,
    "v9_recommend": one_product,
    "v9_recommend_unknown": unknown_product,
    "v9_recommend_stored": stored_product,
    "v10_chosen_product": chosen,
    "v11_recommend_all": every_product,
    "v12_recommend_requests": answered_requests,
    "v12_requests_with_defaults": odd_requests,
    "v13_euclidean": other_metric("euclidean"),
    "v13_manhattan": other_metric("manhattan"),
    "v13_dot_product": other_metric("dot_product"),
    "v13_euclidean_all": other_metric_everywhere("euclidean"),
    "v13_manhattan_all": other_metric_everywhere("manhattan"),
    "v13_dot_product_all": other_metric_everywhere("dot_product"),
    "v14_strict_weights": strict,
    "v9_recommend_from_descriptions": from_descriptions,
}


def _scored(wt, wi):
    return f"""WITH {VECTORS} SELECT b.id, {blend('a', 'b', wt, wi)} AS score
        FROM vectors a, vectors b WHERE a.id = {QUERY}"""


def _none(direction):
    """What an item without a picture adds: nothing to a similarity, any distance."""
    return "'inf'::DOUBLE" if direction == "ASC" else "0"


def _by_metric(text, image, direction):
    return f"""WITH {VECTORS},
        scored AS (SELECT b.id, round({text} * 0.6 + CASE WHEN b.id % 17 <> 0 THEN {image} * 0.4 ELSE {_none(direction)} END, 6) + 0.0 AS score
                   FROM vectors a, vectors b JOIN part ON b.id = p_partkey WHERE a.id = {QUERY} AND b.id <> {QUERY})
        SELECT {QUERY}::BIGINT AS query_id, row_number() OVER (ORDER BY score {direction}, id) AS rank, id, score
        FROM scored ORDER BY rank LIMIT 10"""


def _sum(body, part):
    pair = f"list_zip(a.{part}, b.{part})"
    return f"list_sum(list_transform({pair}, lambda p: {body}))"


SQL = {
    "v1_similarity_row": f"""WITH {VECTORS} SELECT a.id AS id_a, b.id AS id_b, round({text_cosine('a.text', 'b.text')}, 6) + 0.0 AS score
        FROM vectors a, vectors b WHERE a.id = {QUERY}""",
    "v1_similarity_entries": f"""WITH {VECTORS},
        pairs AS (SELECT l_partkey AS id_a, l_suppkey AS id_b FROM lineitem UNION SELECT id, id FROM vectors)
        SELECT id_a, id_b, round({text_cosine('a.text', 'b.text')}, 6) + 0.0 AS score
        FROM pairs JOIN vectors a ON a.id = id_a JOIN vectors b ON b.id = id_b""",
    "v1_similar_classes": f"""WITH {VECTORS},
        classes AS (SELECT min(id) AS id, text, image FROM vectors GROUP BY text, image)
        SELECT a.id AS class_a, b.id AS class_b, {blend('a', 'b', 0.7, 0.3)} AS score
        FROM classes a JOIN classes b ON a.id < b.id WHERE {blend('a', 'b', 0.7, 0.3)} >= 0.3""",
    "v1_similar_by_distance": f"""WITH {VECTORS},
        classes AS (SELECT min(id) AS id, text FROM vectors GROUP BY text)
        SELECT a.id AS class_a, b.id AS class_b, round(list_distance(a.text, b.text), 6) AS score
        FROM classes a JOIN classes b ON a.id < b.id WHERE round(list_distance(a.text, b.text), 6) <= 0.8""",
    "v1_class_members": f"""WITH {VECTORS}, signs AS (SELECT id, list_transform(text[1:6], lambda x: sign(x)) AS s FROM vectors)
        SELECT id, min(id) OVER (PARTITION BY s) AS "class" FROM signs""",
    "v2_text_score": f"""WITH {VECTORS} SELECT b.id, round({text_cosine('a.text', 'b.text')} * 0.7, 6) + 0.0 AS text_score
        FROM vectors a, vectors b WHERE a.id = {QUERY}""",
    "v3_image_score": f"""WITH {VECTORS} SELECT b.id, round({image_cosine('a.image', 'b.image')} * 0.3, 6) + 0.0 AS image_score
        FROM vectors a, vectors b WHERE a.id = {QUERY}""",
    "v4_blend": _scored(0.7, 0.3),
    "v5_default_weights": _scored(0.5, 0.5),
    "v5_text_only": _scored(0.5, 0),
    "v5_image_only": _scored(0, 0.5),
    "v5_no_modality": _scored(1, 0),
    "v6_rank": _scored(0.5, 0.5),
    "v7_exclude_query": f"SELECT * FROM ({_scored(0.5, 0.5)}) WHERE id <> {QUERY}",
    "v8_top_n": f"""SELECT {QUERY}::BIGINT AS query_id, row_number() OVER (ORDER BY score DESC, id) AS rank, id, score
        FROM ({_scored(0.5, 0.5)}) WHERE id <> {QUERY} ORDER BY rank LIMIT 10""",
    "v9_recommend": f"WITH {recommendations(5, 0.7, 0.3, 'JOIN part ON vec_id = p_partkey')} SELECT * FROM recs WHERE query_id = {QUERY}",
    "v9_recommend_unknown": f"WITH {recommendations(5, 0.5, 0.5)} SELECT * FROM recs WHERE query_id = 1000000000",
    "v10_chosen_product": f"""WITH {recommendations(5, 0.7, 0.3)}
        SELECT query_id, p.name, p.category, string_agg(r.id, ',' ORDER BY rank) AS ids
        FROM recs r JOIN products p ON p.id = query_id GROUP BY ALL""",
    "v11_recommend_all": f"WITH {recommendations(5, 0.7, 0.3)} SELECT query_id, rank, id, score FROM recs",
    "v12_recommend_requests": f"""WITH {VECTORS},
        requests AS (SELECT event_id AS request_id, user_id AS product_id, event_type IN ('view', 'click', 'purchase') AS use_text,
                            event_type IN ('view', 'click', 'signup') AS use_image, CASE WHEN value < 20 THEN 30 ELSE 70 END AS percent
                     FROM events),
        weighted AS (SELECT request_id, product_id,
                            CASE WHEN use_text AND use_image THEN percent / 100.0 WHEN use_image THEN 0 ELSE 1 END::DOUBLE AS wt,
                            CASE WHEN use_text AND use_image THEN (100 - percent) / 100.0 WHEN use_image THEN 1 ELSE 0 END::DOUBLE AS wi
                     FROM requests),
        asked AS (SELECT DISTINCT product_id, wt, wi FROM weighted),
        scored AS (SELECT product_id, wt, wi, b.id, {blend('a', 'b', 'wt', 'wi')} AS score
                   FROM asked JOIN vectors a ON a.id = product_id JOIN vectors b ON b.id <> product_id),
        placed AS (SELECT *, row_number() OVER (PARTITION BY product_id, wt, wi ORDER BY score DESC, id) AS rank FROM scored)
        SELECT request_id, rank, id, score FROM weighted JOIN placed USING (product_id, wt, wi) WHERE rank <= 3""",
    "v13_euclidean": _by_metric(
        f"sqrt({_sum('(p[1] - p[2]) * (p[1] - p[2])', 'text')})", f"sqrt({_sum('(p[1] - p[2]) * (p[1] - p[2])', 'image')})", "ASC"
    ),
    "v13_manhattan": _by_metric(_sum("abs(p[1] - p[2])", "text"), _sum("abs(p[1] - p[2])", "image"), "ASC"),
    "v13_dot_product": _by_metric("list_dot_product(a.text, b.text)", "list_dot_product(a.image, b.image)", "DESC"),
    "v14_strict_weights": _scored(0.25, 0.75),
}


def _all_by_metric(metric, direction):
    """The same formulas over every pair; the SQL is quick enough on whole tables."""
    text, image = _PARTS[metric]
    return f"""WITH {VECTORS},
        scored AS (SELECT a.id AS query_id, b.id,
                          round({text} * 0.6 + CASE WHEN a.id % 17 <> 0 AND b.id % 17 <> 0 THEN {image} * 0.4
                                                    WHEN a.id % 17 <> 0 THEN {_none(direction)} ELSE 0 END, 6) + 0.0 AS score
                   FROM vectors a JOIN vectors b ON a.id <> b.id),
        placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {direction}, id) AS rank FROM scored)
        SELECT query_id, rank, id, score FROM placed WHERE rank <= 5"""


_SQUARE = "(p[1] - p[2]) * (p[1] - p[2])"
_PARTS = {
    "euclidean": tuple(f"sqrt({_sum(_SQUARE, part)})" for part in ("text", "image")),
    "manhattan": tuple(_sum("abs(p[1] - p[2])", part) for part in ("text", "image")),
    "dot_product": tuple(f"list_dot_product(a.{part}, b.{part})" for part in ("text", "image")),
}
SQL["v9_recommend_stored"] = f"""WITH {PRODUCTS},{VECTORS},
    scored AS (SELECT b.id, {blend('a', 'b', 0.7, 0.3)} AS score FROM vectors a, vectors b WHERE a.id = {QUERY} AND b.id <> {QUERY}),
    placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored)
    SELECT {QUERY}::BIGINT AS query_id, rank, s.id, name, category, description, image_path, score
    FROM placed s LEFT JOIN (SELECT * FROM products WHERE id % 3 <> 0) p ON p.id = s.id WHERE rank <= 5"""
SQL["v12_requests_with_defaults"] = (
    SQL["v12_recommend_requests"]
    .replace("event_type IN ('view', 'click', 'purchase') AS use_text", "event_id % 3 = 0 OR event_type IN ('view', 'click', 'purchase') AS use_text")
    .replace("event_type IN ('view', 'click', 'signup') AS use_image", "event_id % 5 = 0 OR event_type IN ('view', 'click', 'signup') AS use_image")
    .replace("CASE WHEN value < 20 THEN 30 ELSE 70 END AS percent", "CASE WHEN event_id % 2 = 0 THEN 50 WHEN value < 20 THEN 30 ELSE 70 END AS percent")
)
SQL["v13_euclidean_all"] = _all_by_metric("euclidean", "ASC")
SQL["v13_manhattan_all"] = _all_by_metric("manhattan", "ASC")
SQL["v13_dot_product_all"] = _all_by_metric("dot_product", "DESC")
