"""Text cleaning, text vectors, picture vectors and function hooks."""

import numpy as np
from pyspark.sql import functions as F

from shelfkin.functions import text as X
from shelfkin.operators import embedding, words
from shelfkin.operators.pictures import CHANNEL_MEAN, CHANNEL_STD
from shelfkin.plans import standins as S
from shelfkin.plans.build_vectors import store_vectors
from shelfkin.session import scratch_dir
from shelfkin.sources import image_files
from shelfkin.sources.vector_store import valid_vectors

from .loading import bitmaps, pictures_read


def _on_documents(expression):
    def query(spark, sf):
        return S.documents(spark, sf).select("doc_id", expression(F.col("text")).alias("result"))

    return query


def _joined(tokens):
    return F.array_join(tokens, "|")


def lemmas(spark, sf):
    """Lemmas made of the words of the cleaned texts."""
    cleaned = words.preprocess_text(S.documents(spark, sf), "text")
    return words.lemmatize(cleaned, "doc_id", "clean_text", lambda forms: words.plural_lemmas(forms.filter("form <> ''")))


def joined_lemmas(spark, sf):
    """The same with a caller's table, which lists forms twice and has rows without a lemma."""
    docs = S.documents(spark, sf)
    known = words.plural_lemmas(words.vocabulary(docs, "text"))
    table = known.unionByName(known).unionByName(known.select(F.col("lemma").alias("form"), F.lit(None).cast("string").alias("lemma")))
    return words.lemmatize(words.preprocess_text(docs, "text"), "doc_id", "clean_text", table)


def clean(spark, sf):
    return words.preprocess_text(S.documents(spark, sf), "text", lemmas=words.plural_lemmas).select("doc_id", "clean_text")


def clean_only(spark, sf):
    return words.preprocess_text(S.documents(spark, sf), "text").select("doc_id", "clean_text")


def text_vectors(spark, sf):
    vectors = embedding.embed_text(S.documents(spark, sf), "doc_id", "text", lemmas=words.plural_lemmas)
    square = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x)
    return vectors.select("doc_id", F.array_size("vector").alias("width"), F.round(F.sqrt(square), 6).alias("length"))


def decoded(spark, sf):
    """(id, image): pictures made from the embeddings, without the detour over files."""
    pixel = F.substring("content", 55, 192)
    one = F.lit(8)
    return bitmaps(spark, sf).select(
        "id",
        F.when(~F.col("label").isin(3, 5), image_files.image_struct(one, one, pixel, F.col("file_name"))).alias("image"),
    )


def tensors(spark, sf):
    return embedding.image_tensors(decoded(spark, sf), "id").select(
        "id", F.array_size("tensor").alias("width"), F.round(F.element_at("tensor", 1).cast("double"), 3).alias("first_red")
    )


def image_vectors(spark, sf):
    """Width, and the mean of red in the first cell, turned back into the sum of its 56 x 56 bytes."""
    vectors = embedding.embed_images(decoded(spark, sf), "id")
    red = (F.element_at("vector", 1) * CHANNEL_STD[0] + CHANNEL_MEAN[0]) * 255 * 56 * 56
    return vectors.select("id", F.array_size("vector").alias("width"), F.round(red).cast("long").alias("first_red_sum"))


def kept_vectors(spark, sf):
    return valid_vectors(S.vectors(spark, sf)).select("id", F.array_size("image").alias("width"))


def both_vectors(spark, sf):
    """Vectors of products whose pictures are files: read, embedded, stored, read back."""
    described = S.products(spark, sf).drop("image_path")
    pictures = pictures_read(spark, sf).filter("image is not null")
    named = S.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.format_string("img/pic_%d.bmp", "vec_id").alias("image_path")
    )
    images = pictures.select(F.format_string("pic_%d.bmp", "id").alias("file_name"), "image")
    stored = store_vectors(spark, described.join(named, "id", "left"), images, scratch_dir(spark, "vectors"), root="img")
    return stored.select("id", F.array_size("text").alias("text_width"), F.array_size("image").alias("image_width"))


def series_function(spark, sf):
    parts = S.table(spark, sf, "part").select("p_partkey", "p_name")
    return embedding.apply_series(parts, "p_name", lambda names: names.str.upper(), "shouted")


def batch_encoder(spark, sf):
    def make():
        return lambda texts: np.array([[len(t), t.count(" ")] for t in texts], dtype=float)

    vectors = embedding.encode_batches(S.documents(spark, sf), "doc_id", "text", make)
    return vectors.select("doc_id", F.col("vector")[0].alias("chars"), F.col("vector")[1].alias("blanks"))


QUERIES = {
    "t1_lower": _on_documents(X.lowered),
    "t2_strip_punctuation": _on_documents(X.strip_punctuation),
    "t3_words": _on_documents(lambda c: _joined(X.words(X.strip_punctuation(c)))),
    "t4_drop_stop_words": _on_documents(lambda c: _joined(X.clean_words(c))),
    "t5_lemmatize": lemmas,
    "t5_lemmatize_joined": joined_lemmas,
    "t4_own_stop_words": _on_documents(lambda c: _joined(X.drop_stop_words(X.words(X.strip_punctuation(X.lowered(c)))))),
    "t6_preprocess_text": clean,
    "t6_without_lemmas": clean_only,
    "t7_embed_text": text_vectors,
    "i1_image_tensors": tensors,
    "i2_embed_images": image_vectors,
    "i3_valid_vectors": kept_vectors,
    "i4_build_vectors": both_vectors,
    "u1_series_function": series_function,
    "u2_batch_encoder": batch_encoder,
}

_PUNCTUATION = X.PUNCTUATION.replace("'", "''")
_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS)


def _split(text: str) -> str:
    spaced = f"regexp_replace({text}, '[{X.QUOTES}]', ' \\0 ', 'g')"
    for first, second in X.FUSED_WORDS:
        spaced = f"regexp_replace({spaced}, '\\b{first}{second}\\b', '{first} {second}', 'g')"
    blanks = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+"
    return f"list_filter(regexp_split_to_array({spaced}, '{blanks}'), lambda w: w <> '')"


_STRIPPED = f"translate(text, '{_PUNCTUATION}', '')"
_CLEAN = f"list_filter({_split(f'lower({_STRIPPED})')}, lambda w: w NOT IN ({_STOPS}))"
_RULES = ", ".join(
    f"CASE WHEN form LIKE '%{end}' AND length(form) > {len(end) + 1} THEN left(form, length(form) - {len(end)}) || '{put}' END"
    for end, put in X.PLURAL_RULES
)

SQL = {
    "t1_lower": "SELECT doc_id, lower(text) AS result FROM documents",
    "t2_strip_punctuation": f"SELECT doc_id, {_STRIPPED} AS result FROM documents",
    "t3_words": f"SELECT doc_id, array_to_string({_split(_STRIPPED)}, '|') AS result FROM documents",
    "t4_drop_stop_words": f"SELECT doc_id, array_to_string({_CLEAN}, '|') AS result FROM documents",
    "t5_lemmatize": f"""
        WITH cleaned AS (SELECT doc_id, {_CLEAN} AS tokens FROM documents),
        tokens AS (SELECT doc_id, unnest(tokens) AS form, generate_subscripts(tokens, 1) AS place FROM cleaned),
        forms AS (SELECT DISTINCT form FROM tokens),
        made AS (SELECT form, unnest(list_filter([{_RULES}], lambda x: x IS NOT NULL)) AS lemma,
                        generate_subscripts(list_filter([{_RULES}], lambda x: x IS NOT NULL), 1) AS rule FROM forms),
        known AS (SELECT form, arg_min(lemma, rule) AS lemma FROM made WHERE lemma IN (SELECT form FROM forms) GROUP BY form)
        SELECT d.doc_id, CASE WHEN len(c.tokens) = 0 THEN '' ELSE t.joined END AS lemma_text
        FROM documents d JOIN cleaned c USING (doc_id) LEFT JOIN
             (SELECT doc_id, string_agg(coalesce(lemma, form), ' ' ORDER BY place) AS joined
              FROM tokens LEFT JOIN known USING (form) GROUP BY doc_id) t USING (doc_id)""",
    "t4_own_stop_words": f"SELECT doc_id, array_to_string({_CLEAN}, '|') AS result FROM documents",
    "t6_without_lemmas": f"SELECT doc_id, array_to_string({_CLEAN}, ' ') AS clean_text FROM documents",
    "i3_valid_vectors": "SELECT vec_id AS id, 32 AS width FROM embeddings WHERE vec_id % 17 <> 0",
    "i4_build_vectors": """
        SELECT p_partkey AS id, 256 AS text_width, CASE WHEN label NOT IN (3, 5) THEN 96 END AS image_width
        FROM part LEFT JOIN embeddings ON vec_id = p_partkey""",
    "u1_series_function": "SELECT p_partkey, p_name, upper(p_name) AS shouted FROM part",
    "u2_batch_encoder": """
        SELECT doc_id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks FROM documents""",
}
SQL["t5_lemmatize_joined"] = SQL["t5_lemmatize"]
SQL["t6_preprocess_text"] = f"SELECT doc_id, lemma_text AS clean_text FROM ({SQL['t5_lemmatize']})"
# Lengths only: the hash behind the vectors is Spark's own; tests check the contents.
SQL["t7_embed_text"] = f"""
    SELECT doc_id, 256 AS width, CASE WHEN len({_CLEAN}) = 0 THEN 0 ELSE 1 END::DOUBLE AS length FROM documents"""

# The first pixel of the crop lies 1/64 of the way from the first grey value to the next.
_GREY = "greatest(0, least(255, round(embedding[{}]::DOUBLE * 400 + 128)))"
_ACROSS = ["round_even((63 * " + _GREY.format(i) + " + " + _GREY.format(i + 1) + ") / 64, 0)" for i in (1, 9)]
SQL["i1_image_tensors"] = f"""
    SELECT vec_id AS id, 150528 AS width,
           round((round_even((63 * {_ACROSS[0]} + {_ACROSS[1]}) / 64, 0) / 255 - 0.485) / 0.229, 3) AS first_red
    FROM embeddings WHERE label NOT IN (3, 5)"""

# Bytes of the first cell: both passes of the enlargement by 32, rounded one after the other.
SQL["i2_embed_images"] = """
    WITH places AS (SELECT range AS k, floor((range + 16.5) / 32 - 0.5)::BIGINT AS low, (range + 16.5) / 32 - 0.5 - floor((range + 16.5) / 32 - 0.5) AS part FROM range(56)),
    greys AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda v: greatest(0, least(255, round(v * 400 + 128)))) AS g
              FROM embeddings WHERE label NOT IN (3, 5)),
    across AS (SELECT id, r.range AS r, k AS x, round_even(g[r.range * 8 + low + 1] * (1 - part) + g[r.range * 8 + low + 2] * part, 0) AS v
               FROM greys, range(4) r, places),
    columns_ AS (SELECT id, x, list(v ORDER BY r) AS c FROM across GROUP BY id, x),
    sums AS (SELECT id, sum(round_even(c[low + 1] * (1 - part) + c[low + 2] * part, 0))::BIGINT AS first_red_sum FROM columns_, places GROUP BY id)
    SELECT vec_id AS id, CASE WHEN first_red_sum IS NOT NULL THEN 96 END AS width, first_red_sum FROM embeddings LEFT JOIN sums ON id = vec_id"""
