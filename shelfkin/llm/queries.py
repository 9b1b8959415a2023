"""One registered query per operator, over its whole table, with the SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from shelfkin.session import scratch_dir

from . import bbit_minhash, bpe, fm_decontam, gru_language, jump_shards, licence_scan, orc_ids, quality_gbdt, suffix_runs, template_html, token_alignment, vector_graph, warc_derive
from .common import table

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return table(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *columns)


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_html.extract_pages(_read(spark, sf_dir, "pages", "page_id", "url", "html"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents", "doc_id", "text")
    found = fm_decontam.find_contamination(documents, _read(spark, sf_dir, "benchmark", "item_id", "text"))
    return fm_decontam.contamination_report(found).drop("text", "spans", "item_ids")


def embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.linked_vectors(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a directory for sixteen ids of a source and language, its first file the licence file."""
    documents = _read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    name = F.when(F.col("doc_id") % 16 == 0, F.lit("LICENSE.")).otherwise(F.lit("document."))
    place = F.floor(F.col("doc_id") / 16).cast("string")
    path = F.concat_ws("/", "source", "lang", place, F.concat(name, F.col("doc_id").cast("string")))
    found = licence_scan.scan_licences(documents.select(path.alias("path"), "text"))
    return found.withColumn("doc_id", F.regexp_extract("path", r"\.(-?\d+)$", 1).try_cast("bigint"))


def warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived records as they are in the written files, blocks as digests."""
    path = scratch_dir(spark, "warc-derivatives")
    pages = _read(spark, sf_dir, "pages", "page_id", "url", "html")
    warc_derive.write_warc(warc_derive.derive(warc_derive.responses_of_pages(pages)), path)
    records = warc_derive.read_derivatives(spark, path)
    return records.withColumn("page_id", F.col("key").try_cast("bigint")).withColumn("block_sha256", F.sha2(F.col("block"), 256)).drop("key", "block")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_gbdt.train(documents, _read(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = quality_gbdt.score_documents(documents, model)
    predicted = (F.col("score") >= quality_gbdt.THRESHOLD).cast("int")
    return scored.select("doc_id", (quality_gbdt.fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", predicted.alias("predicted"))


def orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-ids")
    orc_ids.write_ids(_read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(TOKENIZER), path)
    return orc_ids.file_report(spark, path)


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jump_shards.shard_rows(_read(spark, sf_dir, "documents", "doc_id", "text"), 24)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))


def token_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.round_trip_digests(documents, public_tokenizers.path(TOKENIZER)).drop("text")


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents", "doc_id", "text")
    return suffix_runs.run_report(suffix_runs.word_runs(documents, key="doc_id", prepare=suffix_runs.periodic_tail)).drop("text")


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_language.language_report(_read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def token_alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents", "doc_id", "text")
    return token_alignment.alignment_report(documents, public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


def _licence_sql() -> str:
    """The licence scan in DuckDB: the same vectors over all files, joined row by row."""
    stop = ", ".join(f"'{w}'" for w in licence_scan.STOP_WORDS)
    notices = ", ".join(f"({k}, '{n}', '{t}')" for k, (n, t) in enumerate(licence_scan.TEMPLATES))
    named = r"regexp_matches(string_split(path, '/')[-1], '(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$')"
    words = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w NOT IN ('', {stop}))"
    head = "string_split(text, chr(10) || chr(10))[1]"
    return f"""
WITH files AS (
    SELECT doc_id, text, source || '/' || lang || '/' || (doc_id // 16) || '/' || CASE WHEN doc_id % 16 = 0 THEN 'LICENSE.' ELSE 'document.' END || doc_id AS path
    FROM documents),
  notices AS (SELECT * FROM (VALUES {notices}) t(template, licence, notice)),
  weights AS (SELECT template, licence, word, count(*) AS n FROM (SELECT template, licence, unnest({words('notice')}) AS word FROM notices) GROUP BY ALL),
  units AS (
    SELECT path, unnest(list_distinct(list_concat(string_split(text, chr(10)),
        CASE WHEN contains({head}, chr(10)) THEN [replace({head}, chr(10), ' ')] ELSE [] END,
        CASE WHEN {named} THEN [replace(text, chr(10), ' ')] ELSE [] END))) AS line
    FROM files WHERE text IS NOT NULL),
  vocabulary AS (SELECT list(DISTINCT word) AS known FROM weights),
  split AS (SELECT path, line, {words('line')} AS words FROM units),
  counted AS (SELECT s.*, known FROM split s, vocabulary WHERE list_has_any(words, known)),
  holding AS (SELECT word, count(DISTINCT path) AS n FROM (SELECT path, unnest(list_distinct(words)) AS word FROM counted) GROUP BY word),
  total AS (SELECT count(DISTINCT path)::DOUBLE AS files FROM files),
  idf AS (SELECT w.word, ln((1 + files) / (1 + coalesce(h.n, 0))) + 1 AS idf FROM (SELECT DISTINCT word FROM weights) w LEFT JOIN holding h USING (word), total),
  norms AS (SELECT template, sqrt(sum((n * idf) ** 2)) AS norm FROM weights JOIN idf USING (word) GROUP BY template),
  sided AS (SELECT template, licence, word, n * idf / norm AS weight FROM weights JOIN idf USING (word) JOIN norms USING (template)),
  own AS (SELECT path, line, len(list_filter(words, lambda w: NOT list_contains(known, w))) AS others, unnest(list_filter(words, lambda w: list_contains(known, w))) AS word FROM counted),
  valued AS (SELECT path, line, others, word, count(*) * any_value(idf) AS value FROM own JOIN idf USING (word) GROUP BY ALL),
  lengths AS (SELECT path, line, sqrt(sum(value ** 2) + any_value(others) * (ln(1 + any_value(files)) + 1) ** 2) AS norm FROM valued, total GROUP BY path, line),
  dots AS (SELECT path, line, licence, template, sum(value * weight) AS dot FROM valued JOIN sided USING (word) GROUP BY ALL),
  scored AS (SELECT path, licence, round(dot / norm, 6) AS score FROM dots JOIN lengths USING (path, line)),
  found AS (
    SELECT path, licence, score FROM (
        SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, licence DESC) AS place FROM scored WHERE score >= {licence_scan.LEAST_COSINE})
    WHERE place = 1),
  givers AS (
    SELECT * FROM (
        SELECT path AS from_path, licence AS given, score AS given_score, regexp_replace(path, '(^|/)[^/]*$', '') AS above,
               row_number() OVER (PARTITION BY above ORDER BY score DESC, path, licence) AS place
        FROM found WHERE {named}) WHERE place = 1),
  nearest AS (
    SELECT path, arg_max(g, length(g.above)) AS g
    FROM files JOIN givers g ON starts_with(files.path, g.above || '/') OR g.above = '' GROUP BY path)
SELECT doc_id, f.path, coalesce(licence, g.given) AS licence, coalesce(score, g.given_score) AS score,
       CASE WHEN licence IS NOT NULL THEN 'own' WHEN g.given IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       CASE WHEN licence IS NOT NULL THEN f.path ELSE g.from_path END AS from_path
FROM files f LEFT JOIN found USING (path) LEFT JOIN nearest USING (path)"""


QUERIES = {
    "op1_main_text": main_text,
    "op2_decontaminate": decontamination,
    "op3_embedding_links": embedding_links,
    "op4_licences": licences,
    "op5_warc_derivatives": warc_derivatives,
    "op6_quality": quality,
    "op7_orc_token_ids": orc_token_ids,
    "op8_jump_shards": shards,
    "op9_near_duplicates": near_duplicates,
    "op10_bpe_round_trip": token_round_trip,
    "op11_periodic_runs": periodic_runs,
    "op12_language": language,
    "op13_token_alignment": token_alignment_report,
}

SQL: dict[str, str] = {"op4_licences": _licence_sql()}
