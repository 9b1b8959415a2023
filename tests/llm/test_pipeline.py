"""Every stage of the pipeline against brute force on its own input."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from shelfkin.llm import quality_gbdt

from .test_pair_operators import brute_near
from .test_text_operators import brute_hits


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]

    good = stages["quality_classifier"](spark, docs, sf)
    model = quality_gbdt.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs.collect()
    scores = model.scores(quality_gbdt.features([(r["text"] or "").encode() for r in rows]))
    expected = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    assert sorted(good.collect()) == sorted(expected) and len(expected) < len(rows)

    docs = spark.createDataFrame(expected, good.schema)
    kept = stages["minhash_near_dedup"](spark, docs, sf)
    near = brute_near([(r["doc_id"], r["text"]) for r in expected])
    expected = [r for r in expected if near[r["doc_id"]][2]]
    assert sorted(kept.collect()) == sorted(expected)

    docs = spark.createDataFrame(expected, kept.schema)
    clean = stages["benchmark_decontamination"](spark, docs, sf)
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = brute_hits([r["text"] for r in expected], items)
    expected = [r for r, (n, hit, _) in zip(expected, hits, strict=True) if not hit or 20 * len(hit) < n]
    assert sorted(clean.collect()) == sorted(expected) and clean.columns == docs.columns

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    done = {r["doc_id"]: tuple(r)[1:] for r in stages["bpe_encoding"](spark, spark.createDataFrame(expected, clean.schema), sf).collect()}
    for r in expected:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert done.pop(r["doc_id"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
    assert not done


def test_run_on_nothing(spark, tmp_path):
    empty = {"documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "labels": "doc_id bigint, quality int", "benchmark": "item_id string, text string"}
    for name, schema in empty.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_all_stages(spark, tmp_path):
    rows = [(1, None, "x", 1), (1, None, "x", 1), (None, "some words", None, None), (None, "some words", None, None), (3, "", "y", 2), (4, "a b c d e f " * 20_000, "z", 0), (5, "A b c d e f " * 20_000, None, 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, score string, component_id int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("i", "qq rr ss")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == [(False, 1), (False, 3), (False, 4), (True, 0), (True, 0)]
