import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfkin.functions import text as X
from shelfkin.operators import embedding, words


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("The Cat's 15.6\" screen!", "cats 156 screen"),
        ("don't stop", "dont stop"),
        ("I cannot\tgo,\n gonna run", "go gon na run"),
        ("a “quoted” word", "“ quoted ” word"),
        ("—cannot— cannot scannot cannots", "—can not— scannot cannots"),
        ("Same same, SAME", ""),
        ("dog  dog", "dog dog"),
        ("", ""),
        (None, None),
        ("the and of", ""),
        ("blank here", "blank"),
    ],
)
def test_cleaning(spark, text, expected):
    assert one(spark, text, X.clean_text) == expected


def test_own_stop_words(spark):
    assert one(spark, "The Cat the dog", lambda c: X.clean_text(c, ["cat"])) == "the the dog"
    assert one(spark, "The Cat", lambda c: X.clean_text(c, [])) == "the cat"


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet=st.sampled_from("abc THE'.,-\n the12"), max_size=60))
def test_cleaning_twice_changes_nothing(spark, text):
    once = one(spark, text, X.clean_text)
    assert one(spark, once, X.clean_text) == once


def test_lemmas_need_a_known_singular(spark):
    docs = spark.createDataFrame([(1, "cat cats bus boxes box wolves wolf glass cities city xyzs"), (2, ""), (3, None)], "id long, t string")
    lemmas = words.plural_lemmas(words.vocabulary(docs, "t", []))
    assert {r["form"]: r["lemma"] for r in lemmas.collect()} == {"cats": "cat", "boxes": "box", "wolves": "wolf", "cities": "city"}
    got = {r["id"]: r["lemma_text"] for r in words.lemmatize(docs, "id", "t", lemmas).collect()}
    assert got == {1: "cat cat bus box box wolf wolf glass city city xyzs", 2: "", 3: None}


def test_lemmas_of_odd_tables(spark):
    """Rows with the same key stay apart, a form listed twice has one lemma, a null lemma none."""
    docs = spark.createDataFrame([(1, "cats dogs"), (1, "birds"), (2, "cats run")], "id long, t string")
    table = spark.createDataFrame([("cats", "kitty"), ("cats", "cat"), ("dogs", None), (None, "x"), ("birds", "bird")], "form string, lemma string")
    got = sorted((r["id"], r["lemma_text"]) for r in words.lemmatize(docs, "id", "t", table).collect())
    assert got == [(1, "bird"), (1, "cat dogs"), (2, "cat run")]
    large = table.unionByName(spark.range(300_000).selectExpr("concat('w', id) as form", "'w' as lemma"))
    assert sorted((r["id"], r["lemma_text"]) for r in words.lemmatize(docs, "id", "t", large).collect()) == got


def test_cleaning_with_lemmas(spark):
    docs = spark.createDataFrame([(1, "The Cats and the cat's boxes; a box!", "x"), (1, None, "y")], "id long, t string, other string")
    got = sorted(map(tuple, words.preprocess_text(docs, "t", lemmas=words.plural_lemmas).collect()), key=repr)
    assert got == [(1, "The Cats and the cat's boxes; a box!", "x", "cat cat box box"), (1, None, "y", None)] or got[0][3] == "cats cats box box"
    vectors = embedding.embed_text(docs.fillna("boxes", "t"), "id", "t", 64, lemmas=words.plural_lemmas)
    assert vectors.count() == 2


def test_lemma_table_of_the_caller(spark):
    docs = spark.createDataFrame([(1, "mice ran mice")], "id long, t string")
    table = spark.createDataFrame([("mice", "mouse")], "form string, lemma string")
    assert words.lemmatize(docs, "id", "t", table).first()["lemma_text"] == "mouse ran mouse"


def test_text_vectors_are_unit_and_follow_content(spark):
    docs = spark.createDataFrame([(1, "red round ball"), (2, "Red, round ball!"), (3, "blue square box"), (4, None)], "id long, t string")
    vectors = {r["id"]: r["vector"] for r in embedding.embed_text(docs, "id", "t", 64).collect()}
    assert vectors[1] == vectors[2] != vectors[3]
    assert abs(sum(x * x for x in vectors[1]) - 1) < 1e-9
    assert sum(x * x for x in vectors[4]) == 0
    assert all(len(v) == 64 for v in vectors.values())


def test_own_text_encoder_is_made_once_per_task(spark):
    def make():
        import numpy as np

        return lambda texts: np.array([[float(len(t))] for t in texts])

    docs = spark.createDataFrame([(1, "The cats!")], "id long, t string")
    assert embedding.embed_text(docs, "id", "t", make_encoder=make).first()["vector"] == [4.0]


def test_template_keeps_unknown_slots(spark):
    df = spark.createDataFrame([("v",)], "a string")
    assert df.select(X.filled(F.lit("[a] [b] [a]"), {"a": F.col("a"), "c": F.col("a")})).first()[0] == "v [b] v"


def test_preview_is_fifty_characters(spark):
    assert one(spark, "x" * 80, X.preview) == "x" * 50 + "..."


@pytest.mark.parametrize("most, chars", [(100_000, 4_000_000), (2, 40), (1, 30)])
def test_frequent_forms_by_map_and_others_by_join(spark, monkeypatch, most, chars):
    """One form in half of all rows; the map takes the most frequent, the rest is joined; same rows."""
    monkeypatch.setattr(words.lemma_map, "__defaults__", (most, chars))
    texts = ["cats and cats", "dogs", "cats dogs mice", "", None, "nothing", "mice " * 3, "averyverylongformindeed cats"] + ["cats sleep"] * 12
    table = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("mice", "mouse"), ("averyverylongformindeed", "long"), ("unused", "x")], "form string, lemma string")
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    got = {r["id"]: r["lemma_text"] for r in words.lemmatize(rows, "id", "t", table).collect()}
    of = {"cats": "cat", "dogs": "dog", "mice": "mouse", "averyverylongformindeed": "long"}
    assert got == {k: None if t is None else " ".join(of.get(w, w) for w in t.split(" ")) for k, t in enumerate(texts)}
