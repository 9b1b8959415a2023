import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfkin.functions import vectors as V
from shelfkin.functions.weights import resolve_weights, switched_weights
from shelfkin.operators import similarity as M

VECTORS = [
    (1, [1.0, 0.0], [1.0, 0.0]),
    (2, [1.0, 0.0], None),
    (3, [0.0, 1.0], [2.0, 0.0]),
    (4, [1.0, 1.0], [0.0, 3.0]),
    (5, [0.0, 0.0], [0.0, 0.0]),
]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(VECTORS, "id long, text array<double>, image array<double>")


def by_id(df, value):
    return {r["id"]: r[value] for r in df.collect()}


def test_known_cosines(vectors):
    assert by_id(M.text_scores(vectors, 1, 1.0), "text_score") == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.707107, 5: 0.0}


def test_missing_image_scores_nothing(vectors):
    assert by_id(M.image_scores(vectors, 1, 0.5), "image_score") == {1: 0.5, 2: 0.0, 3: 0.5, 4: 0.0, 5: 0.0}
    assert set(by_id(M.image_scores(vectors, 2, 1.0), "image_score").values()) == {0.0}


def test_twin_comes_first_and_query_never(vectors):
    rows = M.top_n(M.score_all(vectors, 1, use_image=False, text_weight=1.0), 1, 10).orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in rows] == [(1, 2), (2, 4), (3, 3), (4, 5)]


def test_unknown_query_is_empty(vectors):
    assert M.score_all(vectors, 10**9).collect() == []


def test_no_modality_is_text_alone(vectors):
    off = M.score_all(vectors, 4, use_text=False, use_image=False)
    text = M.score_all(vectors, 4, use_image=False, text_weight=1.0)
    assert sorted(off.collect()) == sorted(text.collect())


@pytest.mark.parametrize("n", [None, 0, -1])
def test_top_n_needs_a_positive_n(vectors, n):
    with pytest.raises(ValueError):
        M.top_n(M.score_all(vectors, 1), 1, n)


def test_other_metrics_rank_near_first(vectors):
    def order(metric):
        scores = M.score_all(vectors, 1, use_image=False, text_weight=1.0, metric=metric)
        return [r["id"] for r in M.top_n(scores, 1, 4, metric).orderBy("rank").collect()]

    assert order("euclidean") == [2, 4, 5, 3]
    assert order("manhattan") == [2, 4, 5, 3]
    assert order("dot_product") == [2, 4, 3, 5]
    with pytest.raises(ValueError):
        order("chebyshev")


def test_switched_off_modality_is_not_read(spark, vectors, tmp_path):
    path = str(tmp_path / "v")
    vectors.write.parquet(path)
    plan = M.score_all(spark.read.parquet(path), 1, use_image=False)._jdf.queryExecution().executedPlan().toString()
    assert "image" not in plan


def test_one_query_makes_no_join_and_no_shuffle(spark, vectors, tmp_path):
    path = str(tmp_path / "v")
    vectors.write.parquet(path)
    plan = M.top_n(M.score_all(spark.read.parquet(path), 1), 1, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan
    assert "TakeOrderedAndProject" in plan


def test_matrix_row_and_entries_agree(spark, vectors):
    pairs = spark.createDataFrame([(4, i) for i in range(1, 6)] + [(4, 4), (4, 77)], "id_a long, id_b long")
    entries = {(r["id_b"], r["score"]) for r in M.similarity_entries(vectors, pairs).collect()}
    row = {(r["id_b"], r["score"]) for r in M.similarity_row(vectors, 4).collect()}
    assert entries == row
    assert len(row) == 5


numbers = st.floats(-100, 100, allow_nan=False).map(lambda x: round(x, 3))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(numbers, numbers, numbers), min_size=2, max_size=6), st.floats(0.01, 50))
def test_cosine_properties(spark, rows, factor):
    pairs = [([*a], [*b], [x * factor for x in a]) for a in rows for b in rows]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>, scaled array<double>")
    for r in df.select(
        V.cosine(F.col("a"), F.col("b")).alias("ab"), V.cosine(F.col("b"), F.col("a")).alias("ba"),
        V.cosine(F.col("scaled"), F.col("b")).alias("sb"),
    ).collect():
        assert math.isclose(r["ab"], r["ba"], abs_tol=1e-12)
        assert -1 - 1e-9 <= r["ab"] <= 1 + 1e-9
        assert math.isclose(r["ab"], r["sb"], abs_tol=1e-9)


@pytest.mark.parametrize(
    "use_text, use_image, expected",
    [(True, True, (0.7, 0.3)), (True, False, (1.0, 0.0)), (False, True, (0.0, 1.0)), (False, False, (1.0, 0.0))],
)
def test_slider_weights(spark, use_text, use_image, expected):
    df = spark.createDataFrame([(use_text, use_image, 70)], "t boolean, i boolean, p int")
    row = df.select(resolve_weights(F.col("t"), F.col("i"), F.col("p")).alias("w")).first()["w"]
    assert (row["text_weight"], row["image_weight"]) == expected


def test_strict_weights():
    assert switched_weights(True, True, 0.25, 0.75, strict=True) == (0.25, 0.75)
    assert switched_weights(True, True, 3, 4) == (3, 4)
    with pytest.raises(ValueError, match="sum"):
        switched_weights(True, True, 0.5, 0.6, strict=True)
    with pytest.raises(ValueError, match="0..1"):
        switched_weights(True, True, -0.5, 1.5, strict=True)
