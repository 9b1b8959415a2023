import pytest
from pyspark.sql import functions as F

from shelfkin.operators import answers as A
from shelfkin.operators import runs as X
from shelfkin.plans import answer as P
from shelfkin.schema import PRODUCT_SCHEMA

RECS = "query_id long, rank int, id long, name string, category string, description string, image_path string, score double"


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame([(1, "c", "asked", "p\nq", "x.jpg"), (2, "c", "two", "a\nb", "y.jpg"), (3, "d", "three", "z", "z.jpg")], PRODUCT_SCHEMA)


@pytest.fixture(scope="module")
def recs(spark):
    rows = [(1, 2, 3, "three", "d", "z", None, 0.1), (1, 1, 2, "two", "c", "a\nb", "y.jpg", 0.9), (2, 1, 9, None, None, None, None, 0.5)]
    return spark.createDataFrame(rows, RECS)


def test_blocks_in_rank_order_with_defaults(recs):
    blocks = {r["query_id"]: r["recommended_products"] for r in A.product_blocks(recs).collect()}
    assert blocks[1] == "* two, a c: a, b\n* three, a d: z\n"
    assert blocks[2] == "* Unknown Product, a Unknown: \n"


def test_prompt(recs, products):
    text = {r["query_id"]: r["prompt"] for r in A.prompts(recs, products, "S", "[original_product_name]/[original_product_description]/[recommended_products]").collect()}
    assert text[1] == "S\n\nasked/p, q/* two, a c: a, b\n* three, a d: z\n"


def test_images(recs):
    row = A.image_lists(recs).filter("query_id = 1").first()
    assert [tuple(i) for i in row["images"]] == [("two", "y.jpg", "c"), ("three", "", "d")]
    assert row["product_count"] == 2


def test_responses(spark, recs, products):
    asked = spark.createDataFrame([(1,), (77,)], "query_id long")
    got = {r["query_id"]: r for r in A.responses(asked, products, P.answer(recs, products)).collect()}
    assert got[1]["success"] and got[1]["product_count"] == 2
    assert got[1]["recommendations_text"] == "Similar products:\n🔸 two: a, b\n🔸 three: z"
    assert not got[77]["success"] and got[77]["images"] == [] and got[77]["product_count"] == 0
    assert got[77]["recommendations_text"] == A.NOTHING_FOUND


def split(spark, text, images):
    df = spark.createDataFrame([(1, text, images)], "query_id long, recommendations_text string, images array<struct<product_name:string,image_path:string,category:string>>")
    return [tuple(r)[1:] for r in A.paragraphs(df).collect()]


def test_paragraphs_pair_with_images(spark):
    images = [("a", "a.jpg", "c"), ("b", "b.jpg", "c"), ("d", "d.jpg", "c")]
    got = split(spark, " intro \n🔸 one \n🔸  \n🔸three🔸four", images)
    assert got == [(0, "intro", None, None), (1, "🔸one", "a", "a.jpg"), (3, "🔸three", "d", "d.jpg"), (4, "🔸four", None, None)]
    assert split(spark, "🔸one", images)[0] == (1, "🔸one", "a", "a.jpg")


def test_text_without_marks_is_shown_whole(spark):
    assert split(spark, "plain ", [("a", "a.jpg", "c")]) == [(0, "plain ", None, None), (1, None, "a", "a.jpg")]


def test_failed_prompts_do_not_spoil_their_batch(spark, recs, products):
    def make():
        def generate(prompts):
            if any("two" in p for p in prompts):
                raise ValueError("bad")
            return ["fine"] * len(prompts)

        return generate

    recs = recs.filter("query_id = 1").unionByName(recs.filter("query_id = 2").withColumn("query_id", F.lit(3).cast("long")))
    got = {r["query_id"]: r for r in P.answer(recs.coalesce(1), products, make).collect()}
    assert (got[1]["text"], got[1]["product_count"], got[1]["images"], got[1]["error"]) == (A.GENERATION_FAILED, 0, [], "bad")
    assert (got[3]["text"], got[3]["product_count"], got[3]["error"]) == ("fine", 1, None)
    runs = {r["run_id"]: r for r in P.record_runs(P.answer(recs, products, make)).collect()}
    assert runs["1"]["success"] == 0.0 and runs["1"]["error"] == "bad" and runs["1"]["response_length_chars"] is None
    assert runs["3"]["success"] == 1.0 and runs["3"]["response_length_chars"] == 4 and runs["3"]["chat_history_length"] == 0


METRICS = "run_id string, experiment_id string, key string, value double, step int, ts timestamp"


@pytest.fixture(scope="module")
def metrics(spark):
    rows = [("a", "e", "loss", 5.0, 0), ("a", "e", "loss", 1.0, 1), ("b", "e", "loss", 3.0, 0), ("c", "e", "loss", 3.0, 0), ("d", "f", "loss", 9.0, 0), ("b", "e", "f1", 0.5, 0)]
    return spark.createDataFrame(rows, "run_id string, experiment_id string, key string, value double, step int").withColumn("ts", F.current_timestamp())


def test_search_pivots_latest_values(metrics):
    got = {r["run_id"]: (r["loss"], r["f1"]) for r in X.search_runs(metrics, "e", ["loss", "f1"]).collect()}
    assert got == {"a": (1.0, None), "b": (3.0, 0.5), "c": (3.0, None)}


def test_best_run(metrics):
    assert tuple(X.best_run(metrics, "e", "loss").first()) == ("b", 3.0)
    assert tuple(X.best_run(metrics, "e", "loss", ascending=True).first()) == ("a", 1.0)
    assert X.best_run(metrics, "e", "nothing").collect() == []
    assert X.best_run(metrics, "no such experiment", "loss").collect() == []


def test_experiments_are_made_once(spark):
    existing = spark.createDataFrame([("7", "old")], "experiment_id string, name string")
    names = spark.createDataFrame([("old",), ("new",), ("new",)], "name string")
    first = X.ensure_experiments(existing, names)
    assert sorted(r["name"] for r in first.collect()) == ["new", "old"]
    assert sorted(X.ensure_experiments(first, names).collect()) == sorted(first.collect())


def test_states_take_the_latest_attempt(spark):
    df = spark.createDataFrame([("a", 1, "boom"), ("a", 2, None), ("b", 1, None), ("b", 2, "boom")], "run_id string, t int, error string")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    assert {r["run_id"]: r["status"] for r in X.run_states(df).collect()} == {"a": "FINISHED", "b": "FAILED"}


def test_params_and_metrics_become_rows(spark, tmp_path):
    wide = spark.createDataFrame([("r", "e", 0, 3, "x", 1.5, None)], "run_id string, experiment_id string, step int, n int, s string, m double, k double").withColumn("ts", F.current_timestamp())
    params = {(r["key"], r["value"]) for r in X.param_rows(wide, ["n", "s"]).collect()}
    assert params == {("n", "3"), ("s", "x")}
    rows = X.metric_rows(wide, ["m", "k"])
    assert [(r["key"], r["value"]) for r in rows.collect()] == [("m", 1.5)]
    X.append_rows(rows, str(tmp_path / "m"))
    X.append_rows(rows, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_timed_records_and_reraises(spark, tmp_path):
    path = str(tmp_path / "t")
    assert X.timed(spark, "q", path, lambda: 5) == 5
    with pytest.raises(RuntimeError):
        X.timed(spark, "q", path, lambda: (_ for _ in ()).throw(RuntimeError("x")))
    got = {(r["query_type"], r["outcome"]) for r in spark.read.parquet(path).collect()}
    assert got == {("q", "ok"), ("q_error", "error")}


def test_knowledge_is_appended(spark):
    prompts = spark.createDataFrame([(1, "P"), (2, "Q")], "query_id long, prompt string")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    known = spark.createDataFrame([(1, [0.9, 0.1], "near"), (2, [0.0, 1.0], "far"), (3, [1.0, 0.0], "same")], "id long, vector array<double>, passage string")
    got = {r["query_id"]: r["prompt"] for r in P.knowledge_prompts(prompts, queries, known, 2).collect()}
    assert got == {1: "P\nBackground:\nsame\nnear", 2: "Q"}
