"""The top-k join against brute force on data chosen to be awkward."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfkin.operators import bounds, matches, tiles
from shelfkin.plans.recommend import recommend, recommend_all, recommend_requests

SCHEMA = "id long, text array<double>, image array<double>"


def frame(spark, text, image=None, ids=None, parts=3):
    ids = range(len(text)) if ids is None else ids
    image = [None] * len(text) if image is None else image
    rows = [
        (int(i), [float(x) for x in t], None if v is None else [float(x) for x in v]) for i, t, v in zip(ids, text, image)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def brute(text, image, k, wt, wi):
    text = np.asarray(text, dtype=float)
    score = wt * unit(text) @ unit(text).T
    if image is not None:
        width = len(next(v for v in image if v is not None))
        pics = np.array([np.zeros(width) if v is None else v for v in image], dtype=float)
        norms = np.linalg.norm(pics, axis=1)
        score = score + wi * (pics @ pics.T) / (np.outer(norms, norms) + 1e-8)
    score = np.round(score, 6) + 0.0
    out = set()
    for q in range(len(text)):
        order = [j for j in np.lexsort((np.arange(len(text)), -score[q])) if j != q][:k]
        out |= {(q, r + 1, int(j), score[q, j]) for r, j in enumerate(order)}
    return out


def rows(df):
    return {(r[0], r[1], r[2], r[3]) for r in df.collect()}


@pytest.mark.parametrize("tile", [7, 64, 4096])
def test_clusters_copies_and_gaps(spark, tile):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 5)) * 4
    text = np.vstack([centres[i % 6] + rng.normal(size=5) * 0.05 for i in range(150)])
    text[40:90] = text[0]  # a third of all rows are copies of one vector
    text[149] = 0.0
    image = [None if i % 7 == 0 else rng.normal(size=4) for i in range(150)]
    for i in range(40, 90):
        image[i] = image[1]
    image[100] = np.zeros(4)
    got = rows(recommend_all(frame(spark, text, image), 4, text_weight=0.6, image_weight=0.4, tile=tile))
    assert got == brute(text, image, 4, 0.6, 0.4)


def test_all_vectors_alike(spark):
    text = np.ones((60, 3))
    assert rows(recommend_all(frame(spark, text), 5, text_weight=1.0, use_image=False, tile=8)) == brute(text, None, 5, 1.0, 0)


def test_fewer_items_than_asked_for(spark):
    text = [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]]
    got = rows(recommend_all(frame(spark, text), 10, use_image=False, text_weight=1.0))
    assert got == brute(text, None, 10, 1.0, 0)
    assert len(got) == 6


def test_very_long_answers(spark):
    text = np.ones((1500, 2))
    text[::3] = [1.0, 0.0]
    some = spark.createDataFrame([(0,), (1,)], "id long")
    got = rows(recommend_all(frame(spark, text), 1200, some, use_image=False, text_weight=1.0))
    assert got == {r for r in brute(text, None, 1200, 1.0, 0) if r[0] < 2}


def test_ties_at_the_cut_go_to_the_lowest_id(spark):
    rng = np.random.default_rng(1)
    text = rng.integers(-1, 2, size=(80, 2)).astype(float)
    assert rows(recommend_all(frame(spark, text), 3, use_image=False, text_weight=1.0, tile=9)) == brute(text, None, 3, 1.0, 0)


def test_far_cells_are_skipped_without_losing_answers(spark):
    rng = np.random.default_rng(2)
    centres = unit(rng.normal(size=(20, 16)))
    text = np.repeat(centres, 30, axis=0) + rng.normal(size=(600, 16)) * 0.01
    assert rows(recommend_all(frame(spark, text), 5, use_image=False, text_weight=1.0, tile=10)) == brute(text, None, 5, 1.0, 0)
    shape = tiles.Shape(16, 0)
    pivots = text[::10]
    cell, gap = tiles.nearest_pivot(text, pivots, shape)
    size = np.bincount(cell, minlength=len(pivots))
    radius = np.array([gap[cell == c].max() if size[c] else 0.0 for c in range(len(pivots))])
    cells = tiles.Cells(pivots, radius, np.full(len(pivots), np.inf), size)
    visits, floor = tiles.cells_to_visit(text, np.ones((600, 2)) * [1.0, 0.0], cells, shape, 6)
    assert visits.mean() < 0.1
    exact = tiles.scores(text, np.ones((600, 2)) * [1.0, 0.0], text, shape)
    assert (tiles.rounded(tiles.kth_best(exact, 6)) >= floor).all()


def test_tiny_image_norms_keep_their_epsilon(spark):
    rng = np.random.default_rng(3)
    text = rng.normal(size=(50, 3))
    image = list(rng.normal(size=(50, 3)) * 10.0 ** rng.integers(-6, 1, size=(50, 1)))
    got = rows(recommend_all(frame(spark, text, image), 4, text_weight=0.3, image_weight=0.7, tile=6))
    assert got == brute(text, image, 4, 0.3, 0.7)


def test_one_query_equals_the_join(spark):
    rng = np.random.default_rng(4)
    vectors = frame(spark, rng.normal(size=(40, 3)), [None if i % 5 == 0 else v for i, v in enumerate(rng.normal(size=(40, 2)))])
    products = spark.range(40).select(
        "id", *[F.lit("x").alias(c) for c in ("name", "category", "description", "image_path")]
    )
    every = rows(recommend_all(vectors, 5, text_weight=0.7, image_weight=0.3))
    for q in (0, 7, 39):
        single = recommend(products, vectors, q, 5, text_weight=0.7, image_weight=0.3).select("query_id", "rank", "id", "score")
        assert rows(single) == {r for r in every if r[0] == q}


def test_requests_with_a_hot_product(spark):
    rng = np.random.default_rng(6)
    text, image = rng.normal(size=(30, 3)), list(rng.normal(size=(30, 3)))
    asked = [(i, 3 if i % 3 == 0 else i % 30, i % 4 != 1, i % 4 != 2, 70) for i in range(120)]
    requests = spark.createDataFrame(asked, "request_id long, product_id long, use_text boolean, use_image boolean, percent int")
    got = rows(recommend_requests(frame(spark, text, image), requests, 2, tile=5))
    weights = {(True, True): (0.7, 0.3), (True, False): (1.0, 0.0), (False, True): (0.0, 1.0), (False, False): (1.0, 0.0)}
    expected = set()
    for request, product, use_text, use_image, _ in asked:
        best = brute(text, image, 2, *weights[use_text, use_image])
        expected |= {(request, r, i, s) for q, r, i, s in best if q == product}
    assert got == expected


@pytest.mark.parametrize("plain", [0.0, 2.0])
def test_requests_with_other_weights_share_a_copy_of_their_vector(spark, monkeypatch, plain):
    rng = np.random.default_rng(17)
    centres = rng.normal(size=(5, 4)) * 3
    text = centres[np.arange(60) % 5] + rng.normal(size=(60, 4)) * 0.05
    text[40:45] = text[0]  # copies ask by one vector
    image = [None if k % 7 == 0 else rng.normal(size=3) for k in range(60)]
    for k in range(40, 45):
        image[k] = image[0]
    # The sixtieth product does not exist; product 3 is asked for with more weights than travel together.
    asked = [(p, percent) for p in range(61) for percent in (0, 30, 50, 70, 100)] + [(3, percent / 8) for percent in range(1, 200)]
    asked = [(n, p, True, None, float(percent)) for n, (p, percent) in enumerate(asked)]
    requests = spark.createDataFrame(asked, "request_id long, product_id long, use_text boolean, use_image boolean, percent double")
    stored, real = {}, matches.materialize
    monkeypatch.setattr(matches, "PLAIN_SHARE", plain)
    monkeypatch.setattr(matches, "materialize", lambda df, purpose: stored.setdefault(purpose, real(df, purpose)))
    got = rows(recommend_requests(frame(spark, text, image), requests, 2, tile=16))
    best = {percent: brute(text, image, 2, percent / 100, (100 - percent) / 100) for percent in {a[4] for a in asked}}
    assert got == {(n, r, i, s) for n, p, _, _, percent in asked for q, r, i, s in best[percent] if q == p}
    asking = stored["routed-queries"]
    assert 55 <= asking.count() <= 60 and asking.agg(F.max(F.size("asks"))).first()[0] < 2 * matches.MOST_ASKS


def test_query_ids_and_unknown_ids(spark):
    text = np.random.default_rng(7).normal(size=(20, 3))
    some = spark.createDataFrame([(4,), (4,), (999,)], "id long")
    got = rows(recommend_all(frame(spark, text), 2, some, use_image=False, text_weight=1.0))
    assert got == {r for r in brute(text, None, 2, 1.0, 0) if r[0] == 4}


def test_no_items(spark):
    assert recommend_all(spark.createDataFrame([], SCHEMA), 3).collect() == []


def test_unequal_lengths_are_refused(spark):
    with pytest.raises(ValueError, match="differ in length"):
        recommend_all(frame(spark, [[1.0, 2.0], [1.0]]), 1)


def test_k_below_one_is_refused(spark):
    with pytest.raises(ValueError):
        recommend_all(frame(spark, [[1.0]]), 0)


def test_best_per_row_prefers_low_ids():
    score = np.array([[0.5, 0.5, 0.1, 0.5]])
    for floor in (-np.inf, 0.5, 0.3):
        _, cols, value = tiles.best_per_row(score, np.array([9, 3, 1, 4]), 2, np.array([floor]))
        assert list(cols) == [1, 3] and list(value) == [0.5, 0.5]


def test_digest_separates_shifted_nulls(spark):
    df = spark.createDataFrame([([1.0], None), (None, [1.0])], "text array<double>, image array<double>")
    keys = df.select(matches.digest(1, F.col("text"), F.col("image")).alias("k")).collect()
    assert keys[0]["k"] != keys[1]["k"]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "dot_product"])
def test_other_metrics_equal_one_query(spark, metric):
    rng = np.random.default_rng(8)
    image = [None if i % 6 == 0 else v for i, v in enumerate(rng.normal(size=(40, 2)))]
    image[7] = np.zeros(2)
    vectors = frame(spark, rng.integers(-2, 3, size=(40, 3)), image)
    every = rows(recommend_all(vectors, 4, text_weight=0.6, image_weight=0.4, tile=11, metric=metric))
    products = vectors.select("id", *[F.lit("x").alias(c) for c in ("name", "category", "description", "image_path")])
    for q in (0, 7, 13):
        single = recommend(products, vectors, q, 4, text_weight=0.6, image_weight=0.4, metric=metric)
        assert rows(single.select("query_id", "rank", "id", "score")) == {r for r in every if r[0] == q}
    assert len(every) == 160


def brute_metric(metric, text, image, k, wt, wi):
    """Distances or products pair by pair; without a picture an item is infinitely far from a query with one."""
    out = set()
    for q in range(len(text)):
        scored = []
        for j in range(len(text)):
            if j == q:
                continue
            total = 0.0
            for a, b, w in ((text[q], text[j], wt), (image[q], image[j], wi)):
                if a is None or w == 0:
                    continue
                if metric == "dot_product":
                    total += 0.0 if b is None else w * sum(x * y for x, y in zip(a, b, strict=True))
                elif b is None:
                    total = float("-inf")
                else:
                    gaps = [abs(x - y) for x, y in zip(a, b, strict=True)]
                    total -= w * (sum(gaps) if metric == "manhattan" else sum(g * g for g in gaps) ** 0.5)
            scored.append((round(total, 6) + 0.0, j))
        for r, (score, j) in enumerate(sorted(scored, key=lambda s: (-s[0], s[1]))[:k]):
            out.add((q, r + 1, j, score + 0.0 if metric == "dot_product" else 0.0 - score))
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "dot_product"])
@pytest.mark.parametrize("tile", [6, 4096])
def test_other_metrics_equal_brute_force(spark, metric, tile):
    rng = np.random.default_rng(9)
    # Small whole numbers: exact sums, many ties and copies.
    text = rng.integers(-3, 4, size=(70, 2)).astype(float)
    text[20:45] = text[3]
    image = [None if i % 5 == 0 else rng.integers(-2, 3, size=2).astype(float) for i in range(70)]
    got = rows(recommend_all(frame(spark, text, image), 3, text_weight=0.5, image_weight=0.25, tile=tile, metric=metric))
    assert got == brute_metric(metric, text, image, 3, 0.5, 0.25)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "dot_product"])
def test_other_metrics_visit_few_cells_of_clusters(spark, metric, caplog):
    rng = np.random.default_rng(10)
    centres = rng.normal(size=(25, 8)) * 10
    text = np.round(np.repeat(centres, 24, axis=0) + rng.normal(size=(600, 8)) * 0.05, 3)
    with caplog.at_level("INFO", logger="shelfkin.operators.matches"):
        got = rows(recommend_all(frame(spark, text), 3, use_image=False, text_weight=1.0, tile=12, metric=metric))
    same = lambda found: {(q, r, i) for q, r, i, _ in found}
    assert same(got) == same(brute_metric(metric, text, [None] * 600, 3, 1.0, 0.0))
    share = float(caplog.records[-1].getMessage().split("(")[-1].rstrip(")"))
    assert share < 0.25


def test_many_equal_scores_and_copies(spark):
    # Different vectors that score alike, each with copies: the lowest ids win across them.
    text = np.array([[1.0, k] for k in (1, 2, 3, 4)] * 25)
    image = [np.array([2.0])] * 100
    got = rows(recommend_all(frame(spark, text, image), 20, use_text=False, image_weight=1.0, tile=2))
    assert got == brute(np.zeros((100, 1)), image, 20, 0.0, 1.0)


def test_bounds_hold_for_every_member():
    rng = np.random.default_rng(11)
    for turn in range(240):
        metric = ("euclidean", "manhattan", "dot_product")[turn % 3]
        shape = tiles.Shape(int(rng.integers(0, 4)), int(rng.integers(1, 4)))
        items = rng.normal(size=(int(rng.integers(4, 40)), shape.width)) * rng.choice([0.01, 1, 100])
        for k, part in bounds.parts_of(shape):
            items[rng.random(len(items)) < rng.choice([0.0, 0.3, 1.0]) * k, part] = np.nan
        queries, weights = rng.permutation(items)[:4] * 1.5, rng.choice([0.0, 0.3, 1.0, -0.5], size=(4, 2))
        pivots = items[: int(rng.integers(1, 4))]
        cell, gap, length, absent = bounds.members(metric, items, pivots, shape)
        size = np.bincount(cell, minlength=len(pivots))
        most = lambda x: np.array([x[cell == c].max(0) if size[c] else np.zeros(2) for c in range(len(pivots))])  # noqa: B023, E731
        lacking = np.array([absent[cell == c].sum(0) for c in range(len(pivots))])
        cells = bounds.MetricCells(pivots, most(gap), most(length), lacking, size)
        low, high = bounds.score_bounds(metric, queries, weights, cells, shape)
        score = tiles.other_scores(metric, queries, weights, items, shape)
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(score), score, 0.0)))
        assert (score <= high[:, cell] + slack).all() and (score >= low[:, cell] - slack).all()
        keep = int(rng.integers(1, 4))
        mask, floor = bounds.cells_in_reach(metric, queries, weights, cells, shape, keep)
        best = tiles.kth_best(score, keep)
        assert (best >= floor - 2e-6).all()
        needed = score > best[:, None] + 1e-6
        assert mask[np.nonzero(needed)[0], cell[np.nonzero(needed)[1]]].all()


@pytest.mark.parametrize("roots", [1, 5])
def test_two_levels_of_cells_equal_brute_force(spark, caplog, roots):
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(25, 6)) * 3
    text = np.round(centres[np.arange(420) % 25] + rng.normal(size=(420, 6)) * 0.03, 3)
    text[100:240] = text[1]  # a third of all rows are copies
    text[419] = 0.0
    image = [None if k % 7 == 0 else np.round(centres[k % 25][:3] + rng.normal(size=3) * 0.02, 3) for k in range(420)]
    for k in range(100, 240):
        image[k] = image[1]
    with caplog.at_level("INFO", logger="shelfkin.operators.matches"):
        got = rows(recommend_all(frame(spark, text, image), 4, text_weight=0.7, image_weight=0.3, tile=9, max_pivots=roots))
    assert got == brute(text, image, 4, 0.7, 0.3)
    assert caplog.records[-1].getMessage().startswith(f"tree of {roots} roots")


def test_leaves_keep_their_size_when_the_table_grows(spark, caplog):
    rng = np.random.default_rng(15)
    centres = unit(rng.normal(size=(40, 8)))
    seen = []
    for many in (400, 4000):
        text = np.repeat(centres, many // 40, axis=0) + rng.normal(size=(many, 8)) * 0.01
        some = spark.range(0, many, many // 40)
        with caplog.at_level("INFO", logger="shelfkin.operators.matches"):
            recommend_all(frame(spark, text), 3, some, use_image=False, text_weight=1.0, tile=16, max_pivots=8).collect()
        message = caplog.records[-1].getMessage()
        seen.append((float(message.split("leaves of ")[1].split(" ")[0]), float(message.split("(")[-1].rstrip(")"))))
    # Sixteen items a leaf are wanted; the share that is compared falls.
    assert all(8 < size < 20 for size, _ in seen) and seen[1][1] < seen[0][1] / 2


def test_pairs_of_a_table_with_itself_are_compared_once(spark, monkeypatch):
    rng = np.random.default_rng(19)
    text, image = rng.normal(size=(300, 6)), list(rng.normal(size=(300, 5)))
    image[::9] = [None] * len(image[::9])
    met = []
    monkeypatch.setattr(matches, "compare_tiles", lambda *a: pytest.fail("compared from both sides"))
    mutually = matches.compare_mutually
    monkeypatch.setattr(matches, "compare_mutually", lambda *a: met.append(a) or mutually(*a))
    got = rows(recommend_all(frame(spark, text, image), 3, text_weight=0.7, image_weight=0.3, tile=64))
    assert got == brute(text, image, 3, 0.7, 0.3)
    assert met


def test_what_a_row_finds_in_its_own_tile_it_is_sure_of_in_the_others(spark):
    rng = np.random.default_rng(21)
    text = rng.normal(size=(300, 6))
    text[:40] = text[0] * np.linspace(1, 2, 40)[:, None]  # equal scores
    text[50] = 0.0
    text[51] *= 1e8  # scored without a screen
    one = [F.lit(x).alias(n) for n, x in (("text_weight", 1.0), ("image_weight", 0.0), ("floor", float("-inf")))]
    routed = frame(spark, text).select(
        F.xxhash64("id").alias("q1"), F.col("id").alias("q2"), F.array("id").alias("ids"), F.col("text").alias("vec"), *one
    )
    found = matches.compare_mutually(routed, 300, tiles.Shape(6, 0), 4, 60)
    got = {r["q2"]: [(e["id"], e["below"]) for e in r["best"]] for r in matches.merge_tiles(found, 4).collect()}
    score = np.round(unit(text) @ unit(text).T, 6) + 0.0
    want = {q: [(int(j), 0.0 - score[q, j]) for j in np.lexsort((np.arange(300), -score[q]))[:4]] for q in range(300)}
    assert got == want
    assert found.count() < 0.8 * 300 * 4 * 5  # without it each row takes its 4 best out of all 5 tiles


def test_cells_that_leave_fewer_pairs_are_used(spark, monkeypatch):
    rng = np.random.default_rng(20)
    centres = rng.normal(size=(12, 6)) * 5
    text = np.vstack([centres[i % 12] + rng.normal(size=6) * 0.01 for i in range(600)])
    monkeypatch.setattr(matches, "compare_mutually", lambda *a: pytest.fail("cells were passed over"))
    got = rows(recommend_all(frame(spark, text), 3, use_image=False, text_weight=1.0, tile=16))
    assert got == brute(text, None, 3, 1.0, 0)
