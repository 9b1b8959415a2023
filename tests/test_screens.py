"""The screen of a tile: the same best pairs as scoring every pair, at few exact scores."""

import numpy as np
import pyarrow as pa
import pytest

from shelfkin.operators import neighbours, screens, tiles
from shelfkin.plans.answer import answer, record_runs
from shelfkin.plans.recommend import recommend_all, with_details

METRICS = ["cosine", "dot_product", "euclidean", "manhattan"]


def unit(rng, n, width=32):
    rows = rng.normal(size=(n, width))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def in_full(queries, weights, floor, items, ids, shape, keep, metric):
    if metric == "cosine":
        score = tiles.scores(queries, weights, items, shape)
    else:
        score = tiles.other_scores(metric, queries, weights, items, shape)
    value = tiles.rounded(score)
    order = [[c for c in np.lexsort((ids, -v)) if not np.isnan(v[c])][:keep] for v in value]
    rows, cols = np.repeat(np.arange(len(order)), [len(o) for o in order]), np.concatenate([np.array(o, int) for o in order])
    return rows, cols, value[rows, cols]


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("sizes", [(40, 9000), (600, 700), (3, 2), (1, 5000)])
def test_best_pairs_equal_full_scores(metric, sizes):
    rng = np.random.default_rng(sizes[0])
    shape = tiles.Shape(20, 12)
    queries, items = unit(rng, sizes[0]), unit(rng, sizes[1])
    missing = 0.0 if metric == "cosine" else np.nan
    for rows in (queries, items):
        rows[::7, 20:] = missing
        rows[1::9, :20] = missing
        rows[::50] *= 1e-7
    odd = [np.nan, np.inf, 1e9, 1e-9]
    for at, value in enumerate(odd[: len(items) - 1]):
        items[at + 1, 2 + at] = value
        queries[(at + 1) % len(queries), 30 - at] = value
    items[-1] = items[0]
    weights = rng.choice([0.0, 0.3, 0.7, 1.0, -0.2], size=(len(queries), 2), p=[0.2, 0.3, 0.2, 0.2, 0.1])
    ids = rng.permutation(len(items))
    for floor in (np.full(len(queries), -np.inf), np.full(len(queries), -0.4)):
        with np.errstate(all="ignore"):
            got = screens.best_of_tile(queries, weights, floor, items, ids, shape, 4, metric)
            want = in_full(queries, weights, floor, items, ids, shape, 4, metric)
        sure = want[2] >= floor[want[0]]  # below the floor neither has to be complete
        wanted = set(zip(want[0][sure].tolist(), ids[want[1][sure]].tolist(), want[2][sure].tolist()))
        found = got[2] >= floor[got[0]]
        assert set(zip(got[0][found].tolist(), ids[got[1][found]].tolist(), got[2][found].tolist())) == wanted


@pytest.mark.parametrize("metric", METRICS)
def test_few_pairs_are_scored_exactly(metric, monkeypatch):
    rng = np.random.default_rng(4)
    shape, scored = tiles.Shape(32, 32), []
    exact = screens.Screen.exact
    monkeypatch.setattr(screens.Screen, "exact", lambda self, rows, cols: scored.append(len(rows)) or exact(self, rows, cols))
    queries, items = unit(rng, 64, 64), unit(rng, 20_000, 64)
    found = screens.best_of_tile(queries, np.tile([0.6, 0.4], (64, 1)), np.full(64, -np.inf), items, np.arange(20_000), shape, 6, metric)
    assert len(found[0]) == 64 * 6
    assert 0 < sum(scored) < 0.02 * 64 * 20_000


def test_long_parts_and_lone_numbers():
    """Parts too long for 16-bit steps, and items that are all equal."""
    rng = np.random.default_rng(5)
    shape = tiles.Shape(400, 0)
    for items in (rng.normal(size=(300, 400)), np.ones((300, 400))):
        queries, weights, floor, ids = rng.normal(size=(9, 400)), np.tile([1.0, 0.0], (9, 1)), np.full(9, -np.inf), np.arange(300)
        got = screens.best_of_tile(queries, weights, floor, items, ids, shape, 5, "manhattan")
        for a, b in zip(got, in_full(queries, weights, floor, items, ids, shape, 5, "manhattan")):
            assert np.allclose(a, b)


def test_queries_that_must_look_everywhere_are_not_copied_to_every_root(spark, caplog):
    rng = np.random.default_rng(6)
    vectors = unit(rng, 1200, 8)
    rows = [(i, v.tolist(), None) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "id long, text array<double>, image array<double>")
    with caplog.at_level("INFO", logger="shelfkin.operators.matches"):
        found = recommend_all(frame, 3, use_image=False, text_weight=1.0, tile=8, max_pivots=140).collect()
    assert caplog.records[-1].getMessage().startswith("join of vectors")
    score = np.round(vectors @ vectors.T, 6) + 0.0
    np.fill_diagonal(score, -np.inf)
    want = {(i, r + 1, int(j)) for i in range(1200) for r, j in enumerate(np.lexsort((np.arange(1200), -score[i]))[:3])}
    assert {(r["query_id"], r["rank"], r["id"]) for r in found} == want


def test_pairs_within_a_threshold_leave_in_blocks():
    """However many pairs two tiles give, no batch holds more than one block of them."""
    rng = np.random.default_rng(7)
    vectors = unit(rng, 3000, 4)
    for metric, least in (("cosine", -1.0), ("euclidean", -2.5)):
        ids = np.arange(3000)
        sides = [
            pa.RecordBatch.from_pydict({"first": ids, "vec": vectors.tolist(), "asked": np.full(3000, asked)}) for asked in (True, False)
        ]
        found = list(neighbours.pairs_of_tiles(tiles.Shape(4, 0), (1.0, 0.0), least, metric)(iter(sides)))
        assert sum(b.num_rows for b in found) == 3000 * 2999 // 2
        assert max(b.num_rows for b in found) <= screens.BLOCK[0] * screens.BLOCK[1]


def test_products_are_not_sent_to_the_driver(spark):
    products = spark.createDataFrame([(1, "c", "n", "d", "p")], "id long, category string, name string, description string, image_path string")
    recs = with_details(spark.createDataFrame([(1, 1, 1, 0.5)], "query_id long, rank int, id long, score double"), products)
    made = answer(recs, products, lambda: lambda prompts: [p[:3] for p in prompts])
    runs = record_runs(made, spark.createDataFrame([(1, 2)], "query_id long, history_length long"), products)
    assert "Broadcast" not in runs._jdf.queryExecution().executedPlan().toString()
    assert runs.count() == 1


def test_both_sides_of_a_block_find_what_each_finds_alone():
    rng = np.random.default_rng(17)
    shape = tiles.Shape(6, 5)

    def table(count, odd):
        rows = rng.normal(size=(count, 11))
        rows[::7, 6:] = 0.0
        rows[20:90] = rows[20]  # crowded: more equal hits than are kept
        if odd:
            rows[5] *= 1e7
            rows[9, 3] = np.nan
            rows[11] = 0.0
        return rows, np.tile([0.7, 0.3], (count, 1)), np.full(count, -np.inf), rng.permutation(count)

    for odd in (False, True):
        left, right = table(1203, odd), table(700, odd)
        both = screens.mutual_best(left, right, shape, 4)
        for found, a, b in ((both[0], left, right), (both[1], right, left)):
            alone = screens.best_of_tile(a[0], a[1], a[2], b[0], b[3], shape, 4)
            for got, expected in zip(found, alone):
                np.testing.assert_array_equal(got, expected)


def test_hits_are_found_in_blocks_of_any_size():
    rng = np.random.default_rng(18)
    for size in ((3, 8), (5, 7), (16, 64), (1, 1)):
        hit = rng.random(size) < 0.1
        for got, expected in zip(screens.pairs_within(hit), np.nonzero(hit)):
            np.testing.assert_array_equal(got, expected)
