"""The thresholded similarity table against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from shelfkin.operators import neighbours, tiles

from .test_matches import SCHEMA, frame, unit


def classes_of(text, image):
    seen = {}
    return [seen.setdefault((tuple(t), None if v is None else tuple(v)), k) for k, (t, v) in enumerate(zip(text, image, strict=True))]


def found(spark, text, image, threshold, **more):
    pairs, members = neighbours.similar_classes(frame(spark, text, image), threshold, **more)
    return {tuple(r) for r in pairs.collect()}, dict(map(tuple, members.collect())), (pairs, members)


@pytest.mark.parametrize("tile", [5, 40, None])
def test_cosine_entries_equal_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, 4))
    text = np.round(centres[np.arange(130) % 9] + rng.normal(size=(130, 4)) * 0.1, 3)
    text[30:75] = text[2]  # a third of all rows are copies
    text[129] = 0.0
    image = [None if k % 5 == 0 else np.round(rng.normal(size=3), 3) for k in range(130)]
    for k in range(30, 75):
        image[k] = image[2]
    pics = np.array([np.zeros(3) if v is None else v for v in image])
    norms = np.linalg.norm(pics, axis=1)
    score = np.round(0.6 * unit(text) @ unit(text).T + 0.4 * (pics @ pics.T) / (np.outer(norms, norms) + 1e-8), 6) + 0.0
    label = classes_of(text, image)
    expected = {(a, b, score[a, b]) for a in set(label) for b in set(label) if a < b and score[a, b] >= 0.55}
    pairs, members, frames = found(spark, text, image, 0.55, text_weight=0.6, image_weight=0.4, tile=tile)
    assert pairs == expected and members == dict(enumerate(label)) and expected
    unfolded = {tuple(r) for r in neighbours.all_entries(*frames).collect()}
    assert unfolded == {(a, b, score[a, b]) for a in range(130) for b in range(a + 1, 130) if label[a] != label[b] and score[a, b] >= 0.55}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "dot_product"])
@pytest.mark.parametrize("tile", [6, None])
def test_other_metrics_equal_brute_force(spark, metric, tile):
    rng = np.random.default_rng(2)
    text = rng.integers(-3, 4, size=(80, 2)).astype(float)
    image = [None if k % 4 == 0 else rng.integers(-2, 3, size=2).astype(float) for k in range(80)]
    threshold = 4.0 if metric == "dot_product" else 1.5
    label, expected = classes_of(text, image), set()
    for a in set(label):
        for b in set(label):
            total = 0.0
            for x, y, w in ((text[a], text[b], 0.5), (image[a], image[b], 0.5)):
                if metric == "dot_product":
                    total += 0.0 if x is None or y is None else w * float(x @ y)
                elif (x is None) != (y is None):
                    total = float("inf")
                elif x is not None:
                    total += w * float(np.abs(x - y).sum() if metric == "manhattan" else np.linalg.norm(x - y))
            total = round(total, 6) + 0.0
            if a < b and (total >= threshold if metric == "dot_product" else total <= threshold):
                expected.add((a, b, total))
    pairs, members, _ = found(spark, text, image, threshold, text_weight=0.5, image_weight=0.5, metric=metric, tile=tile)
    assert pairs == expected and members == dict(enumerate(label)) and expected


def test_far_groups_are_not_compared(spark, caplog):
    rng = np.random.default_rng(3)
    centres = unit(rng.normal(size=(20, 16)))
    text = np.repeat(centres, 30, axis=0) + rng.normal(size=(600, 16)) * 0.01
    with caplog.at_level("INFO", logger="shelfkin.operators.matches"):
        pairs, _, _ = found(spark, text, [None] * 600, 0.97, tile=20)
    assert len(pairs) == 20 * 30 * 29 // 2
    assert float(caplog.records[-1].getMessage().split("(")[-1].rstrip(")")) < 0.2


def test_tiles_meet_once_if_cells_leave_most_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    text = unit(rng.normal(size=(90, 3)))
    copied, real = [], neighbours.dealt
    monkeypatch.setattr(neighbours, "dealt", lambda rows, parts: copied.append(rows.count()) or real(rows, parts))
    for tile in (2, 30, None):  # of the smallest tiles some are empty
        pairs, _, _ = found(spark, text, [None] * 90, 1.4, metric="euclidean", tile=tile)
        gap = np.round(np.linalg.norm(text[:, None] - text[None], axis=2), 6)
        assert {p[:2] for p in pairs} == {(a, b) for a in range(90) for b in range(a + 1, 90) if gap[a, b] <= 1.4}
    assert copied == [90 * 45, 90 * 3, 90]


def test_pairs_leave_in_an_order_in_which_scores_repeat():
    rng = np.random.default_rng(5)
    grid = rng.integers(0, 4, size=(700, 3)).astype(float)
    sides = [pa.RecordBatch.from_pydict({"first": np.arange(700) * 2 + asked, "vec": grid.tolist(), "asked": np.full(700, asked)}) for asked in (True, False)]
    both = list(neighbours.pairs_of_tiles(tiles.Shape(3, 0), (1.0, 0.0), -2.0, "euclidean", True)(iter(sides)))
    close = np.linalg.norm(grid[:, None] - grid[None], axis=2) <= 2.0
    assert sum(b.num_rows for b in both) == close.sum()  # whichever of two classes is the lower
    for batch in both:
        assert (np.diff(batch.column("score").to_numpy()) >= 0).all()
        assert (batch.column("class_a").to_numpy() < batch.column("class_b").to_numpy()).all()


def test_empty_tables_and_unknown_metrics(spark):
    pairs, members = neighbours.similar_classes(spark.createDataFrame([], SCHEMA), 0.5)
    assert pairs.collect() == [] and members.collect() == []
    with pytest.raises(ValueError):
        neighbours.similar_classes(spark.createDataFrame([], SCHEMA), 0.5, metric="other")
