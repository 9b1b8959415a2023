"""The similarity matrix as a table of its large entries: a join of vectors by a threshold.

Equal vectors are one class, named by its lowest id; entries are pairs of classes, and a
table of members tells which ids a class stands for, so copies are never paired with each
other.  Cells, groups and tiles are those of the top-k join: a class visits a group only
if a proven upper bound of the group's scores reaches the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import METRICS
from ..session import materialize
from . import bounds, screens, tiles
from .matches import (
    LOG,
    MAX_PIVOTS,
    MOST_PARTITIONS,
    MUTUAL_PER_CORE,
    ROUTED_ROWS,
    WIDE_ROWS,
    balanced_tile,
    celled_items,
    dealt,
    digest,
    distinct_items,
    joined_vector,
    most_pairs_left,
    tile_sides,
    vector_shape,
)

Taken = Callable[[np.ndarray, np.ndarray], np.ndarray]  # by the ids of two classes, whether their pair is taken
OUT_ROWS = 262_144  # pairs of a block that is scored in full, and of a batch that leaves
SPAN = 8192  # classes of each side of an area whose pairs leave in one order: a page of a file then names few classes
HELD_PAIRS = 1_048_576  # that wait to leave in order


def vector_classes(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors with their lowest id, and (id, class) of every item."""
    stored = materialize(distinct_items(items, 1), "vector-classes")
    keys = [digest(n, F.col("text"), F.col("image")).alias(f"k{n}") for n in (1, 2)]
    # Most classes have one member; only the others are joined.
    keyed = materialize(items.select("id", *keys), "vector-keys")
    shared = keyed.groupBy("k1", "k2").agg(F.min("id").alias("class"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = keyed.join(shared, ["k1", "k2"], "left").select("id", F.coalesce("class", "id").alias("class"))
    return stored, members


def similar_classes(
    items: DataFrame,
    threshold: float,
    text_weight: float = 1.0,
    image_weight: float = 0.0,
    metric: str = "cosine",
    tile: int | None = None,
    max_pivots: int = MAX_PIVOTS,
) -> tuple[DataFrame, DataFrame]:
    """(class_a, class_b, score) of all pairs of classes within the threshold, and (id, class).

    ``items`` has (id, text, image).  A similarity must reach the threshold, a distance
    may not exceed it, both rounded to six places; class_a is below class_b.  By a distance
    an item without a part is infinitely far from one that has it, if the part counts.
    A class has no entry with itself: its members are equal.  Builds scratch tables.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose one of {sorted(METRICS)}")
    distance = not METRICS[metric]
    least = -threshold if distance else threshold
    spark = items.sparkSession
    stored, members = vector_classes(items)
    count, shape = vector_shape(stored)
    if not count or not shape.width:
        return spark.createDataFrame([], "class_a long, class_b long, score double"), members
    halves = tile or balanced_tile(spark, shape, count, MUTUAL_PER_CORE)
    tile = tile or balanced_tile(spark, shape, count, most=WIDE_ROWS)
    vec = joined_vector(shape, 0.0 if metric == "cosine" else float("nan")).alias("vec")
    packed = stored.select("k1", "k2", "ids", vec)
    queries = packed.select(F.col("k1").alias("q1"), F.col("ids")[0].alias("own"), "vec")
    both, routed = (text_weight, image_weight), None
    if count > tile:
        assigned, cells, group_of_cell, _ = celled_items(packed, count, shape, tile, max_pivots, metric)
        routed = materialize(_routed(queries, cells, group_of_cell, shape, both, least, metric), "routed-classes")
    once = routed is None or most_pairs_left(routed, cells.size, group_of_cell)
    if once:
        sides, partitions = tile_pairs(queries, count, halves, metric)
    else:
        visits = routed.select(F.explode("groups").alias("group"), "q1", "own", "vec", F.lit(1).alias("n"))
        left, right, partitions = tile_sides(visits, routed.count(), assigned, cells.size, group_of_cell, tile, metric)
        sides = left.select("pair", F.col("own").alias("first"), "vec", F.lit(True).alias("asked")).unionByName(
            right.select("pair", F.col("ids")[0].alias("first"), "vec", F.lit(False).alias("asked"))
        )
    # Both sides of a tile pair come as one group, so that its pairs leave it a block at a time.
    compare = pairs_of_tiles(shape, both, least, metric, once)
    pairs = dealt(sides.filter(F.col("first").isNotNull()), partitions).applyInArrow(compare, "class_a long, class_b long, score double")
    return pairs, members


def tile_pairs(classes: DataFrame, count: int, tile: int, metric: str) -> tuple[DataFrame, int]:
    """Classes cut into tiles, copied once to each ``pair`` of tiles and to that of their own tile with itself."""
    cut = math.ceil(count / tile)
    pairs = cut * (cut + 1) // 2
    LOG.info("join of vectors by %s: %d tiles compared with each other once, %d pairs of tiles", metric, cut, pairs)
    rows = classes.withColumn("tile", F.pmod("q1", F.lit(cut)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(cut - 1))))
    low, high = F.least("tile", "other").cast("long"), F.greatest("tile", "other").cast("long")
    pair = (high * (high + 1) / 2 + low).cast("long").alias("pair")
    asked = F.when(F.col("tile") != F.col("other"), F.col("tile") < F.col("other")).alias("asked")
    sides = rows.select(pair, F.col("own").alias("first"), "vec", asked)
    return sides, max(1, min(MOST_PARTITIONS, pairs))


def pairs_of_tiles(
    shape: tiles.Shape, both: tuple[float, float], least: float, metric: str, once: bool = False
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The comparison of two tiles of classes: every pair that reaches ``least``.

    If two tiles meet ``once``, their pairs are taken whichever class is the lower, and a tile that meets itself comes
    without ``asked``; otherwise each pair is met from both sides.
    """
    distance = not METRICS[metric]

    def near(screen: screens.Screen, some: slice, of: slice, hit: np.ndarray, taken: Taken, own: np.ndarray, first: np.ndarray) -> tuple:
        rows, cols = screens.pairs_within(hit)
        rows, cols = rows + some.start, cols + of.start
        wanted = taken(own[rows], first[cols])
        rows, cols = rows[wanted], cols[wanted]
        return rows, cols, tiles.rounded(screen.exact(rows, cols))

    def screened(x: np.ndarray, y: np.ndarray, weights: np.ndarray, taken: Taken, own: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
        screen = screens.Screen(x, weights, y, shape, metric)
        areas = screen.areas()
        for some in screens.blocks(len(x), screen.block[0]):
            cap = screen.cap(np.full(some.stop - some.start, least), some)[:, None]
            for of in screens.blocks(len(y), screen.block[1]):
                yield near(screen, some, of, screen.least(some, of, areas) <= cap, taken, own, first)

    def in_full(x: np.ndarray, y: np.ndarray, weights: np.ndarray, taken: Taken, own: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
        for some in screens.blocks(len(x), max(1, OUT_ROWS // len(y))):
            if metric == "cosine":
                score = tiles.scores(x[some], weights[some], y, shape)
            else:
                score = tiles.other_scores(metric, x[some], weights[some], y, shape)
            rows, cols = np.nonzero((score >= least - tiles.ROUNDING_SLACK) & taken(own[some][:, None], first[None, :]))
            yield rows + some.start, cols, tiles.rounded(score[rows, cols])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        alone = parts[0].column("asked").null_count > 0
        asked = np.concatenate([tiles.numbers(b.column("asked").fill_null(True)) for b in parts])
        ids = np.concatenate([tiles.numbers(b.column("first")) for b in parts])
        vectors = np.concatenate([tiles.matrix(b.column("vec"), shape.width) for b in parts])
        del parts
        met = asked if alone else ~asked
        taken = np.not_equal if once and not alone else np.less
        own, first, x, y = ids[asked], ids[met], vectors[asked], vectors[met]
        del vectors
        if not len(x) or not len(y):
            return
        weights = np.tile([float(both[0]), float(both[1])], (len(x), 1))
        lacking = [{k: bounds.lacks(side, span) for k, span in bounds.parts_of(shape)} for side in (x, y)]
        for way, some, of in screens.plain_sides(x, weights, y, shape, metric):
            for rows_of, cols_of in ((some[r], of[c]) for r in screens.blocks(len(some), SPAN) for c in screens.blocks(len(of), SPAN)):
                held, many = [], 0
                for rows, cols, value in (screened if way else in_full)(x[rows_of], y[cols_of], weights[rows_of], taken, own[rows_of], first[cols_of]):
                    rows, cols, reached = rows_of[rows], cols_of[cols], value >= least
                    if distance:
                        for k, span in bounds.parts_of(shape):
                            if both[k] > 0:
                                reached &= lacking[0][k][rows] == lacking[1][k][cols]
                    a, b, value = own[rows[reached]], first[cols[reached]], value[reached]
                    held.append((np.minimum(a, b), np.maximum(a, b), 0.0 - value if distance else value))
                    many += len(a)
                    if many >= HELD_PAIRS:
                        yield from in_order(held)
                        held, many = [], 0
                yield from in_order(held)

    return compare


def in_order(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Pairs in an order in which columns repeat, so that files of them stay small: by score where scores recur, else by class."""
    a, b, score = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros(0),) * 3
    order = np.argsort(score, kind="stable")
    if 2 * (1 + np.count_nonzero(np.diff(score[order]))) > len(score):
        order = np.lexsort((b, a))
    for some in screens.blocks(len(order), OUT_ROWS):
        columns = [pa.array(c[order[some]]) for c in (a, b, score)]
        yield pa.RecordBatch.from_arrays(columns, names=["class_a", "class_b", "score"])


def _routed(
    queries: DataFrame, cells: tiles.Cells | bounds.MetricCells, group_of_cell: np.ndarray, shape: tiles.Shape,
    both: tuple[float, float], least: float, metric: str,
) -> DataFrame:
    """Add the groups of the cells whose best possible score reaches ``least``."""
    known = queries.sparkSession.sparkContext.broadcast((cells, group_of_cell))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        described, group = known.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROUTED_ROWS):
                batch = whole.slice(at, ROUTED_ROWS)
                rows = tiles.matrix(batch.column("vec"), shape.width)
                weights = np.tile([float(both[0]), float(both[1])], (len(rows), 1))
                if metric == "cosine":
                    highest = sum(tiles.score_span(rows, weights, described, shape))
                else:
                    highest = bounds.score_bounds(metric, rows, weights, described, shape)[1]
                visits = (described.size > 0) & (highest >= least - tiles.ROUNDING_SLACK)
                groups = pa.array([np.unique(group[v]) for v in visits], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, groups], [*batch.schema.names, "groups"])

    return queries.mapInArrow(route, "q1 long, own long, vec array<double>, groups array<int>")


def all_entries(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b, score) for pairs of members, id_a below id_b, where the caller wants classes unfolded."""
    a, b = (members.select(F.col("id").alias(f"m{s}"), F.col("class").alias(f"class_{s}")) for s in "ab")
    both = pairs.join(a, "class_a").join(b, "class_b")
    return both.select(F.least("ma", "mb").alias("id_a"), F.greatest("ma", "mb").alias("id_b"), "score")
