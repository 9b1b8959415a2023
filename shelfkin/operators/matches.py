"""The best items for a table of queries: an exact top-k join on vectors.

How a large catalogue is handled:

* Copies.  Equal vectors score alike, so each distinct vector is compared once and
  stands for its ``k + 1`` lowest ids; no answer needs more of them.  The same holds
  for equal queries.  However many rows share a vector, they cost one comparison.
* Cells.  Distinct items go to the nearest of a bounded number of pivot items.  A
  query visits a cell only if a proven upper bound of the cell's scores reaches the
  score it is already sure of (see ``tiles.cells_to_visit`` for the cosine and
  ``bounds.cells_in_reach`` for the other metrics): nothing is lost.
* Tree.  With more items than the pivots can tell apart, each cell has leaves of its own
  (see ``pivot_tree``), so a cell keeps its size when the table grows.  Queries that must
  visit most cells anyway are compared in plain tiles, which copies them less often.
* Groups.  Neighbouring cells are compared together, so that data without clusters,
  where no cell can be skipped, is not copied more often than plain tiles would be.
* Tiles.  A group's items and its visitors are both cut by hash into tiles of bounded
  size; one task call sees one tile of each, whatever the size of the group.
* Screens.  Within a tile cheap bounds tell which pairs can be among the best; only those
  are scored (see ``screens``).
* Only the ``k + 1`` best of each tile leave it; scores of all pairs never exist.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import METRICS
from ..session import materialize
from . import bounds, pivot_tree, screens, tiles

LOG = logging.getLogger(__name__)

TILE_BYTES = 32 * 1024 * 1024  # vectors of one tile
TILE_ROWS = 32_768
WIDE_ROWS = 65_536  # the same where two sides are copied to each other's tiles, which large tiles do less often
LEAST_TILE_ROWS = 4096  # a table of fewer rows is not cut for the sake of more tasks
PAIRS_PER_CORE = 4  # tile pairs of a table that is compared with itself
MUTUAL_PER_CORE = 8  # the same if a pair of tiles is compared once for both, so that half of them are left
MOST_PARTITIONS = 2000  # that tile pairs are dealt over
MOST_ASKS = 64  # queries that travel with one copy of their vector
ASKS_PER_ROW = 4  # queries of a tile for each row it may hold
PLAIN_SHARE = 0.8  # of all comparisons; if cells leave more, tiles of equal size are copied less often than groups
TREE_VISITS = 64  # root cells that a query may visit on average, being copied to each
CELL_ROWS = 128
SPARK_GROUP_LIMIT = 1000  # default of spark.sql.optimizer.windowGroupLimitThreshold
SALTS = 64
ROUTED_ROWS = 1024  # queries routed at once; the work area is this times the pivots
MAX_PIVOTS = 1024  # bounds what the driver and every task hold: pivots x width doubles


def tile_rows(shape: tiles.Shape, most: int = TILE_ROWS) -> int:
    return max(256, min(most, TILE_BYTES // (8 * shape.width)))


def balanced_tile(spark: SparkSession, shape: tiles.Shape, count: int, per_core: int = PAIRS_PER_CORE, most: int = TILE_ROWS) -> int:
    """Rows of a tile: as many as fit, but few enough that all cores get tile pairs."""
    parts, fit = math.sqrt(per_core * spark.sparkContext.defaultParallelism), tile_rows(shape, most)
    return max(min(LEAST_TILE_ROWS, fit), min(fit, math.ceil(count / parts)))


def digest(seed: int, *cols: Column) -> Column:
    """64 bits of a row's content; the separators keep shifted nulls apart."""
    parts: list[Column] = [F.lit(seed)]
    for i, col in enumerate(cols):
        parts += [col, F.lit(i)]
    return F.xxhash64(*parts)


def distinct_items(items: DataFrame, keep: int) -> DataFrame:
    """(k1, k2, ids, text, image): each distinct vector with its lowest ids.

    Up to SPARK_GROUP_LIMIT rows Spark cuts a row_number filter down before its shuffle,
    so a vector with very many copies is no burden; above it the copies are salted.
    """
    keyed = items.select(
        "id", "text", "image", digest(1, F.col("text"), F.col("image")).alias("k1"),
        digest(2, F.col("text"), F.col("image")).alias("k2"),
    )

    def lowest(rows: DataFrame, *keys: str) -> DataFrame:
        place = Window.partitionBy(*keys).orderBy("id")
        return rows.withColumn("copy", F.row_number().over(place)).filter(F.col("copy") <= keep).drop("copy")

    if keep > SPARK_GROUP_LIMIT:
        keyed = lowest(keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), "k1", "k2", "salt").drop("salt")
    return (
        lowest(keyed, "k1", "k2")
        .groupBy("k1", "k2")
        .agg(
            F.sort_array(F.collect_list("id")).alias("ids"),
            F.first("text").alias("text"),
            F.first("image").alias("image"),
        )
    )


def vector_shape(items: DataFrame) -> tuple[int, tiles.Shape]:
    """Row count and the common vector lengths; unequal lengths are an error."""
    row = items.agg(
        F.count("*").alias("n"),
        *[f(F.array_size(c)).alias(f"{f.__name__}_{c}") for c in ("text", "image") for f in (F.min, F.max)],
    ).first()
    for c in ("text", "image"):
        if row[f"min_{c}"] != row[f"max_{c}"]:
            raise ValueError(f"{c} vectors differ in length: {row[f'min_{c}']} to {row[f'max_{c}']}")
    return row["n"], tiles.Shape(row["max_text"] or 0, row["max_image"] or 0)


def check_queries(queries: DataFrame, shape: tiles.Shape) -> None:
    """Queries need vectors of the items' lengths; a part that no item has may be of any length."""
    sizes = queries.agg(*[f(F.array_size(c)).alias(f"{f.__name__}_{c}") for c in ("text", "image") for f in (F.min, F.max)]).first()
    for c, size in (("text", shape.text), ("image", shape.image)):
        low, high = sizes[f"min_{c}"], sizes[f"max_{c}"]
        if size and low is not None and not low == high == size:
            raise ValueError(f"{c} vectors of queries have {low} to {high} numbers, those of items {size}")


def joined_vector(shape: tiles.Shape, missing: float) -> Column:
    """Text part, then image part; a part that is null is filled with ``missing``."""

    def part(name: str, size: int) -> Column:
        if not size:
            return F.array().cast("array<double>")
        return F.coalesce(F.col(name), F.array_repeat(F.lit(missing), size))

    return F.concat(part("text", shape.text), part("image", shape.image))


def assign_cells(items: DataFrame, pivots: np.ndarray, shape: tiles.Shape) -> DataFrame:
    """Add the nearest cell, the distance to its pivot and the image norm."""
    bound = items.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = tiles.matrix(batch.column("vec"), shape.width)
            cell, gap = tiles.nearest_pivot(rows, bound.value, shape)
            norm = np.linalg.norm(rows[:, shape.text :], axis=1)
            extra = [pa.array(cell, pa.int32()), pa.array(gap), pa.array(norm)]
            yield pa.RecordBatch.from_arrays(
                batch.columns + extra, [*batch.schema.names, "cell", "gap", "image_norm"]
            )

    fields = "k1 long, k2 long, ids array<long>, vec array<double>"
    return items.select("k1", "k2", "ids", "vec").mapInArrow(
        assign, f"{fields}, cell int, gap double, image_norm double"
    )


def describe_cells(assigned: DataFrame, pivots: np.ndarray) -> tiles.Cells:
    """At most one row per pivot reaches the driver."""
    stats = (
        assigned.groupBy("cell")
        .agg(
            F.count("*").alias("n"),
            F.max("gap").alias("radius"),
            F.min(F.when(F.col("image_norm") > 0, F.col("image_norm"))).alias("least"),
        )
        .collect()
    )
    radius, size = np.zeros(len(pivots)), np.zeros(len(pivots), dtype=np.int64)
    least = np.full(len(pivots), np.inf)
    for row in stats:
        size[row["cell"]] = row["n"]
        radius[row["cell"]] = row["radius"] + 1e-9
        least[row["cell"]] = np.inf if row["least"] is None else row["least"]
    return tiles.Cells(pivots, radius, least, size)


def assign_metric_cells(items: DataFrame, pivots: np.ndarray, shape: tiles.Shape, metric: str) -> DataFrame:
    """Add the nearest cell and, per part, the distance to its pivot, the length, and whether it is absent."""
    bound = items.sparkSession.sparkContext.broadcast(pivots)
    names = [f"{what}_{k}" for what in ("gap", "length", "absent") for k in (0, 1)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = tiles.matrix(batch.column("vec"), shape.width)
            cell, *measures = bounds.members(metric, rows, bound.value, shape)
            extra = [pa.array(cell, pa.int32()), *(pa.array(m[:, k].astype(float)) for m in measures for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "cell", *names])

    fields = "k1 long, k2 long, ids array<long>, vec array<double>, cell int"
    return items.select("k1", "k2", "ids", "vec").mapInArrow(assign, ", ".join([fields, *(f"{n} double" for n in names)]))


def describe_metric_cells(assigned: DataFrame, pivots: np.ndarray) -> bounds.MetricCells:
    """At most one row per pivot reaches the driver."""
    measures = [F.max(f"gap_{k}") for k in (0, 1)] + [F.max(f"length_{k}") for k in (0, 1)] + [F.sum(f"absent_{k}") for k in (0, 1)]
    stats = assigned.groupBy("cell").agg(F.count("*"), *measures).collect()
    out = np.zeros((len(pivots), 7))
    for cell, *values in stats:
        out[cell] = values
    return bounds.MetricCells(pivots, out[:, 1:3], out[:, 3:5], out[:, 5:7], out[:, 0].astype(np.int64))


def metric_groups(cells: bounds.MetricCells, tile: int, shape: tiles.Shape) -> np.ndarray:
    spread = np.where(np.isfinite(cells.spread), cells.spread, np.finfo(float).max)
    nearest = lambda part, seeds: bounds.nearest_raw(cells.pivots[part], cells.pivots[seeds], shape)
    return tiles.grouped_cells(spread, cells.size, tile, nearest)


def route_queries(
    queries: DataFrame, cells: tiles.Cells | bounds.MetricCells, group_of_cell: np.ndarray, shape: tiles.Shape, keep: int, metric: str = "cosine"
) -> DataFrame:
    """Add ``floor``, a score each query is sure of, ``cells``, how many may hold its best, and their ``groups``."""
    known = queries.sparkSession.sparkContext.broadcast((cells, group_of_cell))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        described, group = known.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROUTED_ROWS):
                batch = whole.slice(at, ROUTED_ROWS)
                rows = tiles.matrix(batch.column("vec"), shape.width)
                weights = np.column_stack([tiles.numbers(batch.column(c)) for c in ("text_weight", "image_weight")])
                if metric == "cosine":
                    visits, floor = tiles.cells_to_visit(rows, weights, described, shape, keep)
                else:
                    visits, floor = bounds.cells_in_reach(metric, rows, weights, described, shape, keep)
                groups = pa.array([np.unique(group[v]) for v in visits], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(floor), pa.array(visits.sum(axis=1), pa.int32()), groups],
                    [*batch.schema.names, "floor", "cells", "groups"],
                )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(route, f"{fields}, floor double, cells int, groups array<int>")


def route_asks(
    asked: DataFrame, cells: tiles.Cells | bounds.MetricCells, group_of_cell: np.ndarray, shape: tiles.Shape, keep: int, metric: str = "cosine"
) -> DataFrame:
    """``route_queries`` for rows of a vector and the queries that ask by it."""
    known = asked.sparkSession.sparkContext.broadcast((cells, group_of_cell))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        described, group = known.value
        for batch in batches:
            vectors = tiles.matrix(batch.column("vec"), shape.width)
            asks, start, of = unfolded(batch.column("asks"))
            weights = np.column_stack([tiles.numbers(asks.field(c)) for c in ("text_weight", "image_weight")])
            floor, reached, groups = np.zeros(len(of)), np.zeros(len(of), np.int32), []
            for some in screens.blocks(len(of), ROUTED_ROWS):
                if metric == "cosine":
                    visits, floor[some] = tiles.cells_to_visit(vectors[of[some]], weights[some], described, shape, keep)
                else:
                    visits, floor[some] = bounds.cells_in_reach(metric, vectors[of[some]], weights[some], described, shape, keep)
                reached[some] = visits.sum(axis=1)
                groups += [np.unique(group[v]) for v in visits]
            known_columns = [asks.field(c) for c in ASK]
            extra = [pa.array(floor), pa.array(reached), pa.array(groups, pa.list_(pa.int32()))]
            told = pa.StructArray.from_arrays([*known_columns, *extra], [*ASK, "floor", "cells", "groups"])
            yield pa.RecordBatch.from_arrays([batch.column("vec"), pa.ListArray.from_arrays(pa.array(start), told)], ["vec", "asks"])

    return asked.select("vec", "asks").mapInArrow(route, f"vec array<double>, {ROUTED_ASKS}")


ASK = ["q1", "q2", "text_weight", "image_weight"]
ROUTED_ASKS = (
    "asks array<struct<q1: long, q2: long, text_weight: double, image_weight: double, floor: double, cells: int, groups: array<int>>>"
)


def unfolded(asks: pa.ListArray) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
    """The queries of all rows, where those of each row start, and the row of each."""
    start = np.asarray(asks.offsets)
    start = (start - start[0]).astype(np.int32)
    return asks.flatten(), start, np.repeat(np.arange(len(asks)), np.diff(start))


def single_asks(routed: DataFrame) -> DataFrame:
    """Queries of which each has a vector of its own, as rows of a vector and the queries that ask by it."""
    return routed.select("vec", F.array(F.struct(*ASK, "floor", "cells", "groups")).alias("asks"))


def asked_vectors(keys: DataFrame, packed: DataFrame) -> DataFrame:
    """(vec, asks): the vectors of items that queries ask by, each with its different queries, about MOST_ASKS a row at most."""
    different = keys.select("v1", "v2", *ASK).dropDuplicates(["q1", "q2"])
    parts = F.ceil(F.count("*") / MOST_ASKS).alias("parts")
    many = different.groupBy("v1", "v2").agg(parts).filter("parts > 1")
    dealt = different.join(many, ["v1", "v2"], "left").withColumn("part", F.pmod("q1", F.coalesce("parts", F.lit(1))))
    asks = dealt.groupBy("v1", "v2", "part").agg(F.collect_list(F.struct(*ASK)).alias("asks"))
    vectors = packed.select(F.col("k1").alias("v1"), F.col("k2").alias("v2"), "vec")
    return asks.join(vectors, ["v1", "v2"]).select("vec", "asks")


def tile_sides(
    visits: DataFrame, total: int, assigned: DataFrame, sizes: np.ndarray, group_of_cell: np.ndarray, tile: int, metric: str
) -> tuple[DataFrame, DataFrame, int]:
    """Visitors and members of every group, each row with the ``pair`` of tiles it is compared in, and the number of
    partitions to deal pairs over, about one each.

    ``visits`` has (group, q1, n), with the number n of queries of a row; ``total`` is the number of all queries.
    """
    spark = visits.sparkSession
    counted = visits.groupBy("group").agg(F.count("*"), F.sum("n")).collect()
    members = np.bincount(group_of_cell, weights=sizes)
    compared, every = sum(n * members[g] for g, _, n in counted), total * members.sum()
    LOG.info("join of vectors by %s: %d of %d comparisons (%.4f)", metric, compared, every, compared / max(1, every))
    item_tiles = {g: math.ceil(members[g] / tile) for g, _, _ in counted}
    # Few queries of many items are cut further, so that all cores get tile pairs.
    wanted = math.ceil(PAIRS_PER_CORE * spark.sparkContext.defaultParallelism / max(1, sum(item_tiles.values())))
    cuts, pairs = [], 0
    for g, rows, n in counted:
        least = max(math.ceil(rows / tile), math.ceil(n / (ASKS_PER_ROW * tile)))
        query_tiles = max(least, min(wanted, math.ceil(n / LEAST_TILE_ROWS)))
        cuts.append((g, pairs, item_tiles[g], query_tiles))
        pairs += item_tiles[g] * query_tiles
    # One row per group or cell, so at most MAX_PIVOTS rows.
    kinds = "group int, first_pair long, item_tiles int, query_tiles int"
    query_cut = F.broadcast(spark.createDataFrame(cuts, kinds))
    groups = {cut[0]: cut for cut in cuts}
    celled = [(cell, *groups[g]) for cell, g in enumerate(group_of_cell.tolist()) if g in groups]
    item_cut = F.broadcast(spark.createDataFrame(celled, f"cell int, {kinds}"))
    pair = (F.col("first_pair") + F.col("item_tile") * F.col("query_tiles") + F.col("query_tile")).alias("pair")
    left = (
        visits.join(query_cut, "group")
        .withColumn("query_tile", F.pmod("q1", "query_tiles"))
        .withColumn("item_tile", F.explode(F.sequence(F.lit(0), F.col("item_tiles") - 1)))
        .select(pair, *[c for c in visits.columns if c not in ("group", "n")])
    )
    right = (
        assigned.select("k1", "ids", "vec", "cell").join(item_cut, "cell")
        .withColumn("item_tile", F.pmod("k1", "item_tiles"))
        .withColumn("query_tile", F.explode(F.sequence(F.lit(0), F.col("query_tiles") - 1)))
        .select(pair, "ids", "vec")
    )
    return left, right, max(1, min(MOST_PARTITIONS, pairs))


def dealt(rows: DataFrame, parts: int) -> GroupedData:
    """Rows by their ``pair``, dealt by number, so that no partition gets several pairs while others get none."""
    return rows.withColumn("part", F.pmod("pair", F.lit(parts)).cast("int")).repartitionById(parts, "part").groupBy("part", "pair")


def comparisons_left(routed: DataFrame, sizes: np.ndarray, group_of_cell: np.ndarray) -> tuple[int, int]:
    """Number of queries, and of the comparisons that their groups leave them."""
    members = np.bincount(group_of_cell, weights=sizes)
    asks = routed.select(F.inline("asks"))
    visits = asks.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count("*").alias("n")).collect()
    return routed.agg(F.sum(F.size("asks"))).first()[0] or 0, int(sum(r["n"] * members[r["group"]] for r in visits))


def compare_tiles(
    routed: DataFrame, assigned: DataFrame, sizes: np.ndarray, group_of_cell: np.ndarray, shape: tiles.Shape, keep: int, tile: int, metric: str
) -> DataFrame:
    """(q1, q2, ids, first_id, score): the ``keep`` best of each pair of tiles.

    A vector is copied once for all the queries that ask by it.
    """
    total, left_over = comparisons_left(routed, sizes, group_of_cell)
    asks = F.col("asks")
    if left_over > PLAIN_SHARE * total * sizes.sum():
        assigned, sizes = one_cell(assigned, int(sizes.sum()))
        group_of_cell, visits = np.zeros(1, dtype=np.int32), routed.withColumn("group", F.lit(0))
    else:
        visits = routed.withColumn("group", F.explode(F.array_distinct(F.flatten(F.transform(asks, lambda a: a["groups"])))))
        asks = F.filter(asks, lambda a: F.array_contains(a["groups"], F.col("group")))
    visits = visits.select("group", "vec", F.transform(asks, lambda a: F.struct(*[a[c].alias(c) for c in (*ASK, "floor")])).alias("asks"))
    visits = visits.withColumns({"q1": F.col("asks")[0]["q1"], "n": F.size("asks")})
    left, right, parts = tile_sides(visits, total, assigned, sizes, group_of_cell, tile, metric)
    sides = left.select("pair", "vec", "asks").unionByName(right, allowMissingColumns=True)
    return dealt(sides, parts).applyInArrow(best_of_asked(shape, keep, metric), FOUND)


FOUND = "q1 long, q2 long, ids array<long>, first_id long, score double"
FOUND_ARROW = pa.schema([
    ("q1", pa.int64()), ("q2", pa.int64()), ("ids", pa.list_(pa.int64())),
    ("first_id", pa.int64()), ("score", pa.float64()),
])


def first_ids(ids: pa.Array) -> np.ndarray:
    return np.asarray(ids.flatten())[np.asarray(ids.offsets)[:-1] - ids.offsets[0].as_py()]


def best_of_tiles(shape: tiles.Shape, keep: int, metric: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The comparison of one tile of queries with one tile of items."""

    def compare(queries: pa.Table, items: pa.Table) -> pa.Table:
        if not len(queries) or not len(items):
            return FOUND_ARROW.empty_table()
        weights = np.column_stack([tiles.numbers(queries[c]) for c in ("text_weight", "image_weight")])
        ids = items["ids"].combine_chunks()
        first = first_ids(ids)
        rows, cols, value = screens.best_of_tile(
            tiles.matrix(queries["vec"], shape.width), weights, tiles.numbers(queries["floor"]),
            tiles.matrix(items["vec"], shape.width), first, shape, keep, metric,
        )
        q1, q2 = (pa.array(tiles.numbers(queries[c])[rows]) for c in ("q1", "q2"))
        return pa.Table.from_arrays([q1, q2, ids.take(pa.array(cols)), pa.array(first[cols]), pa.array(value)], schema=FOUND_ARROW)

    return compare


def best_of_asked(shape: tiles.Shape, keep: int, metric: str) -> Callable[[pa.Table], pa.Table]:
    """The comparison of a tile of vectors, with the queries that ask by them, with one tile of items."""

    def compare(pair: pa.Table) -> pa.Table:
        asking = pair["asks"].is_valid()
        queries, items = pair.filter(asking), pair.filter(pc.invert(asking))
        if not len(queries) or not len(items):
            return FOUND_ARROW.empty_table()
        vectors, rows = (tiles.matrix(side["vec"], shape.width) for side in (queries, items))
        asks, _, of = unfolded(queries["asks"].combine_chunks())
        weights = np.column_stack([tiles.numbers(asks.field(c)) for c in ("text_weight", "image_weight")])
        q1, q2, floor = (tiles.numbers(asks.field(c)) for c in ("q1", "q2", "floor"))
        ids = items["ids"].combine_chunks()
        first, found = first_ids(ids), []
        for some in screens.blocks(len(of), TILE_ROWS):
            at, cols, value = screens.best_of_tile(vectors[of[some]], weights[some], floor[some], rows, first, shape, keep, metric)
            columns = [pa.array(q1[some][at]), pa.array(q2[some][at]), ids.take(pa.array(cols)), pa.array(first[cols]), pa.array(value)]
            found.append(pa.Table.from_arrays(columns, schema=FOUND_ARROW))
        return pa.concat_tables(found)

    return compare


def most_pairs_left(routed: DataFrame, sizes: np.ndarray, group_of_cell: np.ndarray) -> bool:
    """Whether the cells leave more pairs than a table has that is compared with itself once for both sides."""
    members = np.bincount(group_of_cell, weights=sizes)
    visits = routed.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count("*").alias("n")).collect()
    return 2 * sum(r["n"] * members[r["group"]] for r in visits) > members.sum() ** 2


OWN = (
    "q1 long, q2 long, ids array<long>, vec array<double>, text_weight double, image_weight double, floor double, tile int, "
    "hits array<struct<ids: array<long>, first_id: long, score: double>>"
)


def compare_mutually(routed: DataFrame, count: int, shape: tiles.Shape, keep: int, tile: int) -> DataFrame:
    """``compare_tiles`` for queries that are the items, by the cosine: a pair of tiles is compared once for both.

    Each tile is compared with itself first: what its rows find there they are sure of in all other tiles.
    A row is copied to each tile it meets, once, not as a query and as an item; tiles and pairs of
    tiles are numbered and dealt by number, so that no partition gets several while others get none.
    """
    cut = math.ceil(count / tile)
    pairs = cut * (cut - 1) // 2
    LOG.info("join of vectors by cosine: %d tiles compared with each other once, %d pairs of tiles", cut, cut + pairs)
    rows = ["q1", "q2", "ids", "vec", "text_weight", "image_weight", "floor"]
    cut_up = routed.select(*rows, F.pmod("q1", F.lit(cut)).cast("int").alias("tile"))
    own = materialize(cut_up.repartitionById(cut, "tile").groupBy("tile").applyInArrow(best_of_own(shape, keep), OWN), "own-tiles")
    parts = max(1, min(MOST_PARTITIONS, pairs))
    met = own.select(*rows, "tile", F.explode(F.sequence(F.lit(0), F.lit(cut - 1))).alias("other")).filter("other != tile")
    low, high = F.least("tile", "other").cast("long"), F.greatest("tile", "other").cast("long")
    dealt = met.select(*rows, "tile", (high * (high - 1) / 2 + low).cast("long").alias("pair"))
    dealt = dealt.withColumn("part", F.pmod("pair", F.lit(parts)).cast("int")).repartitionById(parts, "part")
    others = dealt.groupBy("part", "pair").applyInArrow(best_of_both(shape, keep), FOUND)
    return others.unionByName(own.select("q1", "q2", F.inline("hits")))


def best_of_own(shape: tiles.Shape, keep: int) -> Callable[[pa.Table], pa.Table]:
    """The comparison of one tile with itself: its rows with their ``keep`` best and the score they are now sure of."""

    def compare(table: pa.Table) -> pa.Table:
        weights = np.column_stack([tiles.numbers(table[c]) for c in ("text_weight", "image_weight")])
        ids, vectors, floor = table["ids"].combine_chunks(), tiles.matrix(table["vec"], shape.width), tiles.numbers(table["floor"])
        first = first_ids(ids)
        found, cols, value = screens.best_of_tile(vectors, weights, floor, vectors, first, shape, keep)
        start = np.searchsorted(found, np.arange(len(table) + 1))  # found rows come in order
        worst = np.full(len(table), np.inf)
        np.minimum.at(worst, found, value)
        sure = np.where(np.diff(start) == keep, np.fmax(floor, worst), floor)
        hits = pa.StructArray.from_arrays([ids.take(pa.array(cols)), pa.array(first[cols]), pa.array(value)], ["ids", "first_id", "score"])
        table = table.set_column(table.schema.get_field_index("floor"), "floor", pa.array(sure))
        return table.append_column("hits", pa.ListArray.from_arrays(pa.array(start, pa.int32()), hits))

    return compare


def best_of_both(shape: tiles.Shape, keep: int) -> Callable[[pa.Table], pa.Table]:
    """The comparison of two tiles with each other."""

    def side(table: pa.Table) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        weights = np.column_stack([tiles.numbers(table[c]) for c in ("text_weight", "image_weight")])
        ids = table["ids"].combine_chunks()
        return ids, (tiles.matrix(table["vec"], shape.width), weights, tiles.numbers(table["floor"]), first_ids(ids))

    def rows_of(table: pa.Table, ids: pa.Array, first: np.ndarray, found: screens.Found) -> pa.Table:
        rows, cols, value = found
        q1, q2 = (pa.array(tiles.numbers(table[c])[rows]) for c in ("q1", "q2"))
        return pa.Table.from_arrays([q1, q2, ids.take(pa.array(cols)), pa.array(first[cols]), pa.array(value)], schema=FOUND_ARROW)

    def compare(pair: pa.Table) -> pa.Table:
        tile = tiles.numbers(pair["tile"])
        tables = [pair.filter(pa.array(tile == t)) for t in np.unique(tile)]
        if len(tables) < 2:
            return FOUND_ARROW.empty_table()
        ids, sides = zip(*(side(t) for t in tables))
        both = screens.mutual_best(*sides, shape, keep)
        return pa.concat_tables([rows_of(tables[k], ids[1 - k], sides[1 - k][3], both[k]) for k in (0, 1)])

    return compare


def merge_tiles(found: DataFrame, keep: int) -> DataFrame:
    """(q1, q2, best): per distinct query its ``keep`` best (distance, id) entries.

    Hits whose betters have enough ids are left out before ids are unfolded, and ids are
    cut down before they are collected: no list is longer than ``keep``.
    """
    ranked = Window.partitionBy("q1", "q2").orderBy(F.col("score").desc(), F.col("first_id").asc())
    upto = Window.partitionBy("q1", "q2").orderBy(F.col("score").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = Window.partitionBy("q1", "q2", "score")
    hits = found.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= keep)
    hits = hits.withColumn("better", F.sum(F.size("ids")).over(upto) - F.sum(F.size("ids")).over(equal)).filter(F.col("better") < keep)
    entries = hits.select("q1", "q2", (F.lit(0.0) - F.col("score")).alias("below"), F.explode("ids").alias("id"))
    lowest = Window.partitionBy("q1", "q2").orderBy("below", "id")
    entries = entries.withColumn("place", F.row_number().over(lowest)).filter(F.col("place") <= keep)
    return entries.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("below", "id"))).alias("best"))


EVERYWHERE = {"floor": float("-inf"), "cells": 1, "groups": [0]}  # of a query that looks at the one cell there is


def route_everywhere(queries: DataFrame) -> DataFrame:
    return queries.withColumns({c: F.lit(value) for c, value in EVERYWHERE.items()})


def route_asks_everywhere(asked: DataFrame) -> DataFrame:
    told = [F.lit(value).alias(c) for c, value in EVERYWHERE.items()]
    return asked.select("vec", F.transform("asks", lambda a: F.struct(*[a[c].alias(c) for c in ASK], *told)).alias("asks"))


def one_cell(items: DataFrame, count: int) -> tuple[DataFrame, np.ndarray]:
    return items.withColumn("cell", F.lit(0)), np.array([count])


def root_pivots(packed: DataFrame, many: int, shape: tiles.Shape) -> tuple[np.ndarray, list[int]]:
    """The first items by content hash, which is as good as at random, and their hashes."""
    rows = packed.orderBy("k1", "k2").limit(many).select("vec", "k1").toArrow()
    return tiles.matrix(rows["vec"], shape.width), rows["k1"].to_pylist()


def tree_found(
    assigned: DataFrame, cells: tiles.Cells, keys: list[int], different: DataFrame, count: int, shape: tiles.Shape, keep: int, tile: int
) -> DataFrame:
    """The best of all tiles through two levels of cells, for the cosine."""
    rooted = route_queries(different, cells, np.arange(len(cells.size), dtype=np.int32), shape, keep).drop("cells")
    visits = materialize(rooted.withColumn("cell", F.explode("groups")).drop("groups"), "root-visits")
    found, leaves, routed = pivot_tree.tree_join(
        assigned, cells, keys, visits, shape, keep, tile, min(CELL_ROWS, tile), best_of_tiles(shape, keep, "cosine"), FOUND
    )
    sizes = leaves.groupBy("cell", "group").agg(F.sum("n").alias("n"))
    row = routed.join(sizes, ["cell", "group"]).agg(F.sum("n")).first()
    every = different.count() * count
    of = leaves.agg(F.count("*"), F.max("n"), F.avg("n")).first()
    LOG.info("tree of %d roots and %d leaves of %.1f items, at most %d: %d of %d comparisons (%.4f)", len(cells.size), of[0], of[2] or 0, of[1] or 0, row[0] or 0, every, (row[0] or 0) / max(1, every))
    return found


def celled_items(
    packed: DataFrame, count: int, shape: tiles.Shape, tile: int, max_pivots: int, metric: str
) -> tuple[DataFrame, tiles.Cells | bounds.MetricCells, np.ndarray, list[int]]:
    """Items with their cells, what is known of the cells, the group of each cell and the hash of its pivot."""
    pivots, keys = root_pivots(packed, min(max_pivots, math.ceil(count / min(CELL_ROWS, tile))), shape)
    if metric == "cosine":
        assigned = materialize(assign_cells(packed, pivots, shape), "assigned-items")
        cells = describe_cells(assigned, pivots)
        return assigned, cells, tiles.cell_groups(cells, tile, shape), keys
    assigned = materialize(assign_metric_cells(packed, pivots, shape, metric), "assigned-items")
    cells = describe_metric_cells(assigned, pivots)
    return assigned, cells, metric_groups(cells, tile, shape), keys


def top_matches(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    tile: int | None = None,
    max_pivots: int = MAX_PIVOTS,
    metric: str = "cosine",
    mutual: tuple[float, float] | None = None,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` best items of every query, exactly.

    ``queries`` has (query_id, self_id, text, image, text_weight, image_weight) with a
    query_id of any type; the item named by self_id is left out of that query's answer.
    Without text and image a query asks by the vector of that item, and has no answer if there is none.
    ``items`` has (id, text, image).  With ``mutual`` the queries are the items, all with
    these two weights: by the cosine each pair is then compared once, unless cells leave fewer.  Cells are used for more than one tile of items; the
    share of comparisons that was left is logged.  Builds scratch tables, so calling it
    starts jobs.
    """
    if k is None or k < 1:
        raise ValueError("k must be 1 or more")
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose one of {sorted(METRICS)}")
    keep = k + 1
    spark = items.sparkSession
    stored = materialize(distinct_items(items, keep), "distinct-items")
    count, shape = vector_shape(stored)
    if not count or not shape.width:
        query_type = queries.schema["query_id"].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {query_type}, rank int, id long, score double")
    mutual = mutual if metric == "cosine" else None
    halves = tile or balanced_tile(spark, shape, count, MUTUAL_PER_CORE)
    tile = tile or balanced_tile(spark, shape, count, most=WIDE_ROWS)
    vec = joined_vector(shape, 0.0 if metric == "cosine" else float("nan")).alias("vec")
    packed = stored.select("k1", "k2", "ids", vec)

    if mutual:
        content = [F.col(c) for c in ("text", "image")]  # the keys of distinct items
        keyed = queries.withColumns({"q1": digest(1, *content), "q2": digest(2, *content)})
        weights = {"text_weight": F.lit(mutual[0]), "image_weight": F.lit(mutual[1])}
        different = packed.withColumnsRenamed({"k1": "q1", "k2": "q2"}).withColumns(weights)
    elif "text" in queries.columns:
        content = [F.col(c) for c in ("text", "image", "text_weight", "image_weight")]
        keyed = queries.withColumns({"q1": digest(1, *content), "q2": digest(2, *content)})
        check_queries(queries, shape)
        different = keyed.select("q1", "q2", vec, "text_weight", "image_weight").dropDuplicates(["q1", "q2"])
        different = different.select("vec", F.array(F.struct(*ASK)).alias("asks"))
    else:
        # No vector is joined to a query: an item's keys stand for it.
        content = [F.col(c) for c in ("text", "image")]
        named = items.select(F.col("id").alias("self_id"), digest(1, *content).alias("v1"), digest(2, *content).alias("v2"))
        content = [F.col(c) for c in ("v1", "v2", "text_weight", "image_weight")]
        keyed = materialize(queries.join(named, "self_id").withColumns({"q1": digest(1, *content), "q2": digest(2, *content)}), "query-keys")
        different = asked_vectors(keyed, packed)

    if count > tile:
        assigned, cells, group_of_cell, keys = celled_items(packed, count, shape, tile, max_pivots, metric)
        sizes = cells.size
        routed = (route_queries if mutual else route_asks)(different, cells, group_of_cell, shape, keep, metric)
    else:
        assigned, sizes = one_cell(packed, count)
        group_of_cell, routed = np.zeros(1, dtype=np.int32), (route_everywhere if mutual else route_asks_everywhere)(different)
    routed = materialize(routed, "routed-queries")
    flat = routed if mutual else routed.select("vec", F.inline("asks"))
    crowded = metric == "cosine" and count > tile and math.ceil(count / min(CELL_ROWS, tile)) > max_pivots
    if crowded and (flat.agg(F.avg("cells")).first()[0] or 0) <= TREE_VISITS:
        found = tree_found(assigned, cells, keys, flat.select("q1", "q2", "vec", "text_weight", "image_weight"), count, shape, keep, tile)
    elif mutual and count > tile and most_pairs_left(routed, sizes, group_of_cell):
        found = compare_mutually(routed, count, shape, keep, halves)
    else:
        found = compare_tiles(single_asks(routed) if mutual else routed, assigned, sizes, group_of_cell, shape, keep, tile, metric)
    others = F.slice(F.filter("best", lambda e: ~e["id"].eqNullSafe(F.col("self_id"))), 1, k)
    below = F.col("entry.below")
    return (
        keyed.select("query_id", "self_id", "q1", "q2")
        .join(merge_tiles(found, keep), ["q1", "q2"])
        .select("query_id", F.posexplode(others).alias("at", "entry"))
        .select(
            "query_id",
            (F.col("at") + 1).alias("rank"),
            F.col("entry.id").alias("id"),
            (F.lit(0.0) - below if METRICS[metric] else below).alias("score"),
        )
    )
