"""Cells of cells: the top-k join for more items than one level of pivots can tell apart.

The first level has a bounded number of root pivots, which every task holds.  Each root
cell draws leaf pivots among its own items by the hash of their content, one for about
CELL_ROWS of them, so a leaf keeps its size when the table grows.  Leaves never meet on
the driver: items are assigned and queries are routed root by root, in tiles, as joins.
A query carries the score it is sure of from level to level; a cell of either level is
skipped only below it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import tiles

MOST_LEAVES = 1024  # about, of one root cell
HASHES = 1 << 30
LEAF = "cell int, leaf long, vec array<double>"


def leaf_pivots(assigned: DataFrame, cells: tiles.Cells, root_keys: list[int], rows: int) -> DataFrame:
    """(cell, leaf, vec): the root pivot of every cell and a hashed share of its items.

    ``rows`` is the wanted size of a leaf; its name is the content hash of its pivot.
    """
    spark = assigned.sparkSession
    wanted = [min(MOST_LEAVES, math.ceil(n / rows)) / max(1, n) for n in cells.size.tolist()]
    shares = [(c, math.ceil(w * HASHES), k) for c, (w, k) in enumerate(zip(wanted, root_keys, strict=True))]
    # One row per root pivot.
    shares = F.broadcast(spark.createDataFrame(shares, "cell int, share long, root long"))
    chosen = (F.pmod("k1", F.lit(HASHES)) < F.col("share")) | (F.col("k1") == F.col("root"))
    return assigned.join(shares, "cell").filter(chosen).select("cell", F.col("k1").alias("leaf"), "vec").dropDuplicates(["cell", "leaf"])


def _in_tiles(left: DataFrame, right: DataFrame, keys: list[str], by: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``left`` dealt over tiles of about ``size`` within ``keys``, and ``right`` copied to each of them."""
    parts = left.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    dealt = left.join(parts, keys).withColumn("part", F.pmod(by, F.col("parts")).cast("int")).drop("parts")
    copied = right.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt, copied


def assign_leaves(assigned: DataFrame, leaves: DataFrame, shape: tiles.Shape, tile: int) -> DataFrame:
    """(k1, ids, vec, cell, leaf, gap, image_norm): items with the nearest leaf of their root cell."""
    items = assigned.select("k1", "ids", "vec", "cell", "image_norm")
    left, right = _in_tiles(items, leaves, ["cell"], "k1", tile)

    def assign(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        x, p = tiles.matrix(rows["vec"], shape.width), tiles.matrix(pivots["vec"], shape.width)
        near, gap = tiles.nearest_pivot(x, p, shape) if len(x) else (np.zeros(0, np.int64), np.zeros(0))
        leaf = tiles.numbers(pivots["leaf"])[near] if len(x) else np.zeros(0, np.int64)
        names = ["k1", "ids", "vec", "cell", "leaf", "gap", "image_norm"]
        columns = [rows["k1"], rows["ids"], rows["vec"], rows["cell"], pa.array(leaf, pa.int64()), pa.array(gap), rows["image_norm"]]
        return pa.Table.from_arrays(columns, names=names)

    fields = "k1 long, ids array<long>, vec array<double>, cell int, leaf long, gap double, image_norm double"
    return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(assign, fields)


def describe_leaves(placed: DataFrame, leaves: DataFrame, shape: tiles.Shape, tile: int) -> DataFrame:
    """(cell, leaf, vec, n, radius, least, group) of every leaf with members; a group is about one tile of items."""
    least = F.min(F.when(F.col("image_norm") > 0, F.col("image_norm")))
    stats = placed.groupBy("cell", "leaf").agg(
        F.count("*").alias("n"), (F.max("gap") + 1e-9).alias("radius"), F.coalesce(least, F.lit(float("inf"))).alias("least")
    )
    known = stats.join(leaves, ["cell", "leaf"]).select("cell", "leaf", "vec", "n", "radius", "least")

    def group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("leaf")
        return rows.append_column("group", pa.array(tiles.cell_groups(_cells(rows, shape), tile, shape), pa.int32()))

    return known.groupBy("cell").applyInArrow(group, f"{LEAF}, n long, radius double, least double, group int")


def _cells(rows: pa.Table, shape: tiles.Shape) -> tiles.Cells:
    return tiles.Cells(tiles.matrix(rows["vec"], shape.width), *(tiles.numbers(rows[c]) for c in ("radius", "least", "n")))


def route_to_leaves(visits: DataFrame, described: DataFrame, shape: tiles.Shape, keep: int, size: int) -> DataFrame:
    """Visits of root cells (q1, q2, vec, weights, floor, cell) as visits of groups of their leaves."""
    left, right = _in_tiles(visits, described, ["cell"], "q1", size)
    fields = "q1 long, q2 long, vec array<double>, text_weight double, image_weight double, floor double, cell int, group int"
    names = [f.split()[0] for f in fields.split(", ")]

    def route(asked: pa.Table, leaves: pa.Table) -> pa.Table:
        rows, groups, floors = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(len(asked))
        if len(asked) and len(leaves):
            known, group = _cells(leaves, shape), tiles.numbers(leaves["group"])
            x = tiles.matrix(asked["vec"], shape.width)
            weights = np.column_stack([tiles.numbers(asked[c]) for c in ("text_weight", "image_weight")])
            floors = np.maximum(tiles.numbers(asked["floor"]), tiles.cells_to_visit(x, weights, known, shape, keep)[1])
            reached = sum(tiles.score_span(x, weights, known, shape)) >= floors[:, None] - tiles.ROUNDING_SLACK
            query, leaf = np.nonzero(reached)
            pairs = np.unique(np.stack([query, group[leaf]], axis=1), axis=0)
            rows, groups = pairs[:, 0], pairs[:, 1].astype(np.int32)
        found = asked.select(names[:5]).take(pa.array(rows))
        columns = [*found.columns, pa.array(floors[rows]), asked["cell"].take(pa.array(rows)), pa.array(groups, pa.int32())]
        return pa.Table.from_arrays(columns, names=names)

    return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(route, fields)


def compare_leaves(routed: DataFrame, placed: DataFrame, described: DataFrame, tile: int, compare: Callable, fields: str) -> DataFrame:
    """Visitors and members of every group, cut into tiles, compared by ``compare``."""
    keys = ["cell", "group"]
    members = placed.join(described.select("cell", "leaf", "group"), ["cell", "leaf"]).select("k1", "ids", "vec", *keys)
    sizes = described.groupBy(*keys).agg(F.ceil(F.sum("n") / tile).cast("int").alias("item_tiles"))
    cuts = routed.groupBy(*keys).agg(F.ceil(F.count("*") / tile).cast("int").alias("query_tiles")).join(sizes, keys)
    left = routed.join(cuts, keys).withColumn("query_tile", F.pmod("q1", "query_tiles").cast("int"))
    left = left.withColumn("item_tile", F.explode(F.sequence(F.lit(0), F.col("item_tiles") - 1))).drop("item_tiles", "query_tiles")
    right = members.join(cuts, keys).withColumn("item_tile", F.pmod("k1", "item_tiles").cast("int"))
    right = right.withColumn("query_tile", F.explode(F.sequence(F.lit(0), F.col("query_tiles") - 1))).drop("item_tiles", "query_tiles", "k1")
    deal = [*keys, "item_tile", "query_tile"]
    return left.groupBy(*deal).cogroup(right.groupBy(*deal)).applyInArrow(compare, fields)


def tree_join(
    assigned: DataFrame, cells: tiles.Cells, root_keys: list[int], visits: DataFrame, shape: tiles.Shape, keep: int, tile: int, rows: int,
    compare: Callable, fields: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The comparisons of all visits, and (for figures) the leaves and the routed visits."""
    leaves = materialize(leaf_pivots(assigned, cells, root_keys, rows), "leaf-pivots")
    placed = materialize(assign_leaves(assigned, leaves, shape, tile), "leaf-items")
    described = materialize(describe_leaves(placed, leaves, shape, tile), "leaf-cells")
    routed = materialize(route_to_leaves(visits, described, shape, keep, tile), "leaf-visits")
    return compare_leaves(routed, placed, described, tile, compare, fields), described, routed
