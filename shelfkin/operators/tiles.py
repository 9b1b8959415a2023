"""Numpy work on one Arrow batch or one tile of vectors, run inside Spark tasks.

A vector row is the text part followed by the image part; a missing part is zeros.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..functions.vectors import IMAGE_EPSILON

DECIMALS = 6
ROUNDING_SLACK = 2e-6  # two scores this close may be equal after rounding
SLICE_CELLS = 2_000_000  # scores held at once, 16 MB
DISTANCE_CELLS, DISTANCE_ITEMS = 16_384, 4096  # a block of distances and its columns


@dataclass(frozen=True)
class Shape:
    text: int
    image: int

    @property
    def width(self) -> int:
        return self.text + self.image


@dataclass(frozen=True)
class Cells:
    """Pivot vectors and what is known of the items nearest to each of them."""

    pivots: np.ndarray  # raw vectors, one row per cell
    radius: np.ndarray  # largest distance of a member to its pivot, 0 for an empty cell
    least_image_norm: np.ndarray  # smallest non-zero image norm among the members
    size: np.ndarray  # number of members


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, width)


def numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False))


def parts_of(shape: Shape) -> list[tuple[int, slice]]:
    both = ((0, slice(0, shape.text)), (1, slice(shape.text, shape.width)))
    return [(k, s) for k, s in both if s.stop > s.start]


def unit_rows(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def unit_parts(rows: np.ndarray, shape: Shape) -> np.ndarray:
    return np.hstack([unit_rows(rows[:, : shape.text]), unit_rows(rows[:, shape.text :])])


def scores(queries: np.ndarray, weights: np.ndarray, items: np.ndarray, shape: Shape) -> np.ndarray:
    """Blended score, not rounded, of every query row against every item row."""
    out = np.zeros((len(queries), len(items)))
    if shape.text and weights[:, 0].any():
        text = unit_rows(queries[:, : shape.text]) @ unit_rows(items[:, : shape.text]).T
        out += weights[:, :1] * text
    if shape.image and weights[:, 1].any():
        a, b = queries[:, shape.text :], items[:, shape.text :]
        lengths = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        lengths += IMAGE_EPSILON
        image = np.nan_to_num(a @ b.T, nan=0.0)
        image /= np.where(np.isnan(lengths), 1.0, lengths)
        image *= weights[:, 1:]
        out += image
    return out


def distances(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Plain distances of all rows of ``a`` to all of ``b``, in blocks whose work areas stay in the cache."""
    out = np.zeros((len(a), len(b)))
    area = np.empty(DISTANCE_CELLS)
    for x in range(0, len(b), DISTANCE_ITEMS):
        columns = np.ascontiguousarray(b[x : x + DISTANCE_ITEMS].T)
        step = max(1, DISTANCE_CELLS // columns.shape[1])
        for at in range(0, len(a), step):
            rows = a[at : at + step]
            gap = area[: len(rows) * columns.shape[1]].reshape(len(rows), -1)
            total = np.zeros(gap.shape)
            for j in range(rows.shape[1]):
                np.subtract(rows[:, j, None], columns[j], out=gap)
                np.abs(gap, out=gap) if metric == "manhattan" else np.multiply(gap, gap, out=gap)
                total += gap
            out[at : at + step, x : x + DISTANCE_ITEMS] = total if metric == "manhattan" else np.sqrt(total, out=total)
    return out


def other_scores(metric: str, queries: np.ndarray, weights: np.ndarray, items: np.ndarray, shape: Shape) -> np.ndarray:
    """Blended value of another metric, distances negated so that larger is closer.

    A missing part is NaN here, to tell it from a vector of zeros.  It adds 0 to a
    similarity; in a distance an item without the part is infinitely far from a query
    that has it.
    """
    out = np.zeros((len(queries), len(items)))
    for number, part in enumerate((slice(0, shape.text), slice(shape.text, shape.width))):
        a, b = queries[:, part], items[:, part]
        if not a.shape[1] or not weights[:, number].any():
            continue
        if metric == "dot_product":
            value = a @ b.T
        else:
            value = -distances(metric, a, b)
        weight = weights[:, number, None]
        if metric != "dot_product":
            far = np.isnan(b[:, 0])[None, :] & ~np.isnan(a[:, 0])[:, None] & (weight > 0)
            value = np.where(np.isnan(value), 0.0, value)
            out += weight * value
            out[far] = -np.inf
        else:
            out += weight * np.nan_to_num(value, nan=0.0)
    return out


def rounded(score: np.ndarray) -> np.ndarray:
    return np.round(score, DECIMALS) + 0.0


def kth_best(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row, minus infinity where a row is shorter."""
    columns = score.shape[1]
    if columns < k:
        return np.full(len(score), -np.inf)
    return np.partition(score, columns - k, axis=1)[:, columns - k]


def best_per_row(
    score: np.ndarray, item_ids: np.ndarray, keep: int, floor: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and rounded scores of each row's ``keep`` best, equal scores by item id.

    ``floor`` is a score each row's answer is known to reach; where it leaves many
    candidates, the row's own k-th best cuts them down first.
    """
    candidates = score >= (floor - ROUNDING_SLACK)[:, None]
    crowded = np.nonzero(candidates.sum(axis=1) > 16 * keep)[0]
    if len(crowded):
        own = kth_best(np.where(np.isnan(score[crowded]), -np.inf, score[crowded]), keep)
        candidates[crowded] = score[crowded] >= (own - ROUNDING_SLACK)[:, None]
    rows, cols = np.nonzero(candidates)
    value = rounded(score[rows, cols])
    order = np.lexsort((item_ids[cols], -value, rows))
    rows, cols, value = rows[order], cols[order], value[order]
    start = np.searchsorted(rows, np.arange(len(score)))
    inside = np.arange(len(rows)) - start[rows] < keep
    return rows[inside], cols[inside], value[inside]


def nearest_pivot(items: np.ndarray, pivots: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Cell number and distance to its pivot, in the space of unit parts."""
    x, p = unit_parts(items, shape), unit_parts(pivots, shape)
    square = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2.0 * (x @ p.T)
    cell = square.argmin(axis=1)
    return cell, np.linalg.norm(x - p[cell], axis=1)


def cell_groups(cells: Cells, tile: int, shape: Shape) -> np.ndarray:
    """Group number per cell; a group holds about one tile of items."""
    return grouped_cells(cells.radius, cells.size, tile, lambda part, seeds: nearest_pivot(cells.pivots[part], cells.pivots[seeds], shape)[0])


def grouped_cells(radius: np.ndarray, size: np.ndarray, tile: int, nearest: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Cells join the nearest of a few of the pivots.

    Wide cells, which most queries have to visit, are kept among themselves, so that a
    visit to one does not drag in the tight cells around it.
    """
    wide = radius > 1.5 * np.median(radius[size > 0])
    group = np.zeros(len(size), dtype=np.int32)
    used = 0
    for part in (np.nonzero(~wide)[0], np.nonzero(wide)[0]):
        if len(part):
            seeds = min(len(part), math.ceil(max(1, size[part].sum()) / tile))
            group[part] = used + nearest(part, part[:seeds])
            used += seeds
    return group


def cells_to_visit(
    queries: np.ndarray, weights: np.ndarray, cells: Cells, shape: Shape, keep: int
) -> tuple[np.ndarray, np.ndarray]:
    """Per query, a mask of the cells that may hold one of its ``keep`` best items, and
    a score its answer is known to reach.

    With Q the weighted unit query, an item x of a cell with pivot p and radius r
    scores between Q.p - |Q| r and Q.p + |Q| r (Cauchy-Schwarz), give or take what the
    image epsilon can shift.  Two scores are surely reached by ``keep`` items: the
    keep-th best pivot, pivots being items themselves, and the lower bound of any cell
    with ``keep`` members.  A cell whose upper bound lies below them is skipped, and
    no other cell is.
    """
    middle, reach, shift = score_span(queries, weights, cells, shape)
    lowest = np.where(cells.size >= keep, middle - reach - shift, -np.inf).max(axis=1) - ROUNDING_SLACK
    floor = np.maximum(rounded(kth_best(scores(queries, weights, cells.pivots, shape), keep)), lowest)
    return (cells.size > 0) & (middle + reach + shift >= floor[:, None] - ROUNDING_SLACK), floor


def score_span(queries: np.ndarray, weights: np.ndarray, cells: Cells, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Q.p, |Q| r and what the image epsilon can shift, for every query and cell."""
    unit = unit_parts(queries, shape)
    unit[:, : shape.text] *= weights[:, :1]
    unit[:, shape.text :] *= weights[:, 1:]
    reach = np.linalg.norm(unit, axis=1)[:, None] * cells.radius[None, :]
    query_norm = np.linalg.norm(queries[:, shape.text :], axis=1)
    shift = np.zeros(reach.shape)  # a query or a cell without images shifts nothing
    lengths = np.outer(query_norm[query_norm > 0], cells.least_image_norm)
    shift[query_norm > 0] = IMAGE_EPSILON / (lengths + IMAGE_EPSILON)
    shift *= np.abs(weights[:, 1:])
    return unit @ unit_parts(cells.pivots, shape).T, reach, shift
