"""Proven bounds for cells of raw vectors under euclidean, manhattan and dot-product scores.

A cell is a pivot item and the items assigned to it.  Per part (text, image) it is known
how far its members lie from the pivot at most, how long they are at most, and how many
lack the part.  The triangle inequality bounds every distance from a query to a member by
its distance to the pivot give or take the radius; |q| times the radius and
|q| times the greatest length bound the dot product.  Work of numpy on one Arrow batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .tiles import ROUNDING_SLACK, Shape, distances, kth_best, other_scores, parts_of, rounded

GUARD = 1e-9  # relative allowance for the rounding of distances
MISMATCH = 1e30  # keeps items that lack a part away from pivots that have it


@dataclass(frozen=True)
class MetricCells:
    """Pivots, and per cell and part: greatest distance and length, and how many lack the part."""

    pivots: np.ndarray
    radius: np.ndarray  # (cells, 2)
    longest: np.ndarray  # (cells, 2)
    lacking: np.ndarray  # (cells, 2)
    size: np.ndarray

    @property
    def spread(self) -> np.ndarray:
        return self.radius.sum(axis=1)


def lacks(rows: np.ndarray, part: slice) -> np.ndarray:
    return np.isnan(rows[:, part.start])


def nearest_raw(items: np.ndarray, pivots: np.ndarray, shape: Shape) -> np.ndarray:
    """The nearest pivot by plain distance; any choice is right, a near one makes tight cells."""
    x, p = np.nan_to_num(items, nan=0.0), np.nan_to_num(pivots, nan=0.0)
    square = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2.0 * (x @ p.T)
    for _, part in parts_of(shape):
        square += MISMATCH * (lacks(items, part)[:, None] != lacks(pivots, part)[None, :])
    return square.argmin(axis=1)


def members(metric: str, items: np.ndarray, pivots: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cell, and per part the distance to its pivot, the length, and whether the part counts as absent."""
    cell = nearest_raw(items, pivots, shape)
    gap, length = np.zeros((len(items), 2)), np.zeros((len(items), 2))
    absent = np.zeros((len(items), 2), bool)
    for k, part in parts_of(shape):
        away = items[:, part] - pivots[cell][:, part]
        far = np.abs(away).sum(1) if metric == "manhattan" else np.linalg.norm(away, axis=1)
        own = np.linalg.norm(items[:, part], axis=1)
        # A number that is none makes a dot product 0, like a part that is missing.
        absent[:, k] = np.isnan(own) if metric == "dot_product" else lacks(items, part)
        gap[:, k] = np.where(absent[:, k], 0.0, np.where(np.isnan(far), np.inf, far))
        length[:, k] = np.where(absent[:, k], 0.0, own)
    return cell, gap, length, absent


def _span(low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest of weight times a value between the two; a weight of 0 is 0."""
    with np.errstate(invalid="ignore"):
        a, b = weight * low, weight * high
    off = np.broadcast_to(weight == 0, a.shape)
    return np.where(off, 0.0, np.minimum(a, b)), np.where(off, 0.0, np.maximum(a, b))


def score_bounds(metric: str, queries: np.ndarray, weights: np.ndarray, cells: MetricCells, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) score any member of a cell may have for a query."""
    lowest, highest = np.zeros((len(queries), len(cells.size))), np.zeros((len(queries), len(cells.size)))
    for k, part in parts_of(shape):
        weight = weights[:, k, None]
        q, p = queries[:, part], cells.pivots[:, part]
        some, every = cells.lacking[:, k] > 0, cells.lacking[:, k] >= cells.size
        radius, longest = cells.radius[None, :, k], cells.longest[None, :, k]
        if metric == "dot_product":
            middle, norm = q @ p.T, np.linalg.norm(q, axis=1)[:, None]
            whole = norm * longest * (1 + GUARD)
            with np.errstate(invalid="ignore"):
                reach = norm * radius + GUARD * (np.abs(middle) + norm * radius)
                low = np.fmax(middle - reach, -whole)
                high = np.fmin(middle + reach, whole)
            low = np.where(some | np.isnan(low), np.minimum(np.nan_to_num(low, nan=0.0), 0.0), low)
            high = np.where(some | np.isnan(high), np.maximum(np.nan_to_num(high, nan=0.0), 0.0), high)
            none = np.isnan(norm)[:, 0]
        else:
            d = distances(metric, q, p)
            with np.errstate(invalid="ignore"):
                guard = GUARD * (d + radius)
                low, high = np.maximum(d - radius - guard, 0.0), d + radius + guard
            unknown = np.isnan(low) | np.isnan(high)
            low, high = -np.where(unknown, np.inf, high), -np.where(unknown, 0.0, low)
            none = lacks(queries, part)
        low, high = _span(low, high, weight)
        if metric != "dot_product":
            # Lacking a part that the query has is infinitely far, if the part counts.
            far = (weight > 0) & ~none[:, None]
            low = np.where(some[None, :], np.where(far, -np.inf, np.minimum(low, 0.0)), low)
            high = np.where(every[None, :] & far, -np.inf, np.where(some[None, :] & ~far, np.maximum(high, 0.0), high))
        low[none], high[none] = 0.0, 0.0
        lowest += low
        # Members that lack a part are far whatever the other part says.
        with np.errstate(invalid="ignore"):
            highest = np.where(np.isneginf(highest) | np.isneginf(high), -np.inf, highest + high)
    return lowest, highest


def cells_in_reach(
    metric: str, queries: np.ndarray, weights: np.ndarray, cells: MetricCells, shape: Shape, keep: int
) -> tuple[np.ndarray, np.ndarray]:
    """Per query, a mask of the cells that may hold one of its ``keep`` best items, and a score it is sure of.

    Sure are the keep-th best pivot, pivots being items themselves, and the lowest
    score of any cell with ``keep`` members.
    """
    lowest, highest = score_bounds(metric, queries, weights, cells, shape)
    sure = np.where(cells.size >= keep, lowest, -np.inf).max(axis=1) - ROUNDING_SLACK
    floor = np.maximum(rounded(kth_best(other_scores(metric, queries, weights, cells.pivots, shape), keep)), sure)
    return (cells.size > 0) & (highest >= floor[:, None] - ROUNDING_SLACK), floor
