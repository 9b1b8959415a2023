"""Candidates of one tile, found cheaply; exact scores are made for them only.

``least`` gives, for a block of queries and items, numbers that never exceed the negated
score by more than ``tolerance``: negated single-precision products for the cosine and the
dot product, distances from below for the others.  A pair whose number lies above what its
query is sure of cannot be among the best; every other pair is scored in double precision.
Blocks are small, so that their work areas stay in the cache and are used again.
Work of numpy on one tile, run inside Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ..functions.vectors import IMAGE_EPSILON
from .tiles import ROUNDING_SLACK, SLICE_CELLS, Shape, best_per_row, other_scores, parts_of, rounded, scores, unit_parts

BLOCK = (256, 2048)  # queries and items of a block
NARROW = (16, 8192)  # the same where a block takes a pass per number
SINGLE = 2.0**-24  # unit of rounding of single precision
LARGEST = 1e6  # rows beyond it are scored without a screen
SHORTEST = 1e-3  # images shorter than that are shifted by the epsilon of their cosine
FAR = 1e15  # stands for the distance to an item that lacks a part
CODES = 32767  # sums of steps that 16 bits hold
LEAST_STEPS = 128  # coarser steps are no screen
GATHERED = 8192  # pairs scored at once
MUTUAL = (512, 1024)  # rows of the two tables of a block that is searched from both sides
WORD = 8  # truth values looked at together


def plain(rows: np.ndarray, shape: Shape, metric: str) -> np.ndarray:
    """Rows that a screen is proven for: finite numbers of usual size, parts that are whole or absent."""
    ok = np.ones(len(rows), bool)
    for k, part in parts_of(shape):
        with np.errstate(invalid="ignore"):
            usual = (np.abs(rows[:, part]) <= LARGEST).all(axis=1)
        if metric == "cosine":
            length = np.linalg.norm(rows[:, part], axis=1)
            usual &= (length == 0) | (length >= SHORTEST)
        else:
            usual |= np.isnan(rows[:, part.start])
        ok &= usual
    return ok


def plain_weights(weights: np.ndarray) -> np.ndarray:
    return ((weights >= 0) & (weights <= 1e3)).all(axis=1)


def plain_sides(
    queries: np.ndarray, weights: np.ndarray, items: np.ndarray, shape: Shape, metric: str
) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Queries and items that make up all pairs: (True, ..) plain ones only, (False, ..) pairs with an odd row."""
    usable, common = plain(queries, shape, metric) & plain_weights(weights), plain(items, shape, metric)
    parts = [(True, usable, common), (False, ~usable, np.ones(len(items), bool)), (False, usable, ~common)]
    for plainly, some, of in parts:
        if some.any() and of.any():
            yield plainly, np.nonzero(some)[0], np.nonzero(of)[0]


class Screen:
    """Plain queries against plain items under one metric."""

    def __init__(self, queries: np.ndarray, weights: np.ndarray, items: np.ndarray, shape: Shape, metric: str):
        self.shape, self.metric = shape, metric
        self.weights = weights.astype(np.float64)
        self.tolerance = np.zeros(len(queries))
        self.queries, self.items = queries, items
        self.absent: tuple[dict[int, np.ndarray], dict[int, np.ndarray]] = {}, {}  # by part, queries and items without it
        if metric != "cosine":
            self.queries, self.items = np.array(queries), np.array(items)
            self.weights = self.weights.copy()
            for k, part in parts_of(shape):
                for rows, absent in ((self.queries, self.absent[0]), (self.items, self.absent[1])):
                    lacks = np.isnan(rows[:, part.start])
                    if metric == "dot_product":
                        lacks = np.isnan(rows[:, part]).any(axis=1)
                    rows[lacks, part] = 0.0
                    absent[k] = lacks
                # A part the query lacks adds nothing.
                self.weights[self.absent[0][k], k] = 0.0
        self.block = NARROW if metric == "manhattan" else BLOCK
        {"cosine": self._products, "dot_product": self._products, "euclidean": self._squares, "manhattan": self._steps}[metric]()

    def _products(self) -> None:
        shape, q, x = self.shape, self.queries, self.items
        if self.metric == "cosine":
            norms = [np.linalg.norm(rows[:, shape.text :], axis=1) for rows in (q, x)]
            q, x = unit_parts(q, shape), unit_parts(x, shape)
            self.units, self.norms = (q, x), norms
            some = norms[1][norms[1] > 0]
            if len(some):
                lengths = np.where(norms[0] > 0, norms[0] * some.min(), np.inf)
                self.tolerance += self.weights[:, 1] * IMAGE_EPSILON / (lengths + IMAGE_EPSILON)
        blended = np.hstack([q[:, : shape.text] * self.weights[:, :1], q[:, shape.text :] * self.weights[:, 1:]])
        longest = np.linalg.norm(x, axis=1).max(initial=0.0)
        self.tolerance += (shape.width + 8) * SINGLE * np.linalg.norm(blended, axis=1) * longest * 1.01 + 1e-12
        self.left, self.right = (-blended).astype(np.float32), np.ascontiguousarray(x.T, dtype=np.float32)

    def _squares(self) -> None:
        """Per part, w w (q - x)(q - x) as one product of rows with three numbers more, given from below."""
        self.sides = []
        for k, part in parts_of(self.shape):
            q, x = self.queries[:, part], self.items[:, part]
            lower = 1.0 - 2.0 * (part.stop - part.start + 16) * SINGLE * 1.01
            ones = np.ones((len(q), 1))
            left = np.hstack([-2.0 * q, (q * q).sum(axis=1, keepdims=True) * lower, ones]) * self.weights[:, k : k + 1] ** 2
            left = np.hstack([left, FAR * FAR * (self.weights[:, k : k + 1] > 0)])
            lacks = self.absent[1][k][:, None].astype(float)
            right = np.hstack([x, np.ones((len(x), 1)), (x * x).sum(axis=1, keepdims=True) * lower, lacks])
            self.sides.append((left.astype(np.float32), np.ascontiguousarray(right.T, dtype=np.float32)))

    def _steps(self) -> None:
        """Per part, numbers as whole steps; cut at the ends, which only brings pairs closer."""
        self.sides = []
        for k, part in parts_of(self.shape):
            q, x = self.queries[:, part], self.items[:, part]
            size = part.stop - part.start
            steps = CODES // size - 1
            low, high = np.quantile(x, [0.001, 0.999])
            step = max((high - low) / max(steps, 1), 1e-9)
            if steps < LEAST_STEPS:  # too long for 16 bits
                kind, step, low, steps, slack = np.float32, 1.0, 0.0, np.inf, 0.0
                ends = np.abs(q).sum(axis=1).max(initial=0.0) + np.abs(x).sum(axis=1).max(initial=0.0)
                slack = 2.0 * (size + 8) * SINGLE * ends
                codes = [rows.astype(kind) for rows in (q, x)]
            else:
                kind, slack = np.int16, float(size)
                codes = [np.clip(np.floor((rows - low) / step), 0, steps).astype(kind) for rows in (q, x)]
            self.sides.append((codes[0], np.ascontiguousarray(codes[1].T), step, slack, self.weights[:, k], self.absent[1][k]))

    def areas(self) -> list[np.ndarray]:
        m, n = min(self.block[0], len(self.queries)), min(self.block[1], len(self.items))
        return [np.empty(m * n, np.float32) for _ in range(2)] + [np.empty(m * n, np.int16) for _ in range(2)]

    def least(self, some: slice, of: slice, areas: list[np.ndarray]) -> np.ndarray:
        m, n = some.stop - some.start, of.stop - of.start
        out, other, *whole = (a[: m * n].reshape(m, n) for a in areas)
        if self.metric in ("cosine", "dot_product"):
            return np.matmul(self.left[some], self.right[:, of], out=out)
        for number, side in enumerate(self.sides):
            into = other if number else out
            if self.metric == "euclidean":
                np.matmul(side[0][some], side[1][:, of], out=into)
                np.sqrt(np.maximum(into, 0.0, out=into), out=into)
            else:
                self._steps_between(side, some, of, into, whole)
            if number:
                out += other
        return out

    def _steps_between(self, side: tuple, some: slice, of: slice, into: np.ndarray, whole: list[np.ndarray]) -> None:
        q, x, step, slack, weight, absent = side
        q, x = q[some], x[:, of]
        total, gap = whole if q.dtype == np.int16 else (into, np.empty_like(into))
        total.fill(0)
        for j in range(q.shape[1]):
            np.subtract(x[j], q[:, j, None], out=gap)
            np.abs(gap, out=gap)
            np.add(total, gap, out=total)
        counts = weight[some] > 0
        np.subtract(total, np.float32(slack), out=into)
        np.maximum(into, 0.0, out=into)
        into *= (weight[some] * step).astype(np.float32)[:, None]
        lacking = np.nonzero(absent[of])[0]
        if len(lacking):
            into[np.ix_(counts, lacking)] = FAR

    def exact(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Double-precision scores, not rounded, of pairs of rows."""
        out = np.empty(len(rows))
        for at in range(0, len(rows), GATHERED):
            some = slice(at, at + GATHERED)
            out[some] = self._exact(rows[some], cols[some])
        return out

    def _exact(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        score = np.zeros(len(rows))
        for k, part in parts_of(self.shape):
            weight = self.weights[rows, k]
            if self.metric == "cosine" and k == 0:
                score += weight * np.einsum("ij,ij->i", self.units[0][rows, part], self.units[1][cols, part])
                continue
            a, b = self.queries[rows, part], self.items[cols, part]
            if self.metric in ("cosine", "dot_product"):
                value = np.einsum("ij,ij->i", a, b)
                if self.metric == "cosine":
                    value /= self.norms[0][rows] * self.norms[1][cols] + IMAGE_EPSILON
                score += weight * value
                continue
            gap = a - b
            value = np.abs(gap).sum(axis=1) if self.metric == "manhattan" else np.sqrt(np.einsum("ij,ij->i", gap, gap))
            far = self.absent[1][k][cols] & (weight > 0)
            score = np.where(far, -np.inf, score - weight * value)
        return score

    def cap(self, floor: np.ndarray, some: slice) -> np.ndarray:
        """What ``least`` may be for a pair whose score reaches ``floor``."""
        return allowed(floor, self.tolerance[some])


def allowed(floor: np.ndarray, tolerance: np.ndarray | float) -> np.ndarray:
    need = ROUNDING_SLACK - floor + tolerance
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(need), need + 4e-6 * np.abs(need), need).astype(np.float32)


def blocks(length: int, size: int) -> Iterator[slice]:
    return (slice(at, min(at + size, length)) for at in range(0, length, size))


def pairs_within(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a block is true; few places are, so whole words without any are passed over."""
    flat = hit.ravel()
    if len(flat) % WORD:
        return np.divmod(np.flatnonzero(flat), hit.shape[1])
    words = np.flatnonzero(flat.view(np.uint64))
    word, place = np.nonzero(flat.reshape(-1, WORD)[words])
    return np.divmod(words[word] * WORD + place, hit.shape[1])


def best_pairs(
    rows: np.ndarray, cols: np.ndarray, value: np.ndarray, item_ids: np.ndarray, keep: int, count: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best of each of ``count`` rows, equal scores by item id."""
    order = np.lexsort((item_ids[cols], -value, rows))
    rows, cols, value = rows[order], cols[order], value[order]
    start = np.searchsorted(rows, np.arange(count))
    inside = np.arange(len(rows)) - start[rows] < keep
    return rows[inside], cols[inside], value[inside]


def screened_best(
    queries: np.ndarray, weights: np.ndarray, floor: np.ndarray, items: np.ndarray, item_ids: np.ndarray, shape: Shape, keep: int, metric: str
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and rounded scores of the ``keep`` best of plain queries among plain items.

    What a query has found so far is what it is sure of for the blocks that follow.
    """
    screen = Screen(queries, weights, items, shape, metric)
    areas, found = screen.areas(), []
    for some in blocks(len(queries), screen.block[0]):
        count = some.stop - some.start
        sure = np.array(floor[some], dtype=np.float64)
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for of in blocks(len(items), screen.block[1]):
            least = screen.least(some, of, areas)
            rows, cols = pairs_within(least <= screen.cap(sure, some)[:, None])
            crowded = np.nonzero(np.bincount(rows, minlength=count) > 16 * keep)[0]
            if len(crowded):
                # The exact scores of any keep items are something a query is sure of.
                first = np.argpartition(least[crowded], keep - 1, axis=1)[:, :keep]
                own = screen.exact(np.repeat(some.start + crowded, keep), of.start + first.ravel())
                sure[crowded] = np.maximum(sure[crowded], rounded(own).reshape(-1, keep).min(axis=1))
                rows, cols = pairs_within(least <= screen.cap(sure, some)[:, None])
            if not len(rows):
                continue
            cols += of.start
            value = rounded(screen.exact(some.start + rows, cols))
            best = best_pairs(*(np.concatenate(c) for c in zip(best, (rows, cols, value))), item_ids, keep, count)
            full = np.bincount(best[0], minlength=count) == keep
            worst = np.full(count, np.inf)
            np.minimum.at(worst, best[0], best[2])
            sure = np.where(full, np.maximum(sure, worst), sure)
        found.append((best[0] + some.start, best[1], best[2]))
    return tuple(np.concatenate(c) for c in zip(*found))


def best_of_tile(
    queries: np.ndarray,
    weights: np.ndarray,
    floor: np.ndarray,
    items: np.ndarray,
    item_ids: np.ndarray,
    shape: Shape,
    keep: int,
    metric: str = "cosine",
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_per_row`` of a whole tile pair.

    Plain rows go through a screen that scores candidates only; what
    involves a row with odd numbers is scored in full.
    """
    found = []
    for plainly, some, of in plain_sides(queries, weights, items, shape, metric):
        if plainly:
            rows, cols, value = screened_best(queries[some], weights[some], floor[some], items[of], item_ids[of], shape, keep, metric)
            found.append((some[rows], of[cols], value))
        else:
            found += _scored_in_full(queries, weights, floor, items, item_ids, shape, keep, metric, some, of)
    if len(found) == 1:
        return found[0]
    return best_pairs(*(np.concatenate(columns) for columns in zip(*found)), item_ids, keep, len(queries))


class Side:
    """What the rows of one of two tables have found in the other: their ``keep`` best, and the score each is sure of."""

    def __init__(self, floor: np.ndarray, other_ids: np.ndarray, keep: int, block: int):
        self.sure, self.other_ids, self.keep = np.array(floor, dtype=np.float64), other_ids, keep
        self.blocks = list(blocks(len(floor), block))
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.best, self.new = [none] * len(self.blocks), [[] for _ in self.blocks]

    def add(self, at: int, rows: np.ndarray, others: np.ndarray, value: np.ndarray) -> None:
        """Hits of block ``at``, sorted in once they are many; until then they only make no row surer."""
        self.new[at].append((rows, others, value))
        count = self.blocks[at].stop - self.blocks[at].start
        if sum(len(hits[0]) for hits in self.new[at]) >= self.keep * count:
            self.sort_in(at)

    def sort_in(self, at: int) -> None:
        some = self.blocks[at]
        count = some.stop - some.start
        best = best_pairs(*(np.concatenate(c) for c in zip(self.best[at], *self.new[at])), self.other_ids, self.keep, count)
        self.best[at], self.new[at] = best, []
        full = np.bincount(best[0], minlength=count) == self.keep
        worst = np.full(count, np.inf)
        np.minimum.at(worst, best[0], best[2])
        self.sure[some] = np.where(full, np.maximum(self.sure[some], worst), self.sure[some])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for at, new in enumerate(self.new):
            if new:
                self.sort_in(at)
        found = [(best[0] + some.start, best[1], best[2]) for some, best in zip(self.blocks, self.best)]
        return tuple(np.concatenate(c) for c in zip(*found))


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def screened_mutual(
    rows: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], shape: Shape, keep: int
) -> tuple[Found, Found]:
    """``screened_best`` by the cosine of plain rows among plain others, and of the others among the rows.

    A score is the same from both sides, so a block is made once.  The tolerance of a row holds
    for all its pairs; the others take the largest of them.
    """
    screen = Screen(rows[0], rows[1], others[0], shape, "cosine")
    loosest = screen.tolerance.max()
    left, right = Side(rows[2], others[3], keep, MUTUAL[0]), Side(others[2], rows[3], keep, MUTUAL[1])
    area = np.empty(min(MUTUAL[0], len(rows[0])) * min(MUTUAL[1], len(others[0])), np.float32)

    def hits(least: np.ndarray, some: slice, of: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        caps = allowed(left.sure[some], screen.tolerance[some]), allowed(right.sure[of], loosest)
        hit = least <= caps[0][:, None]
        hit |= least <= caps[1]
        i, j = pairs_within(hit)
        near = least[i, j]
        return i, j, near <= caps[0][i], near <= caps[1][j]

    def surer(side: Side, some: slice, least: np.ndarray, crowd: np.ndarray, score) -> None:
        """The exact scores of any ``keep`` others are something a row is sure of."""
        first = np.argpartition(least[crowd], keep - 1, axis=1)[:, :keep]
        own = rounded(score(np.repeat(crowd, keep), first.ravel())).reshape(-1, keep).min(axis=1)
        side.sure[some.start + crowd] = np.maximum(side.sure[some.start + crowd], own)

    for a, some in enumerate(left.blocks):
        for b, of in enumerate(right.blocks):
            m, n = some.stop - some.start, of.stop - of.start
            least = np.matmul(screen.left[some], screen.right[:, of], out=area[: m * n].reshape(m, n))
            i, j, mine, theirs = hits(least, some, of)
            crowds = [
                np.nonzero(np.bincount(x, minlength=size) > 16 * keep)[0] for x, size in ((i[mine], m), (j[theirs], n))
            ]
            if len(crowds[0]) or len(crowds[1]):
                if len(crowds[0]):
                    surer(left, some, least, crowds[0], lambda x, y: screen.exact(some.start + x, of.start + y))
                if len(crowds[1]):
                    surer(right, of, least.T, crowds[1], lambda y, x: screen.exact(some.start + x, of.start + y))
                i, j, mine, theirs = hits(least, some, of)
            if len(i):
                value = rounded(screen.exact(some.start + i, of.start + j))
                if mine.any():
                    left.add(a, i[mine], j[mine] + of.start, value[mine])
                if theirs.any():
                    right.add(b, j[theirs], i[theirs] + some.start, value[theirs])
    return left.found(), right.found()


def mutual_best(
    rows: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], shape: Shape, keep: int
) -> tuple[Found, Found]:
    """``best_of_tile`` by the cosine for both of two tables of (vectors, weights, floors, ids), all with the same weights."""
    tables = rows, others
    plainly = [plain(t[0], shape, "cosine") & plain_weights(t[1]) for t in tables]
    usable, odd = [np.nonzero(p)[0] for p in plainly], [np.nonzero(~p)[0] for p in plainly]
    found: tuple[list, list] = [], []
    if len(usable[0]) and len(usable[1]):
        both = screened_mutual(*(tuple(c[u] for c in t) for t, u in zip(tables, usable)), shape, keep)
        for k in (0, 1):
            found[k].append((usable[k][both[k][0]], usable[1 - k][both[k][1]], both[k][2]))
    for k in (0, 1):
        (vectors, weights, floor, _), (items, _, _, ids) = tables[k], tables[1 - k]
        for some, of in ((odd[k], np.arange(len(items))), (usable[k], odd[1 - k])):
            if len(some) and len(of):
                found[k].extend(_scored_in_full(vectors, weights, floor, items, ids, shape, keep, "cosine", some, of))
    return tuple(
        best_pairs(*(np.concatenate(c) for c in zip(*found[k])), tables[1 - k][3], keep, len(tables[k][0])) for k in (0, 1)
    )


def _scored_in_full(
    queries: np.ndarray, weights: np.ndarray, floor: np.ndarray, items: np.ndarray, item_ids: np.ndarray, shape: Shape, keep: int, metric: str,
    some: np.ndarray, of: np.ndarray,
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    step = max(1, SLICE_CELLS // len(of))
    found = []
    for at in range(0, len(some), step):
        part = some[at : at + step]
        if metric == "cosine":
            score = scores(queries[part], weights[part], items[of], shape)
        else:
            score = other_scores(metric, queries[part], weights[part], items[of], shape)
        rows, cols, value = best_per_row(score, item_ids[of], keep, floor[part])
        found.append((part[rows], of[cols], value))
    return found
