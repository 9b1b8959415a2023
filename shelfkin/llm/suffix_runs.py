"""Periodic runs of words: suffix trees, constant-time extension and Lyndon roots.

A run is a stretch of words with smallest period ``q`` and at least ``max(6, 4 * q)``
words that no neighbouring word extends.  For the stretches of a text that can hold one,

1. Ukkonen's algorithm builds the suffix tree of the stretch and of its reversal,
2. an Euler tour of a tree, reduced to the shallowest node between neighbouring leaves,
   answers the longest common extension of two positions in constant time (a table of
   minima over ranges of lengths 1, 2, 4 ...),
3. the longest Lyndon word at every position, once for the order of the words and once
   for the reversed order, is a candidate root; every run has such a root,
4. a root is extended to both sides by one extension of each tree.

A stretch is left out only if it cannot hold a run: inside a run every four words
recur after at most ``q`` words, at ``3 * q - 3`` neighbouring positions or more (two or
more for ``q = 1``).  Most prose has no such place, so most words never enter a tree.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, encoded_texts

LEAST_WORDS = 6
LEAST_EXPONENT = 4
GRAM = 4
# Words of several stretches that share one pair of trees; a longer stretch has its own.
TREE_WORDS = 60_000

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
FIELDS = [
    T.StructField("n_runs", T.LongType()),
    T.StructField("runs", T.ArrayType(RUN)),
    T.StructField("best", RUN),
    T.StructField("collapsed", T.StringType()),
]


class SuffixTree:
    """Ukkonen's tree of a sequence whose last symbol occurs nowhere else.

    ``starts[v]`` and ``ends[v]`` bound the label of the edge into node ``v``; leaves
    have no children.
    """

    def __init__(self, symbols: list[int]):
        self.size = size = len(symbols)
        starts, ends, links, children = [0], [0], [0], [{}]
        node = edge = length = waiting = 0
        for i, symbol in enumerate(symbols):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                down = children[node]
                first = symbols[edge]
                child = down.get(first)
                if child is None:
                    down[first] = len(starts)
                    starts.append(i)
                    ends.append(size)
                    links.append(0)
                    children.append(None)
                    if unlinked:
                        links[unlinked] = node
                        unlinked = 0
                else:
                    label = ends[child] - starts[child]
                    if length >= label:
                        node, edge, length = child, edge + label, length - label
                        continue
                    at = starts[child] + length
                    if symbols[at] == symbol:
                        if unlinked:
                            links[unlinked] = node
                        length += 1
                        break
                    middle = len(starts)
                    starts += (starts[child], i)
                    ends += (at, size)
                    links += (0, 0)
                    children += ({symbols[at]: child, symbol: middle + 1}, None)
                    starts[child] = at
                    down[first] = middle
                    if unlinked:
                        links[unlinked] = middle
                    unlinked = middle
                waiting -= 1
                if not node and length:
                    length -= 1
                    edge = i - waiting + 1
                else:
                    node = links[node]
        self.starts, self.ends, self.children = starts, ends, children

    def tour(self, order: Callable[[tuple[int, int]], int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes from leaf to leaf, and the depth of the shallowest node passed before each.

        ``order`` sorts the children of a node, (symbol, node) pairs; by symbol if not given.
        """
        starts, ends, children, size = self.starts, self.ends, self.children, self.size
        suffixes, passed = [], []
        stack, low = [(0, 0)], 0
        while stack:
            node, depth = stack.pop()
            below = children[node]
            if depth < low:
                low = depth
            if below is None:
                suffixes.append(starts[node] - depth)
                passed.append(low)
                low = size
            else:
                depth += ends[node] - starts[node]
                stack.extend([(child, depth) for _, child in sorted(below.items(), key=order, reverse=True)])
        return np.array(suffixes, np.int64), np.array(passed, np.int64)


class Extensions:
    """Longest common extensions of pairs of positions, from one tour of a suffix tree."""

    def __init__(self, suffixes: np.ndarray, passed: np.ndarray):
        self.place = np.empty(len(suffixes), np.int64)
        self.place[suffixes] = np.arange(len(suffixes))
        self.least = [passed.astype(np.int32)]
        width = 1
        while 2 * width <= len(passed):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far two different positions have the same symbols."""
        x, y = self.place[a], self.place[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self.least[k]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k)])
        return out


def lyndon_lengths(place: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at every position: up to the next smaller suffix."""
    size = len(place)
    rank = place.tolist()
    out = np.zeros(size, np.int64)
    stack: list[int] = []
    for i in range(size - 1, -1, -1):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            stack.pop()
        out[i] = (stack[-1] if stack else size) - i
        stack.append(i)
    return out


def tree_runs(stretches: list[np.ndarray]) -> np.ndarray:
    """Rows (stretch, start, length, period) of the runs of each stretch, through one pair of trees.

    Stretches are joined by ends that differ from each other and sort before any word,
    so nothing is common beyond them.
    """
    sizes = [len(s) for s in stretches]
    joined = np.concatenate([np.r_[s, -1 - k] for k, s in enumerate(stretches)]).astype(np.int64)
    size = len(joined)
    words = joined.tolist()
    top = max(words) + 1
    tree = SuffixTree(words)
    forward = Extensions(*tree.tour())
    reversed_place = np.empty(size, np.int64)
    reversed_place[tree.tour(lambda x: x[0] if x[0] < 0 else top - x[0])[0]] = np.arange(size)
    del tree
    # The reversal ends with an end of its own.
    backward = Extensions(*SuffixTree([*words[-2::-1], -1 - len(stretches)]).tour())
    found = []
    for place in (forward.place, reversed_place):
        period = lyndon_lengths(place)
        at = np.flatnonzero((joined >= 0) & (np.arange(size) + period < size))
        period = period[at]
        right = forward(at, at + period)
        left = np.zeros(len(at), np.int64)
        inner = at > 0
        left[inner] = backward(size - 1 - at[inner], size - 1 - at[inner] - period[inner])
        length = left + period + right
        long = length >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * period)
        found.append(np.stack([at - left, length, period], axis=1)[long])
    rows = np.unique(np.concatenate(found), axis=0)
    begins = np.cumsum([0, *[n + 1 for n in sizes]])
    of = np.searchsorted(begins, rows[:, 0], side="right") - 1
    return np.column_stack([of, rows[:, 0] - begins[of], rows[:, 1], rows[:, 2]])


def possible_stretches(words: np.ndarray, begins: np.ndarray) -> list[tuple[int, int]]:
    """(first word, end) of every stretch that can hold a run; ``begins`` bounds the texts.

    Equal hashes of different words only add stretches.
    """
    if len(words) < LEAST_WORDS:
        return []
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    gram = text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(GRAM):
        gram[: len(words) - k] = (gram[: len(words) - k] ^ words[k:].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        gram ^= gram >> np.uint64(29)
    at = np.flatnonzero(np.arange(len(words)) + GRAM <= begins[1:][text])
    order = at[np.argsort(gram[at], kind="stable")]
    again = (gram[order[1:]] == gram[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    recurs = np.zeros(len(words), np.int64)
    recurs[order[:-1][again]] = (order[1:] - order[:-1])[again]
    place = np.flatnonzero(recurs)
    while len(place):
        first = np.flatnonzero(np.r_[True, np.diff(place) != 1])
        size = np.diff(np.r_[first, len(place)])
        each = np.repeat(size, size)
        good = (each > 1) & (recurs[place] <= each // 3 + 1)
        if good.all():
            ends = np.minimum(place[first] + size + GRAM - 1 + size // 3 + 1, begins[1:][text[place[first]]])
            return list(zip(place[first].tolist(), ends.tolist(), strict=True))
        place = place[good]
    return []


def find_runs(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) by text, start and period; words are numbers."""
    none = np.zeros((0, 4), np.int64)
    stretches = possible_stretches(words, begins)
    found, group, held = [none], [], 0
    for k, (start, end) in enumerate(stretches):
        group.append((start, end))
        held += end - start
        if held >= TREE_WORDS or k + 1 == len(stretches):
            rows = tree_runs([np.unique(words[i:j], return_inverse=True)[1] for i, j in group])
            rows[:, 1] += np.array([i for i, _ in group])[rows[:, 0]]
            found.append(rows)
            group, held = [], 0
    rows = np.concatenate(found)
    if not len(rows):
        return none
    text = np.searchsorted(begins, rows[:, 1], side="right") - 1
    start, length, period = rows[:, 1], rows[:, 2], rows[:, 3]
    # A run cut by the end of a stretch lies whole in the next stretch.
    low, end = begins[text], begins[text + 1]
    cut = (start > low) & (words[start - 1] == words[np.minimum(start - 1 + period, len(words) - 1)])
    cut |= (start + length < end) & (words[np.minimum(start + length, len(words) - 1)] == words[start + length - period])
    rows = np.column_stack([text, start - low, length, period])[~cut]
    rows = np.unique(rows, axis=0)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def word_runs(df: DataFrame, text: str = "text", key: str | None = None, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Add (n_runs, runs, best, collapsed) to the rows of ``df``; no shuffle.

    ``runs`` has every run by start, then period; ``best`` the one with the greatest
    length / period, null without a run; ``collapsed`` the words outside repetitions
    (a run keeps its first period) joined by one space.  Words are ``[^\\x20\\x09-\\x0D]+``.
    ``prepare`` may change the words of a row, given its ``key``.

    Null and empty texts have no runs and an empty ``collapsed``; repeated rows are
    handled each by itself; an empty table gives an empty one; columns of ``df`` named
    like a new one are replaced.  Texts of any length are taken whole: a stretch that
    may hold a run needs memory in proportion to its words.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist() if key else [None] * batch.num_rows
        rows = [t.split() for t in encoded_texts(batch, text)]
        if prepare:
            rows = [prepare(k, words) for k, words in zip(keys, rows, strict=True)]
        number: dict[bytes, int] = {}
        begins = np.cumsum([0, *map(len, rows)])
        words = np.fromiter((number.setdefault(w, len(number)) for r in rows for w in r), np.int64, int(begins[-1]))
        found = find_runs(words, begins)
        counts = np.bincount(found[:, 0], minlength=len(rows))
        cuts = np.r_[0, np.cumsum(counts)].tolist()
        values = [tuple(r) for r in found[:, 1:].tolist()]
        best = [longest(values[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
        # Words after the first period of a run are dropped.
        inside = np.zeros(len(words) + 1, np.int64)
        low = begins[found[:, 0]] + found[:, 1]
        np.add.at(inside, low + found[:, 3], 1)
        np.add.at(inside, low + found[:, 2], -1)
        stays = np.cumsum(inside)[:-1] == 0
        collapsed = []
        for k, r in enumerate(rows):
            if counts[k]:
                r = [w for w, stay in zip(r, stays[begins[k] : begins[k + 1]].tolist(), strict=True) if stay]
            collapsed.append(b" ".join(r).decode())
        kind = pa.struct([(c, pa.int64()) for c in RUN.names])
        structs = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], RUN.names)
        return [
            pa.array(counts.astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), structs),
            pa.array([dict(zip(RUN.names, b, strict=True)) if b else None for b in best], kind),
            pa.array(collapsed, pa.string()),
        ]

    return append_columns(df, FIELDS, compute)


def runs_digest(runs: str | Column = "runs") -> Column:
    """SHA-256 of ``start,length,period`` and a line end for every run."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return F.sha2(F.concat_ws("", F.transform(runs, lambda r: F.concat(line(r), F.lit("\n")))), 256)


def run_report(found: DataFrame) -> DataFrame:
    """Rows of ``word_runs`` with the best run as columns and digests in place of runs and text."""
    best = [F.col(f"best.{c}").alias(c) for c in RUN.names]
    best.append(F.expr("(1000 * best.length) div best.period").alias("exponent_milli"))
    rest = [F.col(f"`{c}`") for c in found.columns if c not in {f.name for f in FIELDS}]
    return found.select(*rest, "n_runs", *best, runs_digest().alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail in every tenth document, chosen by the crc32 of its id."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]
