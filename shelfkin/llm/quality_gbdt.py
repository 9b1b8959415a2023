"""Quality scores by histogram gradient-boosted trees over statistics of the whole text.

The statistics are counts of kinds of bytes, of words, word sequences and lines; nothing
else about a document is looked at.  Trees are grown level by level from histograms of
gradients over binned statistics and kept as arrays (feature, threshold, value) of
complete binary trees, so that scoring is a few numpy look-ups per level for all rows of
a batch at once.

The model is fitted on the driver on at most ``TRAINING_ROWS`` labelled rows, chosen by
the hash of their id; all rows are scored on the executors in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, beside, encoded_texts

TRAINING_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5

TREES, DEPTH, BINS = 60, 4, 64
RATE, L2, LEAST_HESSIAN = 0.1, 1.0, 3.0

# Kinds of bytes: letters by case, digits, spaces, line ends, single marks, the rest, and UTF-8 beyond ASCII.
MARKS = b".,!?*#%&$|@:/-'\"()<>"
KINDS = np.full(256, 5, np.int64)
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[32], KINDS[10] = 0, 1, 2, 3, 4
KINDS[0x80:0xC0], KINDS[0xC0:] = 6, 7
for _k, _mark in enumerate(MARKS):
    KINDS[_mark] = 8 + _k
N_KINDS = 8 + len(MARKS)
PLAIN = [
    "log_words", "distinct_words", "top_word", "repeated_word", "longest_repeat", "distinct_trigrams", "bytes_a_word",
    "short_words", "long_words", "words_a_line", "distinct_lines", "top_line", "marked_words", "capital_words", "all_capitals",
    "distinct_half", "rarest_half",
]
FEATURES = [*PLAIN, *[f"kind_{k}" for k in range(N_KINDS)]]

STEP = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
SLICE_BYTES = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of stretches of a byte sequence, from one running sum over it."""
    n = len(data)
    powers = np.full(n, STEP)
    powers[:1] = 1
    np.cumprod(powers, out=powers)
    back = np.full(n, INVERSE)
    back[:1] = 1
    np.cumprod(back, out=back)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=total[1:])
    return _mixed((total[ends] - total[starts]) * back[starts])


def _shares(group: np.ndarray, h: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the commonest one in each group, as shares of its values; 0 without any."""
    ordered = np.sort((group.astype(np.uint64) << np.uint64(42)) | (h >> np.uint64(22)))
    cuts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
    of = (ordered[cuts] >> np.uint64(42)).astype(np.int64)
    size = np.maximum(1, np.bincount(group, minlength=groups))
    top = np.zeros(groups, np.int64)
    np.maximum.at(top, of, np.diff(np.r_[cuts, len(ordered)]))
    return np.bincount(of, minlength=groups) / size, top / size


def _statistics(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    first_byte = np.r_[0, np.cumsum(lengths + 1)]
    doc_of = np.repeat(np.arange(n), lengths + 1)
    kinds = np.bincount(doc_of * N_KINDS + KINDS[data], minlength=n * N_KINDS).reshape(n, N_KINDS)
    kinds[:, 4] -= 1  # the line end put between texts

    def stretches(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the stretches of marked bytes."""
        edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
        return edge[::2], edge[1::2], doc_of[edge[::2]]

    starts, ends, doc = stretches(~SPACES[data])
    size, h = ends - starts, _hashes(data, starts, ends)
    words = np.bincount(doc, minlength=n)
    some = np.maximum(1, words)

    def share(marked: np.ndarray) -> np.ndarray:
        return np.bincount(doc[marked], minlength=n) / some

    distinct, top = _shares(doc, h, n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    runs = np.flatnonzero(~same)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc[runs], np.diff(np.r_[runs, len(h)]))
    whole = np.flatnonzero(doc[2:] == doc[:-2])
    trigrams = _mixed((h[whole] * STEP + h[whole + 1]) * STEP + h[whole + 2])
    line_start, line_end, line_doc = stretches(data != 10)
    distinct_lines, top_line = _shares(line_doc, _hashes(data, line_start, line_end), n)
    place = np.arange(len(h)) - np.repeat(np.cumsum(words) - words, words)
    half = _shares(2 * doc + (2 * place >= words[doc]), h, 2 * n)[0].reshape(n, 2)
    capital = KINDS[data[starts]] == 1
    plain = [
        np.log1p(words), distinct, top, share(same), longest / some, _shares(doc[whole], trigrams, n)[0],
        np.bincount(doc, size, n) / some, share(size <= 3), share(size >= 14),
        words / np.maximum(1, np.bincount(line_doc, minlength=n)), distinct_lines, top_line,
        share(KINDS[data[ends - 1]] >= 8), share(capital), share(capital & (size > 1) & (KINDS[data[np.minimum(starts + 1, len(data) - 1)]] == 1)),
        half.max(axis=1), half.min(axis=1),
    ]
    return np.column_stack([*plain, kinds / np.maximum(1, lengths)[:, None]])


def features(texts: list[bytes]) -> np.ndarray:
    """The FEATURES of each text; an empty one has zeros only.  Texts are measured in slices of bounded size."""
    out, at, held = [np.empty((0, len(FEATURES)))], 0, 0
    for k, text in enumerate(texts):
        held += len(text) + 1
        if held >= SLICE_BYTES or k - at >= 100_000 or k == len(texts) - 1:
            out.append(_statistics(texts[at : k + 1]))
            at, held = k + 1, 0
    return np.concatenate(out)


@dataclass
class Trees:
    """Complete binary trees in arrays: (trees, inner nodes) features and thresholds, (trees, leaves) values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, all rows walking down one level of a tree at a time."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(self.value.shape[1]).bit_length() - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Boosted trees for the log loss; without rows or with one class only the base rate is left."""
    n = len(y)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(rate / (1 - rate)))
    inner, leaves = 2**depth - 1, 2**depth
    if not n or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)])
    score = np.full(n, base)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 2**level
            local = at - (nodes - 1)
            best = np.full(nodes, 1e-6)
            best_bin = np.full(nodes, bins)
            best_feature = np.zeros(nodes, np.int64)
            for f in range(width):
                key = local * bins + binned[f]
                gs = np.cumsum(np.bincount(key, g, nodes * bins).reshape(nodes, bins), axis=1)
                hs = np.cumsum(np.bincount(key, h, nodes * bins).reshape(nodes, bins), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                gain[(hs < LEAST_HESSIAN) | (ht - hs < LEAST_HESSIAN)] = -np.inf
                gain[:, len(edges[f]) :] = -np.inf
                b = gain.argmax(axis=1)
                top = gain[np.arange(nodes), b]
                won = top > best
                best[won], best_bin[won], best_feature[won] = top[won], b[won], f
            for k in range(nodes):
                if best_bin[k] < bins:
                    feature[nodes - 1 + k] = best_feature[k]
                    threshold[nodes - 1 + k] = edges[best_feature[k]][best_bin[k]]
            right = binned[best_feature[local], np.arange(n)] > best_bin[local]
            at = 2 * at + 1 + right
        leaf = at - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        score += value[leaf]
        out.append((feature, threshold, value))
    return Trees(*[np.stack(part) for part in zip(*out, strict=True)], base)


def fold_of(key) -> F.Column:
    """The fold of an id: the checksum of its decimal text modulo FOLDS; null counts as fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS, F.lit(0))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAINING_ROWS) -> Trees:
    """Fit on labelled rows whose fold is not 0, at most about ``rows`` of them.

    Rows are taken by the hash of their id, so the choice does not depend on order or
    partitions.  Null ids, null labels and labels without a document are left out; of
    several labels of an id the smallest counts.
    """
    known = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(fold_of(F.col("id")) != 0).groupBy("id").agg(F.min("y").alias("y"))
    total = known.count()
    if total > rows:
        # The share is a little smaller than rows / total, which keeps the bound.
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * (rows - 3 * rows**0.5) / total))
    sample = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "id")
    measured = append_columns(sample, [T.StructField("x", T.ArrayType(T.DoubleType()))], _measure).select("id", "y", "x")
    found = measured.toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    x = np.array(found["x"].combine_chunks().flatten() if found.num_rows else []).reshape(found.num_rows, len(FEATURES))
    order = np.lexsort([*x.T[::-1], found["id"].to_numpy()]) if len(x) else np.empty(0, np.int64)
    return fit_trees(x[order], found["y"].to_numpy().astype(float)[order])


def _measure(batch: pa.RecordBatch) -> list[pa.Array]:
    x = features(encoded_texts(batch, "text"))
    return [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))]


def score_documents(df: DataFrame, model: Trees, text: str = "text", score: str = "score") -> DataFrame:
    """Append the score of each whole text; null counts as empty, which has a score too."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(model.scores(features(encoded_texts(batch, text))))]

    return append_columns(df, [T.StructField(score, T.DoubleType())], compute)


def keep_good(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose score reaches THRESHOLD, with their own columns only."""
    model = train(documents, labels, key, text)
    return beside(documents, ["score"], lambda df: score_documents(df, model, text).where(F.col("score") >= THRESHOLD))
