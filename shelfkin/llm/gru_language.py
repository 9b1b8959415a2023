"""Language of a text: a bidirectional gated recurrent network over its bytes.

The bytes of a text are cut into segments.  A gated recurrent layer reads each segment
from the front, another one from the back, and at every byte both states together give
a probability of every language: each position has a label.  The probabilities of a
document are the means over all its positions.

The network is trained in numpy by backpropagation through time, on segments of a bounded
sample of labelled documents.  All arrays have the positions last: (direction, state, segment).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, encoded_texts, held

FOLDS = 5
UNKNOWN = "und"
STATE = 8
SEGMENT = 128
BLOCK = 1024  # segments computed at once
# The training sample: documents of a language, and segments of a document, spread evenly.
DOCUMENTS = 500
SEGMENTS = 3
UPDATES = 200
BATCH = 96
RATE = 0.02
CLIP = 1.0
LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """Weights: ``table`` (2, 3H, 256) of a byte, ``state`` (2, 3H, H), ``inner`` (2, H, 1), ``out`` (C, 2, H), ``bias`` (C, 1).

    The three parts of 3H are the update gate, the reset gate and the candidate state.
    """

    languages: list[str]
    table: np.ndarray
    state: np.ndarray
    inner: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.state, self.inner, self.out, self.bias]


def new_network(languages: list[str], size: int = STATE, seed: int = 7) -> Network:
    draw = np.random.default_rng(seed)
    normal = lambda scale, *shape: (draw.standard_normal(shape) * scale).astype(np.float32)
    bias = np.zeros((len(languages), 1), np.float32)
    return Network(languages, normal(0.3, 2, 3 * size, 256), normal(size**-0.5, 2, 3 * size, size), np.zeros((2, size, 1), np.float32), normal(0.1, len(languages), 2, size), bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def both_ways(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(step, direction, segment): the bytes of segments from the front and from the back, then padding."""
    step = np.arange(int(lengths.max()))[:, None]
    inside = np.minimum(step, lengths - 1)
    return np.stack([buffer[starts + inside], buffer[starts + lengths - 1 - inside]], axis=1)


def gradients(net: Network, steps: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over positions and its gradients, by backpropagation through time."""
    count, _, width = steps.shape
    size = net.inner.shape[1]
    hidden = np.zeros((count + 1, 2, size, width), np.float32)
    gates = np.empty((count, 2, 2 * size, width), np.float32)
    candidate = np.empty((count, 2, size, width), np.float32)
    pushed = np.empty((count, 2, size, width), np.float32)
    for t in range(count):
        x = np.stack([net.table[d][:, steps[t, d]] for d in (0, 1)])
        from_state = net.state @ hidden[t]
        gates[t] = _sigmoid(x[:, : 2 * size] + from_state[:, : 2 * size])
        pushed[t] = from_state[:, 2 * size :] + net.inner
        candidate[t] = np.tanh(x[:, 2 * size :] + gates[t][:, size:] * pushed[t])
        hidden[t + 1] = candidate[t] + gates[t][:, :size] * (hidden[t] - candidate[t])
    # The state from the back at position i was reached at step length - 1 - i.
    at = np.arange(count)[:, None]
    valid = at < lengths
    mirror = np.where(valid, lengths - 1 - at, at)
    column = np.arange(width)[None]
    front, back = hidden[1:, 0].transpose(0, 2, 1), hidden[1:, 1].transpose(0, 2, 1)[mirror, column]
    both = np.concatenate([front, back], axis=2)
    flat_out = net.out.reshape(len(net.bias), -1)
    logits = both @ flat_out.T + net.bias[:, 0]
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    total = float(valid.sum())
    right = p[at, column, labels[None]]
    loss = float(-(np.log(right + 1e-9) * valid).sum() / total)
    d_logits = p
    d_logits[at, column, labels[None]] -= 1
    d_logits *= (valid / total)[:, :, None]
    flat = d_logits.reshape(-1, d_logits.shape[2])
    d_out = (flat.T @ both.reshape(-1, 2 * size)).reshape(net.out.shape)
    d_bias = flat.sum(axis=0)[:, None]
    d_both = d_logits @ flat_out
    d_front = d_both[:, :, :size].transpose(0, 2, 1)
    d_back = d_both[:, :, size:][mirror, column].transpose(0, 2, 1)
    carried = np.zeros((2, size, width), np.float32)
    d_state, d_inner = np.zeros_like(net.state), np.zeros_like(net.inner)
    d_steps = np.empty((count, 2, 3 * size, width), np.float32)
    for t in range(count - 1, -1, -1):
        d_hidden = carried + np.stack([d_front[t], d_back[t]])
        update, reset = gates[t][:, :size], gates[t][:, size:]
        d_candidate = d_hidden * (1 - update) * (1 - candidate[t] ** 2)
        d_update = d_hidden * (hidden[t] - candidate[t]) * update * (1 - update)
        d_reset = d_candidate * pushed[t] * reset * (1 - reset)
        d_pushed = d_candidate * reset
        d_steps[t] = np.concatenate([d_update, d_reset, d_candidate], axis=1)
        into_state = np.concatenate([d_update, d_reset, d_pushed], axis=1)
        d_state += into_state @ hidden[t].transpose(0, 2, 1)
        d_inner += d_pushed.sum(axis=2, keepdims=True)
        carried = d_hidden * update + net.state.transpose(0, 2, 1) @ into_state
    d_table = np.zeros_like(net.table)
    for d in (0, 1):
        byte = steps[:, d].ravel()
        order = np.argsort(byte, kind="stable")
        rows = d_steps[:, d].transpose(0, 2, 1).reshape(-1, 3 * size)[order]
        first = np.flatnonzero(np.r_[True, np.diff(byte[order].astype(np.int64)) != 0])
        d_table[d][:, byte[order][first]] = np.add.reduceat(rows, first, axis=0).T
    return loss, [d_table, d_state, d_inner, d_out, d_bias]


def fit(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, labels: np.ndarray, languages: list[str], size: int = STATE, updates: int = UPDATES, seed: int = 7) -> Network:
    """Train on segments of ``buffer``; steps follow running means of gradients and of their squares."""
    net = new_network(languages, size, seed)
    if len(languages) < 2 or not len(starts):
        return net
    draw = np.random.default_rng(seed)
    mean, square = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    order = np.zeros(0, np.int64)
    for done in range(1, updates + 1):
        while len(order) < min(BATCH, len(starts)):
            order = np.r_[order, draw.permutation(len(starts))]
        rows, order = order[:BATCH], order[BATCH:]
        grads = gradients(net, both_ways(buffer, starts[rows], lengths[rows]), lengths[rows], labels[rows])[1]
        norm = float(np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads)))
        rate = RATE * (1 - done / (updates + 1)) * (1 - 0.999**done) ** 0.5 / (1 - 0.9**done)
        for w, g, m, s in zip(net.weights(), grads, mean, square, strict=True):
            g = g * min(1.0, CLIP / (norm + 1e-9))
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            w -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    return net


def segments(lengths: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in the joined bytes, length) of the segments of every text, none left out."""
    parts = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), parts)
    inside = (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * size
    return text, (np.cumsum(lengths) - lengths)[text] + inside, np.minimum(size, lengths[text] - inside)


def position_sums(net: Network, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(language, segment): the sums of the probabilities of all positions; lengths must fall."""
    size, classes = net.inner.shape[1], len(net.languages)
    # Half the gates' input, so that one tangent serves all three parts.
    half = np.r_[np.full(2 * size, 0.5), np.ones(size)].astype(np.float32)[None, :, None]
    table, state = net.table * half, net.state * half
    steps = both_ways(buffer, starts, lengths)
    hidden = np.zeros((2, size, len(starts)), np.float32)
    logits = np.zeros((2, len(steps), classes, len(starts)), np.float32)
    for t, active in enumerate(np.searchsorted(-lengths, -np.arange(len(steps)), side="left").tolist()):
        h = hidden[:, :, :active]
        x = np.stack([table[d].take(steps[t, d, :active], axis=1) for d in (0, 1)])
        from_state = state @ h
        x[:, : 2 * size] += from_state[:, : 2 * size]
        gates = np.tanh(x[:, : 2 * size])
        gates *= 0.5
        gates += 0.5
        pushed = from_state[:, 2 * size :]
        pushed += net.inner
        pushed *= gates[:, size:]
        pushed += x[:, 2 * size :]
        np.tanh(pushed, out=pushed)
        h -= pushed
        h *= gates[:, :size]
        h += pushed
        for d in (0, 1):
            np.matmul(net.out[:, d], h[d], out=logits[d, t, :, :active])
    at = np.arange(len(steps))[:, None]
    valid = at < lengths
    whole = bool(valid.all())
    back = logits[1, ::-1] if whole else logits[1][np.where(valid, lengths - 1 - at, at)[:, None], np.arange(classes)[None, :, None], np.arange(len(starts))]
    p = logits[0] + back + net.bias
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    if not whole:
        p *= valid[:, None]
    return p.sum(axis=0)


def probabilities(net: Network, batch: list[bytes]) -> np.ndarray:
    """(text, language): mean probabilities over all bytes of each whole text; zeros for an empty one."""
    lengths = np.fromiter(map(len, batch), np.int64, len(batch))
    buffer = np.frombuffer(b"".join(batch), np.uint8)
    text, starts, sizes = segments(lengths)
    order = np.argsort(-sizes, kind="stable")
    total = np.zeros((len(net.languages), len(batch)))
    for at in range(0, len(order), BLOCK):
        rows = order[at : at + BLOCK]
        sums = position_sums(net, buffer, starts[rows], sizes[rows])
        for c, row in enumerate(sums):
            total[c] += np.bincount(text[rows], row, len(batch))
    return (total / np.maximum(lengths, 1)).T


def fold_of(key: Column) -> Column:
    """The checksum of the decimal text of an id modulo FOLDS; null counts as fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS, F.lit(0))


def train(documents: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", per_language: int = DOCUMENTS) -> Network:
    """Fit on documents with a language whose fold is not 0.

    The sample has at most ``per_language`` documents of each language, the first by the
    hash of their id and text, and of each at most SEGMENTS segments, so it grows with the number of
    languages only.  Documents without letters teach nothing and are left out.
    """
    own = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{language}`").alias("language"))
    known = own.where("id is not null and language is not null and text rlike '\\\\p{L}'").where(fold_of(F.col("id")) != 0)
    known = known.withColumn("content", F.xxhash64("text"))
    # Chosen without their texts; the limit is taken in every partition before rows of a language meet.
    first = Window.partitionBy("language").orderBy(F.xxhash64("id", "content"), "id", "content")
    chosen = known.select("language", "id", "content").withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_language)
    chosen = held(chosen.groupBy("language", "id", "content").agg(F.min("place").alias("place")))
    fields = [T.StructField("parts", T.ArrayType(T.BinaryType()))]
    cut = append_columns(known.join(chosen, ["language", "id", "content"]), fields, _spread_segments)
    rows = cut.groupBy("language", "place").agg(F.min("parts").alias("parts")).toArrow().sort_by([("language", "ascending"), ("place", "ascending")])
    names = rows["language"].to_pylist()
    languages = sorted(set(names))
    parts = rows["parts"].to_pylist()
    flat = [p for row in parts for p in row]
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    labels = np.repeat(np.searchsorted(np.array(languages, object), np.array(names, object)), [len(r) for r in parts]) if flat else np.zeros(0, np.int64)
    return fit(np.frombuffer(b"".join(flat), np.uint8), np.cumsum(lengths) - lengths, lengths, labels.astype(np.int64), languages)


def _spread_segments(batch: pa.RecordBatch) -> list[pa.Array]:
    out = []
    for t in encoded_texts(batch, "text"):
        n = -(-len(t) // SEGMENT)
        out.append([t[k * SEGMENT : (k + 1) * SEGMENT] for k in sorted({j * (n - 1) // max(1, SEGMENTS - 1) for j in range(SEGMENTS)})])
    return [pa.array(out, pa.list_(pa.binary()))]


def predict_language(df: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """Add (lang_pred, score) to the rows of ``df``, from whole texts; no shuffle.

    ``score`` is the mean probability of the predicted language.  Null and empty texts, texts without
    a letter, and all texts where nothing could be learned are ``und`` with score 0.  Equal
    probabilities go to the first language by name.  Repeated rows are alike; columns of ``df``
    named like a new one are replaced; texts are cut into segments, however long they are.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        whole = encoded_texts(batch, text)
        # A text of only one language to choose from still needs a letter.
        lettered = np.array([bool(net.languages) and LETTER.search(t.decode()) is not None for t in whole], bool)
        p = probabilities(net, [t if ok else b"" for t, ok in zip(whole, lettered, strict=True)]) if net.languages else np.zeros((len(whole), 1))
        best = p.argmax(axis=1) if len(whole) else np.zeros(0, np.int64)
        names = [net.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        score = np.where(lettered, np.clip(p[np.arange(len(whole)), best], 0.0, 1.0), 0.0)
        return [pa.array(names, pa.string()), pa.array(score, pa.float64())]

    return append_columns(df, fields, compute)


def language_report(documents: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) of every document; held out are those the network never saw."""
    net = train(documents, key, text, language)
    found = predict_language(documents.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")), net, "__text")
    return found.select(F.col("__key").alias(key), (fold_of(F.col("__key")) == 0).alias("held_out"), "lang_pred", "score")
