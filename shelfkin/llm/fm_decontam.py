"""Benchmark decontamination with an FM-index for every shard of the training texts.

A shard is a stretch of documents of bounded size inside one task.  Its words become
numbers of the benchmark's vocabulary.  A stretch of text that holds a window can only
consist of such words, so the index is built over runs of them that are long enough; all
other words cannot be hit and are only counted.

The index of a shard: suffix array by doubling, Burrows-Wheeler transform, a wavelet
matrix over it for ranks, and every ``SAMPLE``-th suffix position.  All windows are
searched backwards together; occurrences are located by stepping to the next sampled
position; their spans are merged per document.

The documents are read once and nothing is shuffled.  Windows are broadcast in blocks of
bounded size; a benchmark of more than one block takes one pass per block, and the spans
of all blocks are united per document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, beside, encoded_texts, pieces

WINDOW = 13
SAMPLE = 8
SHARD_BYTES = 16 << 20
BLOCK_WORDS = 1_000_000

# Bytes of words: digits, lower-case letters, and whatever is not ASCII.
WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in LOWER)

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
]


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Windows:
    """Distinct windows of benchmark items as numbers of their words, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words((text or "").encode())]
            for at in range(max(1, len(ids) - width + 1) if ids else 0):
                found.setdefault(tuple(ids[at : at + width]), set()).add(item)
        self.patterns = list(found)
        self.items = [sorted(found[p]) for p in self.patterns]
        self.lengths = np.array([len(p) for p in self.patterns], np.int64)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        self.matrix = np.zeros((len(self.patterns), max(map(len, self.patterns), default=0)), np.int64)
        for k, p in enumerate(self.patterns):
            self.matrix[k, : len(p)] = p


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with counts per bit of a symbol."""

    def __init__(self, values: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            counts = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=counts[1:])
            self.ones.append(counts)
            self.zeros.append(int(len(values) - counts[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        start = np.zeros_like(end)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            bit = ((symbol >> level) & 1).astype(bool)
            ones_start, ones_end = self.ones[k][start], self.ones[k][end]
            start = np.where(bit, self.zeros[k] + ones_start, start - ones_start)
            end = np.where(bit, self.zeros[k] + ones_end, end - ones_end)
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before it."""
        symbol, start, place = np.zeros_like(at), np.zeros_like(at), at
        for k in range(self.bits):
            ones = self.ones[k]
            bit = (ones[place + 1] - ones[place]).astype(bool)
            start = np.where(bit, self.zeros[k] + ones[start], start - ones[start])
            place = np.where(bit, self.zeros[k] + ones[place], place - ones[place])
            symbol = symbol * 2 + bit
        return symbol, place - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions sorted by what follows them, by doubling until no ties are left."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, reach = len(text), 1
    order = np.argsort(rank, kind="stable")
    while reach < n:
        second = np.zeros(n, np.int64)
        second[:-reach] = rank[reach:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        fresh = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        reach *= 2
        if fresh[-1] == n - 1:
            break
    return order


class FmIndex:
    """FM-index of a sequence of positive numbers."""

    def __init__(self, text: np.ndarray, largest: int):
        text = np.r_[text, 0]
        self.sa = suffix_array(text)
        bwt = text[self.sa - 1]
        self.before = np.cumsum(np.r_[0, np.bincount(bwt, minlength=largest + 1)])[:-1]
        self.wavelet = WaveletMatrix(bwt, largest)
        self.sampled = self.sa % SAMPLE == 0
        self.sample_rank = np.cumsum(np.r_[0, self.sampled])
        self.samples = self.sa[self.sampled]
        self.n = len(text)
        del self.sa

    def search(self, matrix: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern, by backward search of all at once."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        alive = np.arange(len(lengths))
        for step in range(1, matrix.shape[1] + 1):
            alive = alive[(lengths[alive] >= step) & (high[alive] > low[alive])]
            if not len(alive):
                break
            symbol = matrix[alive, lengths[alive] - step]
            low[alive] = self.before[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.wavelet.rank(symbol, high[alive])
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks, by walking back to a sampled position."""
        found, open_, place, steps = np.zeros(len(at), np.int64), np.arange(len(at)), at.copy(), 0
        while len(open_):
            hit = self.sampled[place]
            found[open_[hit]] = self.samples[self.sample_rank[place[hit]]] + steps
            open_, place, steps = open_[~hit], place[~hit], steps + 1
            symbol, count = self.wavelet.access(place)
            place = self.before[symbol] + count
        return found


def scan_shard(texts: list[bytes], windows: Windows) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Word counts, merged spans of hit words and items, for each text of a shard."""
    get = windows.vocabulary.get
    counts, parts = [], []
    for text in texts:
        split = words(text)
        counts.append(len(split))
        parts.append(np.fromiter((get(w, 0) for w in split), np.int64, len(split)))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if not windows.patterns or not texts:
        return counts, spans, items
    # Runs of known words, with a 0 after each document and where unknown words stood.
    flat = np.concatenate([x for p in parts for x in (p, np.zeros(1, np.int64))])
    first = np.cumsum([0, *[n + 1 for n in counts]])
    known = np.r_[False, flat > 0, False]
    starts, ends = np.flatnonzero(~known[:-1] & known[1:]), np.flatnonzero(known[:-1] & ~known[1:])
    long = ends - starts >= windows.shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return counts, spans, items
    size = ends - starts + 1
    run = np.repeat(np.arange(len(starts)), size)
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    source = starts[run] + offset
    largest = len(windows.vocabulary) + 1
    # The separator is the largest symbol: no window has it.
    text = np.where(offset == size[run] - 1, largest, flat[np.minimum(source, len(flat) - 1)])
    index = FmIndex(text, largest)
    low, high = index.search(windows.matrix, windows.lengths)
    many = np.maximum(0, high - low)
    pattern = np.repeat(np.arange(len(many)), many)
    at = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    begin = source[index.locate(at)]
    order = np.argsort(begin, kind="stable")
    begin, pattern = begin[order], pattern[order]
    of = np.searchsorted(first, begin, side="right") - 1
    begin = begin - first[of]
    if not len(of):
        return counts, spans, items
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(of)], strict=True):
        doc = int(of[i])
        spans[doc] = merge_spans(begin[i:j], begin[i:j] + windows.lengths[pattern[i:j]])
        items[doc] = sorted({x for p in np.unique(pattern[i:j]).tolist() for x in windows.items[p]})
    return counts, spans, items


def merge_spans(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Unite spans that overlap or touch; ``begin`` is sorted."""
    reach = np.maximum.accumulate(end)
    new = np.r_[True, begin[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(begin) - 1]
    return list(zip(begin[new].tolist(), reach[last].tolist(), strict=True))


def _blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """Benchmark items in blocks of about ``block_words`` words, one block on the driver at a time."""
    items = benchmark.select(F.col(f"`{item}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t"))
    total = items.agg(F.sum(F.size(F.split(F.coalesce("t", F.lit("")), r"\s+")))).first()[0] or 0
    n = max(1, -(-int(total) // block_words))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items
        yield [(r["i"] if r["i"] is not None else "", r["t"]) for r in block.collect()]


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Append ``n_words``, ``spans`` (hit words, as merged [start, end) word positions) and ``item_ids``.

    Null and empty texts have no words and no spans.  An item of fewer words than
    ``window`` is one window; an item without words is none; an item id that is null
    counts as the empty string; repeated items count once.  Repeated documents are each
    reported.  Columns of ``documents`` named like the new ones are replaced.
    """
    base = documents.drop(*[f.name for f in FIELDS])
    result = None
    for block in _blocks(benchmark, item, item_text, block_words):
        held = base.sparkSession.sparkContext.broadcast(block)
        found = base.mapInArrow(_scanner(held, text, window), T.StructType([*base.schema.fields, *FIELDS]))
        result = found if result is None else _united(result, found, base.columns)
    return result


def _scanner(held, text: str, window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(held.value, window)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for shard in pieces(batch, SHARD_BYTES):
                counts, spans, items = scan_shard(encoded_texts(shard, text), windows)
                dicts = [[{"start": a, "end": b} for a, b in s] for s in spans]
                new = [pa.array(counts, pa.int64()), pa.array(dicts, span), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*shard.columns, *new], names=[*shard.schema.names, *[f.name for f in FIELDS]])

    return run


def _united(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of two passes over the same documents, spans and items united; equal rows keep their number."""
    keys = [F.col(f"`{c}`") for c in columns]
    both = a.unionByName(b).withColumn("__key", F.xxhash64(*keys))
    rows = both.groupBy("__key", *keys, "n_words").agg(
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        (F.count("*") / 2).cast("int").alias("__n"),
    )
    merged = F.aggregate(
        F.array_sort("spans"),
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
        )).otherwise(F.concat(acc, F.array(s))),
    )
    return (
        rows.withColumn("spans", merged).withColumn("__i", F.explode(F.sequence(F.lit(1), "__n"))).select(*keys, "n_words", "spans", "item_ids")
    )


def contamination_report(found: DataFrame) -> DataFrame:
    """``find_contamination`` with counts, a digest of the item ids and the verdict.

    Contaminated: some word is hit, and the hit words are a twentieth of all or more.
    """
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return (
        found.withColumn("n_hit", hit)
        .withColumn("n_items", F.size("item_ids").cast("bigint"))
        .withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


REPORT = [*[f.name for f in FIELDS], "n_hit", "n_items", "items_sha256", "contaminated"]


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns only."""
    return beside(documents, REPORT, lambda df: contamination_report(find_contamination(df, benchmark)).where(~F.col("contaminated")))
