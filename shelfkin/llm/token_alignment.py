"""Alignment of two tokenizers over the same bytes, and how often their tokens meet.

Both tokenizers read space + text.  The cumulative byte ends of each are kept as a
dictionary from end to index; the keys both have, sorted, slice the two id lists into
groups, and each slice is expanded into the links of its overlapping tokens.

A space that follows no white space begins a new token in both vocabularies (checked when
they are loaded), so a text is aligned chunk by chunk and chunks met before are
remembered.  What links how often is counted over all documents in Spark.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfkin.session import materialize

from .bpe import byte_characters
from .common import append_columns, held, lists, texts

REMEMBERED = 200_000
ALIGNED_BYTES = 2 << 20  # of texts aligned at once
LONG_CHUNK = 64
ENCODED_TOGETHER = 64
# White space by any of the two rules; a space behind it may belong to the same token.
CHUNK = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) ")
LOOSE = re.compile(r"[\s\x1c-\x1f\x85] ")
ENDS_LOOSE = re.compile(r"[\s\x1c-\x1f\x85]\Z")
META = "▁"

LINK = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("times", T.IntegerType())])
FIELDS = [
    T.StructField("n_a", T.LongType()),
    T.StructField("n_b", T.LongType()),
    T.StructField("n_groups", T.LongType()),
    T.StructField("n_links", T.LongType()),
    T.StructField("groups", T.StringType()),
    T.StructField("links", T.ArrayType(LINK)),
]


def common_slices(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends both have, and for each the index behind it in either list."""
    at_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1), strict=True))
    at_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1), strict=True))
    common = sorted(at_a.keys() & at_b.keys())
    return tuple(np.array(x, np.int64) for x in (common, [at_a[e] for e in common], [at_b[e] for e in common]))


def slice_links(ends_a: np.ndarray, ends_b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slice, index in a, index in b) of tokens whose byte ranges overlap, by slice.

    A token alone on its side meets all of the other side; else both sides are walked.
    """
    first_a, first_b = np.r_[0, stop_a[:-1]].astype(np.int64), np.r_[0, stop_b[:-1]].astype(np.int64)
    size_a, size_b = stop_a - first_a, stop_b - first_b
    alone = np.flatnonzero((size_a == 1) | (size_b == 1))
    n = np.maximum(size_a, size_b)[alone]
    of = np.repeat(alone, n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    a = first_a[of] + np.where(size_a[of] > 1, step, 0)
    b = first_b[of] + np.where(size_b[of] > 1, step, 0)
    walked = []
    for k in np.flatnonzero((size_a > 1) & (size_b > 1)).tolist():
        i, j = int(first_a[k]), int(first_b[k])
        xs, ys = ends_a[i : stop_a[k]].tolist(), ends_b[j : stop_b[k]].tolist()
        x = y = 0
        while True:
            walked.append((k, i + x, j + y))
            if xs[x] == ys[y]:
                break
            if xs[x] < ys[y]:
                x += 1
            else:
                y += 1
    more = np.array(walked, np.int64).reshape(-1, 3)
    of, a, b = np.r_[of, more[:, 0]], np.r_[a, more[:, 1]], np.r_[b, more[:, 2]]
    order = np.argsort(of, kind="stable")
    return of[order], a[order], b[order]


class Aligner:
    """Two vocabularies and the chunks aligned so far; one per worker process."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        # A task has one core; threads of the library would only contend for it.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path_a, encoding="utf-8") as file:
            data = json.load(file)
        before = data.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or data.get("normalizer"):
            raise ValueError(f"{path_a} is not a plain byte-level vocabulary")
        self.first = Tokenizer.from_file(path_a)
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        bytes_of = byte_characters()
        vocab = data["model"]["vocab"]
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_a = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for word, i in vocab.items():
            self.bytes_a[i] = word.encode() if word in special else bytes(bytes_of[c] for c in word)
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any(META in p.lstrip(META) for p in pieces):
            raise ValueError(f"{path_b} has pieces that go on after a word has ended")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace(META, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.width, self.space = len(pieces), self.second.piece_to_id(META)
        numbers = range(max(len(self.bytes_a), self.width))
        self.decimal = np.array([[f"{i}{sign}" for i in numbers] for sign in ",|;"], object)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        # Per chunk: tokens of both, groups, links, and whether both give the text back.
        self.counts = np.zeros((0, 5), np.int64)
        self.uses = np.zeros(0, np.int64)
        self.rendered: list[str] = []
        self.begins = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Keep only the chunks that were met again lately."""
        stay = np.flatnonzero(self.uses > 1)
        if len(stay) > REMEMBERED // 2:
            stay = stay[np.argsort(-self.uses[stay], kind="stable")[: REMEMBERED // 2]]
            stay.sort()
        names = list(self.known)
        n = np.diff(self.begins)[stay]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.pairs = self.pairs[np.repeat(self.begins[stay], n) + inside]
        self.begins = np.r_[0, np.cumsum(n)]
        self.counts = self.counts[stay]
        self.rendered = [self.rendered[k] for k in stay.tolist()]
        self.known = {names[k]: i for i, k in enumerate(stay.tolist())}
        self.uses = np.zeros(len(stay), np.int64)

    def chunks(self, text: str) -> list[str]:
        """Chunks of space + text, each without its first space."""
        return CHUNK.split(text) if LOOSE.search(text) or text[:1] == " " else text.split(" ")

    def learn(self, new: list[str]) -> None:
        """Align chunks and remember them."""
        # Behind white space, which only ends a text, a space begins no new token.
        loose = [c for c in new if ENDS_LOOSE.search(" " + c)]
        tight = [c for c in new if not ENDS_LOOSE.search(" " + c)] if loose else new
        new = tight + loose
        parts = [tight[k : k + ENCODED_TOGETHER] for k in range(0, len(tight), ENCODED_TOGETHER)] + [[c] for c in loose]
        firsts = np.r_[0, np.cumsum([len(p) for p in parts])].tolist()
        sound = np.ones(len(new), bool)
        joined = [" ".join(part) for part in parts]
        ids_a, ids_b = self._encode(joined)
        for k, text in enumerate(joined):
            if not self._same(text, ids_a[k], ids_b[k]):
                # Some chunk is not given back; the others are encoded by themselves.
                each = list(zip(*self._encode(parts[k]), strict=True))
                good = [self._same(c, *ids) for c, ids in zip(parts[k], each, strict=True)]
                sound[firsts[k] : firsts[k + 1]] = good
                ids_a[k] = [i for (a, _), ok in zip(each, good, strict=True) if ok for i in a]
                ids_b[k] = [i for (_, b), ok in zip(each, good, strict=True) if ok for i in b]
        # One list of tokens for all chunks: the ends of chunks are common ends.
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        common, stop_a, stop_b = common_slices(ends_a, ends_b)
        of, link_a, link_b = slice_links(ends_a, ends_b, stop_a, stop_b)
        length = np.fromiter((len(c.encode()) + 1 for c in new), np.int64, len(new))
        chunk_ends = np.cumsum(np.where(sound, length, 0))
        chunk_of = np.searchsorted(chunk_ends, common)
        links = np.bincount(chunk_of[of], minlength=len(new))
        counts = [np.bincount(np.searchsorted(chunk_ends, x), minlength=len(new)) for x in (ends_a, ends_b, common)]
        # Tokens in the order of their groups, each with the sign behind it.
        signs = np.empty(len(a) + len(b), object)
        slice_a, slice_b = np.searchsorted(stop_a, np.arange(len(a)), "right"), np.searchsorted(stop_b, np.arange(len(b)), "right")
        signs[np.arange(len(a)) + np.r_[0, stop_b][slice_a]] = self.decimal[np.where(np.arange(1, len(a) + 1) == stop_a[slice_a], 1, 0), a]
        signs[np.arange(len(b)) + stop_a[slice_b]] = self.decimal[np.where(np.arange(1, len(b) + 1) == stop_b[slice_b], 2, 0), b]
        signs, cuts = signs.tolist(), np.r_[0, np.cumsum(counts[0] + counts[1])].tolist()
        self.known.update(zip(new, range(len(self.rendered), len(self.rendered) + len(new)), strict=True))
        self.rendered += ["".join(signs[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
        self.counts = np.concatenate([self.counts, np.stack([*counts, links, sound], axis=1)])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(links)])
        self.pairs = np.concatenate([self.pairs, a[link_a] * self.width + b[link_b]])

    def _encode(self, batch: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of space + text of both tokenizers."""
        ids_a = [e.ids for e in self.first.encode_batch_fast([" " + t for t in batch], add_special_tokens=False)]
        # The model adds no space to an empty text, but there is one.
        return ids_a, [ids or [self.space] for ids in self.second.encode(batch, num_threads=1)]

    def _same(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether the tokens of both give space + text back."""
        whole = (" " + text).encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b))

    def align(self, batch: list[str], digest: bool = False) -> list[pa.Array]:
        """The columns of ``align`` for whole texts."""
        if len(self.known) > REMEMBERED:
            self.shrink()
        known = self.known
        split = [self.chunks(t) if t and META not in t else [] for t in batch]
        new = {c for row in split for c in row if c not in known}
        if new:
            self.learn(list(new))
        rows = [[known[c] for c in row] for row in split]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        of = np.repeat(np.arange(len(rows)), sizes)
        chunk = np.fromiter((c for row in rows for c in row), np.int64, int(sizes.sum()))
        self.uses += np.bincount(chunk, minlength=len(self.uses))
        broken = np.zeros(len(rows), bool)
        broken[of[self.counts[chunk, 4] == 0]] = True
        keep = ~broken[of]
        of, chunk = of[keep], chunk[keep]
        totals = [np.bincount(of, self.counts[chunk, c], len(rows)).astype(np.int64) for c in range(4)]
        rendered = self.rendered
        groups = ["" if bad else "".join([rendered[c] for c in row])[:-1] for row, bad in zip(rows, broken.tolist(), strict=True)]
        if digest:
            groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        # Every different chunk of a text once, with its times; then every different pair.
        different, times = np.unique(of * max(1, len(rendered)) + chunk, return_counts=True)
        of, chunk = np.divmod(different, max(1, len(rendered)))
        n = self.begins[chunk + 1] - self.begins[chunk]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        pair = self.pairs[np.repeat(self.begins[chunk], n) + inside]
        span = len(self.bytes_a) * self.width
        pairs, back = np.unique(np.repeat(of, n) * span + pair, return_inverse=True)
        count = np.bincount(back, np.repeat(times, n), len(pairs)).astype(np.int32)
        row, pair = np.divmod(pairs, span)
        a, b = np.divmod(pair, self.width)
        structs = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(count)], LINK.names)
        cuts = lists(a, np.bincount(row, minlength=len(rows))).offsets
        # Long chunks hardly occur again.
        if sum(len(c) for c in new if len(c) > LONG_CHUNK) > REMEMBERED * 8:
            self.forget()
        return [*map(pa.array, totals), pa.array(groups, pa.string()), pa.ListArray.from_arrays(cuts, structs)]


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(df: DataFrame, path_a: str, path_b: str, text: str = "text", digest: bool = False) -> DataFrame:
    """Add (n_a, n_b, n_groups, n_links, groups, links) to the rows of ``df``; no shuffle.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` (decimal ids in order, ``path_a`` the byte-level
    vocabulary, ``path_b`` the model of pieces); with ``digest`` its SHA-256 in lowercase
    hex stands in its place as ``groups_sha256``, empty without tokens.  ``links`` has
    every different linked id pair with the number of linked occurrences.

    Null and empty texts, and texts that either tokenizer does not give back byte for byte,
    have no tokens: zeros, an empty ``groups`` and no links.  Rows are aligned each by
    itself; columns of ``df`` named like a new one are replaced.
    """
    fields = [T.StructField("groups_sha256", T.StringType()) if digest and f.name == "groups" else f for f in FIELDS]
    return append_columns(df, fields, lambda batch: aligner(path_a, path_b).align(texts(batch, text), digest), limit=ALIGNED_BYTES)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(a, b, documents, best): how many rows hold a pair, and whether no pair of ``a`` is in more.

    A pair occurs at most once in a row's ``links``, and is counted before the shuffle, so
    a pair of every document is no bottleneck.
    """
    counts = linked.select(F.inline("links")).groupBy("a", "b").agg(F.count("*").alias("documents"))
    counts = materialize(counts, "pair-counts")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(most, "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def alignment_report(documents: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    ``n_best``: links whose pair is in as many documents as any pair of their A id;
    ``count_sum``: over links, the documents that hold their pair.  Every row counts as a
    document, also repeated ones and those without an id.
    """
    own = documents.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    aligned = align(own, path_a, path_b, "__text", digest=True).drop("__text").withColumn("__row", F.monotonically_increasing_id())
    stored = materialize(aligned, "token-alignment")
    counts = held(materialize(pair_counts(stored), "pair-table"))
    # Rows of a document lie together: sums are made before the shuffle.
    single = stored.select("__row", F.inline("links")).join(counts, ["a", "b"])
    sums = single.groupBy("__row").agg(
        F.sum(F.when(F.col("best"), F.col("times").cast("long")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("documents")).alias("count_sum"),
    )
    whole = stored.drop("links").join(sums, "__row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return whole.select(F.col("__key").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
