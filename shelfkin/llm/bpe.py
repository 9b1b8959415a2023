"""Byte-level BPE, encoded by speculation: propose, verify, and merge only what fails.

A chunk is a stretch of text that no token can cross (white space before a word belongs
to the word).  For chunks not met before,

1. greedy longest match proposes tokens,
2. one vectorised check tests every adjacent pair of all proposals: a pair is compatible
   if the merges, applied in their order to the joined bytes of both, never cross the
   border between them.  Tokens whose adjacent pairs are all compatible are what exact
   merging gives,
3. chunks with a failing pair are merged exactly.

Decoding joins the bytes of the tokens and replaces what is not UTF-8.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, lists, texts

NEVER = np.iinfo(np.int64).max
CACHED_CHUNKS = 200_000
LONG_WORD = 64
STRETCH = 250_000

# White space by Unicode; the space itself is handled apart.
OTHER_SPACES = "\t\n\x0b\x0c\r\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
WIDE_SPACE = re.compile("[\x85" + OTHER_SPACES[6:] + "] ")
# The contractions and classes by which this vocabulary splits texts.
SIMPLE_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNICODE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Beyond these characters the classes of ``re`` and of Unicode may differ.
UNUSUAL = re.compile("[^\t\n\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """Vocabulary, merges and the tables of the pair check; one per worker process."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        bytes_of = byte_characters()
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for word, i in vocab.items():
            if word not in special:
                self.token_bytes[i] = bytes(bytes_of[c] for c in word)
        self.special = special
        for word, i in special.items():
            self.token_bytes[i] = word.encode()
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.id_of = {b: i for i, b in enumerate(self.token_bytes) if b and i not in set(special.values())}
        # The longest token that begins with up to three given bytes.
        self.longest: dict[bytes, int] = {}
        for b in self.id_of:
            for n in range(1, 4):
                self.longest[b[:n]] = max(self.longest.get(b[:n], 1), len(b) if n == 3 else min(n, len(b)))
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.size, self.made = size, made
        self.byte_ids = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        self.rank_of = {(a, b): (k, m) for k, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))}
        keys = left * size + right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self._edges(left, right, made)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.decimal = [str(i) for i in range(size)]
        self.stats = {"chunks": 0, "merged": 0}

    def _edges(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        """For every token the tokens that its first and last byte grow through, with their ranks."""
        made_at = np.full(self.size, -1, np.int64)
        made_at[made] = np.arange(len(made))
        starts, ends = [[i] for i in range(self.size)], [[i] for i in range(self.size)]
        for a, b, m in zip(left.tolist(), right.tolist(), made.tolist(), strict=True):
            starts[m], ends[m] = [*starts[a], m], [*ends[b], m]
        width = max(map(len, starts + ends)) + 1

        def grown(paths: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
            token, rank = np.zeros((self.size, width), np.int64), np.full((self.size, width), NEVER)
            for i, path in enumerate(paths):
                token[i, : len(path)] = path
                rank[i, : len(path)] = made_at[path]
            return token, rank

        self.starts, self.starts_rank = grown(starts)
        self.ends, self.ends_rank = grown(ends)
        self.sound = np.ones(self.size, bool)
        inner = self._open_border(left, right)
        for a, b, m, ok in zip(left.tolist(), right.tolist(), made.tolist(), inner.tolist(), strict=True):
            self.sound[m] = ok and self.sound[a] and self.sound[b]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def _open_border(self, a: np.ndarray, b: np.ndarray, last: bool = False) -> np.ndarray:
        """Whether no merge crosses the border before both sides are whole (``last``: nor after).

        Merges happen in rising rank, the leftmost of equal ones first.  The tokens at
        the border grow along ``ends[a]`` and ``starts[b]``; a merge across the border
        happens if it ranks before the next step of the left side and not after the
        next step of the right side.
        """
        good = np.ones(len(a), bool)
        open_, i, j = np.arange(len(a)), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(open_):
            x, y = a[open_], b[open_]
            across = self._rank(self.ends[x, i], self.starts[y, j])
            next_left, next_right = self.ends_rank[x, i + 1], self.starts_rank[y, j + 1]
            whole = (next_left == NEVER) & (next_right == NEVER)
            crossed = (across < next_left) & (across <= next_right) & (across != NEVER) & (last | ~whole)
            good[open_[crossed]] = False
            go = ~crossed & ~whole
            step_left = next_left <= next_right
            i, j, open_ = (i + step_left)[go], (j + ~step_left)[go], open_[go]
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether exact merging of the joined bytes of two tokens gives these two tokens."""
        return self._open_border(a, b, last=True)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        get, longest = self.id_of.get, self.longest.get
        if (token := get(word)) is not None:
            return [token]
        out, at, n = [], 0, len(word)
        while at < n:
            # Without a token of three bytes here, two or one are left to try.
            end = at + longest(word[at : at + 3], 2)
            while (token := get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = at + len(self.token_bytes[token]) if end > n else end
        return out

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging: each round applies the lowest, leftmost merge of every word at once."""
        if not words:
            return []
        out: list[list[int]] = [[] for _ in words]
        long = [k for k, w in enumerate(words) if len(w) > LONG_WORD]
        for k in long:
            out[k] = self.merge_long(words[k])
        short = [k for k, w in enumerate(words) if len(w) <= LONG_WORD]
        if not short:
            return out
        lengths = np.fromiter((len(words[k]) for k in short), np.int64, len(short))
        of = np.repeat(np.array(short), lengths)
        token = self.byte_ids[np.frombuffer(b"".join([words[k] for k in short]), np.uint8)]
        rank = np.full(len(token), NEVER)
        inside = np.flatnonzero(of[1:] == of[:-1])
        rank[inside] = self._rank(token[inside], token[inside + 1])
        while len(token):
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(of)])
            ended = least == NEVER
            if ended.any():
                done = np.repeat(ended, size)
                kept = token[done].tolist()
                cuts = np.cumsum(np.r_[0, size[ended]]).tolist()
                for k, i, j in zip(of[first[ended]].tolist(), cuts, cuts[1:], strict=False):
                    out[k] = kept[i:j]
                token, rank, of = token[~done], rank[~done], of[~done]
                least, size = least[~ended], size[~ended]
                if not len(token):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            at = at[np.r_[True, of[at[1:]] != of[at[:-1]]]]
            token[at] = self.made[rank[at]]
            stay = np.ones(len(token), bool)
            stay[at + 1] = False
            moved = at - np.arange(len(at))
            token, of, rank = token[stay], of[stay], rank[stay]
            near = np.r_[moved, moved[moved > 0] - 1]
            rank[near] = NEVER
            near = near[near + 1 < len(of)]
            near = near[of[near] == of[near + 1]]
            rank[near] = self._rank(token[near], token[near + 1])
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merging with a heap over a linked list: n log n for words of any length."""
        tokens = [self.id_of[word[k : k + 1]] for k in range(len(word))]
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = self.rank_of
        heap = [(r[0], k, tokens[k], tokens[k + 1]) for k in range(n - 1) if (r := rank_of.get((tokens[k], tokens[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            nxt = after[k]
            if tokens[k] != a or nxt >= n or tokens[nxt] != b:
                continue
            tokens[k] = rank_of[a, b][1]
            tokens[nxt] = -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if r := rank_of.get((tokens[k], tokens[after[k]])):
                    heapq.heappush(heap, (r[0], k, tokens[k], tokens[after[k]]))
            if before[k] >= 0 and (r := rank_of.get((tokens[before[k]], tokens[k]))):
                heapq.heappush(heap, (r[0], before[k], tokens[before[k]], tokens[k]))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words that no token crosses the ends of."""
        proposals = [self.propose(w) for w in words]
        lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(lengths.sum()))
        of = np.repeat(np.arange(len(words)), lengths)
        failed = np.zeros(len(words), bool)
        failed[of[~self.sound[flat]]] = True
        inside = np.flatnonzero(of[1:] == of[:-1])
        pairs, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        bad = ~self.compatible(pairs // self.size, pairs % self.size)[back]
        failed[of[inside[bad]]] = True
        failing = np.flatnonzero(failed).tolist()
        for k, exact in zip(failing, self.merge([words[k] for k in failing]), strict=True):
            proposals[k] = exact
        self.stats["chunks"] += len(words)
        self.stats["merged"] += int(failed.sum())
        return proposals

    def split(self, text: str) -> list[str]:
        """Pieces of a text by the pattern of the vocabulary."""
        return SIMPLE_SPLIT.findall(text) if not UNUSUAL.search(text) else _unicode_split().findall(text)

    def learn(self, chunks: set[str]) -> None:
        """Fill the cache with the ids (little-endian 32-bit integers) of chunks."""
        new = list(chunks)
        # A word of plain letters is one piece; other pieces are chunks that may be known.
        pieces = [[c] if c[1:].isalpha() and c.isascii() and (c[0] == " " or c[0].isalpha()) else self.split(c) for c in new]
        cache = self.cache
        distinct = list({p for ps in pieces for p in ps if p not in cache})
        ids = self.encode_words([p.encode() for p in distinct])
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) * 4).tolist()
        flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        cache.update({p: flat[i:j] for p, i, j in zip(distinct, [0, *ends], ends, strict=False)})
        get = cache.__getitem__
        for chunk, ps in zip(new, pieces, strict=True):
            if len(ps) > 1:
                cache[chunk] = b"".join(map(get, ps))

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library encodes it without adding special tokens.

        Texts are taken a few at a time, so that what the first ones bring is known to the next.
        """
        out, at, held = [], 0, 0
        for k, text in enumerate(batch):
            held += len(text)
            if held >= STRETCH or k == len(batch) - 1:
                out += self._encode(batch[at : k + 1])
                at, held = k + 1, 0
        return out

    def _encode(self, batch: list[str]) -> list[np.ndarray]:
        if len(self.cache) > CACHED_CHUNKS:
            # What is met again comes back from the older half.
            self.older, self.cache = self.cache, {}
        get, older = self.cache.get, self.older
        known: list[list[bytes | None]] = []
        missing: list[tuple[list[bytes | None], int, str]] = []
        for text in batch:
            parts = self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]
            row: list[bytes | None] = []
            for part in parts:
                if part in self.special:
                    row.append(np.array([self.special[part]], "<u4").tobytes())
                    continue
                chunks = self.chunks(part)
                found = list(map(get, chunks))
                if None in found:
                    base = len(row)
                    for k, ids in enumerate(found):
                        if ids is None:
                            chunk = chunks[k]
                            if (ids := older.get(chunk)) is not None:
                                found[k] = self.cache[chunk] = ids
                            else:
                                missing.append((row, base + k, chunk))
                row += found
            known.append(row)
        self.learn({chunk for _, _, chunk in missing})
        for row, k, chunk in missing:
            row[k] = self.cache[chunk]
        return [np.frombuffer(b"".join(row), "<u4") for row in known]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Cut before every space; where white space runs meet a space, the text is one chunk per piece.

        A single space between other characters always begins a token, so what lies
        between two of them can be encoded by itself.
        """
        if not text:
            return []
        if "  " in text or "\n " in text or "\t " in text or "\r " in text or "\x0b " in text or "\x0c " in text or (not text.isascii() and WIDE_SPACE.search(text)):
            return [p for p in (SIMPLE_SPLIT if not UNUSUAL.search(text) else _unicode_split()).findall(text)]
        first, *rest = text.split(" ")
        return [*([first] if first else []), *[" " + r for r in rest]]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(1)
def _unicode_split():
    import regex

    return regex.compile(UNICODE_SPLIT)


@lru_cache(4)
def load(path: str) -> Bpe:
    """The tables of one vocabulary, once per process."""
    sys.setswitchinterval(0.005)
    return Bpe(path)


def encode_documents(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append the array of token ids of each whole text.

    Null and empty texts give an empty array; repeated rows stay; a column of ``df``
    named like ``ids`` is replaced; the order of rows does not matter.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        found = load(path).encode(texts(batch, text))
        return [lists(np.concatenate([np.empty(0, np.int64), *found]).astype(np.int32), np.array([len(x) for x in found], np.int64))]

    return append_columns(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))], compute)


def decode_documents(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Append the text of an array of ids; bytes that are not UTF-8 become the replacement character.

    A null array gives an empty text.  An id outside the vocabulary is an error.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe, column = load(path), batch.column(batch.schema.get_field_index(ids))
        return [pa.array([bpe.decode(np.array(x or [], np.int64)) for x in column.to_pylist()], pa.string())]

    return append_columns(df, [T.StructField(decoded, T.StringType())], compute)


DIGEST_FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]


def round_trip_digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encode, decode, and append the token count and digests of the ids and of the decoded text.

    Both happen in one pass, so that the ids do not travel between two Python stages.
    Null texts count as empty; columns named like the new ones are replaced.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        bpe = load(path)
        found = bpe.encode(texts(batch, text))
        named = [hashlib.sha256(",".join(map(bpe.decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in found]
        plain = [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in found]
        return [pa.array([len(x) for x in found], pa.int64()), pa.array(named, pa.string()), pa.array(plain, pa.string())]

    return append_columns(df, DIGEST_FIELDS, compute)
