"""Near duplicates by b-bit MinHash.

1. One pass over the texts: the set of five-word shingles of a document gives a key of
   the set, 128 minima, their lowest four bits, mixed, packed as bit planes, and 48 hashed
   bands of four minima each: 32 of neighbours and 16 of minima far from each other.
   A pair with a similarity of 0.75 shares no band with a probability of about 1e-8.
2. Documents with equal sets are one node from here on, named by their smallest id.
3. Buckets are bands with two nodes or more.  Candidate pairs are judged by comparing bit
   planes: the share of equal places, less the share that agrees by chance, estimates
   the similarity.  Only pairs at five standard deviations below the threshold or
   better go on; for sets of fewer than 64 shingles, seven.  Simulated pairs of 4 to 40
   shingles at 0.75 spread as computed: 0.040 for 128 minima, 0.0141 for 1024.
4. First every node meets the leaders of its buckets; links are confirmed on the full
   sets and joined to components.  Then the members that a bucket's leader did not
   reach meet all other members of the bucket that are in another component, each pair
   in the first bucket that it shares.  Here 1024 minima, made for members of buckets
   only, sharpen the estimate, so that few pairs below the threshold are left to
   confirm.  Pairs inside a component are never formed: a group of copies costs one pair
   per copy, and no link between components is lost.  Rows of a hot bucket or leader
   are dealt over tiles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfkin.session import materialize

from .common import LOWER, append_columns, beside, encoded_texts, held, lists, pieces
from .components import components

WORDS = 5
PERCENT = 75
ROWS, BITS = 4, 4
PERMUTATIONS = 128
# Every minimum is in one band of neighbours; the first ones are dealt to further bands apart.
NEAR_BANDS, FAR_BANDS = PERMUTATIONS // ROWS, 16
BANDS = NEAR_BANDS + FAR_BANDS
PLANE_WORDS = PERMUTATIONS // 64
# Estimates that a pair must reach: five deviations of each signature below 0.75.
LEAST_SIMILARITY = 0.55
DEEP_WORDS = 16
DEEP_SIMILARITY = 0.679
# Sets of few shingles must reach estimates seven deviations below only: a chance below 1e-11.
FEW_SHINGLES, FEW_SIMILARITY, FEW_DEEP_SIMILARITY = 64, 0.47, 0.65
TILE = 1000  # rows of a hot key that are joined in one place
BLOCK = 1 << 16
SEED = 20240229

_random = np.random.default_rng(SEED)
FACTORS = (_random.integers(0, 2**31, PERMUTATIONS + 64 * DEEP_WORDS, np.int64) * 2 + 1).astype(np.uint32)
SHIFTS = _random.integers(0, 2**32, PERMUTATIONS + 64 * DEEP_WORDS, np.int64).astype(np.uint32)
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; fewer words make one shingle."""
    split = text.translate(LOWER).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    if not len(h):
        return h
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mixed(out * MIX + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def minima(sets: list[np.ndarray], first: int = 0, many: int = PERMUTATIONS) -> np.ndarray:
    """Minima of every set, none of them empty; blocks of shingles stay in the cache."""
    out = np.empty((len(sets), many), np.uint32)
    lengths = np.array([len(s) for s in sets], np.int64)
    block = np.cumsum(lengths) // BLOCK
    for b in np.unique(block):
        rows = np.flatnonzero(block == b)
        values = np.concatenate([sets[k] for k in rows])
        values = (values ^ (values >> np.uint64(32))).astype(np.uint32)
        starts = np.r_[0, np.cumsum(lengths[rows])[:-1]]
        for p in range(many):
            out[rows, p] = np.minimum.reduceat(values * FACTORS[first + p] + SHIFTS[first + p], starts)
    return out


def bit_planes(least: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of each mixed minimum, as BITS planes of bits in 64-bit words.

    Low bits of a product depend on low bits only; mixed, they depend on all of them.
    """
    least = (least ^ (least >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    least = (least ^ (least >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    least ^= least >> np.uint32(16)
    planes = [np.packbits((least >> k) & 1, axis=1, bitorder="little") for k in range(BITS)]
    return np.concatenate(planes, axis=1).view("<i8")


def band_places() -> np.ndarray:
    """The places of the minima of every band: ROWS neighbours, or ROWS places far from each other."""
    near = np.arange(PERMUTATIONS).reshape(NEAR_BANDS, ROWS)
    far = np.arange(PERMUTATIONS).reshape(ROWS, PERMUTATIONS // ROWS).T[:FAR_BANDS]
    return np.concatenate([near, far])


def band_hashes(least: np.ndarray) -> np.ndarray:
    """One hash for each band of ROWS minima, different for equal minima of other bands."""
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None], len(least), axis=0)
    grouped = least[:, band_places()].astype(np.uint64)
    for k in range(ROWS):
        out = _mixed(out * MIX + grouped[:, :, k])
    return out.view(np.int64)


SIGNED = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("set_key", T.BinaryType()),
    T.StructField("planes", T.ArrayType(T.LongType())),
    T.StructField("bands", T.ArrayType(T.LongType())),
]


def signatures(df: DataFrame, text: str = "text") -> DataFrame:
    """Append set size, key of the set, bit planes and band hashes; a text without words has null keys."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = [shingles(t) for t in encoded_texts(batch, text)]
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        least = minima([sets[k] for k in full])
        width = np.where(sizes > 0, 1, 0)
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return [
            pa.array(sizes),
            pa.array(keys, pa.binary()),
            lists(bit_planes(least).ravel(), width * PLANE_WORDS * BITS),
            lists(band_hashes(least).ravel(), width * BANDS),
        ]

    return append_columns(df, SIGNED, compute)


def estimated(a: Column, b: Column) -> Column:
    """Similarity estimated from bit planes, corrected for places that agree by chance."""
    different = F.lit(0)
    for w in range(PLANE_WORDS):
        word = F.lit(0).cast("bigint")
        for plane in range(BITS):
            at = plane * PLANE_WORDS + w
            word = word.bitwiseOR(a[at].bitwiseXOR(b[at]))
        different = different + F.bit_count(word)
    chance = 0.5**BITS
    return (1 - different / PERMUTATIONS - chance) / (1 - chance)


def deeply_estimated(a: Column, b: Column) -> Column:
    """The same from the deeper signatures."""

    def word(total: Column, w: Column) -> Column:
        planes = [a[w + p * DEEP_WORDS].bitwiseXOR(b[w + p * DEEP_WORDS]) for p in range(BITS)]
        return total + F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), planes))

    different = F.aggregate(F.sequence(F.lit(0), F.lit(DEEP_WORDS - 1)), F.lit(0), word)
    chance = 0.5**BITS
    return (1 - different / (64 * DEEP_WORDS) - chance) / (1 - chance)


def dealt(many: DataFrame, few: DataFrame, key: str, by: str, size: int = TILE, counted: DataFrame | None = None) -> DataFrame:
    """``many`` joined to ``few`` on ``key``, rows of a key with more than ``size`` dealt over tiles by ``by``.

    Every tile meets all rows of ``few``, so no pair is lost and no task has a whole hot key.
    Keys are counted in ``counted``, if given: a stored table with the rows of ``many`` or more.
    """
    hot = (many if counted is None else counted).groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("n")).where(F.col("n") > size)
    hot = held(hot.select("__hot", F.ceil(F.col("n") / size).cast("int").alias("__tiles")))
    tiles = F.coalesce("__tiles", F.lit(1))
    left = many.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__tile", F.pmod(F.xxhash64(by), tiles).cast("int"))
    right = few.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__tile", F.explode(F.sequence(F.lit(0), tiles - 1)))
    dropped = ["__hot", "__tiles"]
    return left.drop(*dropped).join(right.drop(*dropped), [key, "__tile"]).drop("__tile")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    both = dealt(dealt(pairs, right, "b", "a"), left, "a", "b", counted=pairs)
    return both.where(100 * common >= percent * union).select("a", "b").distinct()


def _sets(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set of shingle hashes, deeper bit planes) of the documents that name the given nodes."""
    chosen = documents.join(held(nodes), "node", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                sets = [shingles(t) for t in encoded_texts(part, "text")]
                full = [s for s in sets if len(s)]
                flat = np.concatenate([np.empty(0, np.uint64), *full]).view(np.int64)
                deep = bit_planes(minima(full, PERMUTATIONS, 64 * DEEP_WORDS)).ravel()
                sizes = np.array([len(s) for s in sets], np.int64)
                columns = [part.column(0), lists(flat, sizes), lists(deep, (sizes > 0) * DEEP_WORDS * BITS)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "set", "deep"])

    return chosen.mapInArrow(run, "node bigint, set array<bigint>, deep array<bigint>")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``documents``.

    ``component_id`` is the smallest key that links lead to.  A null or empty text, or
    one of white space, has no shingles and links with nothing.  A row with a null key
    links with nothing, has no component and is kept.  Rows with the same key count as
    one document.  No other column is read.
    """
    docs = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    signed = materialize(signatures(docs, "text").drop("text"), "minhash-signatures")
    usable = signed.where("doc is not null and set_key is not null")
    nodes = usable.groupBy("set_key").agg(F.min("doc").alias("node"), F.first("n_shingles").alias("n"), F.first("planes").alias("planes"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "minhash-nodes")

    in_bands = nodes.select(F.explode("bands").alias("band"), "node")
    shared = in_bands.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.min_by("node", F.xxhash64("node")).alias("any")).where("n > 1")
    members = in_bands.join(shared.drop("n"), "band")
    planes = nodes.select("node", "n", "planes")
    members = materialize(members.join(planes, "node"), "minhash-buckets")

    gate = lambda a, b, many, few: F.when(F.least(a, b) < FEW_SHINGLES, few).otherwise(many)
    alike = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    near = lambda x, y: estimated(F.col(f"planes{x}"), F.col(f"planes{y}")) >= gate(f"n{x}", f"n{y}", LEAST_SIMILARITY, FEW_SIMILARITY)
    leaders = members.select(F.explode(F.array("low", "high", "any")).alias("a"), F.col("node").alias("b"), "n", "planes").where("a <> b").distinct()
    of_leader = planes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("planes").alias("planes_a"))
    # Leaders of several buckets are counted more than once, which only makes more tiles.
    named = members.select(F.explode(F.array("low", "high", "any")).alias("a"))
    led = dealt(leaders, of_leader, "a", "b", counted=named)
    led = led.where(alike("n_a", "n") & near("_a", ""))
    first = materialize(led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "minhash-pairs")

    texts = docs.select(F.col("doc").alias("node"), "text")
    sets = materialize(_sets(texts, materialize(members.select("node").distinct(), "minhash-named")), "minhash-sets")
    links = materialize(_confirm(first, sets, percent), "minhash-links")
    reached = components(links, "minhash-components")

    placed = members.join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_leader = reached.select(F.col("node").alias("low"), F.col("component").alias("main"))
    placed = placed.join(of_leader, "low", "left").withColumn("main", F.coalesce("main", "low"))
    placed = materialize(placed.select("band", "node", "planes", "component", "main"), "minhash-placed")
    unreached = placed.where("component <> main").select("band").distinct()
    deep = sets.select("node", "deep").join(nodes.select("node", "n", "bands"), "node")
    placed = materialize(placed.join(unreached, "band", "left_semi").join(deep, "node"), "minhash-unreached")
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("node", "planes", "component", "bands", "deep", "n")]
    left = placed.where("component <> main").select("band", "main", *side("x"))
    right = placed.select("band", *side("y"))
    # A pair of two members outside the leader's component comes up twice: take it once.
    once = (F.col("component_y") == F.col("main")) | (F.col("node_x") < F.col("node_y"))
    in_first = F.array_intersect("bands_x", "bands_y")[0] == F.col("band")
    deeply = deeply_estimated(F.col("deep_x"), F.col("deep_y")) >= gate("n_x", "n_y", DEEP_SIMILARITY, FEW_DEEP_SIMILARITY)
    # A band that many unlike documents share is cut into tiles.
    met = dealt(left, right, "band", "node_x")
    across = met.where((F.col("component_x") != F.col("component_y")) & once & alike("n_x", "n_y") & in_first & near("_x", "_y") & deeply)
    second = across.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    second = materialize(second.join(first, ["a", "b"], "left_anti"), "minhash-pairs")
    all_links = links.unionByName(_confirm(second, sets, percent))
    found = materialize(components(all_links, "minhash-components"), "minhash-components")

    of_set = nodes.select("set_key", "node").join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    rows = signed.select("doc", "n_shingles", "set_key").join(of_set, "set_key", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return rows.select(F.col("doc").alias(key), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest key.

    Of rows that repeat a key one stays.  The columns of ``documents`` are returned.
    """
    found = near_duplicates(documents, key, text).where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("doc")).agg(F.min("component_id").alias("to"), F.count("*").alias("n"))
    found = materialize(found, "minhash-kept")
    gone = held(found.where("doc <> to").select("doc"))
    repeated = held(found.where("doc = to and n > 1").select("doc"))

    def run(df: DataFrame) -> DataFrame:
        own = F.col(f"`{key}`")
        stay = df.join(gone, own == F.col("doc"), "left_anti")
        twice = stay.join(repeated, own == F.col("doc"), "left_semi").dropDuplicates([key])
        return stay.join(repeated, own == F.col("doc"), "left_anti").unionByName(twice)

    return beside(documents, ["doc"], run)
