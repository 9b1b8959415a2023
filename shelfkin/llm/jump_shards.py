"""Sharding by jump consistent hashing, in DataFrame expressions only.

The shard of a key follows from the key and the number of shards alone; with one shard
more, the rows that move all move into the new shard.  No table of a ring is kept.

The generator is the 64-bit linear congruential one of the published algorithm.  Its
state is held as two 32-bit halves, because an expression may not overflow 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the multiplier of the published generator, 2862933555777941757.
MULTIPLIER = 2862933555777941757
M_HIGH, M_LOW1, M_LOW0 = MULTIPLIER >> 32, (MULTIPLIER >> 16) & 0xFFFF, MULTIPLIER & 0xFFFF
MASK32, MASK16 = 0xFFFFFFFF, 0xFFFF


def _low(x: Column, bits: int = MASK32) -> Column:
    return x.bitwiseAND(F.lit(bits).cast("bigint"))


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """state * MULTIPLIER + 1 modulo 2^64, on halves; no product exceeds 62 bits."""
    t0, t1 = low * M_LOW0, low * M_LOW1
    part = t0 + F.shiftleft(_low(t1, MASK16), 16) + 1
    carry = F.shiftright(part, 32) + F.shiftright(t1, 16)
    cross = _low(high * M_LOW0) + F.shiftleft(_low(high * M_LOW1, MASK16), 16) + _low(low * M_HIGH)
    return _low(cross + carry), _low(part)


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown_shard): the shard among ``shards`` and among one more.

    ``key`` is a BIGINT; null counts as a key of its own, the smallest BIGINT.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    seed = F.coalesce(key.cast("bigint"), F.lit(-(2**63)).cast("bigint"))
    zero = F.lit(0).cast("bigint")

    def start() -> Column:
        return F.struct(
            _low(F.shiftright(seed, 32)).alias("high"), _low(seed).alias("low"), (zero - 1).alias("at"), zero.alias("next")
        )

    def step(state: Column, _: Column) -> Column:
        high, low = _next(state["high"], state["low"])
        jump = F.floor((state["next"] + 1) * (F.lit(float(2**31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("bigint")
        moved = F.struct(high.alias("high"), low.alias("low"), state["next"].alias("at"), jump.alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    def finish(state: Column) -> Column:
        grown = F.when(state["next"] == shards, F.lit(shards)).otherwise(state["at"].cast("int"))
        return F.struct(state["at"].cast("int").alias("shard"), grown.cast("int").alias("grown_shard"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start(), step, finish)


def shard_rows(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", buckets: int = 4096) -> DataFrame:
    """One row per row of ``df``: key, size, checksum, shard, place in the shard, and the shard after growth.

    ``slot`` numbers the rows of a shard from 0 without gaps.  Rows are numbered within
    buckets of the key's hash and shifted by the counts of the buckets before, so no
    shard passes through one task; equal rows are counted first and numbered as one
    stretch, so a repeated key does no harm either.  A null text has no bytes and counts
    8; a null key is a key of its own; an empty table gives no rows.  Other columns of
    ``df`` are not read.
    """
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = (
        df.select(F.col(f"`{key}`").cast("bigint").alias("k"), (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
        .groupBy("k", "size", "text_crc32")
        .agg(F.count("*").alias("copies"))
        .withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int"))
        .withColumn("j", jump_shards(F.col("k"), shards))
        .select("k", "size", "text_crc32", "copies", "bucket", "j.shard", "j.grown_shard")
    )
    # At most shards x buckets rows: fit to be broadcast.
    counts = rows.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    before = F.sum("n").over(_window("shard", "bucket").rowsBetween(-(2**31), -1))
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    within = F.sum("copies").over(_window(["bucket", "shard"], "k", "size", "text_crc32").rowsBetween(-(2**31), -1))
    placed = rows.withColumn("first", F.coalesce(within, F.lit(0))).join(F.broadcast(offsets), ["shard", "bucket"])
    slots = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))
    return placed.select("*", slots.alias("i")).select(
        F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("first") + F.col("i")).alias("slot"), "grown_shard",
    )


def _window(by: str | list[str], *order: str):
    return Window.partitionBy(by).orderBy(*order)

