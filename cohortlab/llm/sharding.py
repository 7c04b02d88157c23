"""Sharding by jump consistent hashing, in DataFrame operations only.

The key's hash drives a 64-bit linear congruential sequence; each value gives the next shard count
at which the key would move, and the last one below the number of shards is the key's shard. There
is no ring table, and one more shard takes keys only into itself. (Lamping and Veach, 2014.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.frames import dimension_join, materialize
from cohortlab.llm.tables import safe_text

#: Multiplier of the sequence in the published algorithm, cut into limbs for overflow-free products.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_LOW1, _LOW0 = _LOW >> 16, _LOW & 0xFFFF
_MASK32, _MASK16 = (1 << 32) - 1, (1 << 16) - 1
BLOCKS = 256


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64 on two 32-bit limbs; no product leaves 63 bits."""
    cross, high_cross = low * F.lit(_LOW1), high * F.lit(_LOW1)
    bottom = low * F.lit(_LOW0) + F.shiftleft(cross.bitwiseAND(F.lit(_MASK16)), 16) + F.lit(1)
    top = (
        F.shiftright(bottom, 32)
        + F.shiftright(cross, 16)
        + low * F.lit(_HIGH)
        + high * F.lit(_LOW0)
        + F.shiftleft(high_cross.bitwiseAND(F.lit(_MASK16)), 16)
    )
    return top.bitwiseAND(F.lit(_MASK32)), bottom.bitwiseAND(F.lit(_MASK32))


def jump_shard(key: Column, shards: int) -> Column:
    """Shard (0 to ``shards - 1``) of a 64-bit key. The jump grows in each step, so ``shards``
    steps are enough for any key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = F.struct(
        F.lit(-1).cast("bigint").alias("shard"),
        F.lit(0).cast("bigint").alias("jump"),
        F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(_MASK32)).alias("high"),
        key.bitwiseAND(F.lit(_MASK32)).alias("low"),
    )

    def advance(at: Column, _: Column) -> Column:
        high, low = _step(at["high"], at["low"])
        scale = F.lit(float(1 << 31)) / (F.shiftright(high, 1) + F.lit(1)).cast("double")
        moved = F.struct(
            at["jump"].alias("shard"),
            F.floor((at["jump"] + F.lit(1)).cast("double") * scale).cast("bigint").alias("jump"),
            high.alias("high"),
            low.alias("low"),
        )
        return F.when(at["jump"] < F.lit(shards), moved).otherwise(at)

    steps = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(steps, state, advance, lambda at: at["shard"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = 24, blocks: int = BLOCKS) -> DataFrame:
    """Every document with its shard, its shard after one more is appended, and its place there.

    The shard depends on ``doc_id`` and the shard count alone (law ``key``). ``slot`` numbers a
    shard's rows from 0 without gaps, ordered by a hash block of the row, then id, checksum and
    size. No task sees a whole shard: rows are numbered per (shard, block), and the offsets of
    blocks come from their counts. Rows equal in id, size and checksum are counted before the
    shuffle, so a repeated row is one row until it gets its numbers.

    A null text has size 8 and checksum 0, a null id hashes like any other key. Repeated rows each
    get a slot. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    raw = safe_text(F.col("text")).cast("binary")
    key = F.xxhash64(F.col("doc_id"))
    rows = (
        docs.select("doc_id", (F.octet_length(raw) + F.lit(8)).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("shard", jump_shard(key, shards))
        .withColumn("grown_shard", jump_shard(key, shards + 1))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(blocks)).cast("int"))
    )
    rows = materialize(rows)
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "block")
        .agg(F.sum("copies").alias("held"))
        .select("shard", "block", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    )
    within = (
        Window.partitionBy("shard", "block")
        .orderBy("doc_id", "text_crc32", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = rows.withColumn("first", F.coalesce(F.sum("copies").over(within), F.lit(0)))
    placed = dimension_join(numbered, offsets, ["shard", "block"], spread_by=["doc_id", "text_crc32"])
    first = F.col("offset") + F.col("first")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(first, first + F.col("copies") - F.lit(1))).alias("slot"),
        "grown_shard",
    )
