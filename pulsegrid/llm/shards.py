"""Sharding by weighted rendezvous hashing (operator 3, DataFrame functions only).

Every (key, shard) pair has a pseudo-random draw u in (0, 1); the key goes to
the shard with the smallest -ln(u) / weight. Adding a shard leaves all other
draws as they are, so the only rows that move are those the new shard wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pulsegrid.llm.store import read_table

#: Slot counters per shard; each is one window group, so a shard's rows spread over this many tasks.
SLOT_BUCKETS = 4096


def _cost(key: Column, shard: int, weight: float) -> Column:
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    uniform = (draw.cast("double") + 0.5) / float(2**53)
    return F.struct((-F.log(uniform) / weight).alias("cost"), F.lit(shard).alias("shard"))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of ``key`` (null counts as a key of its own); shard i gets a share weights[i] / sum."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive and not empty")
    text = F.coalesce(key.cast("string"), F.lit("null key"))
    if len(weights) == 1:
        return F.lit(0)
    return F.array_min(F.array(*[_cost(text, i, float(w)) for i, w in enumerate(weights)]))["shard"]


def assign_shards(
    df: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """``df`` with ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard``.

    ``grown_shard`` is the shard with one more shard of weight ``grown_weight``:
    it differs from ``shard`` only where the new one wins. Rows of one key share
    a shard; ``order`` names further columns that spread the rows of a hot key
    over slot counters and settle their order. Equal rows get different slots.
    Columns of these names in ``df`` are replaced. An empty table stays empty.

    A row's slot is its place in one of ``SLOT_BUCKETS`` hash buckets of the
    shard plus the sizes of the buckets before; the only broadcast table is
    those sizes, at most ``SLOT_BUCKETS`` rows per shard.
    """
    df = df.drop("shard", "slot", "grown_shard")
    weights = list(weights)
    placed = df.withColumn("shard", shard_of(F.col(f"`{key}`"), weights))
    if grown_weight is not None:
        grown = shard_of(F.col(f"`{key}`"), [*weights, grown_weight])
        placed = placed.withColumn("grown_shard", grown)
    sorting = [F.col(f"`{c}`") for c in (key, *order)]
    bucket = F.pmod(F.xxhash64(F.lit("slot"), *sorting), F.lit(SLOT_BUCKETS))
    placed = placed.withColumn("_bucket", bucket)
    sizes = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(W.partitionBy("shard", "_bucket").orderBy(*sorting)) - 1
    return (
        placed.withColumn("_place", within)
        .join(F.broadcast(starts), ["shard", "_bucket"])
        .withColumn("slot", (F.col("_start") + F.col("_place")).cast("long"))
        .drop("_bucket", "_place", "_start")
    )


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 equal shards by the law ``key``, and in 17.

    Size is the UTF-8 bytes of the text plus 1 and a null text counts as empty.
    """
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign_shards(rows, "doc_id", [1.0] * 16, 1.0, order=("text_crc32",))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
