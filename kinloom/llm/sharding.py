"""Shards by rendezvous hashing: each key goes to the shard that scores highest for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table, text_or_empty
from .registry import query

SHARDS = 16


def shard_score(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u), with u in (0, 1) from a hash of key and shard: the largest of n such
    scores falls on a shard in proportion to its weight."""
    high = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return F.lit(-float(weight)) / F.log((high + 0.5) / float(1 << 53))


def best_shard(key: Column, weights: list[float]) -> Column:
    """struct(score, rank) of the best shard; its number is ``-rank``, ties go to the smaller one."""
    return F.array_max(
        F.array(
            *[
                F.struct(shard_score(key, s, w).alias("score"), F.lit(-s).alias("rank"))
                for s, w in enumerate(weights)
            ]
        )
    )


def assign_shards(
    df: DataFrame, key: str, weights: list[float], shard: str = "shard", grown: str | None = None, grown_weight: float = 1.0
) -> DataFrame:
    """Add the shard of every row from its ``key`` and the weights alone.

    Each shard's score of a key never depends on the other shards, so a new shard takes
    only the keys for which it scores highest, and a removed one gives up only its own.
    ``grown`` names a column with the shard after one more shard of ``grown_weight``.
    Rows are not moved. A null key counts as empty text; equal keys share a shard; a
    shard of weight 0 gets nothing; an empty table gives an empty one.
    """
    if not weights or all(w <= 0 for w in weights):
        raise ValueError("at least one shard must have a positive weight")
    kept = [c for c in df.columns if c not in (shard, grown)]
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    scored = df.withColumn("__best", best_shard(text, weights))
    chosen = (-F.col("__best.rank")).cast("int")
    more = []
    if grown:
        wins = shard_score(text, len(weights), grown_weight) > F.col("__best.score")
        more = [F.when(wins, F.lit(len(weights))).otherwise(chosen).cast("int").alias(grown)]
    return scored.select(*kept, chosen.alias(shard), *more)


def number_slots(df: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    The rows are written once with the task that wrote them. Each (shard, task) is then
    numbered by itself and shifted by the small table of counts before it, so a shard's
    rows are never gathered in one task, whatever its keys are. Repeated rows each get
    a slot. ``df`` should hold only the columns that must go along.
    """
    written = cut_lineage(
        df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    )
    counts = written.groupBy(shard, "__part").count()
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(shard, "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy(shard, "__part").orderBy("__at")
    return (
        written.withColumn("__n", F.row_number().over(inside))
        .join(shifts, [shard, "__part"])
        .select(*df.columns, (F.col("__n") - 1 + F.col("__shift")).alias(slot))
    )


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 equal shards; null texts have size 1 and checksum 0."""
    data = text_or_empty().cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32")
    )
    placed = assign_shards(docs, "doc_id", [1.0] * SHARDS, grown="grown_shard")
    return number_slots(placed).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
