"""Ranking, running totals and joins that keep working when one key is hot.

A plain window sorts a whole key in one task. The running operators here take a
``chunk`` column that grows with the order (a time slice, a page range). They
number rows inside (key, chunk), sum the small per-chunk totals, and add both, so
that a key with a third of all rows is spread over its chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def top_k_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. Spark cuts each task's rows to k per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k_per(df, keys, order, 1, "_first").drop("_first")


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key as a combinable aggregate: no sort, partial results per task."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    picked = df.groupBy(*keys).agg(F.max(row).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def running_sum(
    df: DataFrame, keys: list[str], chunk: Column, order: list[Column], amount: Column, name: str
) -> DataFrame:
    """Sum of ``amount`` over the rows of the key up to and including this one."""
    rows = df.withColumn("_chunk", chunk).withColumn("_amount", amount.cast("long"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(name, F.sum("_amount").over(inside))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        df.select(*keys, chunk.alias("_chunk"), amount.cast("long").alias("_amount"))
        .groupBy(*keys, "_chunk")
        .agg(F.sum("_amount").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    return (
        rows.join(totals, [*keys, "_chunk"])
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_chunk", "_amount", "_before")
    )


def running_number(
    df: DataFrame, keys: list[str], chunk: Column, order: list[Column], name: str = "index"
) -> DataFrame:
    """1-based position of a row inside its key."""
    return running_sum(df, keys, chunk, order, F.lit(1), name)


def previous_value(
    df: DataFrame, keys: list[str], chunk: Column, value: str, name: str = "previous"
) -> DataFrame:
    """Next smaller ``value`` of the key; ``chunk`` must grow with ``value``."""
    rows = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(value)
    rows = rows.withColumn(name, F.lag(value).over(inside))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    ends = (
        df.withColumn("_chunk", chunk)
        .groupBy(*keys, "_chunk")
        .agg(F.max(value).alias("_end"))
        .withColumn("_carried", F.lag("_end").over(across))
        .drop("_end")
    )
    return (
        rows.join(ends, [*keys, "_chunk"])
        .withColumn(name, F.coalesce(F.col(name), F.col("_carried")))
        .drop("_chunk", "_carried")
    )


def sort_rank(df: DataFrame, order: list[Column], rank: str = "position") -> DataFrame:
    """Global 1-based position without moving all rows to one task.

    The rows are range-partitioned on the order, numbered inside each range, and
    shifted by the sizes of the ranges before.
    """
    from ..session import cut_lineage

    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = cut_lineage(ranged)  # the range of a row must not change between the two uses
    inside = Window.partitionBy("_range").orderBy(*order)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        ranged.groupBy("_range")
        .count()
        .select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    )
    return (
        ranged.withColumn(rank, F.row_number().over(inside))
        .join(F.broadcast(shift), "_range")  # one row per partition
        .withColumn(rank, F.col(rank) + F.col("_shift"))
        .drop("_range", "_shift")
    )


def rank_within(df: DataFrame, keys: list[str], order: list[Column], rank: str = "position") -> DataFrame:
    """Position inside a key that may be hot: the global position less the key's first one."""
    placed = sort_rank(df, [*[F.asc(k) for k in keys], *order], "_global")
    first = placed.groupBy(*keys).agg(F.min("_global").alias("_first"))
    return placed.join(first, keys).withColumn(rank, F.col("_global") - F.col("_first") + 1).drop(
        "_global", "_first"
    )


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and the salts each one gets: all of them, in a
    written table, so that it is counted once and its size is known to the planner."""
    return hot_counts(df.groupBy(*keys).count(), keys, "count", hot_rows)


def hot_counts(counts: DataFrame, keys: list[str], count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``hot_keys`` of a table that already counts rows per key."""
    from ..session import cut_lineage

    salts = F.ceil(F.col(count) / hot_rows).cast("int")
    return cut_lineage(counts.where(F.col(count) > hot_rows).select(*keys, salts.alias("_salts")))


def skew_join(
    big: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None
) -> DataFrame:
    """Equi join in which rows of ``big`` with a hot key are dealt over several tasks.

    ``hot`` comes from ``hot_keys`` of a stored table (or of a written step), so that
    finding hot keys does not redo the work behind ``big``; rows of ``other`` with such
    a key are copied to each task. The hot keys are broadcast if their written size allows. Without ``hot`` the split is left to the adaptive
    skew join. ``how`` may be inner, left, left_semi or left_anti: every row of ``big``
    meets all its partners once.
    """
    if hot is None:
        return big.join(other, keys, how)
    deal = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if _hashable(big, c)]), F.col("_salts"))
    left = big.join(hot, keys, "left").withColumn("_salt", F.coalesce(deal, F.lit(0)).cast("int")).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right = other.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame, column: str) -> bool:
    return "map" not in df.schema[column].dataType.simpleString()


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
