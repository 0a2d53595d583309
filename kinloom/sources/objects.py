"""Object listings, companion files and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import stem
from ..operators.windows import any_of, skew_join


def scan_objects(
    df: DataFrame,
    key: str = "key",
    modified: str = "modified",
    prefix: str | None = None,
    suffixes: list[str] | None = None,
    start: Column | None = None,
    end: Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Listing rows by prefix, extension and time; a limit keeps the smallest keys."""
    if prefix:
        df = df.where(F.col(key).startswith(prefix))
    if suffixes:
        df = df.where(any_of([F.lower(key).endswith(s) for s in suffixes]))
    if start is not None:
        df = df.where(F.col(modified) >= start)
    if end is not None:
        df = df.where(F.col(modified) <= end)
    return df if limit is None else df.orderBy(key).limit(limit)


def join_companion(objects: DataFrame, companions: DataFrame, key: str, companion_key: str) -> DataFrame:
    """Attach the ``.json`` file of the same key; none is normal."""
    found = companions.where(F.lower(companion_key).endswith(".json")).withColumn("_stem", stem(F.col(companion_key)))
    return skew_join(objects.withColumn("_stem", stem(F.col(key))), found, ["_stem"], "left").drop("_stem")


def report_rows(audit: DataFrame, summary: DataFrame) -> DataFrame:
    """JSON rows of a report: the totals, then one row per document."""
    total = summary.select(F.lit("totals").alias("part"), F.to_json(F.struct(*summary.columns)).alias("body"))
    each = audit.select(F.lit("document").alias("part"), F.to_json(F.struct(*audit.columns)).alias("body"))
    return total.unionByName(each)


def write_report(audit: DataFrame, summary: DataFrame, path: str) -> None:
    report_rows(audit, summary).write.mode("overwrite").partitionBy("part").text(path)
