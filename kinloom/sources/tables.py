"""Parquet store of the twelve register tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLES

# Tables that are stored by batch or by record type.
PARTITIONED = {
    "persons": "source_batch_id",
    "baptism_records": "source_batch_id",
    "marriage_records": "source_batch_id",
    "death_records": "source_batch_id",
    "genealogical_records": "batch_id",
    "duplicate_candidates": "record_type",
}


def fit(df: DataFrame, name: str) -> DataFrame:
    """Columns of the stored table, missing ones null."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name].fields
        ]
    )


def save_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Write tables; with a partitioned one only the batches at hand are replaced."""
    for name, df in tables.items():
        writer = fit(df, name).write.mode(mode)
        if name in PARTITIONED:
            writer = writer.partitionBy(PARTITIONED[name]).option("partitionOverwriteMode", "dynamic")
        writer.parquet(f"{path}/{name}")


def load_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")


def reset(spark: SparkSession, path: str) -> None:
    """Empty every table."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{name}")
