"""Record files to lines, read in splits so that one file may be many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import HEAD_BYTES, detect_charset, fold_typographic
from ..operators.records import split_line
from ..operators.windows import running_number, skew_join, top_k_per

RECORD_FILES = "*.{ged,gedcom,GED,GEDCOM,Ged,Gedcom}"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Record files with size and time, newest first; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return (
        files.where(F.lower("path").rlike(r"\.(ged|gedcom)$"))
        .select(F.col("path").alias("file_id"), F.col("length").alias("file_size"), "modificationTime")
        .orderBy(F.desc("modificationTime"), F.asc("file_id"))
    )


def _decode(raw: Column, charset: Column) -> Column:
    """Text of a line. Bytes that are not UTF-8 are read as latin-1 where the file says
    so, else replaced."""
    text = raw.cast("string")
    return F.when(
        (charset == "latin-1") & ~F.is_valid_utf8(text), F.decode(raw, "ISO-8859-1")
    ).otherwise(F.make_valid_utf8(text))


def charsets(raw_lines: DataFrame) -> DataFrame:
    """(file_id, charset) from each file's first lines, of which a thousand bytes can
    hold no more than a thousand."""
    head = top_k_per(raw_lines.where("split = 0"), ["file_id"], [F.asc("seq")], HEAD_BYTES)
    lines = F.array_sort(F.collect_list(F.struct("rank", F.decode(F.substring("raw", 1, HEAD_BYTES), "ISO-8859-1").alias("t"))))
    text = head.groupBy("file_id").agg(F.array_join(lines["t"], "\n").alias("head"))
    return text.select("file_id", detect_charset(F.encode("head", "ISO-8859-1")).alias("charset"))


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, split, seq, raw): undecoded lines and their order."""
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", RECORD_FILES).text(path)
    )
    return files.select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").cast("binary").alias("raw"),
    )


def read_gedcom_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, rejected files). Blank lines are dropped and not counted; files in a
    charset Spark cannot decode are rejected whole."""
    raw = read_raw_lines(spark, path)
    labels = charsets(raw)
    readable = labels.where("charset <> 'ansel'")
    decoded = skew_join(raw, readable, ["file_id"]).withColumn("line", fold_typographic(_decode(F.col("raw"), F.col("charset"))))
    kept = decoded.where(F.regexp_replace("line", r"\s", "") != "").select("file_id", "split", "seq", "line")
    numbered = running_number(kept, ["file_id"], F.col("split"), [F.asc("seq")], "line_no")
    lines = numbered.select("file_id", "line_no", *split_line(F.col("line")))
    rejected = labels.where("charset = 'ansel'").withColumn("reason", F.lit("charset cannot be decoded"))
    return lines, rejected
