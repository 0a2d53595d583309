"""Counts and checks of record texts held as (file_id, text).

Whole-text counts are single expressions and need no shuffle. Reference and line
checks explode lines and aggregate by id. Every error is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Fixed value: pattern of the line check. (?d): only "\n" ends a line.
LINE_FORMAT = r"^\d+ (@[^@]+@ )?\w+( .*)?$"
STEPS = ["structure", "duplicate", "undefined", "format"]


def _count(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(f"(?md){pattern}")).cast("long")


def count_records(texts: DataFrame) -> DataFrame:
    """Individuals, families and events per text."""
    out = texts.select(
        "file_id",
        _count(r"^0 @I.*@ INDI").alias("individuals"),
        _count(r"^0 @F.*@ FAM").alias("families"),
        _count(r"^[ \t\r\f]*1 (?:BAPM|CHR)").alias("baptisms"),
        _count(r"^[ \t\r\f]*1 DEAT").alias("deaths"),
        _count(r"^[ \t\r\f]*1 MARR").alias("marriages"),
    )
    total = F.col("baptisms") + F.col("deaths") + F.col("marriages")
    return out.withColumn("total_persons", F.col("individuals")).withColumn("total_events", total)


def document_metrics(counts: DataFrame, document: str = "document_id") -> DataFrame:
    parts = ["individuals", "families", "baptisms", "deaths", "marriages", "total_events"]
    return counts.groupBy(document).agg(*[F.sum(c).alias(c) for c in parts])


def has_header(text: Column) -> Column:
    return strip(text).startswith("0 HEAD")


def has_trailer(text: Column) -> Column:
    return F.contains(text, F.lit("0 TRLR"))


def file_summary(texts: DataFrame) -> DataFrame:
    return texts.select(
        "file_id",
        F.size(F.split("text", "\n")).cast("long").alias("total_lines"),
        has_header(F.col("text")).alias("has_header"),
        has_trailer(F.col("text")).alias("has_trailer"),
        _count(r"^0 @I.*@ INDI").alias("individual_count"),
        _count(r"^0 @F.*@ FAM").alias("family_count"),
        _count(r"^0 @S.*@ SOUR").alias("source_count"),
    )


def _errors(step: str, df: DataFrame, position: Column, message: Column) -> DataFrame:
    return df.select(
        "file_id", F.lit(step).alias("step"), position.cast("long").alias("position"), message.alias("message")
    )


def validate_structure(texts: DataFrame) -> DataFrame:
    """Error rows: header first, trailer present, trailer last."""
    last = strip(F.element_at(F.split(strip(F.col("text")), "\n"), -1))
    checks = F.array(
        F.when(~has_header(F.col("text")), F.lit("Missing GEDCOM header (0 HEAD)")),
        F.when(~has_trailer(F.col("text")), F.lit("Missing GEDCOM trailer (0 TRLR)")),
        F.when(~last.startswith("0 TRLR"), F.lit("GEDCOM trailer (0 TRLR) must be the last line")),
    )
    found = texts.select("file_id", F.posexplode(checks).alias("pos", "message")).where("message is not null")
    return _errors("structure", found, F.col("pos") + 1, F.col("message"))


def id_counts(texts: DataFrame) -> DataFrame:
    """(file_id, id, defined, referenced) per text; definition lines hold no references."""
    defined = F.regexp_extract_all("text", F.lit(r"(?md)^0 @([^@\n]+)@ \w+"), 1)
    rest = F.regexp_replace("text", r"(?md)^0 @.*$", "")
    referenced = F.regexp_extract_all(rest, F.lit(r"@([^@\n]+)@"), 1)
    tagged = F.concat(
        F.transform(defined, lambda i: F.struct(i.alias("id"), F.lit(1).alias("d"), F.lit(0).alias("r"))),
        F.transform(referenced, lambda i: F.struct(i.alias("id"), F.lit(0).alias("d"), F.lit(1).alias("r"))),
    )
    return (
        texts.select("file_id", F.inline(tagged))
        .groupBy("file_id", "id")
        .agg(F.sum("d").alias("defined"), F.sum("r").alias("referenced"))
    )


def reference_errors(texts: DataFrame) -> DataFrame:
    """(file_id, id, kind, times): undefined references and repeated definitions."""
    kind = F.when(F.col("defined") == 0, "undefined").when(F.col("defined") > 1, "duplicate")
    times = F.when(F.col("defined") == 0, F.col("referenced")).otherwise(F.col("defined") - 1)
    return (
        id_counts(texts)
        .select("file_id", "id", kind.alias("kind"), times.alias("times"))
        .where("kind is not null")
    )


def validate_ids(texts: DataFrame) -> DataFrame:
    """Error rows: one for each repeated definition and each undefined id, which has no position."""
    errors = reference_errors(texts)
    repeated = errors.where("kind = 'duplicate'").withColumn(
        "n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    )
    duplicate = _errors(
        "duplicate", repeated, F.col("n"), F.concat(F.lit("Duplicate ID definition: @"), "id", F.lit("@"))
    )
    undefined = errors.where("kind = 'undefined'")
    message = F.concat(F.lit("Undefined ID reference: @"), "id", F.lit("@"))
    return duplicate.unionByName(_errors("undefined", undefined, F.lit(None), message))


def validate_lines(texts: DataFrame) -> DataFrame:
    """Error rows: every badly formed line, whole, at its line number."""
    lines = texts.select("file_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    line = F.regexp_replace("raw", r"\s+$", "")
    bad = lines.select("file_id", (F.col("pos") + 1).alias("line_no"), line.alias("line")).where(
        (F.col("line") != "") & ~F.col("line").rlike(f"(?d){LINE_FORMAT}")
    )
    message = F.concat(F.lit("Line "), F.col("line_no").cast("string"), F.lit(": Invalid format: "), "line")
    return _errors("format", bad, F.col("line_no"), message)


def validation_errors(texts: DataFrame, strict: bool = False) -> DataFrame:
    out = validate_structure(texts).unionByName(validate_ids(texts))
    return out.unionByName(validate_lines(texts)) if strict else out


def validate(texts: DataFrame, strict: bool = False) -> DataFrame:
    """(file_id, is_valid, error_count); the messages are in ``validation_errors``."""
    counts = validation_errors(texts, strict).groupBy("file_id").agg(F.count("*").alias("error_count"))
    joined = texts.select("file_id").join(counts, "file_id", "left")
    n = F.coalesce("error_count", F.lit(0)).cast("long")
    return joined.select("file_id", (n == 0).alias("is_valid"), n.alias("error_count"))
