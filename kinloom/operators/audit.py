"""Completeness of documents and their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import previous_value

PAGES_PER_CHUNK = 4096
MISSING_PER_ROW = 10_000


def _distinct_pages(pages: DataFrame) -> DataFrame:
    return pages.where("page_number is not null").select("document_id", "page_number").distinct()


def completion_status(missing: Column, percent: Column) -> Column:
    return (
        F.when(missing == 0, "complete")
        .when(percent >= 90, "mostly_complete")
        .when(percent >= 50, "partial")
        .otherwise("incomplete")
    )


def audit_pages(pages: DataFrame) -> DataFrame:
    """One row per document of (document_id, page_number[, path, collection_id]).

    Copies of a page are folded before the shuffle and no page list is ever
    collected: the missing pages are counted here and listed by ``missing_pages``.
    A document without numbered pages is ``empty``.
    """
    extra = []
    if "path" in pages.columns:
        extra.append(F.min("path").alias("first_path"))
    if "collection_id" in pages.columns:
        extra.append(F.max("collection_id").alias("collection_id"))
    per_page = pages.groupBy("document_id", "page_number").agg(
        *([F.min("path").alias("path")] if "path" in pages.columns else []),
        *([F.max("collection_id").alias("collection_id")] if "collection_id" in pages.columns else []),
        F.count("*").alias("_copies"),
    )
    per_document = per_page.groupBy("document_id").agg(
        F.count("page_number").alias("total_pages"),
        F.min("page_number").alias("min_page"),
        F.max("page_number").alias("max_page"),
        *extra,
    )
    known = F.col("total_pages") > 0
    expected = F.coalesce(F.col("max_page").cast("long") - F.col("min_page").cast("long") + 1, F.lit(0))
    out = per_document.withColumn("expected_pages", expected)
    out = out.withColumn("missing_count", F.col("expected_pages") - F.col("total_pages"))
    percent = F.when(known, F.col("total_pages") / F.col("expected_pages") * 100).otherwise(F.lit(0.0))
    status = F.when(known, completion_status(F.col("missing_count"), percent)).otherwise("empty")
    return out.withColumn("completion_percentage", F.round(percent, 2)).withColumn("status", status)


def page_gaps(pages: DataFrame, pages_per_chunk: int = PAGES_PER_CHUNK) -> DataFrame:
    """(document_id, first_missing, last_missing) ranges between the seen pages."""
    distinct = _distinct_pages(pages)
    chunk = F.floor(F.col("page_number") / pages_per_chunk)
    seen = previous_value(distinct, ["document_id"], chunk, "page_number")
    return seen.where(F.col("page_number") - F.col("previous") > 1).select(
        "document_id",
        (F.col("previous") + 1).alias("first_missing"),
        (F.col("page_number") - 1).alias("last_missing"),
    )


def missing_pages(pages: DataFrame) -> DataFrame:
    """(document_id, page_number) of every missing page; a wide gap is cut before it is listed."""
    starts = F.explode(F.sequence("first_missing", "last_missing", F.lit(MISSING_PER_ROW)))
    cut = page_gaps(pages).withColumn("_from", starts)
    last = F.least(F.col("_from") + MISSING_PER_ROW - 1, F.col("last_missing"))
    return cut.select("document_id", F.explode(F.sequence("_from", last)).alias("page_number"))


def audit_summary(audit: DataFrame) -> DataFrame:
    documents = F.count("*")
    complete = F.count_if(F.col("status") == "complete")
    return audit.agg(
        documents.alias("total_documents"),
        F.coalesce(F.sum("total_pages"), F.lit(0)).alias("total_pages"),
        complete.alias("complete_documents"),
        F.coalesce(F.round(F.try_divide(complete, documents) * 100, 1), F.lit(0.0)).alias("complete_percentage"),
        F.count_if(F.col("missing_count") > 0).alias("documents_with_missing"),
        F.coalesce(F.sum("missing_count"), F.lit(0)).alias("total_missing"),
    )


def missing_only(audit: DataFrame) -> DataFrame:
    return audit.where("missing_count > 0")


def report_order(mode: str) -> list[Column]:
    return {
        "pages": [F.desc("total_pages")],
        "missing": [F.desc("missing_count")],
        "completion": [F.asc("completion_percentage")],
    }.get(mode, []) + [F.asc("document_id")]


def sort_report(audit: DataFrame, mode: str = "name") -> DataFrame:
    return audit.orderBy(*report_order(mode))


def candidate_stats(candidates: DataFrame) -> DataFrame:
    """Counts by status, and pending ones by type, in one pass."""
    by_both = candidates.groupBy("status", "record_type").count()
    kinds = F.array(
        F.struct(F.lit("status").alias("part"), F.col("status").alias("name")),
        F.when(
            F.col("status") == "pending", F.struct(F.lit("pending_type").alias("part"), F.col("record_type").alias("name"))
        ),
    )
    return (
        by_both.select(F.inline(F.array_compact(kinds)), "count")
        .groupBy("part", "name")
        .agg(F.sum("count").alias("count"))
    )


def upload_stats(events: DataFrame, processed: Column, uploaded: Column, keys: list[str]) -> DataFrame:
    """Files handled and uploaded with the success rate, 0 when none was handled."""
    done, ok = F.count_if(processed), F.count_if(uploaded)
    return events.groupBy(*keys).agg(
        done.alias("files_processed"),
        ok.alias("files_uploaded"),
        F.coalesce(F.try_divide(ok, done), F.lit(0.0)).alias("success_rate"),
    )
