"""Queue messages: parsing with dead letters, as batch and as stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null

# Message layouts.
IMAGE = (
    "Records array<struct<s3: struct<bucket: struct<name: string>, object: struct<key: string>>>>,"
    " s3_uri string, s3Uri string, imageUri string, image_uri string"
)
PAGE = (
    "message_id string, timestamp string,"
    " metadata struct<document_id: string, page_number: int, total_pages: int, document_title: string,"
    " date_range: string, location: string, record_type: string, language: string, source: string>,"
    " ocr_result struct<markdown_text: string, s3_uri: string, character_count: int>,"
    " source_image struct<s3_uri: string, filename: string, width: int, height: int>"
)
RECORD = (
    "document_metadata struct<document_id: string, document_title: string, date_range: string, location: string,"
    " total_pages: int, page_number: int, page_index: int, completion_reason: string>,"
    " gedcom_data struct<content: string, filename: string, s3_uri: string, validation_status: string,"
    " individual_count: int, family_count: int, baptism_count: int, death_count: int, marriage_count: int,"
    " total_events: int>, source_ocr_uris array<string>,"
    " metadata struct<processing_time_ms: long>"
)
SCHEMAS = {"image": IMAGE, "page": PAGE, "record": RECORD}


def _image_uri(m: Column) -> Column:
    first = F.get(m["Records"], F.lit(0))["s3"]
    bucket, key = blank_to_null(first["bucket"]["name"]), blank_to_null(first["object"]["key"])
    stored = F.concat(F.lit("s3://"), bucket, F.lit("/"), key)
    named = F.coalesce(*[blank_to_null(m[c]) for c in ("s3_uri", "s3Uri", "imageUri", "image_uri")])
    return F.when(F.size(m["Records"]) > 0, stored).otherwise(named)


def _problem(kind: str, m: Column, body: Column) -> Column:
    """Why a message cannot be used; null when it can."""
    unreadable = F.when(body.isNull() | m.isNull() | ~F.coalesce(body.rlike(r"^\s*\{"), F.lit(False)), "invalid JSON")
    if kind == "image":
        return unreadable.when(_image_uri(m).isNull(), "no object address")
    if kind == "page":
        return (
            unreadable.when(m["metadata"].isNull(), "no metadata")
            .when(m["ocr_result"].isNull(), "no page result")
            .when(blank_to_null(m["metadata"]["document_id"]).isNull(), "no document_id")
        )
    return unreadable.when(m["gedcom_data"].isNull(), "no record data")


def mark_messages(df: DataFrame, kind: str, body: str = "body") -> DataFrame:
    """Every message with the struct ``m``, its ``problem`` (null if it can be used) and, for images, ``uri``.

    A body is parsed once: problem and address are worked out inside a generator, through which no
    filter or column of later steps is pushed back to the parser.
    """
    parsed = F.array(F.struct(F.from_json(F.col(body), SCHEMAS[kind]).alias("m")))

    def judged(row: Column) -> Column:
        m = row["m"]
        columns = [m.alias("m"), _problem(kind, m, F.col(body)).alias("problem")]
        return F.struct(*columns, *([_image_uri(m).alias("uri")] if kind == "image" else []))

    return df.drop("m", "problem", *(["uri"] if kind == "image" else [])).select("*", F.inline(F.transform(parsed, judged)))


def parse_messages(df: DataFrame, kind: str, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(usable, rejected). Usable rows gain the struct ``m``, image rows also ``uri``."""
    marked = mark_messages(df, kind, body)
    return marked.where("problem is null").drop("problem"), marked.where("problem is not null").drop("m", "uri")


def read_messages(
    spark: SparkSession, path: str, include_existing: bool = True, files_per_trigger: int = 1000
) -> DataFrame:
    """Stream of one message per line; existing files come first unless they are skipped.

    ``files_per_trigger`` is the back-pressure limit.
    """
    reader = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger)
    if not include_existing:
        from datetime import datetime, timezone

        # The file source lists the folder; older files are filtered by their time.
        since = datetime.now(timezone.utc).isoformat()
        stream = reader.text(path).select("value", F.col("_metadata.file_modification_time").alias("at"))
        return stream.where(F.col("at") >= F.lit(since).cast("timestamp")).select(F.col("value").alias("body"))
    return reader.text(path).select(F.col("value").alias("body"))


def deliver(
    stream: DataFrame,
    kind: str,
    checkpoint: str,
    good: Callable[[DataFrame, int], None],
    bad: Callable[[DataFrame, int], None],
    once: bool = True,
):
    """Start a query that hands each batch's usable and rejected rows to two sinks.

    The checkpoint moves on after both returned, which is the acknowledgement.
    """

    def both(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            usable, rejected = parse_messages(batch, kind)
            good(usable, number)
            bad(rejected, number)
        finally:
            batch.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(both)
    return (writer.trigger(availableNow=True) if once else writer).start()
