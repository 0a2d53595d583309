"""Pages of a document: order, groups, running context, assembled text and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import output_key
from ..functions.scores import present
from ..functions.text import strip, title_words
from .windows import running_number, running_sum, skew_join

CONTEXT_CHARS = 4000
PART_CHARS = 16_000_000
ROWS_PER_CHUNK = 4096
MAX_RETRIES = 3
# Metadata of a page message that describes its document.
DOCUMENT_FIELDS = ["document_title", "location", "date_range", "record_type", "language", "source"]


def page_order() -> list[Column]:
    """Page numbers first, unknown ones last in arrival order."""
    return [F.asc_nulls_last("page_number"), F.asc("arrival")]


def _page_chunk(rows_per_chunk: int) -> Column:
    """Grows with ``page_order``: slices of page numbers, then slices of arrivals."""
    unknown = F.lit(1 << 40) + F.floor(F.col("arrival") / rows_per_chunk)
    return F.coalesce(F.floor(F.col("page_number") / rows_per_chunk), unknown)


def sort_pages(pages: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add ``page_index``, the 1-based place of a page in its document."""
    return running_number(pages, ["document_id"], _page_chunk(rows_per_chunk), page_order(), "page_index")


def arrival_index(messages: DataFrame, key: str, chunk: Column, order: list[Column]) -> DataFrame:
    return running_number(messages, [key], chunk, order, "arrival_index")


def metadata_header(total: Column) -> Column:
    """Header lines of the fields that are present."""

    def line(field: str, label: str, value: Column, end: str = "") -> Column:
        return F.when(present(F.col(field)), F.concat(F.lit(f"{label}: "), value, F.lit(end)))

    return F.concat_ws(
        "\n",
        F.lit("DOCUMENT METADATA:"),
        line("document_title", "Title", F.col("document_title")),
        line("location", "Location", F.col("location")),
        line("date_range", "Date Range", F.col("date_range")),
        line("record_type", "Record Type", title_words(F.col("record_type")), " Records"),
        line("language", "Language", F.initcap("language")),
        F.concat(F.lit("Total Pages: "), total.cast("string")),
        line("source", "Source", title_words(F.col("source"))),
    )


def _section(index: Column, text: Column) -> Column:
    known = F.col("page_number").cast("string")
    label = F.coalesce(known, F.concat(index.cast("string"), F.lit(" (page number unknown)")))
    return F.concat(F.lit("---\nPAGE "), label, F.lit(":\n\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def document_metadata(pages: DataFrame) -> DataFrame:
    """The first message's metadata and the number of messages of each document."""
    fields = F.struct(*[F.col(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in DOCUMENT_FIELDS])
    return (
        pages.groupBy("document_id")
        .agg(F.min_by(fields, "arrival").alias("m"), F.count("*").alias("message_count"))
        .select("document_id", "m.*", "message_count")
    )


def format_documents(pages: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(document_id, part_no, text): header and pages in order.

    A document is one part until it is longer than ``part_chars``; then it goes on in
    further parts, which read in order and joined by a line break give all of it.
    """
    sections = sort_pages(pages).select(
        "document_id", "page_index", _section(F.col("page_index"), F.col("text")).alias("section")
    )
    chunk = F.floor(F.col("page_index") / ROWS_PER_CHUNK)
    size = F.length("section")
    ends = running_sum(sections, ["document_id"], chunk, [F.asc("page_index")], size, "_end")
    parts = (
        ends.withColumn("part_no", F.floor((F.col("_end") - F.length("section")) / part_chars).cast("long"))
        .groupBy("document_id", "part_no")
        .agg(F.array_sort(F.collect_list(F.struct("page_index", "section"))).alias("s"))
        .select("document_id", "part_no", F.array_join(F.col("s.section"), "\n").alias("body"))
    )
    joined = skew_join(parts, document_metadata(pages), ["document_id"])
    header = F.concat(metadata_header(F.col("message_count")), F.lit("\n\n"))
    text = F.when(F.col("part_no") == 0, F.concat(header, "body")).otherwise(F.col("body"))
    return joined.select("document_id", "part_no", text.alias("text"))


def format_single_pages(pages: DataFrame) -> DataFrame:
    """Each page with the header of its document; an unknown page is labelled 1."""
    joined = skew_join(pages.select("document_id", "arrival", "page_number", "text"), document_metadata(pages), ["document_id"])
    text = F.concat(metadata_header(F.col("message_count")), F.lit("\n\n"), _section(F.lit(1), F.col("text")))
    return joined.select("document_id", "arrival", "page_number", text.alias("text"))


def document_summary(pages: DataFrame) -> DataFrame:
    dates = F.when(present(F.col("date_range")), F.concat(F.lit("("), "date_range", F.lit(")")))
    title = F.when(present(F.col("document_title")), F.col("document_title"))
    count = F.concat(F.col("message_count").cast("string"), F.lit(" pages"))
    return document_metadata(pages).select("document_id", F.concat_ws(" ", title, dates, count).alias("summary"))


def carry_context(
    pages: DataFrame, key: str, order: str, text: str, max_chars: int = CONTEXT_CHARS, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Add ``context``: the last ``max_chars`` characters of the key's earlier texts.

    Every text gets its character range within the key by a running sum. The texts are
    laid into blocks of ``max_chars``, and a context reads the end of two neighbouring
    blocks. No task sees more than a block of a key at once, however long the key is.
    """
    trimmed = strip(F.coalesce(F.col(text), F.lit("")))
    piece = F.when(trimmed == "", F.lit("")).otherwise(F.concat(trimmed, F.lit("\n")))
    rows = pages.withColumn("_piece", piece)
    chunk = F.floor(F.col(order) / rows_per_chunk)
    ranged = running_sum(rows, [key], chunk, [F.asc(order)], F.length("_piece"), "_end")
    ranged = ranged.withColumn("_start", F.col("_end") - F.length("_piece"))

    first, last = F.floor(F.col("_start") / max_chars), F.floor((F.col("_end") - 1) / max_chars)
    cut = ranged.where("_piece <> ''").select(key, "_start", "_end", "_piece", F.explode(F.sequence(first, last)).alias("_block"))
    low = F.greatest("_start", F.col("_block") * max_chars)
    high = F.least("_end", (F.col("_block") + 1) * max_chars)
    slices = cut.select(
        key, "_block", "_start", F.substr("_piece", (low - F.col("_start") + 1).cast("int"), (high - low).cast("int")).alias("_slice")
    )
    blocks = slices.groupBy(key, "_block").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("_start", "_slice")))["_slice"], "").alias("_content")
    )
    # The line break before this page is not part of the context.
    stop = F.col("_start") - 1
    wanted = ranged.withColumn("_stop", stop).withColumn("_block", F.floor((stop - 1) / max_chars))
    here = blocks.withColumnRenamed("_content", "_here")
    before = blocks.select(key, (F.col("_block") + 1).alias("_block"), F.col("_content").alias("_before"))
    joined = wanted.join(here, [key, "_block"], "left").join(before, [key, "_block"], "left")
    offset = (F.col("_stop") - F.col("_block") * max_chars).cast("int")  # characters used of the later block
    context = F.concat(
        F.coalesce(F.substr("_before", offset + 1), F.lit("")), F.substr(F.coalesce("_here", F.lit("")), F.lit(1), offset)
    )
    context = F.when(F.col("_stop") > 0, context).otherwise(F.lit(""))
    return joined.withColumn("context", context).select(*pages.columns, "context")


def page_counts(messages: DataFrame) -> DataFrame:
    """Messages and distinct numbered pages per document, and pages that came twice."""
    per_page = messages.groupBy("document_id", "page_number").agg(F.count("*").alias("n"))
    return per_page.groupBy("document_id").agg(
        F.sum("n").alias("message_count"),
        F.count("page_number").alias("unique_pages"),
        F.count_if((F.col("n") > 1) & F.col("page_number").isNotNull()).alias("duplicate_pages"),
    )


def expected_pages(messages: DataFrame) -> DataFrame:
    """First known total per document, in arrival order; 0 counts as unknown."""
    known = F.col("total_pages") > 0
    return messages.groupBy("document_id").agg(
        F.min_by("total_pages", F.when(known, F.col("arrival"))).alias("expected_pages")
    )


def group_status(groups: DataFrame, now: Column, timeout_seconds: int = 300) -> DataFrame:
    """State of each group of (unique_pages, expected_pages, last_updated)."""
    full = (F.col("expected_pages") > 0) & (F.col("unique_pages") >= F.col("expected_pages"))
    idle = F.unix_timestamp(now) - F.unix_timestamp("last_updated") >= timeout_seconds
    return groups.withColumn(
        "status",
        F.when(F.coalesce(full, F.lit(False)), "all_pages_received").when(idle, "timeout_reached").otherwise("incomplete"),
    )


def session_summaries(
    events: DataFrame, key: str, at: str, gap_seconds: int, tie: Column | None = None, gaps_per_chunk: int = 64
) -> DataFrame:
    """(key, messages, first_seen, last_updated, last_tie): runs of events less than the gap apart.

    Time is cut into chunks. Inside a chunk of a key the runs are summed up by themselves: those in the
    middle are closed, only the first and the last may go on in the chunks beside it. These
    edges are then stitched along the chunks. So a key with a third of all events is spread over
    its chunks, and what meets in one task grows with the time covered, not with
    the events. Events without a time are left out; ``last_tie`` is the largest tie of the last moment.
    """
    micros = gap_seconds * 1_000_000
    given = events.where(F.col(at).isNotNull()).select(
        F.col(key).alias("_key"), F.unix_micros(F.col(at).cast("timestamp")).alias("_at"), (F.lit(None).cast("long") if tie is None else tie).alias("_tie")
    )
    moments = given.groupBy("_key", F.floor(F.col("_at") / (micros * gaps_per_chunk)).alias("_chunk"), "_at").agg(
        F.count("*").alias("_n"), F.max("_tie").alias("_tie")
    )
    inside = Window.partitionBy("_key", "_chunk").orderBy("_at")
    fresh = F.when(F.col("_at") - F.lag("_at").over(inside) < micros, 0).otherwise(1)
    runs = moments.withColumn("_run", fresh).withColumn("_run", F.sum("_run").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("_key", "_chunk", "_run").agg(
        F.sum("_n").alias("_n"), F.min("_at").alias("_first"), F.max(F.struct("_at", "_tie")).alias("_last")
    )
    middle = (F.col("_run") > 1) & (F.col("_run") < F.max("_run").over(Window.partitionBy("_key", "_chunk")))
    runs = runs.withColumn("_middle", middle)
    along = Window.partitionBy("_key").orderBy("_first")
    edges = runs.where("not _middle").withColumn("_goes_on", F.col("_first") - F.lag("_last._at").over(along) < micros)
    edges = edges.withColumn("_run", F.sum(F.when(F.col("_goes_on"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = edges.groupBy("_key", "_run").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    columns = ["_key", "_n", "_first", "_last"]
    kind = events.schema[at].dataType
    return runs.where("_middle").select(*columns).unionByName(stitched.select(*columns)).select(
        F.col("_key").alias(key), F.col("_n").alias("messages"), F.timestamp_micros("_first").cast(kind).alias("first_seen"),
        F.timestamp_micros("_last._at").cast(kind).alias("last_updated"), F.col("_last._tie").alias("last_tie"),
    )


def session_documents(messages: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """Groups that end when no message came for the gap; the gap restarts per message."""
    return session_summaries(messages, key, at, gap_seconds).drop("last_tie")


def debounce(events: DataFrame, key: str, at: str, tie: str, quiet_seconds: int) -> DataFrame:
    """Last event of every quiet-separated burst of a key."""
    bursts = session_summaries(events, key, at, quiet_seconds, F.col(tie))
    return bursts.select(key, F.col("last_updated").alias(at), F.col("last_tie").alias(tie), F.col("messages").alias("burst"))


def drop_late(messages: DataFrame, closed: DataFrame) -> DataFrame:
    """Messages that arrived no later than their document was closed."""
    ends = closed.select("document_id", "closed_at")
    joined = skew_join(messages, ends, ["document_id"], "left")
    return joined.where("closed_at is null or at <= closed_at").drop("closed_at")


def unprocessed_pages(messages: DataFrame, processed: DataFrame) -> DataFrame:
    """Messages whose page is not done; pages without a number always stay."""
    done = processed.select("document_id", "page_number").distinct()
    return messages.join(done, ["document_id", "page_number"], "left_anti").select(*messages.columns)


def retry_state(attempts: DataFrame, keys: list[str], failed: Column, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Failures per page and whether it may be tried again."""
    counted = attempts.groupBy(*keys).agg(F.count_if(failed).alias("failures"), F.count("*").alias("attempts"))
    state = (
        F.when(F.col("failures") >= max_retries, "permanently_failed")
        .when(F.col("failures") < F.col("attempts"), "processed")
        .otherwise("pending_retry")
    )
    return counted.withColumn("state", state)


def build_result_message(df: DataFrame, metadata: list[str]) -> DataFrame:
    """Page result JSON; unknown metadata and image sizes are left out."""
    message = F.struct(
        "message_id",
        F.col("timestamp"),
        F.struct(*metadata).alias("metadata"),
        F.struct(
            "markdown_text",
            F.col("result_uri").alias("s3_uri"),
            F.length("markdown_text").alias("character_count"),
        ).alias("ocr_result"),
        F.struct(
            F.col("source_uri").alias("s3_uri"), "filename",
            *[c for c in ("width", "height") if c in df.columns],
        ).alias("source_image"),
    )
    return df.select("message_id", F.to_json(message).alias("body"))


def route_results(df: DataFrame, prefix: str, bucket: str) -> DataFrame:
    """Given address when there is one, else the key the content will be written to."""
    given = F.when(present(F.col("s3_uri")), F.col("s3_uri"))
    key = output_key(F.col("source_uri"), prefix, F.col("filename"))
    target = F.coalesce(given, F.concat(F.lit(f"s3://{bucket}/"), key))
    return df.withColumn("target_uri", target).withColumn("must_write", given.isNull())


def publish_pages(pages: DataFrame, prefix: str, bucket: str, strict: bool = False) -> DataFrame:
    """Record-ready rows per page: address, counts and verdict; a bad page is still sent.

    Pages are (file_id, document_id, page_number, text, source_uri).
    """
    from .validate import count_records, validate

    texts = pages.select("file_id", "text")
    verdict = validate(texts, strict).select("file_id", F.when(F.col("is_valid"), "valid").otherwise("invalid").alias("validation_status"))
    name = F.concat(F.col("document_id").cast("string"), F.lit("_p"), F.col("page_number").cast("string"), F.lit(".ged"))
    sent = pages.withColumn("filename", name)
    address = F.concat(F.lit(f"s3://{bucket}/"), output_key(F.col("source_uri"), prefix, F.col("filename")))
    return (
        sent.withColumn("s3_uri", address)
        .drop("text")
        .join(count_records(texts), "file_id")
        .join(verdict, "file_id")
    )
