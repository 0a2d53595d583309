"""Objects, messages, catalogue pages, document audits and page groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, documents
from ..sources import catalogue, messages, objects
from .bindings import bound, spark_sql, with_views
from .catalog import query
from .register import AUDITED_SQL
from .relational import STATUS_SQL

# ---- objects and messages -------------------------------------------------

LISTING = """
    SELECT page_id, url, ts FROM {pages} JOIN {events} ON event_id = page_id"""


@query(
    "object_scan",
    with_views(
        f"""SELECT page_id FROM ({LISTING}) WHERE url LIKE 'https://%' AND (lower(url) LIKE '%.html' OR lower(url) LIKE '%/')
            AND ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' ORDER BY url LIMIT 40"""
    ),
)
def object_scan(spark, d):
    day = lambda n: F.lit(f"2024-01-{n} 00:00:00").cast("timestamp")
    found = objects.scan_objects(
        spark_sql(spark, d, LISTING), "url", "ts", "https://", [".html", "/"], day("01"), day("20"), limit=40
    )
    return found.select("page_id")


BODIES = """
    SELECT o_orderkey AS id, CASE o_orderkey % 8
        WHEN 0 THEN concat('{{"Records": [{{"s3": {{"bucket": {{"name": "in"}}, "object": {{"key": "a/', o_orderkey, '.jpg"}}}}}}]}}')
        WHEN 1 THEN concat('{{"s3_uri": "s3://in/', o_orderkey, '"}}') WHEN 2 THEN concat('{{"imageUri": "s3://in/', o_orderkey, '", "s3Uri": ""}}')
        WHEN 3 THEN concat('{{"image_uri": "s3://in/', o_orderkey, '"}}') WHEN 4 THEN '{{"Records": [{{"s3": {{"bucket": {{"name": "in"}}}}}}]}}'
        WHEN 5 THEN '{{"other": 1}}' WHEN 6 THEN 'not json' ELSE concat('{{"s3Uri": "s3://in/', o_orderkey, '"}}') END AS body FROM {orders}"""


@query(
    "message_parse",
    """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN concat('s3://in/a/', o_orderkey, '.jpg') WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL
              ELSE concat('s3://in/', o_orderkey) END AS uri,
              CASE o_orderkey % 8 WHEN 4 THEN 'no object address' WHEN 5 THEN 'no object address' WHEN 6 THEN 'invalid JSON' END AS problem FROM orders""",
)
def message_parse(spark, d):
    """Four address forms; unusable messages carry their reason."""
    marked = messages.mark_messages(spark_sql(spark, d, BODIES), "image")
    return marked.select("id", F.when(F.col("problem").isNull(), F.col("uri")).alias("uri"), "problem")


PAGE_BODIES = """
    SELECT conv_id, turn, CASE conv_id % 4 WHEN 3 THEN concat('{{"metadata": {{"page_number": ', turn, '}}, "ocr_result": {{"markdown_text": "x"}}}}')
        WHEN 2 THEN '{{"ocr_result": {{"markdown_text": "x"}}}}'
        ELSE concat('{{"message_id": "m', turn, '", "metadata": {{"document_id": "d', conv_id, '", "page_number": ', turn, '}}, "ocr_result": {{"markdown_text": "', role, '"}}}}') END AS body
    FROM {conversations}"""


@query(
    "page_messages",
    """SELECT conv_id, turn, CASE WHEN conv_id % 4 < 2 THEN concat('d', conv_id) END AS document_id, CASE WHEN conv_id % 4 < 2 THEN role END AS text,
              CASE conv_id % 4 WHEN 3 THEN 'no document_id' WHEN 2 THEN 'no metadata' END AS problem FROM conversations""",
)
def page_messages(spark, d):
    marked = messages.mark_messages(spark_sql(spark, d, PAGE_BODIES), "page")
    usable = F.col("problem").isNull()
    return marked.select(
        "conv_id", "turn", F.when(usable, F.col("m.metadata.document_id")).alias("document_id"),
        F.when(usable, F.col("m.ocr_result.markdown_text")).alias("text"), "problem",
    )


@query(
    "result_message",
    """SELECT conv_id, turn, concat('doc', conv_id) AS document_id, CASE WHEN turn % 2 = 0 THEN turn::INTEGER END AS page_number,
              length(text)::INTEGER AS character_count, text, turn % 2 = 0 AS has_page FROM conversations""",
)
def result_message(spark, d):
    """The message of every turn, read back; unknown fields are not in its text."""
    rows = bound(spark, d, "conversations").select(
        "conv_id", "turn",
        F.struct("conv_id", "turn").cast("string").alias("message_id"),
        F.lit("2024-01-01").alias("timestamp"),
        F.concat(F.lit("doc"), F.col("conv_id").cast("string")).alias("document_id"),
        F.when(F.col("turn") % 2 == 0, F.col("turn").cast("int")).alias("page_number"),
        F.col("text").alias("markdown_text"),
        F.lit("s3://out/x.md").alias("result_uri"), F.lit("s3://in/x.jpg").alias("source_uri"), F.lit("x.jpg").alias("filename"),
    )
    sent = documents.build_result_message(rows, ["document_id", "page_number"])
    m = F.from_json("body", messages.PAGE)
    key = F.from_json(F.translate("message_id", "{}", "[]"), "array<long>")
    return sent.select(m.alias("m"), "body", key.alias("k")).select(
        F.col("k")[0].alias("conv_id"), F.col("k")[1].alias("turn"),
        F.col("m.metadata.document_id").alias("document_id"), F.col("m.metadata.page_number").alias("page_number"),
        F.col("m.ocr_result.character_count").alias("character_count"), F.col("m.ocr_result.markdown_text").alias("text"),
        F.get_json_object("body", "$.metadata.page_number").isNotNull().alias("has_page"),
    )


ROUTES = """
    SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN concat('s3://given/', o_orderkey, '.ged') WHEN 1 THEN '' END AS s3_uri,
           concat('s3://in/', o_custkey, '/p.jpg') AS source_uri, concat(o_orderkey, '.ged') AS filename, o_custkey FROM {orders}"""


@query(
    "route_results",
    with_views(
        f"""SELECT id, CASE id % 3 WHEN 0 THEN s3_uri ELSE concat('s3://out/records/', o_custkey, '/', filename) END AS target_uri, id % 3 <> 0 AS must_write FROM ({ROUTES})"""
    ),
)
def route_results(spark, d):
    return documents.route_results(spark_sql(spark, d, ROUTES), "records/", "out").select("id", "target_uri", "must_write")


# ---- catalogue pages ------------------------------------------------------

PAGE_PATTERNS = {"title": r"(?s)<title>(.*?)</title>", "lang": r'<html lang="(\w+)"', "place": catalogue.SIDEBAR_PATTERNS["place"]}


@query(
    "page_fields",
    r"""SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, nullif(regexp_extract(html, '<html lang="(\w+)"', 1), '') AS lang,
               NULL::VARCHAR AS place FROM pages""",
)
def page_fields(spark, d):
    out = catalogue.extract_page_fields(bound(spark, d, "pages"), PAGE_PATTERNS, as_text=False)
    return out.select("page_id", "title", "lang", "place")


@query(
    "sidebar_fields",
    "SELECT page_id, concat('Town ', page_id) AS place, concat(page_id, ' M-1874') AS unit, NULL::VARCHAR AS years, concat(page_id, '.jpg (1 z 9)') AS page FROM pages",
)
def sidebar_fields(spark, d):
    """A side bar set in front of every page; the label of the years is missing."""
    n = F.col("page_id").cast("string")
    side = F.concat(
        F.lit('<div id="side"><b>Miejscowość:</b>\n Town '), n, F.lit("\n<b>Jednostka:</b>\n  "), n, F.lit(" M-1874\n<i>Plik:</i>\n"), n,
        F.lit(".jpg (1 z 9)\n</div>"),
    )
    pages = bound(spark, d, "pages").withColumn("html", F.concat(side, "html"))
    return catalogue.extract_page_fields(pages).select("page_id", "place", "unit", "years", "page")


@query(
    "page_links",
    r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS tag FROM pages)
        SELECT page_id, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(tag, '>([^<]*)<', 1)) AS name FROM a
        WHERE regexp_matches(tag, 'href="/[a-z]+"')""",
)
def page_links(spark, d):
    return catalogue.extract_links(bound(spark, d, "pages"), "^/[a-z]+$", ["page_id"]).select("page_id", "href", "name")


@query(
    "unit_links",
    "SELECT page_id, concat('https://base/id', page_id, '-sy3500') AS url, concat(page_id) AS number, concat('Births ', page_id) AS description, '42' AS file_count FROM pages",
)
def unit_links(spark, d):
    """A unit row set in front of every page."""
    n = F.col("page_id").cast("string")
    row = F.concat(
        F.lit('<table><tr class="r"><td><a class="u" href="/id'), n, F.lit('-sy3500">'), n, F.lit("</a></td><td>x</td><td> <b>Births "), n,
        F.lit("</b></td><td>y</td><td>42</td></tr></table>"),
    )
    pages = bound(spark, d, "pages").withColumn("html", F.concat(row, "html"))
    return catalogue.extract_units(pages, ["page_id"], "https://base").select("page_id", "url", "number", "description", "file_count")


# ---- audits ---------------------------------------------------------------


@query(
    "audit_pages",
    with_views(
        f"""SELECT document_id, total_pages, min_page, max_page, expected_pages, missing_count, round(percent, 2) AS completion_percentage, first_path,
                   {STATUS_SQL} AS status FROM ({AUDITED_SQL})"""
    ),
)
def audit_pages(spark, d):
    return audit.audit_pages(bound(spark, d, "document_pages")).select(
        "document_id", "total_pages", "min_page", "max_page", "expected_pages", "missing_count", "completion_percentage", "first_path", "status"
    )


MISSING_SQL = """
    WITH seen AS (SELECT DISTINCT document_id, page_number FROM {document_pages}),
    ends AS (SELECT document_id, min(page_number) AS a, max(page_number) AS b FROM seen GROUP BY document_id),
    lost AS (SELECT document_id, CAST(n AS INTEGER) AS page_number FROM ends, LATERAL (SELECT unnest(range(a, b + 1)) AS n)
             WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.document_id = ends.document_id AND s.page_number = n))"""


@query("missing_pages", with_views(MISSING_SQL + " SELECT document_id, page_number FROM lost"))
def missing_pages(spark, d):
    return audit.missing_pages(bound(spark, d, "document_pages"))


@query(
    "page_gaps",
    with_views(
        """SELECT document_id, previous + 1 AS first_missing, page_number - 1 AS last_missing FROM (
             SELECT *, lag(page_number) OVER (PARTITION BY document_id ORDER BY page_number) AS previous FROM (SELECT DISTINCT document_id, page_number FROM {document_pages}))
           WHERE page_number - previous > 1"""
    ),
)
def page_gaps(spark, d):
    return audit.page_gaps(bound(spark, d, "document_pages"), pages_per_chunk=3)


SUMMARY_SQL = f"""
    SELECT count(*) AS total_documents, sum(total_pages)::BIGINT AS total_pages, count(*) FILTER (missing_count = 0) AS complete_documents,
           round(count(*) FILTER (missing_count = 0) * 100.0::DOUBLE / count(*), 1) AS complete_percentage,
           count(*) FILTER (missing_count > 0) AS documents_with_missing, sum(missing_count)::BIGINT AS total_missing FROM ({AUDITED_SQL})"""


@query("audit_summary", with_views(SUMMARY_SQL))
def audit_summary(spark, d):
    return audit.audit_summary(audit.audit_pages(bound(spark, d, "document_pages")))


@query(
    "report_totals",
    with_views(
        f"""SELECT 'totals' AS part, total_documents AS a, total_missing AS b FROM ({SUMMARY_SQL})
            UNION ALL SELECT 'document', document_id, missing_count FROM ({AUDITED_SQL})"""
    ),
)
def report_totals(spark, d):
    """Rows of the JSON report, read back."""
    audited = audit.audit_pages(bound(spark, d, "document_pages"))
    rows = objects.report_rows(audited, audit.audit_summary(audited))
    pick = lambda a, b: F.coalesce(F.get_json_object("body", f"$.{a}"), F.get_json_object("body", f"$.{b}")).cast("long")
    return rows.select(
        "part", pick("document_id", "total_documents").alias("a"), pick("missing_count", "total_missing").alias("b")
    )


# ---- page groups ----------------------------------------------------------

GROUP_MESSAGES = """
    SELECT l_orderkey AS document_id, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linenumber END AS page_number,
           CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS INT) % 5 END AS total_pages, l_shipdate AS moment,
           l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS arrival FROM {lineitem}"""


@query(
    "page_counts",
    with_views(
        f"""SELECT document_id, count(*) AS message_count, count(DISTINCT page_number) AS unique_pages,
                   count(page_number) FILTER (again) AS duplicate_pages FROM (
              SELECT document_id, page_number, count(*) OVER (PARTITION BY document_id, page_number) > 1
                     AND row_number() OVER (PARTITION BY document_id, page_number) = 1 AS again FROM ({GROUP_MESSAGES})) GROUP BY document_id"""
    ),
)
def page_counts(spark, d):
    return documents.page_counts(spark_sql(spark, d, GROUP_MESSAGES))


@query(
    "expected_pages",
    with_views(
        f"""SELECT document_id, min_by(total_pages, arrival) FILTER (total_pages > 0) AS expected_pages FROM (
              SELECT document_id, arrival, max(total_pages) AS total_pages FROM ({GROUP_MESSAGES}) GROUP BY 1, 2) GROUP BY document_id"""
    ),
)
def expected_pages(spark, d):
    rows = spark_sql(spark, d, GROUP_MESSAGES).groupBy("document_id", "arrival").agg(F.max("total_pages").alias("total_pages"))
    return documents.expected_pages(rows)


@query(
    "group_status",
    with_views(
        f"""SELECT document_id, CASE WHEN unique_pages >= expected_pages THEN 'all_pages_received'
                   WHEN last_updated <= TIMESTAMP '1999-12-31 23:55:00' THEN 'timeout_reached' ELSE 'incomplete' END AS status
            FROM (SELECT document_id, count(DISTINCT page_number) AS unique_pages, max(nullif(total_pages, 0)) AS expected_pages, max(moment) AS last_updated
                  FROM ({GROUP_MESSAGES}) GROUP BY document_id)"""
    ),
)
def group_status(spark, d):
    rows = spark_sql(spark, d, GROUP_MESSAGES)
    groups = documents.page_counts(rows).join(
        rows.groupBy("document_id").agg(
            F.max(F.nullif("total_pages", F.lit(0))).alias("expected_pages"), F.max("moment").alias("last_updated")
        ),
        "document_id",
    )
    return documents.group_status(groups, F.lit("2000-01-01").cast("timestamp")).select("document_id", "status")


@query(
    "page_order",
    with_views(
        """SELECT document_id, arrival, row_number() OVER (PARTITION BY document_id ORDER BY page_number NULLS LAST, arrival) AS page_index FROM {page_texts}"""
    ),
)
def page_order(spark, d):
    return documents.sort_pages(bound(spark, d, "page_texts"), rows_per_chunk=2).select("document_id", "arrival", "page_index")


HEADER_SQL = """
    concat('DOCUMENT METADATA:', CASE WHEN m.document_title IS NOT NULL THEN concat(chr(10), 'Title: ', m.document_title) ELSE '' END,
           CASE WHEN m.date_range IS NOT NULL THEN concat(chr(10), 'Date Range: ', m.date_range) ELSE '' END,
           chr(10), 'Record Type: ', upper(m.record_type[1]), m.record_type[2:], ' Records',
           CASE WHEN m.language <> '' THEN concat(chr(10), 'Language: Latin') ELSE '' END, chr(10), 'Total Pages: ', m.n,
           CASE WHEN m.source IS NOT NULL THEN concat(chr(10), 'Source: Parish Register') ELSE '' END)"""
META_SQL = """
    m AS (SELECT document_id, count(*) AS n, arg_min(document_title, arrival) AS document_title, arg_min(date_range, arrival) AS date_range,
                 arg_min(record_type, arrival) AS record_type, arg_min(language, arrival) AS language, arg_min(source, arrival) AS source
          FROM (SELECT * FROM {page_texts}) GROUP BY document_id)"""


@query(
    "format_document",
    with_views(
        f"""WITH {META_SQL},
    s AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number NULLS LAST, arrival) AS k FROM {{page_texts}}),
    b AS (SELECT document_id, string_agg(concat('---', chr(10), 'PAGE ', coalesce(page_number::VARCHAR, concat(k, ' (page number unknown)')), ':', chr(10), chr(10), text, chr(10)), chr(10) ORDER BY k) AS body
          FROM s GROUP BY document_id)
    SELECT document_id, 0::BIGINT AS part_no, concat({HEADER_SQL}, chr(10), chr(10), body) AS text FROM m JOIN b USING (document_id)"""
    ),
)
def format_document(spark, d):
    return documents.format_documents(bound(spark, d, "page_texts"))


@query(
    "format_page",
    with_views(
        f"""WITH {META_SQL}
    SELECT p.document_id, p.arrival, concat({HEADER_SQL}, chr(10), chr(10), '---', chr(10), 'PAGE ', coalesce(page_number::VARCHAR, '1 (page number unknown)'), ':', chr(10), chr(10), p.text, chr(10)) AS text
    FROM {{page_texts}} p JOIN m USING (document_id)"""
    ),
)
def format_page(spark, d):
    return documents.format_single_pages(bound(spark, d, "page_texts")).select("document_id", "arrival", "text")


@query(
    "document_summary",
    with_views(
        """SELECT document_id, concat(CASE WHEN document_id % 3 = 0 THEN '' ELSE concat('Register ', document_id, ' ') END,
                  CASE WHEN document_id % 5 = 0 THEN '(1820-1850) ' ELSE '' END, count(*), ' pages') AS summary FROM {page_texts} GROUP BY document_id"""
    ),
)
def document_summary(spark, d):
    return documents.document_summary(bound(spark, d, "page_texts"))


@query(
    "carry_context",
    r"""WITH t AS (SELECT conv_id, turn, nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), '') AS text FROM conversations)
        SELECT conv_id, turn, coalesce(right(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 400), '') AS context
        FROM t""",
)
def carry_context(spark, d):
    """Last 400 characters of the turns before each turn."""
    c = bound(spark, d, "conversations").select("conv_id", "turn", "text")
    return documents.carry_context(c, "conv_id", "turn", "text", max_chars=400, rows_per_chunk=3).drop("text")


SESSIONS_SQL = """
    WITH e AS (SELECT user_id, event_id, event_type, date_trunc('second', ts) AS moment FROM events),
    g AS (SELECT *, CASE WHEN epoch(moment) - epoch(lag(moment) OVER w) < {gap} THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY moment, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY moment, event_id) AS n FROM g)"""


def _seconds(spark, d):
    return bound(spark, d, "events").select("user_id", "event_id", "event_type", F.date_trunc("second", "ts").alias("moment"))


@query(
    "session_docs",
    SESSIONS_SQL.replace("{gap}", "14400")
    + """ SELECT user_id, count(*) AS messages, epoch(min(moment))::BIGINT AS first_seen, epoch(max(moment))::BIGINT AS last_updated FROM s GROUP BY user_id, n""",
)
def session_docs(spark, d):
    out = documents.session_documents(_seconds(spark, d), "user_id", "moment", 14400)
    return out.select("user_id", "messages", *[F.unix_timestamp(c).alias(c) for c in ("first_seen", "last_updated")])


@query(
    "debounce",
    SESSIONS_SQL.replace("{gap}", "3600")
    + " SELECT user_id, max_by(event_id, (moment, event_id)) AS event_id, count(*) AS burst FROM s GROUP BY user_id, n",
)
def debounce(spark, d):
    return documents.debounce(_seconds(spark, d), "user_id", "moment", "event_id", 3600).select("user_id", "event_id", "burst")


@query(
    "late_drop",
    """WITH closed AS (SELECT user_id, min(ts) AS closed_at FROM events WHERE event_type = 'purchase' GROUP BY user_id)
       SELECT event_id, e.user_id FROM events e LEFT JOIN closed c ON c.user_id = e.user_id WHERE closed_at IS NULL OR ts <= closed_at""",
)
def late_drop(spark, d):
    """A purchase closes a user's group; what comes later is ignored."""
    rows = bound(spark, d, "events").select("event_id", F.col("user_id").alias("document_id"), F.col("ts").alias("at"), "event_type")
    closed = rows.where("event_type = 'purchase'").groupBy("document_id").agg(F.min("at").alias("closed_at"))
    return documents.drop_late(rows, closed).select("event_id", F.col("document_id").alias("user_id"))


@query(
    "retry_state",
    """SELECT user_id, k, count(*) FILTER (event_type = 'error') AS failures, CASE WHEN count(*) FILTER (event_type = 'error') >= 3 THEN 'permanently_failed'
              WHEN count(*) FILTER (event_type = 'error') < count(*) THEN 'processed' ELSE 'pending_retry' END AS state
       FROM (SELECT user_id, event_type, (props->>'k')::INTEGER % 10 AS k FROM events) GROUP BY 1, 2""",
)
def retry_state(spark, d):
    rows = bound(spark, d, "events").select(
        "user_id", "event_type", (F.get_json_object("props", "$.k").cast("int") % 10).alias("k")
    )
    out = documents.retry_state(rows, ["user_id", "k"], F.col("event_type") == "error")
    return out.select("user_id", "k", "failures", "state")


@query(
    "unprocessed_pages",
    with_views(
        f"""SELECT document_id, page_number, arrival FROM ({GROUP_MESSAGES}) g WHERE page_number IS NULL OR NOT EXISTS (
              SELECT 1 FROM {{document_pages}} p WHERE quantity > 25 AND p.document_id = g.document_id AND p.page_number = g.page_number)"""
    ),
)
def unprocessed_pages(spark, d):
    """Pages delivered in a large quantity count as done."""
    done = bound(spark, d, "document_pages").where("quantity > 25")
    return documents.unprocessed_pages(spark_sql(spark, d, GROUP_MESSAGES), done).select("document_id", "page_number", "arrival")
