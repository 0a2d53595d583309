"""Register search, sort orders, pages and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, documents, search, windows
from .bindings import bound, spark_sql, with_views
from .catalog import query

NAME_COLUMNS = ["first_name", "last_name", "maiden_name", "birth_place", "death_place", "residence"]


def _term(term: str, columns: list[str]) -> str:
    return "(" + " OR ".join(f"coalesce({c}, '') ILIKE '%{term}%'" for c in columns) + ")"


@query(
    "search_multi",
    with_views(f"SELECT id, first_name, last_name FROM {{persons}} WHERE {_term('BL_', NAME_COLUMNS)} AND {_term('brand#1', NAME_COLUMNS)}"),
)
def search_multi(spark, d):
    """Two words, one with a wildcard, over six columns."""
    return search.search(bound(spark, d, "persons"), "BL_ brand#1", NAME_COLUMNS).select("id", "first_name", "last_name")


@query("search_single", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%12%' OR c_mktsegment ILIKE '%12%'")
def search_single(spark, d):
    return search.search(bound(spark, d, "customer"), "12", ["c_name", "c_mktsegment"]).select("c_custkey", "c_name")


@query("filter_unknown", with_views("SELECT id, gender FROM {persons} WHERE gender IS NULL OR gender = 'Unknown'"))
def filter_unknown(spark, d):
    return search.category_filter(bound(spark, d, "persons"), "gender", "Unknown").select("id", "gender")


@query("filter_category", with_views("SELECT id, gender FROM {persons} WHERE gender = 'F'"))
def filter_category(spark, d):
    return search.category_filter(bound(spark, d, "persons"), "gender", "F").select("id", "gender")


@query("filter_flag", with_views("SELECT id FROM {persons} WHERE NOT birth_date_estimated"))
def filter_flag(spark, d):
    """Any text but ``true`` means false."""
    return search.flag_filter(bound(spark, d, "persons"), "birth_date_estimated", "yes").select("id")


@query("filter_status", with_views("SELECT id, parish, village FROM {order_events} WHERE parish ILIKE '%n_1%' OR village ILIKE '%n_1%'"))
def filter_status(spark, d):
    return search.status_filter(bound(spark, d, "order_events"), ["parish", "village"], "n_1").select("id", "parish", "village")


@query(
    "filter_candidates",
    with_views("SELECT id, composite_score FROM {candidates} WHERE record_type = 'person' AND status = 'pending' AND composite_score >= 0.5"),
)
def filter_candidates(spark, d):
    return search.filter_candidates(bound(spark, d, "candidates"), "person", "pending", 0.5).select("id", "composite_score")


@query(
    "identity_filter",
    with_views(
        """SELECT id FROM {persons} WHERE coalesce(last_name, '') <> '' OR coalesce(maiden_name, '') <> ''
           OR ((birth_date IS NOT NULL OR death_date IS NOT NULL) AND parish IS NOT NULL)"""
    ),
)
def identity_filter(spark, d):
    return search.has_identity(bound(spark, d, "persons")).select("id")


FILES = """
    SELECT doc_id, concat('in/', doc_id, CASE doc_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' WHEN 3 THEN '.tif' ELSE '' END) AS path,
           n_chars FROM {documents}"""


@query(
    "validate_files",
    with_views(
        f"""
    SELECT doc_id, reason = '' AS is_valid, reason FROM (
      SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 'Unsupported extension: .txt' WHEN doc_id % 5 = 4 THEN 'Unsupported extension: '
                          WHEN n_chars < 200 THEN concat('File too small: ', n_chars, ' bytes')
                          WHEN n_chars > 20000 THEN concat('File too large: ', n_chars, ' bytes') ELSE '' END AS reason
      FROM ({FILES}))"""
    ),
)
def validate_files(spark, d):
    out = search.validate_files(spark_sql(spark, d, FILES), "path", "n_chars", None, 200, 20000)
    return out.select("doc_id", "is_valid", "reason")


FILE_STATUS = """
    SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE
           CASE WHEN o_orderpriority = '5-LOW' THEN 'processing' ELSE 'failed' END END AS processing_status FROM {orders}"""


@query("parseable_files", with_views(f"SELECT id FROM ({FILE_STATUS}) WHERE processing_status NOT IN ('processing', 'completed')"))
def parseable_files(spark, d):
    return search.parseable(spark_sql(spark, d, FILE_STATUS)).select("id")


@query(
    "sort_rank",
    with_views("SELECT id, row_number() OVER (ORDER BY birth_date DESC NULLS LAST, id) AS position FROM {persons}"),
)
def sort_rank(spark, d):
    p = bound(spark, d, "persons")
    order = [*search.sort_columns(p.columns, "birth_date", "desc"), F.asc("id")]
    return windows.sort_rank(p.select("id", "birth_date"), order).select("id", "position")


@query(
    "sort_name_rank",
    with_views("SELECT id, row_number() OVER (ORDER BY last_name NULLS LAST, first_name NULLS LAST, id) AS position FROM {persons}"),
)
def sort_name_rank(spark, d):
    p = bound(spark, d, "persons")
    order = [*search.sort_columns(p.columns, "no_such_column", "asc", "last_name"), F.asc("id")]
    return windows.sort_rank(p.select("id", "first_name", "last_name"), order).select("id", "position")


@query("sorted_register", with_views("SELECT id, first_name, last_name FROM {persons}"))
def sorted_register(spark, d):
    return search.sort_by(bound(spark, d, "persons"), "first_name", "desc").select("id", "first_name", "last_name")


@query(
    "paginate_deep",
    with_views(
        """WITH n AS (SELECT count(*) AS total FROM {persons}), ranked AS (
             SELECT *, row_number() OVER (ORDER BY last_name NULLS LAST, first_name NULLS LAST, id) AS k FROM {persons})
           SELECT id, last_name, total, CAST((total + 49) // 50 AS BIGINT) AS pages
           FROM ranked, n WHERE k BETWEEN 51 AND 100"""
    ),
)
def paginate_deep(spark, d):
    """A page of 50 rows by ranges of the order."""
    p = bound(spark, d, "persons")
    order = [*search.sort_columns(p.columns, "last_name"), F.asc("id")]
    return search.paginate_deep(p, 2, 50, order).select("id", "last_name", "total", "pages")


@query(
    "paginate",
    with_views(
        """SELECT id, last_name, (SELECT count(*) FROM {persons}) AS total, CAST((SELECT (count(*) + 19) // 20 FROM {persons}) AS BIGINT) AS pages
           FROM {persons} ORDER BY last_name NULLS LAST, first_name NULLS LAST, id LIMIT 20 OFFSET 40"""
    ),
)
def paginate(spark, d):
    p = bound(spark, d, "persons")
    order = [*search.sort_columns(p.columns, "last_name"), F.asc("id")]
    return search.paginate(p, 3, 20, order).select("id", "last_name", "total", "pages")


@query(
    "list_rows",
    with_views("SELECT id, first_name, last_name, gender, birth_date, death_date, birth_place FROM {persons}"),
)
def list_rows(spark, d):
    return search.list_rows(bound(spark, d, "persons"), "person")


@query(
    "list_events",
    with_views(
        """SELECT id, 'baptism' AS kind, baptism_date AS date, parish FROM {baptisms} UNION ALL
           SELECT id, 'marriage', marriage_date, parish FROM {marriages} UNION ALL SELECT id, 'death', death_date, parish FROM {deaths}"""
    ),
)
def list_events(spark, d):
    parts = []
    for kind in ("baptism", "marriage", "death"):
        rows = search.list_rows(bound(spark, d, kind + "s"), kind)
        parts.append(rows.select("id", F.lit(kind).alias("kind"), F.col(f"{kind}_date").alias("date"), "parish"))
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "topk_per_key",
    """SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (
         SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
       WHERE rank <= 3""",
)
def topk_per_key(spark, d):
    o = bound(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return windows.top_k_per(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).drop("o_totalprice")


@query(
    "first_per_key",
    """SELECT l_orderkey, min_by(l_partkey, (l_shipdate, l_partkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey""",
)
def first_per_key(spark, d):
    rows = bound(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    return windows.first_per(rows, ["l_orderkey"], [F.asc("l_shipdate"), F.asc("l_partkey")]).drop("l_shipdate")


@query(
    "arrival_index",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS arrival_index FROM events",
)
def arrival_index(spark, d):
    """Messages of a user numbered by arrival, in slices of six hours."""
    e = bound(spark, d, "events").select("event_id", "user_id", "ts")
    chunk = F.floor(F.unix_timestamp("ts") / 21600)
    return documents.arrival_index(e, "user_id", chunk, [F.asc("ts"), F.asc("event_id")]).drop("ts")


@query("limit_rows", "SELECT page_id, url FROM pages ORDER BY url, page_id LIMIT 25")
def limit_rows(spark, d):
    return bound(spark, d, "pages").select("page_id", "url").orderBy("url", "page_id").limit(25)


AUDIT_SQL = """
    SELECT document_id, count(DISTINCT page_number) AS total_pages, min(page_number) AS min_page, max(page_number) AS max_page,
           max(page_number)::BIGINT - min(page_number) + 1 AS expected_pages, min(path) AS first_path
    FROM {document_pages} GROUP BY document_id"""
AUDITED_SQL = f"""
    SELECT *, expected_pages - total_pages AS missing_count, total_pages * 100.0::DOUBLE / expected_pages AS percent FROM ({AUDIT_SQL})"""


@query(
    "report_ranked",
    with_views(
        f"SELECT document_id, row_number() OVER (ORDER BY missing_count DESC, document_id) AS position FROM ({AUDITED_SQL})"
    ),
)
def report_ranked(spark, d):
    a = audit.audit_pages(bound(spark, d, "document_pages")).select("document_id", "missing_count")
    return windows.sort_rank(a, audit.report_order("missing")).select("document_id", "position")


@query("report_sorted", with_views(f"SELECT document_id, total_pages FROM ({AUDITED_SQL})"))
def report_sorted(spark, d):
    return audit.sort_report(audit.audit_pages(bound(spark, d, "document_pages")), "pages").select("document_id", "total_pages")
