"""Record texts written from the given tables, read back and checked."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import detect_charset, normalize_record_text
from ..operators import documents, records, validate
from ..session import spread
from .bindings import MONTHS_SQL, bound, spark_sql, with_views
from .catalog import query
from .importing import tables_of_records

# One record per person and one family per child, as (file, order, text) lines. A line
# is (text, column that must be known); MON(x) is the month abbreviation of a date.
PERSON_LINES = [
    ("concat('0 @I', id, '@ INDI')", None),
    ("concat('1 NAME ', coalesce(first_name, ''), ' /', coalesce(last_name, ''), '/')", None),
    ("concat('1 NAME Other /Name', id, '/')", None),
    ("concat('1 SEX ', coalesce(gender, 'U'))", None),
    ("'1 BIRT'", None),
    ("'2 DATE 1 JAN 1600'", None),
    ("CASE WHEN birth_date IS NULL THEN '2 DATE UNKNOWN' ELSE concat('2 DATE ABT ', day(birth_date), ' ', MON(birth_date), ' ', year(birth_date)) END", None),
    ("concat('2 PLAC ', birth_place)", None),
    ("'3 NOTE deep'", None),
    ("'1 CHR'", None),
    ("concat('2 DATE ', MON(birth_date), ' ', year(birth_date))", "birth_date"),
    ("concat('2 PLAC ', parish)", None),
    ("'1 DEAT'", "death_date"),
    ("concat('2 DATE ', day(death_date), ' ', MON(death_date), ' ', year(death_date))", "death_date"),
    ("concat('2 PLAC ', death_place)", "death_date"),
    ("concat('1 OCCU ', occupation)", None),
    ("'1 BIRT'", None),
    ("'2 DATE 1999'", None),
    ("concat('0 @F', id, '@ FAM')", None),
    ("concat('1 HUSB @I', father_id, '@')", "father_id"),
    ("concat('1 WIFE @I', mother_id, '@')", "mother_id"),
    ("concat('1 CHIL @I', id, '@')", None),
    ("concat('1 CHIL @I', id + 1, '@')", None),
    ("'1 MARR'", "birth_date"),
    ("concat('2 DATE BET ', year(birth_date), ' AND 1990')", "birth_date"),
    ("concat('2 PLAC ', parish)", "birth_date"),
]


def _line_texts(month: str) -> list[str]:
    out = []
    for text, known in PERSON_LINES:
        text = re.sub(r"MON\((\w+)\)", month, text)
        out.append(f"CASE WHEN {known} IS NOT NULL THEN {text} END" if known else text)
    return out


LINES = f"""
    SELECT source_batch_id AS file_id, id * 100 + pos AS line_no, col AS line
    FROM (SELECT id, source_batch_id, posexplode(array({", ".join(_line_texts(r"upper(date_format(\1, 'MMM'))"))})) FROM {{persons}}) WHERE col IS NOT NULL"""
LINES_SQL = f"""
    SELECT source_batch_id AS file_id, id * 100 + pos - 1 AS line_no, line
    FROM (SELECT id, source_batch_id, unnest(texts) AS line, generate_subscripts(texts, 1) AS pos
          FROM (SELECT *, [{", ".join(_line_texts(rf"({MONTHS_SQL})[month(\1)]"))}] AS texts FROM {{persons}})) WHERE line IS NOT NULL"""


def _lines(spark, d):
    raw = spark.sql(LINES, persons=spread(bound(spark, d, "persons"), "id"))
    return raw.select("file_id", "line_no", *records.split_line(F.col("line")))


def _tree(spark, d):
    return records.assemble_records(_lines(spark, d), lines_per_chunk=20_000)


def _tables(spark, d):
    return tables_of_records(_tree(spark, d))


# ---- lines and trees ------------------------------------------------------

TEXTS = """
    SELECT id AS file_id, concat('0 HEAD', chr(10), '0 @I', id, '@ INDI', chr(13), chr(10), '1 NAME ', coalesce(first_name, ''), ' /', coalesce(last_name, ''), '/',
           chr(10), '  ', chr(10), '1 BIRT', chr(10), '2 PLAC ', birth_place, chr(10), '0 TRLR') AS text, first_name, last_name, birth_place
    FROM {persons}"""


@query(
    "gedcom_lines",
    with_views(
        f"""
    SELECT file_id, l.line_no, l.level, l.xref, l.tag, l.value FROM ({TEXTS}), LATERAL (VALUES
      (1::BIGINT, 0, NULL, 'HEAD', NULL), (2, 0, concat('@I', file_id, '@'), 'INDI', NULL),
      (3, 1, NULL, 'NAME', trim(concat(coalesce(first_name, ''), ' /', coalesce(last_name, ''), '/'))), (4, 1, NULL, 'BIRT', NULL),
      (5, 2, NULL, 'PLAC', birth_place), (6, 0, NULL, 'TRLR', NULL)) AS l(line_no, level, xref, tag, value)"""
    ),
)
def gedcom_lines(spark, d):
    return records.lines_of_text(spark_sql(spark, d, TEXTS), "file_id", "text")


@query(
    "charset_detect",
    """
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'ansel' WHEN 2 THEN 'ascii' WHEN 3 THEN 'latin-1'
           ELSE CASE WHEN n < 990 THEN 'utf-8' ELSE 'latin-1' END END AS charset
    FROM (SELECT doc_id, length(text) AS n FROM documents)""",
)
def charset_detect(spark, d):
    """The tag in front of a text, or after it, where only the first thousand bytes count."""
    k = F.col("doc_id") % 5
    tag = F.when(k == 0, "1 CHAR UTF-8\n").when(k == 1, "1 CHAR ANSEL\n").when(k == 2, "1 CHAR ASCII\n").otherwise("")
    # Plain letters only: a letter cut at the thousandth byte would make the head unreadable.
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "x").cast("binary")
    whole = F.concat(tag.cast("binary"), plain, F.when(k == 4, "1 CHAR UTF8").otherwise("").cast("binary"))
    return bound(spark, d, "documents").select("doc_id", detect_charset(whole).alias("charset"))


@query(
    "text_normalize",
    r"""SELECT doc_id, array_to_string(list_filter(string_split(replace(replace(text, '“', '"'), '”', '"'), chr(10)), lambda s: regexp_replace(s, '\s', '', 'g') <> ''), chr(10)) AS plain
        FROM documents""",
)
def text_normalize(spark, d):
    """Each text with its quotes curled and blank lines added, made plain again."""
    curled = F.translate("text", "\"'-", "”’–")
    spaced = F.replace(curled, F.lit("\n"), F.lit("\n \n\n"))
    return bound(spark, d, "documents").select("doc_id", normalize_record_text(spaced).alias("plain"))


@query(
    "gedcom_records",
    with_views(
        f"""
    WITH l AS (SELECT file_id, line_no, CAST(line[1] AS INTEGER) AS level, split_part(line, ' ', 2) AS second, split_part(line, ' ', 3) AS third FROM ({LINES_SQL})),
    r AS (SELECT *, CASE WHEN level = 0 THEN third ELSE second END AS tag, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS record_no FROM l)
    SELECT file_id, line_no, CAST(record_no AS BIGINT) AS record_no, tag,
           CASE level WHEN 1 THEN max(CASE WHEN level = 0 THEN line_no END) OVER w WHEN 2 THEN max(CASE WHEN level = 1 THEN line_no END) OVER w
                      WHEN 3 THEN max(CASE WHEN level = 2 THEN line_no END) OVER w END AS parent_line
    FROM r WINDOW w AS (PARTITION BY file_id, record_no ORDER BY line_no)"""
    ),
)
def gedcom_records(spark, d):
    return _tree(spark, d).select("file_id", "line_no", "record_no", "tag", "parent_line")


# ---- tables ---------------------------------------------------------------

BATCH = "sha256(concat('batch|', source_batch_id))"
PERSON_KEY = f"sha256(concat({BATCH}, '|', gedcom_id))"


@query(
    "persons_build",
    with_views(
        f"""SELECT {PERSON_KEY} AS id, gedcom_id, {BATCH} AS source_batch_id, first_name, last_name, gender, birth_date, birth_place,
                   death_date, death_place, occupation FROM {{persons}}"""
    ),
)
def persons_build(spark, d):
    """First name, sex and event block; inside a block the last date; back to the view."""
    return _tables(spark, d)["persons"].select(
        "id", "gedcom_id", "source_batch_id", "first_name", "last_name", "gender", "birth_date", "birth_place",
        "death_date", "death_place", "occupation",
    )


@query(
    "baptisms_build",
    with_views(
        f"""SELECT concat(gedcom_id, '_BAPM') AS gedcom_id, {PERSON_KEY} AS child_id, first_name AS child_name, gender AS child_gender,
                   CAST(date_trunc('month', birth_date) AS DATE) AS baptism_date, birth_date, parish FROM {{persons}} WHERE birth_date IS NOT NULL"""
    ),
)
def baptisms_build(spark, d):
    return _tables(spark, d)["baptisms"].select(
        "gedcom_id", "child_id", "child_name", "child_gender", "baptism_date", "birth_date", "parish"
    )


@query(
    "deaths_build",
    with_views(
        f"""SELECT concat(gedcom_id, '_DEAT') AS gedcom_id, {PERSON_KEY} AS deceased_id, first_name AS deceased_name, last_name AS deceased_surname,
                   death_date, death_place AS parish FROM {{persons}} WHERE death_date IS NOT NULL"""
    ),
)
def deaths_build(spark, d):
    return _tables(spark, d)["deaths"].select(
        "gedcom_id", "deceased_id", "deceased_name", "deceased_surname", "death_date", "parish"
    )


_PARENT = "LEFT JOIN {{persons}} {a} ON {a}.id = p.{c} AND {a}.source_batch_id = p.source_batch_id"
_JOINED = _PARENT.format(a="f", c="father_id") + " " + _PARENT.format(a="m", c="mother_id")


def _key(alias: str) -> str:
    return f"CASE WHEN {alias}.id IS NOT NULL THEN sha256(concat(sha256(concat('batch|', {alias}.source_batch_id)), '|', {alias}.gedcom_id)) END"


@query(
    "marriages_build",
    with_views(
        f"""SELECT concat('@F', p.id, '@_MARR') AS gedcom_id, CAST(date_trunc('year', p.birth_date) AS DATE) AS marriage_date, p.parish,
                   {_key('f')} AS spouse1_id, f.first_name AS spouse1_name, f.last_name AS spouse1_surname,
                   {_key('m')} AS spouse2_id, m.first_name AS spouse2_name, m.last_name AS spouse2_surname
            FROM {{persons}} p {_JOINED.replace('{{', '{').replace('}}', '}')} WHERE p.birth_date IS NOT NULL"""
    ),
)
def marriages_build(spark, d):
    return _tables(spark, d)["marriages"].select(
        "gedcom_id", "marriage_date", "parish", "spouse1_id", "spouse1_name", "spouse1_surname",
        "spouse2_id", "spouse2_name", "spouse2_surname",
    )


@query(
    "parent_links",
    with_views(
        f"""WITH fam AS (SELECT p.source_batch_id, p.id, {_key('f')} AS father, {_key('m')} AS mother FROM {{persons}} p {_JOINED.replace('{{', '{').replace('}}', '}')}),
            born AS (SELECT source_batch_id, id AS fam, id AS child, father, mother FROM fam UNION ALL SELECT source_batch_id, id, id + 1, father, mother FROM fam)
            SELECT {_key('p')} AS id, min_by(father, fam) FILTER (father IS NOT NULL) AS father_id, min_by(mother, fam) FILTER (mother IS NOT NULL) AS mother_id
            FROM born JOIN {{persons}} p ON p.id = born.child AND p.source_batch_id = born.source_batch_id GROUP BY p.id, p.source_batch_id, p.gedcom_id"""
    ),
)
def parent_links(spark, d):
    """Two families may name a child; the first that knows a parent sets it."""
    gathered = records.gather_records(_tree(spark, d))
    persons = records.person_table(records.build_persons(records.individuals_of(gathered)))
    return records.build_parent_links(records.children_of_families(gathered), persons)


@query(
    "raw_records",
    with_views(
        f"""SELECT 'INDIVIDUAL' AS record_type, gedcom_id AS external_id, concat('Other /Name', id, '/') AS name, coalesce(gender, 'U') AS sex,
                   '1999' AS date, CAST(NULL AS VARCHAR) AS husband FROM {{persons}}
            UNION ALL SELECT 'FAMILY', concat('@F', id, '@'), NULL, NULL, concat('BET ', year(birth_date), ' AND 1990'),
                   CASE WHEN father_id IS NOT NULL THEN concat('@I', father_id, '@') END FROM {{persons}} WHERE birth_date IS NOT NULL"""
    ),
)
def raw_records(spark, d):
    """Last name and sex, and the first date of the last dated block."""
    at = lambda f: F.get_json_object("raw_payload", f"$.{f}")
    return _tables(spark, d)["raw"].select(
        "record_type", "external_id", at("name").alias("name"), at("sex").alias("sex"),
        F.coalesce(at("birth"), at("marriage_date")).alias("date"), at("husband").alias("husband"),
    )


@query(
    "unresolved_refs",
    with_views(
        """SELECT source_batch_id AS file_id, concat('@I', child, '@') AS child FROM
             (SELECT source_batch_id, id + 1 AS child FROM {persons}) c
           WHERE NOT EXISTS (SELECT 1 FROM {persons} p WHERE p.id = c.child AND p.source_batch_id = c.source_batch_id)"""
    ),
)
def unresolved_refs(spark, d):
    return _tables(spark, d)["unresolved"].select("file_id", "child")


@query("batch_link", with_views(f"SELECT DISTINCT source_batch_id AS file_id, {BATCH} AS source_batch_id FROM {{persons}}"))
def batch_link(spark, d):
    files = bound(spark, d, "persons").select(F.col("source_batch_id").alias("file_id")).distinct()
    return records.assign_batch(files)


# ---- counts and checks ----------------------------------------------------

# One text per document: a record file around its words, some of them spoilt.
CHECKED = """
    SELECT doc_id AS file_id,
           concat(CASE doc_id % 4 WHEN 0 THEN ' 0 HEAD' WHEN 1 THEN '0 HEAD' ELSE '1 X' END, nl, '0 @I', doc_id, '@ INDI', nl, '1 NAME A', nl, '1 BAPM', nl,
                  '0 @F', doc_id, '@ FAM', nl, '1 CHIL @I', doc_id, '@', nl, '1 CHIL @I', doc_id + 1, '@', nl, ' 1 DEAT', nl, '1 MARR', nl, '0 @S1@ SOUR', nl,
                  CASE WHEN doc_id % 3 = 0 THEN concat('0 @I', doc_id, '@ INDI', nl) ELSE '' END, body, nl,
                  CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('0 TRLR', nl, '1 END', nl) ELSE concat('0 TRLR', nl) END) AS text, body
    FROM (SELECT doc_id, replace(replace(text, '0 TRLR', ''), '0 HEAD', '') AS body, chr(10) AS nl FROM {documents})"""


@query(
    "count_records",
    with_views(
        f"""
    WITH l AS (SELECT file_id, unnest(string_split(text, chr(10))) AS line FROM ({CHECKED})),
    c AS (SELECT file_id, count(*) FILTER (line LIKE '0 @I%' AND contains(line, '@ INDI')) AS individuals,
                 count(*) FILTER (line LIKE '0 @F%' AND contains(line, '@ FAM')) AS families,
                 count(*) FILTER (ltrim(line) LIKE '1 BAPM%' OR ltrim(line) LIKE '1 CHR%') AS baptisms,
                 count(*) FILTER (ltrim(line) LIKE '1 DEAT%') AS deaths, count(*) FILTER (ltrim(line) LIKE '1 MARR%') AS marriages FROM l GROUP BY file_id)
    SELECT *, individuals AS total_persons, baptisms + deaths + marriages AS total_events FROM c"""
    ),
)
def count_records(spark, d):
    return validate.count_records(spark_sql(spark, d, CHECKED))


@query(
    "file_summary",
    with_views(
        f"""
    SELECT file_id, len(string_split(text, chr(10))) AS total_lines, file_id % 4 < 2 AS has_header, file_id % 5 <> 0 AS has_trailer,
           CASE WHEN file_id % 3 = 0 THEN 2::BIGINT ELSE 1 END AS individual_count, 1::BIGINT AS family_count, 1::BIGINT AS source_count FROM ({CHECKED})"""
    ),
)
def file_summary(spark, d):
    return validate.file_summary(spark_sql(spark, d, CHECKED))


STRUCTURE_SQL = """
    SELECT file_id, 'structure' AS step, 1::BIGINT AS position, 'Missing GEDCOM header (0 HEAD)' AS message FROM ({c}) WHERE file_id % 4 > 1
    UNION ALL SELECT file_id, 'structure', 2, 'Missing GEDCOM trailer (0 TRLR)' FROM ({c}) WHERE file_id % 5 = 0
    UNION ALL SELECT file_id, 'structure', 3, 'GEDCOM trailer (0 TRLR) must be the last line' FROM ({c}) WHERE file_id % 5 < 2""".replace("{c}", CHECKED)


@query("validate_structure", with_views(STRUCTURE_SQL))
def validate_structure(spark, d):
    return validate.validate_structure(spark_sql(spark, d, CHECKED))


REFERENCES_SQL = r"""
    WITH l AS (SELECT file_id, unnest(string_split(text, chr(10))) AS line FROM ({c})),
    defs AS (SELECT file_id, regexp_extract(line, '^0 @([^@]+)@ \w+', 1) AS id, count(*) AS n FROM l WHERE regexp_matches(line, '^0 @([^@]+)@ \w+') GROUP BY 1, 2),
    refs AS (SELECT file_id, unnest(regexp_extract_all(line, '@([^@]+)@', 1)) AS id FROM l WHERE line NOT LIKE '0 @%'),
    bad AS (SELECT file_id, id, 'undefined' AS kind, count(*) AS times FROM refs r WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.file_id = r.file_id AND d.id = r.id) GROUP BY 1, 2
            UNION ALL SELECT file_id, id, 'duplicate', n - 1 FROM defs WHERE n > 1)""".replace("{c}", CHECKED)


@query("reference_errors", with_views(REFERENCES_SQL + " SELECT * FROM bad"))
def reference_errors(spark, d):
    return validate.reference_errors(spark_sql(spark, d, CHECKED))


LINE_ERRORS_SQL = r"""
    , raw AS (SELECT file_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM ({c})),
    odd AS (SELECT file_id, n, regexp_replace(line, '\s+$', '') AS line FROM raw),
    wrong AS (SELECT * FROM odd WHERE line <> '' AND NOT regexp_matches(line, '^\d+ (@[^@]+@ )?\w+( .*)?$'))""".replace("{c}", CHECKED)
LINE_ROWS_SQL = """
    SELECT file_id, 'format' AS step, n::BIGINT AS position, concat('Line ', n, ': Invalid format: ', line) AS message FROM wrong"""


@query("validate_lines", with_views(REFERENCES_SQL + LINE_ERRORS_SQL + LINE_ROWS_SQL))
def validate_lines(spark, d):
    return validate.validate_lines(spark_sql(spark, d, CHECKED))


@query(
    "validate_ids",
    """
    WITH refs AS (SELECT l_orderkey AS file_id, concat('I', l_partkey) AS id FROM lineitem GROUP BY 1, 2)
    SELECT file_id, 'undefined' AS step, NULL::BIGINT AS position, concat('Undefined ID reference: @', id, '@') AS message FROM refs""",
)
def validate_ids(spark, d):
    """One line of text per line item stands for a file part with one open reference."""
    texts = spark_sql(spark, d, "SELECT l_orderkey AS file_id, concat('1 CHIL @I', l_partkey, '@') AS text FROM {lineitem}")
    return validate.validate_ids(texts)


@query(
    "validate",
    with_views(
        REFERENCES_SQL
        + LINE_ERRORS_SQL
        + f""", errors AS (SELECT file_id FROM ({STRUCTURE_SQL}) UNION ALL SELECT file_id FROM ({LINE_ROWS_SQL}) UNION ALL SELECT file_id FROM bad WHERE kind = 'undefined'
                   UNION ALL SELECT file_id FROM (SELECT file_id, unnest(range(times)) FROM bad WHERE kind = 'duplicate'))
        SELECT c.file_id, count(e.file_id) = 0 AS is_valid, count(e.file_id) AS error_count FROM ({CHECKED}) c LEFT JOIN errors e ON e.file_id = c.file_id GROUP BY c.file_id"""
    ),
)
def validate_texts(spark, d):
    """Strict verdict on every text."""
    return validate.validate(spark_sql(spark, d, CHECKED), strict=True)


@query(
    "document_metrics",
    with_views(
        f"""
    WITH l AS (SELECT lang AS document_id, c.file_id, unnest(string_split(c.text, chr(10))) AS line FROM ({CHECKED}) c JOIN documents ON doc_id = c.file_id)
    SELECT document_id, count(*) FILTER (line LIKE '0 @I%' AND contains(line, '@ INDI')) AS individuals, count(*) FILTER (line LIKE '0 @F%' AND contains(line, '@ FAM')) AS families,
           count(*) FILTER (ltrim(line) LIKE '1 BAPM%' OR ltrim(line) LIKE '1 CHR%') AS baptisms, count(*) FILTER (ltrim(line) LIKE '1 DEAT%') AS deaths,
           count(*) FILTER (ltrim(line) LIKE '1 MARR%') AS marriages,
           count(*) FILTER (ltrim(line) LIKE '1 BAPM%' OR ltrim(line) LIKE '1 CHR%' OR ltrim(line) LIKE '1 DEAT%' OR ltrim(line) LIKE '1 MARR%') AS total_events
    FROM l GROUP BY document_id"""
    ),
)
def document_metrics(spark, d):
    """Counts of the texts summed per language."""
    counts = validate.count_records(spark_sql(spark, d, CHECKED))
    owner = bound(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("lang").alias("document_id"))
    return validate.document_metrics(counts.join(owner, "file_id"))


@query(
    "publish_pages",
    with_views(
        f"""
    SELECT v.file_id, concat('s3://out/records/', v.file_id % 7, '/doc', v.file_id, '_p', v.file_id % 50, '.ged') AS s3_uri,
           'invalid' AS validation_status, CASE WHEN file_id % 3 = 0 THEN 2::BIGINT ELSE 1 END AS individuals
    FROM ({CHECKED}) v"""
    ),
)
def publish_pages(spark, d):
    """Every text refers to a person outside it, so all are sent with a bad verdict."""
    pages = spark_sql(spark, d, CHECKED).select(
        "file_id",
        F.concat(F.lit("doc"), F.col("file_id").cast("string")).alias("document_id"),
        (F.col("file_id") % 50).cast("int").alias("page_number"),
        "text",
        F.concat(F.lit("s3://in/"), (F.col("file_id") % 7).cast("string"), F.lit("/x.jpg")).alias("source_uri"),
    )
    out = documents.publish_pages(pages, "records/", "out")
    return out.select("file_id", "s3_uri", "validation_status", "individuals")
