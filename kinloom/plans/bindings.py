"""Register tables derived from the given tables.

The given data holds no registers, so each view derives one, row for row, with
expressions that read the same in Spark and in the checking SQL. ``{...}`` names a
given table or another view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import table


MONTHS_SQL = "['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC']"


class Spark:
    @staticmethod
    def div(a: str, b: int) -> str:
        return f"(({a}) div {b})"

    @staticmethod
    def days(base: str, n: str) -> str:
        return f"date_add(DATE'{base}', CAST({n} AS INT))"

    @staticmethod
    def array(*items: str) -> str:
        return f"array({', '.join(items)})"


class Ansi:
    @staticmethod
    def div(a: str, b: int) -> str:
        return f"(({a}) // {b})"

    @staticmethod
    def days(base: str, n: str) -> str:
        return f"(DATE '{base}' + CAST({n} AS INTEGER))"

    @staticmethod
    def array(*items: str) -> str:
        return f"[{', '.join(items)}]"


def _persons(d) -> str:
    born = d.days("1750-01-01", "p_partkey % 36500")
    died = d.days("1750-01-01", "p_partkey % 36500 + (20 + p_size) * 365")
    return f"""
    SELECT p_partkey AS id,
           concat('@I', p_partkey, '@') AS gedcom_id,
           p_brand AS source_batch_id,
           CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE split_part(p_name, ' ', 1) END AS first_name,
           CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE split_part(p_name, ' ', 2) END AS last_name,
           CASE WHEN p_size % 7 = 0 THEN p_type END AS maiden_name,
           CASE WHEN p_size % 3 = 0 THEN 'M' WHEN p_size % 3 = 1 THEN 'F' END AS gender,
           CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE {born} END AS birth_date,
           CASE WHEN p_size % 4 = 0 THEN NULL ELSE {died} END AS death_date,
           p_size % 5 = 0 AS birth_date_estimated,
           p_brand AS birth_place,
           CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS death_place,
           p_type AS parish,
           CAST(NULL AS STRING) AS residence,
           p_type AS occupation,
           nullif({d.div('p_partkey', 2)}, 0) AS father_id,
           nullif({d.div('p_partkey', 3)}, 0) AS mother_id
    FROM {{part}}"""


def _linked_persons(d) -> str:
    codes = lambda c: d.array(f"substr({c}, 1, 2)", f"substr({c}, 1, 1)")
    some = lambda c: f"CASE WHEN {c} IS NULL THEN {d.array()} ELSE {codes(c)} END"
    numbers = d.array(
        "CAST(q.p_size AS DOUBLE) / 50", "q.p_retailprice / 1000", "CAST(length(q.p_name) AS DOUBLE) / 10", "CAST(1.5 AS DOUBLE)"
    )
    return f"""
    SELECT p.*, {some('first_name')} AS first_name_codes, {some('last_name')} AS last_name_codes,
           {some('maiden_name')} AS maiden_name_codes, {numbers} AS embedding
    FROM {{persons}} p JOIN {{part}} q ON q.p_partkey = p.id"""


def _copied_persons(d) -> str:
    """Persons with few distinct values, so that many agree in everything."""
    born = d.days("1800-01-01", "p_size * 400")
    codes = lambda n: d.array(f"split_part(p_name, ' ', {n})")
    return f"""
    SELECT p_partkey AS id, p_brand AS source_batch_id,
           split_part(p_name, ' ', 1) AS first_name, split_part(p_name, ' ', 2) AS last_name,
           CAST(NULL AS STRING) AS maiden_name,
           CASE WHEN p_size % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
           {born} AS birth_date, CAST(NULL AS DATE) AS death_date,
           p_type AS birth_place, CAST(NULL AS STRING) AS death_place, CAST(NULL AS STRING) AS parish,
           CAST(NULL AS STRING) AS residence,
           nullif({d.div('p_partkey', 2)}, 0) AS father_id, nullif({d.div('p_partkey', 3)}, 0) AS mother_id,
           {codes(1)} AS first_name_codes, {codes(2)} AS last_name_codes,
           CAST({d.array()} AS {"ARRAY<STRING>" if d is Spark else "VARCHAR[]"}) AS maiden_name_codes,
           {d.array("CAST(p_size AS DOUBLE) / 50", "CAST(1 AS DOUBLE)")} AS embedding
    FROM {{part}}"""


def _marriages(d) -> str:
    """Each person names the couple of its pair and of its ten; copies fold later."""
    rows = []
    for step, other in ((2, 1), (10, 2)):
        first = f"(p_partkey - p_partkey % {step})"
        rows.append(
            f"""
    SELECT 4000000000 + p_partkey * 10 + {other} AS id, concat('@F', {first}, '-{other}@_MARR') AS gedcom_id,
           p_brand AS source_batch_id, {first} AS spouse1_id, {first} + {other} AS spouse2_id,
           {d.days('1770-01-01', f'{first} % 36500')} AS marriage_date,
           p_type AS parish, CASE WHEN p_size % 2 = 0 THEN p_brand END AS village
    FROM {{part}}"""
        )
    return " UNION ALL ".join(rows)


def _baptisms(d) -> str:
    return """
    SELECT 1000000000 + id AS id, concat(gedcom_id, '_BAPM') AS gedcom_id, source_batch_id, id AS child_id,
           first_name AS child_name, gender AS child_gender, birth_date AS baptism_date, birth_date, parish,
           CASE WHEN gender = 'M' THEN birth_place END AS village, father_id, mother_id
    FROM {persons} WHERE birth_date IS NOT NULL"""


def _deaths(d) -> str:
    return """
    SELECT 2000000000 + id AS id, concat(gedcom_id, '_DEAT') AS gedcom_id, source_batch_id, id AS deceased_id,
           first_name AS deceased_name, last_name AS deceased_surname, death_date, parish,
           CASE WHEN gender = 'M' THEN death_place END AS village, birth_place AS cemetery
    FROM {persons} WHERE death_date IS NOT NULL"""


def _batches(d) -> str:
    return """
    SELECT 3000000000 + CAST(split_part(p_brand, '#', 2) AS BIGINT) AS id, p_brand AS source,
           min(p_type) AS description
    FROM {part} GROUP BY p_brand"""


def _order_events(d) -> str:
    """Orders as dated register entries with two-part names and four-number vectors."""
    return f"""
    SELECT o_orderkey AS id, o_orderstatus, o_orderpriority,
           concat('k', o_custkey % 50) AS name_a, concat('m', o_custkey % 7) AS name_b,
           CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE concat('f', o_custkey % 11) END AS name_c,
           {d.array("concat('k', o_custkey % 50)", "concat('q', o_custkey % 20)")} AS codes_a,
           {d.array("concat('m', o_custkey % 7)")} AS codes_b,
           {d.array("concat('f', o_custkey % 11)", "concat('g', o_custkey % 33)")} AS codes_c,
           CAST(o_orderdate AS DATE) AS event_date, n_name AS parish,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS village,
           {d.array("CAST(o_custkey % 50 AS DOUBLE) / 50", "CAST(o_custkey % 7 AS DOUBLE) / 7", "o_totalprice / 500000", "CAST(1 AS DOUBLE)")} AS embedding
    FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey JOIN {{nation}} ON n_nationkey = c_nationkey"""


def _document_pages(d) -> str:
    """All line items as pages; returned ones stand ten pages further on, which makes gaps."""
    return """
    SELECT l_orderkey AS document_id, l_linenumber + CASE WHEN l_returnflag = 'R' THEN 10 ELSE 0 END AS page_number,
           concat('s3://scans/', l_suppkey, '/', l_orderkey, '/', l_partkey, '.jpg') AS path,
           l_shipdate AS at, CAST(l_quantity AS BIGINT) AS quantity
    FROM {lineitem}"""


def _page_texts(d) -> str:
    """Conversation turns as pages; some turns carry no page number."""
    return """
    SELECT conv_id AS document_id, turn AS arrival,
           CASE WHEN turn % 4 = 3 THEN NULL ELSE CAST(turn AS INT) + 1 END AS page_number, text,
           CASE WHEN conv_id % 3 = 0 THEN NULL ELSE concat('Register ', conv_id) END AS document_title,
           role AS record_type, CASE WHEN conv_id % 2 = 0 THEN 'parish_register' END AS source,
           CASE WHEN conv_id % 5 = 0 THEN '1820-1850' END AS date_range,
           CASE WHEN conv_id % 7 = 0 THEN '' ELSE 'latin' END AS language, CAST(NULL AS STRING) AS location
    FROM {conversations}"""


def _candidates(d) -> str:
    """One candidate pair per order, between the records of two order numbers."""
    return f"""
    SELECT o_orderkey AS id,
           CASE WHEN o_orderstatus = 'F' THEN 'person' WHEN o_orderstatus = 'O' THEN 'baptism' ELSE 'death' END AS record_type,
           CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1000000000 ELSE 2000000000 END + o_custkey AS record1_id,
           CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1000000000 ELSE 2000000000 END + {d.div('o_orderkey', 4)} AS record2_id,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'confirmed' WHEN o_orderpriority = '5-LOW' THEN 'rejected' ELSE 'pending' END AS status,
           o_totalprice / 500000 AS composite_score
    FROM {{orders}}"""


def _kin(d) -> str:
    """Customers as persons in pairs that agree in all but what a few of them lack."""
    g = d.div("c_custkey", 2)
    return f"""
    SELECT c_custkey AS id, c_mktsegment AS source_batch_id, {g} AS pair, c_custkey % 2 AS copy,
           concat('n', {g} % 50) AS first_name, concat('s', {g} % 70) AS last_name,
           CASE WHEN {g} % 2 = 0 THEN 'M' ELSE 'F' END AS gender, concat('p', {g} % 9) AS birth_place,
           CASE WHEN {g} % 2 = 0 AND c_custkey % 2 = 1 THEN NULL ELSE {d.days('1800-01-01', f'({g} * 37) % 20000')} END AS birth_date,
           {d.array(f"concat('n', {g} % 50)")} AS first_name_codes, {d.array(f"concat('s', {g} % 70)")} AS last_name_codes,
           {d.array(f"CAST({g} % 50 AS DOUBLE) / 50", f"CAST({g} % 70 AS DOUBLE) / 70", "CAST(1 AS DOUBLE)")} AS embedding,
           CASE WHEN c_custkey > 40 THEN c_custkey - 40 END AS father_id, CAST(NULL AS STRING) AS maiden_name,
           {"CAST(array() AS ARRAY<STRING>)" if d is Spark else "CAST([] AS VARCHAR[])"} AS maiden_name_codes, CAST(NULL AS DATE) AS death_date,
           CAST(NULL AS STRING) AS death_place, CAST(NULL AS STRING) AS parish, CAST(NULL AS STRING) AS residence
    FROM {{customer}}"""


def _kin_event(d, base: int, first: str, second: str, misspelt: str) -> str:
    """An entry for every person of a pair; ``misspelt``: where the second of the pair has another name."""
    name = f"CASE WHEN copy = 1 AND {misspelt} THEN concat('x', pair % 50) ELSE concat('n', pair % 50) END"
    return f"""
    SELECT {base} + id AS id, source_batch_id, concat('p', pair % 9) AS parish, CAST(NULL AS STRING) AS village,
           {name} AS {first}, {d.array(name)} AS {first}_codes,
           concat('s', pair % 70) AS {second}, {d.array("concat('s', pair % 70)")} AS {second}_codes, embedding"""


def _kin_baptisms(d) -> str:
    return f"""{_kin_event(d, 1000000000, 'child_name', 'father_surname', 'pair % 3 = 0')},
           id AS child_id, concat('m', pair % 11) AS mother_name, {d.array("concat('m', pair % 11)")} AS mother_name_codes,
           {d.days('1800-01-04', '(pair * 37) % 20000')} AS baptism_date
    FROM {{kin}}"""


def _kin_deaths(d) -> str:
    return f"""{_kin_event(d, 2000000000, 'deceased_name', 'deceased_surname', 'pair % 5 <> 0')},
           id AS deceased_id, {d.days('1870-01-01', '(pair * 11) % 9000')} AS death_date
    FROM {{kin}}"""


def _kin_marriages(d) -> str:
    return f"""{_kin_event(d, 4000000000, 'spouse1_name', 'spouse1_surname', 'pair % 4 <> 0')},
           id AS spouse1_id, id + 2 AS spouse2_id, concat('n', (pair + 1) % 50) AS spouse2_name, {d.array("concat('n', (pair + 1) % 50)")} AS spouse2_name_codes,
           {d.days('1830-01-01', '(pair * 13) % 12000')} AS marriage_date
    FROM {{kin}}"""


BUILDERS = {
    "kin": _kin,
    "kin_baptisms": _kin_baptisms,
    "kin_deaths": _kin_deaths,
    "kin_marriages": _kin_marriages,
    "persons": _persons,
    "linked_persons": _linked_persons,
    "copied_persons": _copied_persons,
    "marriages": _marriages,
    "baptisms": _baptisms,
    "deaths": _deaths,
    "batches": _batches,
    "order_events": _order_events,
    "document_pages": _document_pages,
    "page_texts": _page_texts,
    "candidates": _candidates,
}
GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _needs(text: str) -> list[str]:
    return [n for n in [*BUILDERS, *GIVEN] if "{" + n + "}" in text]


def bound(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view (or given table) as a DataFrame."""
    if name in GIVEN:
        return table(spark, folder, name)
    return spark_sql(spark, folder, BUILDERS[name](Spark))


def spark_sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """SQL over views and given tables, written as ``{name}``."""
    return spark.sql(text, **{n: bound(spark, folder, n) for n in _needs(text)})


def with_views(body: str) -> str:
    """Checking SQL whose ``{name}`` views are spelled out in front."""
    needed: dict[str, str] = {}

    def add(text: str) -> None:
        for n in _needs(text):
            if n in BUILDERS and n not in needed:
                inner = BUILDERS[n](Ansi)
                add(inner)
                needed[n] = inner
    add(body)
    names = {n: n for n in [*BUILDERS, *GIVEN]}
    parts = ",\n".join(f"{n} AS ({text.format(**names)})" for n, text in needed.items())
    main = body.format(**names).strip()
    if not parts:
        return main
    if main.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {parts},\n{main[len('WITH RECURSIVE'):]}"
    if main.upper().startswith("WITH"):
        return f"WITH {parts},\n{main[len('WITH'):]}"
    return f"WITH {parts}\n{main}"
