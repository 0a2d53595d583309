"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, paths, phonetic, scores, text, vectors
from ..operators import features
from ..operators.linkage import composite_score
from ..session import spread
from .bindings import bound, spark_sql, with_views
from .catalog import query

MONTH_NAMES = "['January','February','March','April','May','June','July','August','September','October','November','December']"


# ---- names and text -------------------------------------------------------

NAME_FORMS = """
    SELECT p_partkey AS id,
           CASE p_partkey % 6 WHEN 0 THEN concat(a, ' /', b, '/') WHEN 1 THEN concat(a, ' /', b)
                WHEN 2 THEN concat('/', b, '/') WHEN 3 THEN concat(' ', a, '  ', b, ' ', p_type) WHEN 4 THEN a ELSE '' END AS name,
           a, b, p_type
    FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM {part})"""


@query(
    "name_split",
    with_views(
        f"""
    SELECT id, CASE WHEN id % 6 IN (2, 5) THEN NULL ELSE a END AS first_name,
           CASE id % 6 WHEN 3 THEN concat(b, ' ', p_type) WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE b END AS last_name
    FROM ({NAME_FORMS})"""
    ),
)
def name_split(spark, d):
    parts = text.split_name(F.col("name"))
    return spark_sql(spark, d, NAME_FORMS).select("id", parts["first_name"].alias("first_name"), parts["last_name"].alias("last_name"))


@query(
    "display_name",
    with_views(
        """
    SELECT id, CASE WHEN first_name IS NULL AND last_name IS NULL THEN 'Unknown'
                    ELSE trim(concat(coalesce(first_name, ''), ' ', coalesce(last_name, ''))) END AS label
    FROM {persons}"""
    ),
)
def display_name(spark, d):
    return bound(spark, d, "persons").select("id", text.display_name(F.col("first_name"), F.col("last_name")).alias("label"))


@query(
    "normalize_text",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS plain
        FROM documents""",
)
def normalize_text(spark, d):
    return bound(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("plain"))


PLACES = """
    SELECT c_custkey AS id,
           CASE c_custkey % 6 WHEN 0 THEN concat('Parish of ', c_mktsegment) WHEN 1 THEN concat('VILLAGE OF St. ', c_mktsegment, '!')
                WHEN 2 THEN concat('Parish of Town of ', c_mktsegment) WHEN 3 THEN concat('town of village of ', c_mktsegment)
                WHEN 4 THEN NULL ELSE concat('  ', c_name, ' ') END AS place, c_mktsegment, c_name
    FROM {customer}"""


@query(
    "normalize_location",
    with_views(
        f"""
    SELECT id, CASE id % 6 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN concat('st ', lower(c_mktsegment)) WHEN 2 THEN lower(c_mktsegment)
                    WHEN 3 THEN concat('village of ', lower(c_mktsegment)) WHEN 4 THEN '' ELSE replace(lower(c_name), '#', '') END AS place
    FROM ({PLACES})"""
    ),
)
def normalize_location(spark, d):
    return spark_sql(spark, d, PLACES).select("id", text.normalize_location(F.col("place")).alias("place"))


def _slavic_sql(column: str) -> str:
    source = "".join(a for a, _ in text.SLAVIC_SINGLE) + text.SLAVIC_DROPPED
    target = "".join(b for _, b in text.SLAVIC_SINGLE)
    out = f"translate({column}, '{source}', '{target}')"
    for letter, spelled in text.SLAVIC_MULTI.items():
        out = f"replace({out}, '{letter}', '{spelled}')"
    return out


@query("slavic_fold", f"SELECT doc_id, {_slavic_sql('text')} AS folded FROM documents")
def slavic_fold(spark, d):
    return bound(spark, d, "documents").select("doc_id", text.fold_slavic(F.col("text")).alias("folded"))


def _sound_rules_sql() -> str:
    """Rows (spelling, place, addition) of the published table."""
    rows = [
        f"('{spelling}', {place}, '{addition}')"
        for spelling, places in phonetic.RULES.items()
        for place, additions in enumerate(places)
        for addition in additions
    ]
    return ", ".join(rows)


def sound_codes_sql(names: str) -> str:
    """(name, codes) of the query ``names``: sounds are walked first, then single digits."""
    word = f"regexp_replace(upper(strip_accents(replace({_slavic_sql('name')}, 'ß', 'ss'))), '[^A-Z]', '', 'g')"
    return f"""
    WITH RECURSIVE rules(spelling, place, addition) AS (VALUES {_sound_rules_sql()}),
    walk(name, begun, rest, raw) AS (
        SELECT name, false, {word}, '' FROM ({names})
        UNION
        SELECT name, true, substr(rest, length(sound) + 1), raw || addition
        FROM (SELECT *, regexp_extract(rest, '^({phonetic.LONGEST_FIRST})', 1) AS sound FROM walk WHERE rest <> '') w
        JOIN rules ON spelling = sound AND place = CASE WHEN NOT begun THEN 0
            WHEN regexp_matches(substr(rest, length(sound) + 1), '^[{phonetic.VOWELS}]') THEN 1 ELSE 2 END),
    digits(name, raw, code, heard) AS (
        SELECT name, raw, '', '' FROM walk WHERE rest = ''
        UNION
        SELECT name, substr(raw, 2), CASE WHEN raw[1] IN (heard, '-') THEN code ELSE left(code || raw[1], {phonetic.CODE_LENGTH}) END, raw[1]
        FROM digits WHERE raw <> '')
    SELECT name, array_to_string(list_sort(list(DISTINCT rpad(code, {phonetic.CODE_LENGTH}, '0'))), ',') AS codes
    FROM digits WHERE raw = '' GROUP BY name"""


@query(
    "phonetic_codes",
    sound_codes_sql(
        r"SELECT DISTINCT name FROM (SELECT unnest(regexp_split_to_array(text, '\P{L}+')) AS name FROM documents) WHERE name <> ''"
    ),
)
def phonetic_codes(spark, d):
    """Sound codes of every word of every document, once per distinct word."""
    words = bound(spark, d, "documents").select(F.explode(F.split("text", r"\P{L}+")).alias("name"))
    dim = phonetic.phonetic_dim(words, "name")
    return dim.select("name", F.array_join("codes", ",").alias("codes"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, d):
    return bound(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


WRAPPED = """
    SELECT doc_id, text,
           CASE doc_id % 5 WHEN 0 THEN concat('Here it is:\n```gedcom\n0 HEAD\n', body, '\n```\nDone') WHEN 1 THEN concat('0 HEAD\n', body, '\n')
                WHEN 2 THEN concat('Sure. 0 HEAD\n', body) WHEN 3 THEN concat('```\n0 HEAD\n', body, '\n```') ELSE body END AS reply, body
    FROM (SELECT *, replace(replace(trim(text), '`', ''), '0 HEAD', '') AS body FROM {documents})"""


@query(
    "extract_block",
    with_views(
        WRAPPED.replace("\\n", "' || chr(10) || '").join(
            ["SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE regexp_replace(concat('0 HEAD', chr(10), body), '\\s+$', '') END AS record_text FROM (", ")"]
        )
    ),
)
def extract_block(spark, d):
    return spark_sql(spark, d, WRAPPED).select("doc_id", text.extract_record_text(F.col("reply")).alias("record_text"))


# ---- dates ----------------------------------------------------------------

DATE_FORMS = """
    SELECT o_orderkey AS id, day,
           CASE o_orderkey % 16
             WHEN 0 THEN concat(dd, ' ', mon, ' ', yyyy) WHEN 1 THEN concat('ABT ', dd, ' ', mon, ' ', yyyy)
             WHEN 2 THEN concat(mon, ' ', yyyy) WHEN 3 THEN yyyy
             WHEN 4 THEN concat('BET ', dd, ' ', mon, ' AND 28 DEC ', yyyy) WHEN 5 THEN concat(yyyy, '/99')
             WHEN 6 THEN concat('(', dd, ' ', mon, ' ', yyyy, ' BC)') WHEN 7 THEN 'unknown'
             WHEN 8 THEN concat('31 FEB ', yyyy) WHEN 9 THEN concat('BETWEEN ', yyyy, ' AND 2010')
             WHEN 10 THEN concat('FROM ', yyyy, ' TO 2010') WHEN 11 THEN concat('( ', dd, ' ', lower(month), ' ', yyyy, ' )')
             WHEN 12 THEN concat('WEEN ', mon, ' AND DEC ', yyyy) WHEN 13 THEN concat('ESTIMATED ', month, ' ', yyyy)
             WHEN 14 THEN concat('BET ', mon, ' AND NOV 81') ELSE concat(dd, ' ', mon, ' 81') END AS phrase
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(day(o_orderdate) AS STRING) AS dd, CAST(year(o_orderdate) AS STRING) AS yyyy,
                 {month} AS month, upper(substr({month}, 1, 3)) AS mon FROM {orders})"""


@query(
    "date_parse",
    with_views(
        "SELECT id, phrase, CASE WHEN id % 16 IN (0, 1, 4, 11) THEN day WHEN id % 16 IN (2, 12, 13) THEN CAST(date_trunc('month', day) AS DATE) "
        "WHEN id % 16 IN (3, 5, 9) THEN CAST(date_trunc('year', day) AS DATE) WHEN id % 16 = 15 THEN make_date(81, CAST(month(day) AS INTEGER), CAST(day(day) AS INTEGER)) END AS parsed FROM ("
        + DATE_FORMS.replace("{month}", f"({MONTH_NAMES})[month(o_orderdate)]")
        + ")"
    ),
)
def date_parse(spark, d):
    forms = DATE_FORMS.replace("{month}", "date_format(o_orderdate, 'MMMM')")
    return spark_sql(spark, d, forms).select("id", "phrase", dates.parse_gedcom_date(F.col("phrase")).alias("parsed"))


NEIGHBOURS = """
    SELECT a.id, a.event_date AS date_a, b.event_date AS date_b, a.parish AS parish_a, b.parish AS parish_b,
           a.village AS village_a, b.village AS village_b, a.name_a AS name_1, b.name_a AS name_2,
           a.name_c AS name_3, b.name_c AS name_4, a.codes_a AS codes_1, b.codes_a AS codes_2, a.codes_c AS codes_3, b.codes_c AS codes_4
    FROM {order_events} a LEFT JOIN {order_events} b ON b.id = a.id + 1"""


def _date_score(a: str, b: str) -> str:
    y = f"(abs({a} - {b}) / 365.25)"
    return (
        f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 WHEN {y} = 0 THEN 1.0 WHEN {y} <= 5 THEN 1.0 - {y} / 10.0 "
        f"WHEN {y} <= 10 THEN 0.5 - ({y} - 5) / 10.0 ELSE 0.0 END)"
    )


def _place_score(a: str, b: str) -> str:
    return (
        f"(CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.0 WHEN lower({a}) = lower({b}) THEN 1.0 "
        f"WHEN contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a})) THEN 0.6 ELSE 0.3 END)"
    )


def _jaccard(a: str, b: str) -> str:
    return (
        f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE "
        f"/ len(list_distinct(list_concat({a}, {b}))) END)"
    )


def _mean(parts: list[str]) -> str:
    """Mean of the non-null SQL values, 0.0 when there is none."""
    return f"coalesce(list_avg(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)), 0.0)"


@query("date_similarity", with_views(f"SELECT id, CAST(round({_date_score('date_a', 'date_b')}, 6) AS DOUBLE) AS score FROM ({NEIGHBOURS})"))
def date_similarity(spark, d):
    score = scores.date_similarity(F.col("date_a"), F.col("date_b"))
    return spark_sql(spark, d, NEIGHBOURS).select("id", F.round(score, 6).alias("score"))


@query(
    "location_similarity",
    with_views(
        f"SELECT id, CAST({_place_score('parish_a', 'parish_b')} AS DOUBLE) AS parish_score, CAST({_place_score('village_a', 'village_b')} AS DOUBLE) AS village_score FROM ({NEIGHBOURS})"
    ),
)
def location_similarity(spark, d):
    return spark_sql(spark, d, NEIGHBOURS).select(
        "id",
        scores.location_similarity(F.col("parish_a"), F.col("parish_b")).alias("parish_score"),
        scores.location_similarity(F.col("village_a"), F.col("village_b")).alias("village_score"),
    )


@query(
    "name_similarity",
    with_views(
        "SELECT id, CAST(round("
        + _mean(
            [
                f"CASE WHEN name_1 IS NOT NULL AND name_2 IS NOT NULL THEN {_jaccard('codes_1', 'codes_2')} END",
                f"CASE WHEN name_3 IS NOT NULL AND name_4 IS NOT NULL THEN {_jaccard('codes_3', 'codes_4')} END",
            ]
        )
        + f", 6) AS DOUBLE) AS score FROM ({NEIGHBOURS})"
    ),
)
def name_similarity(spark, d):
    c = F.col
    score = scores.name_similarity(
        [(c("name_1"), c("codes_1"), c("name_2"), c("codes_2")), (c("name_3"), c("codes_3"), c("name_4"), c("codes_4"))]
    )
    return spark_sql(spark, d, NEIGHBOURS).select("id", F.round(score, 6).alias("score"))


LETTERS = """
    SELECT a.p_partkey AS id, {letters_a} AS codes_a, {letters_b} AS codes_b
    FROM {part} a JOIN {part} b ON b.p_partkey = {half}"""


@query(
    "code_jaccard",
    with_views(
        f"SELECT id, CAST(round({_jaccard('codes_a', 'codes_b')}, 6) AS DOUBLE) AS score FROM ("
        + LETTERS.replace("{letters_a}", "list_distinct(string_split(a.p_name, ''))")
        .replace("{letters_b}", "list_distinct(string_split(b.p_name, ''))")
        .replace("{half}", "a.p_partkey // 2")
        + ")"
    ),
)
def code_jaccard(spark, d):
    pairs = (
        LETTERS.replace("{letters_a}", "array_distinct(split(a.p_name, ''))")
        .replace("{letters_b}", "array_distinct(split(b.p_name, ''))")
        .replace("{half}", "a.p_partkey div 2")
    )
    return spark_sql(spark, d, pairs).select("id", F.round(scores.jaccard(F.col("codes_a"), F.col("codes_b")), 6).alias("score"))


# ---- vectors --------------------------------------------------------------


def _long(df, key: str, vector):
    """One row per dimension, rounded."""
    return df.select(key, F.posexplode(vector).alias("dim", "value")).withColumn("value", F.round("value", 6))


def _byte(word: str, n: str) -> str:
    return f"CAST('0x' || substr(md5({word}), 2 * ({n}) + 1, 2) AS INTEGER)"


@query(
    "hash_vector",
    with_views(
        f"""
    SELECT id, CAST(dim AS INTEGER) AS dim,
           CAST(round(CASE WHEN dim > 15 OR a IS NULL AND b IS NULL THEN 0
                ELSE (coalesce({_byte('a', 'dim')}, 0) + coalesce({_byte('b', 'dim')}, 0)) / 255.0 / 2 END, 6) AS DOUBLE) AS value
    FROM (SELECT id, first_name AS a, last_name AS b FROM {{persons}}), range(64) AS r(dim)"""
    ),
)
def hash_vector(spark, d):
    """Names stand for codes; a missing name is skipped but counted."""
    return _long(bound(spark, d, "persons"), "id", vectors.phonetic_vector(F.array("first_name", "last_name")))


@query(
    "location_vector",
    with_views(
        f"""
    WITH passes AS (
      SELECT id, s, i, (s * 16 + i) % 48 AS dim,
             coalesce((({_byte('a', 'i')}) + s * 37) % 256, 0) + coalesce((({_byte('b', 'i')}) + s * 37) % 256, 0) AS v
      FROM (SELECT id, birth_place AS a, death_place AS b FROM {{persons}}), range(5) AS p(s), range(16) AS q(i))
    SELECT id, CAST(dim AS INTEGER) AS dim, CAST(round(sum(v) / 255.0 / 2, 6) AS DOUBLE) AS value FROM passes GROUP BY id, dim"""
    ),
)
def location_vector(spark, d):
    return _long(bound(spark, d, "persons"), "id", vectors.location_vector(F.array("birth_place", "death_place")))


_LIVES = """
    SELECT id, year(birth_date) AS b, year(death_date) AS e, year(death_date) - year(birth_date) AS a FROM {persons}"""


def _unit(x: str) -> str:
    return f"greatest(0.0, least(1.0, ({x})))"


def _year_dims(y: str) -> list[str]:
    return [
        _unit(f"({y} - 1600) / 400.0"),
        f"CASE WHEN {y} IS NULL THEN 0 ELSE 1 END",
        f"CASE WHEN {y} // 100 - 16 BETWEEN 0 AND 3 THEN ({y} // 100 - 16) / 3.0 ELSE 0 END",
        f"({y} % 100) // 10 / 9.0",
    ]


_DIMS = (
    _year_dims("b")
    + _year_dims("e")
    + [
        _unit("a / 120.0"),
        "CASE WHEN a IS NULL THEN 0 ELSE 1 END",
        "CASE WHEN a < 18 THEN 0 WHEN a < 60 THEN 0.5 WHEN a >= 60 THEN 1 END",
        "least(a // 10, 12) / 12.0",
        _unit("(e - b) / 120.0"),
        "CASE WHEN e - b IS NULL THEN 0 ELSE 1 END",
        _unit("((b + e) // 2 - 1600) / 400.0"),
        "CASE WHEN e // 100 > b // 100 THEN 1 ELSE 0 END",
    ]
)
_ABSENT = ["b"] * 4 + ["e"] * 4 + ["a"] * 4 + ["(b + e)"] * 4
_TEMPORAL_SQL = ", ".join(
    f"CAST(CASE WHEN {miss} IS NULL THEN 0 ELSE {dim} END AS DOUBLE)" for dim, miss in zip(_DIMS, _ABSENT)
)


@query(
    "temporal_vector",
    with_views(
        f"""
    SELECT id, CAST(dim AS INTEGER) AS dim, round(v[dim + 1], 6) AS value
    FROM (SELECT id, [{_TEMPORAL_SQL}] AS v FROM ({_LIVES})), range(16) AS r(dim)"""
    ),
)
def temporal_vector(spark, d):
    return _long(spark_sql(spark, d, _LIVES), "id", vectors.temporal_vector(F.col("b"), F.col("e"), F.col("a")))


@query(
    "l2_normalize",
    """
    SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(embedding[dim + 1]::DOUBLE / n, 6) AS value
    FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings), range(64) AS r(dim)""",
)
def l2_normalize(spark, d):
    return _long(bound(spark, d, "embeddings"), "vec_id", vectors.l2_normalize(F.col("embedding")))


@query(
    "cosine_pairs",
    """
    SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_pairs(spark, d):
    a = bound(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = bound(spark, d, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id", "left").select("vec_id", F.round(vectors.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))


# ---- features -------------------------------------------------------------


@query(
    "features",
    with_views(
        r"""
    SELECT id, list_aggregate(first_name_codes, 'string_agg', ',') AS first_codes, coalesce(lower(first_name), '') AS first_plain,
           year(birth_date)::INTEGER AS birth_year, year(death_date)::INTEGER AS death_year,
           (year(death_date) - year(birth_date))::INTEGER AS age,
           replace(lower(birth_place), '#', '') AS place, coalesce(gender, 'Unknown') AS gender,
           father_id IS NOT NULL AS has_father, mother_id IS NOT NULL AS has_mother
    FROM {linked_persons}"""
    ),
)
def person_features(spark, d):
    f = features.record_features(bound(spark, d, "linked_persons"), "person")
    return f.select(
        "id",
        F.nullif(F.array_join("phonetic_first_name", ","), F.lit("")).alias("first_codes"),
        F.col("normalized_first_name").alias("first_plain"),
        "birth_year", "death_year", "age", F.col("place_birth_place").alias("place"), "gender", "has_father", "has_mother",
    )


def _place_sql(column: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({column}, '')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


def _record_sql(kind: str, names: list[str], birth: str, death: str, age: str, places: list[str], view: str) -> str:
    first, second, third = (names + ["NULL"] * 3)[:3]
    return f"""SELECT '{kind}' AS kind, id, {first} AS name1, {second} AS name2, {third} AS name3, {birth} AS b, {death} AS e, {age} AS a,
           list_filter([{', '.join(map(_place_sql, places))}], lambda p: p <> '') AS places FROM {{{view}}}"""


_RECORDS_SQL = " UNION ALL ".join(
    [
        _record_sql("person", ["first_name", "last_name", "maiden_name"], "year(birth_date)", "year(death_date)",
                    "year(death_date) - year(birth_date)", ["birth_place", "death_place", "parish", "residence"], "persons"),
        _record_sql("baptism", [], "coalesce(year(birth_date), year(baptism_date))", "NULL", "NULL", ["parish", "village"], "baptisms"),
        _record_sql("marriage", [], "year(marriage_date)", "NULL", "NULL", ["parish", "village"], "marriages"),
        _record_sql("death", ["deceased_name", "deceased_surname"], "NULL", "year(death_date)", "NULL",
                    ["parish", "village", "cemetery"], "deaths"),
    ]
)


def _turned_sql(step: str) -> str:
    return f"coalesce(list_sum(list_transform(places, lambda p: ({_byte('p', 'dim % 16')} + ({step}) * 37) % 256)), 0)"


_NAMES_SQL = "SELECT DISTINCT unnest([name1, name2, name3]) AS name FROM records"


@query(
    "record_vectors",
    with_views(
        f"""
    WITH records AS ({_RECORDS_SQL}),
    named AS (SELECT name, string_split(codes, ',') AS codes FROM ({sound_codes_sql(f"SELECT name FROM ({_NAMES_SQL}) WHERE name <> ''")})),
    coded AS (
        SELECT r.*, list_concat(coalesce(x.codes, []), coalesce(y.codes, []), coalesce(z.codes, [])) AS codes
        FROM records r LEFT JOIN named x ON x.name = name1 LEFT JOIN named y ON y.name = name2 LEFT JOIN named z ON z.name = name3),
    vectors AS (
        SELECT kind, id, codes, list_concat(
            list_transform(range(16), lambda i:
                coalesce(list_sum(list_transform(codes, lambda w: {_byte('w', 'i')})), 0)::DOUBLE / 255 / greatest(len(codes), 1)),
            list_transform(range(48), lambda i: 0::DOUBLE),
            [{_TEMPORAL_SQL}],
            list_transform(range(48), lambda dim:
                ({_turned_sql('dim // 16')} + CASE WHEN dim < 32 THEN {_turned_sql('dim // 16 + 3')} ELSE 0 END)::DOUBLE
                / 255 / greatest(len(places), 1))) AS v
        FROM coded),
    sized AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM vectors)
    SELECT kind, id, array_to_string(codes, ',') AS codes, CAST(len(v) AS INTEGER) AS dims,
           array_to_string(list_transform(v, lambda x:
               CAST(round(CAST(x / CASE WHEN n < 1e-10 THEN 1 ELSE n END AS FLOAT)::DOUBLE * 1000000) AS BIGINT)), ' ') AS millionths
    FROM sized"""
    ),
)
def record_vectors(spark, d):
    """Name codes and all 128 numbers of the stored vector of every person, baptism, marriage and death."""

    def of_kind(kind: str, view: str):
        out = features.with_embedding(spread(bound(spark, d, view), "id"), kind)
        coded = [F.col(f"{c}_codes") for c in features.PHONETIC[kind] if f"{c}_codes" in out.columns]
        return out.select(
            F.lit(kind).alias("kind"),
            "id",
            F.array_join(F.concat(*coded, F.array().cast("array<string>")), ",").alias("codes"),
            F.size("embedding").alias("dims"),
            F.array_join(
                F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("bigint").cast("string")), " "
            ).alias("millionths"),
        )

    kinds = {"person": "persons", "baptism": "baptisms", "marriage": "marriages", "death": "deaths"}
    person, baptism, marriage, death = (of_kind(kind, view) for kind, view in kinds.items())
    return person.unionByName(baptism).unionByName(marriage).unionByName(death)


# ---- keys and metadata ----------------------------------------------------

KEYS = """
    SELECT l_orderkey AS id, l_linenumber AS n, l_suppkey AS s, l_partkey AS p,
           CASE l_partkey % 8
             WHEN 0 THEN concat('s3://scans/lubelski/', l_suppkey, '/', l_orderkey, '/00', l_linenumber, '.jpg')
             WHEN 1 THEN concat('s3://scans/', l_orderkey, '/page-', l_linenumber, '.jpg')
             WHEN 2 THEN concat('s3://scans/documents/book-', l_orderkey, '/', l_linenumber, '.jpg')
             WHEN 3 THEN concat('s3://scans/area/vol', l_suppkey, '/', l_orderkey, '/Page_', l_linenumber, '.tif')
             WHEN 4 THEN concat('s3://scans/vol', l_orderkey, '/p', l_linenumber, '.png')
             WHEN 5 THEN concat('s3://scans/', l_orderkey, '.jpg')
             WHEN 6 THEN concat('s3://scans/x/books/', l_suppkey, '/deep/scan.jpg')
             ELSE concat('https://scans/', l_orderkey) END AS uri
    FROM {lineitem}"""


@query(
    "path_metadata",
    with_views(
        f"""
    SELECT uri, CASE p % 8 WHEN 0 THEN concat(s, '-', id) WHEN 1 THEN concat(id) WHEN 2 THEN concat('book-', id)
                     WHEN 3 THEN concat(id) WHEN 4 THEN concat('vol', id) WHEN 6 THEN concat(s) END AS document_id,
           CASE p % 8 WHEN 0 THEN concat(s) END AS collection_id, CASE p % 8 WHEN 0 THEN concat(id) END AS unit_number,
           CASE WHEN p % 8 IN (0, 1, 2, 3, 4) THEN n WHEN p % 8 = 5 THEN id::INTEGER END AS page_number
    FROM ({KEYS})"""
    ),
)
def path_metadata(spark, d):
    meta = paths.path_metadata(F.col("uri"))
    return spark_sql(spark, d, KEYS).withColumn("m", meta).select(
        "uri", *[F.col(f"m.{c}").alias(c) for c in ("document_id", "collection_id", "unit_number", "page_number")]
    )


@query(
    "parse_uri",
    """
    SELECT page_id, split_part(rest, '/', 1) AS bucket, substr(rest, strpos(rest, '/') + 1) AS key
    FROM (SELECT page_id, split_part(url, '://', 2) AS rest FROM pages)""",
)
def parse_uri(spark, d):
    uri = paths.parse_uri(F.regexp_replace("url", "^https?://", "s3://"))
    return bound(spark, d, "pages").select("page_id", uri["bucket"].alias("bucket"), uri["key"].alias("key"))


@query(
    "source_uri",
    with_views(
        """SELECT l_orderkey, l_linenumber, concat('s3://images/', CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'other/' END,
                  l_suppkey, '/', l_orderkey, '.v1.jpg') AS source_uri FROM {lineitem}"""
    ),
)
def source_uri(spark, d):
    keys = spark_sql(
        spark, d,
        """SELECT l_orderkey, l_linenumber, concat(CASE WHEN l_linenumber % 2 = 0 THEN 'ocr-results/' ELSE 'other/' END,
                  l_suppkey, '/', l_orderkey, '.v1.md') AS key FROM {lineitem}""",
    )
    return keys.select("l_orderkey", "l_linenumber", paths.source_uri(F.col("key"), "ocr-results/", "images").alias("source_uri"))


@query(
    "output_key",
    with_views(
        f"""
    SELECT uri, concat('records/', CASE p % 8 WHEN 0 THEN concat('lubelski/', s, '/', id, '/') WHEN 1 THEN concat(id, '/')
              WHEN 2 THEN concat('documents/book-', id, '/') WHEN 3 THEN concat('area/vol', s, '/', id, '/') WHEN 4 THEN concat('vol', id, '/')
              WHEN 6 THEN concat('x/books/', s, '/deep/') ELSE '' END, id, '.ged') AS key
    FROM ({KEYS})"""
    ),
)
def output_key(spark, d):
    name = F.concat(F.col("id").cast("string"), F.lit(".ged"))
    return spark_sql(spark, d, KEYS).select("uri", paths.output_key(F.col("uri"), "records/", name).alias("key"))


FILES = """
    SELECT c_custkey AS id,
           concat('in/', CASE c_nationkey % 8 WHEN 0 THEN '.hidden' WHEN 1 THEN concat(c_name, '.JPG') WHEN 2 THEN concat(c_name, '.png')
                WHEN 3 THEN concat(c_name, '.crdownload') WHEN 4 THEN 'Thumbs.db' WHEN 5 THEN concat(c_name, '.tif')
                WHEN 6 THEN concat(c_name, '.TMP') ELSE concat(c_name, '.jpeg') END) AS path, c_nationkey AS k
    FROM {customer}"""


@query(
    "system_files",
    with_views(
        f"""
    SELECT id, path, k % 8 IN (0, 3, 4, 6) AS is_system,
           CASE k % 8 WHEN 0 THEN 'HIDDEN' WHEN 1 THEN 'JPEG' WHEN 2 THEN 'PNG' WHEN 3 THEN 'CRDOWNLOAD' WHEN 4 THEN 'DB' WHEN 5 THEN 'TIF'
                      WHEN 6 THEN 'TMP' ELSE 'JPEG' END AS format
    FROM ({FILES})"""
    ),
)
def system_files(spark, d):
    return spark_sql(spark, d, FILES).select(
        "id", "path", paths.is_system_file(F.col("path")).alias("is_system"), paths.format_from_extension(F.col("path")).alias("format")
    )


@query(
    "url_canonical",
    """
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN CASE WHEN contains(url, '?') THEN concat(url, '&zoom=1.0') ELSE concat(url, '?zoom=1.0') END
                                     WHEN 1 THEN concat('https://base/a?zoom=1.0&p=', page_id) ELSE concat('https://base/id', page_id, '?zoom=1.0') END AS url
    FROM pages""",
)
def url_canonical(spark, d):
    href = (
        F.when(F.col("page_id") % 3 == 0, F.col("url"))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("/a?zoom=2.5&p="), F.col("page_id").cast("string")))
        .otherwise(F.concat(F.lit("id"), F.col("page_id").cast("string")))
    )
    return bound(spark, d, "pages").select("page_id", paths.canonical_url(href, "https://base").alias("url"))


TAGS = """
    SELECT event_id, concat('{{"document_id": "doc', user_id, '", "page_number": "', CASE WHEN event_type = 'error' THEN event_type ELSE k END,
           '", "language": "', event_type, '"', CASE WHEN event_type = 'click' THEN concat(', "total_pages": "', user_id, '"') ELSE '' END, '}}') AS tags,
           user_id, event_type, k
    FROM (SELECT *, regexp_replace(props, '[^0-9]', '') AS k FROM {events})"""


def _tags(spark, d):
    return spark_sql(spark, d, TAGS).withColumn("tags", F.from_json("tags", "map<string,string>"))


TAGS_SQL = """
    SELECT event_id, user_id, event_type, regexp_replace(props, '[^0-9]', '', 'g') AS k FROM {events}"""


@query(
    "tag_metadata",
    with_views(
        f"""
    SELECT event_id, concat('doc', user_id) AS document_id, event_type AS language,
           CASE WHEN event_type <> 'error' THEN k::INTEGER END AS page_number,
           CASE WHEN event_type = 'click' THEN user_id::INTEGER END AS total_pages
    FROM ({TAGS_SQL})"""
    ),
)
def tag_metadata(spark, d):
    m = paths.tag_metadata(F.col("tags"))
    return _tags(spark, d).withColumn("m", m).select(
        "event_id", *[F.col(f"m.{c}").alias(c) for c in ("document_id", "language", "page_number", "total_pages")]
    )


CATALOGUE = """
    SELECT o_orderkey AS id, o_custkey AS c, day(o_orderdate) AS n,
           concat('{{', CASE WHEN o_custkey % 5 = 0 THEN '"other": 1' ELSE concat(
               CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('"collection_id": "', o_custkey, '", ') END,
               '"place": "Town", "unit": "', CASE WHEN o_custkey % 4 = 0 THEN 'M-' ELSE '' END, o_orderkey, ' M-1874", "page": "',
               CASE o_custkey % 3 WHEN 0 THEN concat('a-b.jpg (', day(o_orderdate), ' z 99)') WHEN 1 THEN concat(' ', day(o_orderdate), ' ') ELSE 'x.jpg' END, '"') END,
               '}}') AS json
    FROM {orders}"""


def _catalogue(spark, d):
    return spark_sql(spark, d, CATALOGUE)


_CAT_SQL = "SELECT o_orderkey AS id, o_custkey AS c, day(o_orderdate)::INTEGER AS n FROM {orders}"


@query(
    "page_of_total",
    with_views(
        f"""SELECT id, CASE WHEN c % 5 <> 0 AND c % 3 <> 2 THEN n END AS page_number,
                   CASE WHEN c % 5 <> 0 AND c % 3 = 0 THEN 99 END AS total_pages FROM ({_CAT_SQL})"""
    ),
)
def page_of_total(spark, d):
    page = F.get_json_object("json", "$.page")
    m = paths.page_of_total(page)
    return _catalogue(spark, d).withColumn("m", m).select("id", "m.page_number", "m.total_pages")


@query(
    "unit_id",
    with_views(
        f"""SELECT id, CASE WHEN c % 5 <> 0 AND c % 4 <> 0 THEN concat(id) END AS unit_number,
                   CASE WHEN c % 5 <> 0 AND c % 4 <> 0 THEN CASE WHEN c % 3 = 0 THEN concat(id) ELSE concat(c, '-', id) END END AS document_id
            FROM ({_CAT_SQL})"""
    ),
)
def unit_id(spark, d):
    unit, coll = F.get_json_object("json", "$.unit"), F.get_json_object("json", "$.collection_id")
    return _catalogue(spark, d).select(
        "id", paths.unit_number(unit).alias("unit_number"), paths.unit_document_id(unit, coll).alias("document_id")
    )


@query(
    "catalogue_meta",
    with_views(
        f"""
    SELECT id, c % 5 <> 0 AS known, CASE WHEN c % 5 <> 0 AND c % 3 <> 0 THEN concat(c) END AS collection_id,
           CASE WHEN c % 5 <> 0 THEN 'Town' END AS place,
           CASE WHEN c % 5 <> 0 AND c % 4 <> 0 THEN CASE WHEN c % 3 = 0 THEN concat(id) ELSE concat(c, '-', id) END END AS document_id,
           CASE WHEN c % 5 <> 0 AND c % 3 <> 2 THEN n END AS page_number
    FROM ({_CAT_SQL})"""
    ),
)
def catalogue_meta(spark, d):
    return _catalogue(spark, d).withColumn("m", paths.catalogue_metadata(F.col("json"))).select(
        "id", F.col("m").isNotNull().alias("known"), "m.collection_id", "m.place", "m.document_id", "m.page_number"
    )


@query(
    "metadata_merge",
    with_views(
        f"""
    WITH keyed AS (SELECT e.event_id, e.user_id AS u, e.event_type AS t, e.k, o.c, o.n, o.id FROM ({TAGS_SQL}) e JOIN ({_CAT_SQL}) o ON o.id = e.event_id),
    parts AS (SELECT *, c % 5 <> 0 AS cat, c % 5 <> 0 AND c % 4 <> 0 AS has_unit, c % 5 <> 0 AND c % 3 <> 0 AS has_coll FROM keyed),
    merged AS (SELECT *, CASE WHEN has_coll THEN concat(c) ELSE concat(u) END AS collection_id, CASE WHEN has_unit THEN concat(id) ELSE '77' END AS unit_number FROM parts)
    SELECT event_id, collection_id, unit_number,
           CASE WHEN cat THEN concat(collection_id, '-', unit_number) ELSE concat('doc', u) END AS document_id,
           CASE WHEN cat AND c % 3 <> 2 THEN n WHEN t <> 'error' THEN k::INTEGER ELSE 5 END AS page_number,
           CASE WHEN cat AND c % 3 = 0 THEN 99 WHEN t = 'click' THEN u::INTEGER END AS total_pages, t AS language
    FROM merged"""
    ),
)
def metadata_merge(spark, d):
    """Tags of an event, catalogue JSON of the order with its number, and a built path."""
    joined = _tags(spark, d).join(_catalogue(spark, d), F.col("event_id") == F.col("id"))
    uri = F.concat(F.lit("s3://b/area/"), F.col("user_id").cast("string"), F.lit("/77/page-5.jpg"))
    structs = joined.select(
        "event_id",
        paths.path_metadata(uri).alias("p"),
        paths.tag_metadata(F.col("tags")).alias("t"),
        paths.catalogue_metadata(F.col("json")).alias("c"),
    )
    m = paths.merge_metadata(F.col("p"), F.col("t"), F.col("c"))
    fields = ("collection_id", "unit_number", "document_id", "page_number", "total_pages", "language")
    return structs.select("event_id", m.alias("m")).select("event_id", *[F.col(f"m.{f}").alias(f) for f in fields])


@query(
    "vertex_order_keys",
    with_views(
        """SELECT id, coalesce(year(birth_date), 9999)::INTEGER AS birth_year,
                  CASE gender WHEN 'M' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS gender_rank FROM {persons}"""
    ),
)
def vertex_order_keys(spark, d):
    return bound(spark, d, "persons").select(
        "id",
        text.birth_year_or_max(F.col("birth_date").cast("string")).alias("birth_year"),
        text.gender_rank(F.col("gender")).alias("gender_rank"),
    )


# ---- composite score ------------------------------------------------------

# Register entries as death records: two names, one date, two places.
DEATHS = """
    SELECT id, name_a AS deceased_name, name_b AS deceased_surname, name_c AS deceased_maiden_name,
           codes_a AS deceased_name_codes, codes_b AS deceased_surname_codes, codes_c AS deceased_maiden_name_codes,
           event_date AS death_date, parish, village, embedding
    FROM {order_events}"""


def event_score_sql(a: str = "a", b: str = "b") -> str:
    names = _mean(
        [
            f"CASE WHEN {a}.name_{n} IS NOT NULL AND {b}.name_{n} IS NOT NULL THEN {_jaccard(f'{a}.codes_{n}', f'{b}.codes_{n}')} END"
            for n in "abc"
        ]
    )
    places = _mean(
        [
            f"CASE WHEN {a}.{c} IS NOT NULL AND {b}.{c} IS NOT NULL THEN {_place_score(f'{a}.{c}', f'{b}.{c}')}::DOUBLE END"
            for c in ("parish", "village")
        ]
    )
    vector = f"list_cosine_similarity({a}.embedding, {b}.embedding)"
    return (
        f"{vector} AS v, {names} AS p, {_date_score(f'{a}.event_date', f'{b}.event_date')}::DOUBLE AS t, {places} AS l"
    )


SCORED = "0.4 * v + 0.3 * p + 0.2 * t + 0.1 * l"


@query(
    "composite_score",
    with_views(
        f"""
    SELECT id, round(v, 6) AS vector_similarity, round(p, 6) AS phonetic_similarity, round(t, 6) AS date_similarity,
           round(l, 6) AS location_similarity, round({SCORED}, 6) AS composite_score
    FROM (SELECT x.id, v, p, t, l FROM {{order_events}} x LEFT JOIN (SELECT a.id, {event_score_sql()} FROM {{order_events}} a JOIN {{order_events}} b ON b.id = a.id + 1) USING (id))"""
    ),
)
def composite(spark, d):
    rows = spark_sql(spark, d, DEATHS)
    body = F.struct(*[c for c in rows.columns if c != "id"])
    pairs = rows.select("id", body.alias("a")).join(rows.select((F.col("id") - 1).alias("id"), body.alias("b")), "id", "left")
    out = composite_score(pairs, "death")
    kept = ["vector_similarity", "phonetic_similarity", "date_similarity", "location_similarity", "composite_score"]
    return out.select("id", *[F.round(c, 6).alias(c) for c in kept])
