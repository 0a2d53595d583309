"""Record linkage over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linkage, nearest
from .bindings import bound, spark_sql, with_views
from .catalog import query
from .scalars import DEATHS, SCORED, _date_score, _jaccard, _mean, _place_score, event_score_sql

COMPONENTS = linkage.COMPONENTS
ROUNDED = ", ".join(
    f"round({sql}, 6) AS {name}"
    for sql, name in zip(("v", "p", "t", "l", "score"), [*COMPONENTS, "composite_score"])
)


def _round_scores(df, *keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in [*COMPONENTS, "composite_score"]])


# Ties: equal scores may differ in the last bits between engines, so scores are ranked
# by their value to nine digits and then by id on both sides where rows are cut.
EVENT_PAIRS = f"""
    SELECT *, {SCORED} AS score FROM (
      SELECT a.id, b.id AS other, {event_score_sql()} FROM {{order_events}} a JOIN {{order_events}} b
        ON a.id <> b.id AND b.event_date BETWEEN a.event_date - 7 AND a.event_date + 7)"""


def _event_sql(threshold: float, limit: int) -> str:
    return f"""
    SELECT id, other AS duplicate_id, CAST(k AS INTEGER) AS rank, {ROUNDED} FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, other) AS k FROM ({EVENT_PAIRS}) WHERE score >= {threshold})
    WHERE k <= {limit}"""


@query("dup_event", with_views(_event_sql(0.85, 5)))
def dup_event(spark, d):
    """Death entries within a week of each other, scored, the best five per entry."""
    found = linkage.find_duplicates(spark_sql(spark, d, DEATHS), "death", 0.85, 5)
    return _round_scores(found, "id", "duplicate_id", "rank")


# The same entries read as baptisms and marriages: two groups of names.
BAPTISMS = """
    SELECT id, name_a AS child_name, name_b AS father_surname, name_c AS mother_name, name_b AS mother_maiden_name,
           codes_a AS child_name_codes, codes_b AS father_surname_codes, codes_c AS mother_name_codes, codes_b AS mother_maiden_name_codes,
           event_date AS baptism_date, parish, village, embedding FROM {order_events}"""
MARRIAGES = """
    SELECT id, name_a AS spouse1_name, name_b AS spouse1_surname, name_c AS spouse2_name, name_b AS spouse2_surname, name_a AS spouse2_maiden_name,
           codes_a AS spouse1_name_codes, codes_b AS spouse1_surname_codes, codes_c AS spouse2_name_codes, codes_b AS spouse2_surname_codes,
           codes_a AS spouse2_maiden_name_codes, event_date AS marriage_date, parish, village, embedding FROM {order_events}"""


def _grouped_sql(second: str, threshold: float, limit: int) -> str:
    def part(n: str) -> str:
        return f"CASE WHEN a.name_{n} IS NOT NULL AND b.name_{n} IS NOT NULL THEN {_jaccard(f'a.codes_{n}', f'b.codes_{n}')} END"

    names = f"({_mean([part('a'), part('b')])} + {_mean([part(n) for n in second])}) / 2"
    places = _mean(
        [
            f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN {_place_score(f'a.{c}', f'b.{c}')}::DOUBLE END"
            for c in ("parish", "village")
        ]
    )
    pairs = f"""
    SELECT *, {SCORED} AS score FROM (
      SELECT a.id, b.id AS other, list_cosine_similarity(a.embedding, b.embedding) AS v, {names} AS p,
             {_date_score('a.event_date', 'b.event_date')}::DOUBLE AS t, {places} AS l
      FROM {{order_events}} a JOIN {{order_events}} b ON a.id <> b.id AND b.event_date BETWEEN a.event_date - 7 AND a.event_date + 7)"""
    return _event_sql(threshold, limit).replace(EVENT_PAIRS, pairs)


@query("dup_baptism", with_views(_grouped_sql("cb", 0.85, 4)))
def dup_baptism(spark, d):
    found = linkage.find_duplicates(spark_sql(spark, d, BAPTISMS), "baptism", 0.85, 4)
    return _round_scores(found, "id", "duplicate_id", "rank")


@query("dup_marriage", with_views(_grouped_sql("cba", 0.85, 4)))
def dup_marriage(spark, d):
    found = linkage.find_duplicates(spark_sql(spark, d, MARRIAGES), "marriage", 0.85, 4)
    return _round_scores(found, "id", "duplicate_id", "rank")


def _person_sql(table: str, threshold: float) -> str:
    """All ordered pairs of persons at the threshold."""
    names = _mean(
        [
            f"CASE WHEN a.{n}_name IS NOT NULL AND b.{n}_name IS NOT NULL THEN {_jaccard(f'a.{n}_name_codes', f'b.{n}_name_codes')} END"
            for n in ("first", "last", "maiden")
        ]
    )
    dates = _mean(
        [
            f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN {_date_score(f'a.{c}', f'b.{c}')}::DOUBLE END"
            for c in ("birth_date", "death_date")
        ]
    )
    places = _mean(
        [
            f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN {_place_score(f'a.{c}', f'b.{c}')}::DOUBLE END"
            for c in ("birth_place", "death_place", "parish", "residence")
        ]
    )
    named = "coalesce({0}.first_name, {0}.last_name, {0}.maiden_name) IS NOT NULL"
    dated = "coalesce({0}.birth_date, {0}.death_date) IS NOT NULL"
    placed = "coalesce({0}.birth_place, {0}.death_place, {0}.parish, {0}.residence) IS NOT NULL"
    both = lambda t: f"{t.format('a')} AND {t.format('b')}"
    return f"""
    SELECT *, 0.4 * v + 0.3 * coalesce(p, 0.3) + 0.2 * coalesce(t, 0.3) + 0.1 * coalesce(l, 0.3) AS score FROM (
      SELECT a.id, b.id AS other, list_cosine_similarity(a.embedding, b.embedding) AS v, CASE WHEN {both(named)} THEN {names} END AS p,
             CASE WHEN {both(dated)} THEN {dates} END AS t, CASE WHEN {both(placed)} THEN {places} END AS l
      FROM {{{table}}} a JOIN {{{table}}} b ON a.id <> b.id AND coalesce(a.gender = b.gender, true))
    WHERE score >= {threshold}"""


LINKED = _person_sql("linked_persons", 0.85)


@query(
    "dup_person",
    with_views(
        f"""
    SELECT id, other AS duplicate_id, CAST(k AS INTEGER) AS rank, {ROUNDED} FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, other) AS k FROM ({LINKED})
      WHERE id IN (SELECT id FROM {{persons}} WHERE last_name IS NOT NULL OR maiden_name IS NOT NULL OR ((birth_date IS NOT NULL OR death_date IS NOT NULL) AND parish IS NOT NULL)))
    WHERE k <= 10"""
    ),
)
def dup_person(spark, d):
    found = linkage.find_duplicates(bound(spark, d, "linked_persons"), "person", 0.85, 10)
    return _round_scores(found, "id", "duplicate_id", "rank")


@query("blocked_pairs", with_views(f"SELECT id, other, round(score, 6) AS composite_score FROM ({LINKED}) WHERE id < other"))
def blocked_pairs(spark, d):
    """Every pair of persons at the threshold, straight from the tiles in which they meet."""
    pairs = linkage.record_pairs(bound(spark, d, "linked_persons"), "person", 0.85)
    return pairs.select("id", "other", F.round("composite_score", 6).alias("composite_score"))


@query(
    "interval_pairs",
    with_views(
        """SELECT a.id, count(*) - 1 AS partners FROM {order_events} a JOIN {order_events} b ON a.o_orderstatus = b.o_orderstatus
             AND a.o_orderpriority = b.o_orderpriority AND b.event_date BETWEEN a.event_date - 7 AND a.event_date + 7 GROUP BY a.id"""
    ),
)
def interval_pairs(spark, d):
    """Partners of each entry in its block and week, counted without forming pairs."""
    rows = bound(spark, d, "order_events").select("id", "o_orderstatus", "o_orderpriority", "event_date")
    out = linkage.partners_within_days(rows, ["o_orderstatus", "o_orderpriority"], "event_date", 7)
    return out.select("id", "partners")


@query(
    "knn_topk",
    """
    SELECT id, neighbour_id, CAST(rank AS INTEGER) AS rank, round(similarity, 6) AS similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour_id) AS rank FROM (
        SELECT a.vec_id AS id, b.vec_id AS neighbour_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id))
    WHERE rank <= 10""",
)
def knn_topk(spark, d):
    out = nearest.knn(bound(spark, d, "embeddings"), "vec_id", "embedding", 10)
    return out.withColumn("similarity", F.round("similarity", 6))


@query(
    "dup_person_knn",
    with_views(
        f"""
    WITH near AS (SELECT * FROM (
        SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.embedding, b.embedding), 9) DESC, b.id) AS n
        FROM {{copied_persons}} a JOIN {{copied_persons}} b ON a.id <> b.id) WHERE n <= 20)
    SELECT id, other AS duplicate_id, CAST(k AS INTEGER) AS rank, round(score, 6) AS composite_score FROM (
      SELECT p.*, row_number() OVER (PARTITION BY p.id ORDER BY round(score, 9) DESC, p.other) AS k FROM ({_person_sql("copied_persons", 0.85)}) p
      JOIN near ON near.id = p.id AND near.other = p.other) WHERE k <= 10"""
    ),
)
def dup_person_knn(spark, d):
    """The twenty nearest vectors are scored, as the register application does."""
    rows = bound(spark, d, "copied_persons").withColumn("embedding", F.col("embedding").cast("array<double>"))
    found = linkage.find_duplicates(rows, "person", 0.85, 10, candidate_mode="knn")
    return found.select("id", "duplicate_id", "rank", F.round("composite_score", 6).alias("composite_score"))


@query(
    "save_candidates",
    with_views(
        f"""
    WITH kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, other) AS k FROM ({EVENT_PAIRS}) WHERE score >= 0.9) WHERE k <= 10),
    pairs AS (SELECT DISTINCT least(id, other) AS record1_id, greatest(id, other) AS record2_id, round(score, 6) AS composite_score FROM kept)
    SELECT 'death' AS record_type, *, 'pending' AS status FROM pairs WHERE NOT EXISTS (
      SELECT 1 FROM orders WHERE least(o_orderkey, o_custkey) = record1_id AND greatest(o_orderkey, o_custkey) = record2_id)"""
    ),
)
def save_candidates(spark, d):
    """Up to twice the limit per record, once per pair, without the pairs stored before."""
    found = linkage.find_duplicates(spark_sql(spark, d, DEATHS), "death", 0.9, 2 * 5)
    old = bound(spark, d, "orders").select(
        F.lit("death").alias("record_type"), F.col("o_orderkey").alias("record1_id"), F.col("o_custkey").alias("record2_id")
    )
    out = linkage.save_candidates(found, "death", old)
    return out.select("record_type", "record1_id", "record2_id", F.round("composite_score", 6).alias("composite_score"), "status")


@query(
    "review_queue",
    with_views(
        f"""SELECT id, duplicate_id, composite_score FROM (SELECT id, other AS duplicate_id, {ROUNDED} FROM ({EVENT_PAIRS}) WHERE score >= 0.9)
            WHERE composite_score < 0.9999"""
    ),
)
def review_queue(spark, d):
    """Every match of an entry that needs a person, on the lists of both its entries."""
    pairs = linkage.record_pairs(spark_sql(spark, d, DEATHS), "death", 0.9)
    found = linkage.review_queue(pairs.withColumn("composite_score", F.round("composite_score", 6)))
    sides = F.array(F.struct("id", F.col("other").alias("duplicate_id")), F.struct(F.col("other").alias("id"), F.col("id").alias("duplicate_id")))
    return found.select(F.inline(sides), "composite_score")


EXACT_SQL = f"""
    WITH exact AS ({_person_sql("copied_persons", linkage.EXACT)}),
    comp AS (SELECT id, min(least(id, other)) AS component FROM exact GROUP BY id),
    kept AS (SELECT component, min_by(id, (source_batch_id, id)) AS survivor_id FROM comp JOIN {{copied_persons}} USING (id) GROUP BY component),
    mapping AS (SELECT id, survivor_id FROM comp JOIN kept USING (component) WHERE id <> survivor_id)"""


@query("merge_map", with_views(EXACT_SQL + " SELECT id, survivor_id, 1.0::DOUBLE AS composite_score FROM mapping"))
def merge_map(spark, d):
    """Exact copies are transitive here, so a component is the set of a record's matches."""
    out = linkage.merge_map(bound(spark, d, "copied_persons"), "person")
    return out.select("id", "survivor_id", F.round("composite_score", 6).alias("composite_score"))


@query(
    "merge_apply",
    with_views(
        EXACT_SQL
        + """ SELECT p.id, coalesce(f.survivor_id, p.father_id) AS father_id, coalesce(m.survivor_id, p.mother_id) AS mother_id
              FROM {copied_persons} p LEFT JOIN mapping f ON f.id = p.father_id LEFT JOIN mapping m ON m.id = p.mother_id
              WHERE p.id NOT IN (SELECT id FROM mapping)"""
    ),
)
def merge_apply(spark, d):
    """The table without merged persons, its parent links moved to the survivors."""
    from ..session import cut_lineage

    persons = bound(spark, d, "copied_persons")
    mapping = cut_lineage(linkage.merge_map(persons, "person"))
    return linkage.apply_merge(persons, mapping, ["father_id", "mother_id"]).select("id", "father_id", "mother_id")


@query(
    "merge_audit",
    with_views(
        EXACT_SQL
        + """ SELECT sha256(concat('person|', id, '|', survivor_id)) AS candidate_id, survivor_id AS kept_record_id, id AS merged_record_id,
                     first_name AS merged_first_name FROM mapping JOIN {copied_persons} USING (id)"""
    ),
)
def merge_audit(spark, d):
    persons = bound(spark, d, "copied_persons")
    mapping = linkage.merge_map(persons, "person")
    _, resolutions, _ = linkage.merge_audit(mapping, persons.drop("first_name_codes", "last_name_codes"), "person")
    return resolutions.select(
        "candidate_id", "kept_record_id", "merged_record_id",
        F.get_json_object("merged_data", "$.first_name").alias("merged_first_name"),
    )
