"""Joins, unions and aggregates of register tables, and table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, changes, records, relate
from ..operators.linkage import merge_map
from ..session import cut_lineage
from ..sources import objects
from .bindings import bound, spark_sql, with_views
from .catalog import query
from .linkage import EXACT_SQL
from .register import AUDITED_SQL


def _label(alias: str) -> str:
    return (
        f"CASE WHEN {alias}.id IS NULL THEN NULL WHEN {alias}.first_name IS NULL AND {alias}.last_name IS NULL THEN 'Unknown' "
        f"ELSE trim(concat(coalesce({alias}.first_name, ''), ' ', coalesce({alias}.last_name, ''))) END"
    )


@query(
    "join_parents",
    with_views(
        """SELECT p.id, f.first_name AS father_first_name, f.last_name AS father_last_name, m.first_name AS mother_first_name,
                  m.last_name AS mother_last_name
           FROM {persons} p LEFT JOIN {persons} f ON f.id = p.father_id LEFT JOIN {persons} m ON m.id = p.mother_id"""
    ),
)
def join_parents(spark, d):
    out = relate.with_parents(bound(spark, d, "persons"))
    return out.select("id", *[f"{r}_{c}_name" for r in ("father", "mother") for c in ("first", "last")])


@query("join_dim", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def join_dim(spark, d):
    dim = bound(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return relate.with_status(bound(spark, d, "customer"), dim, "c_nationkey").select("c_custkey", "n_name")


@query(
    "join_spouses",
    with_views(
        f"""SELECT m.id, {_label('a')} AS spouse1_label, {_label('b')} AS spouse2_label FROM {{marriages}} m
            LEFT JOIN {{persons}} a ON a.id = m.spouse1_id LEFT JOIN {{persons}} b ON b.id = m.spouse2_id"""
    ),
)
def join_spouses(spark, d):
    out = relate.with_spouses(bound(spark, d, "marriages"), bound(spark, d, "persons"))
    return out.select("id", "spouse1_label", "spouse2_label")


CHILDREN_SQL = """
    SELECT father_id AS parent_id, id AS child_id FROM {persons} WHERE father_id IS NOT NULL
    UNION SELECT mother_id, id FROM {persons} WHERE mother_id IS NOT NULL"""


@query("children", with_views(CHILDREN_SQL))
def children(spark, d):
    return relate.children_of(bound(spark, d, "persons"))


@query(
    "marriages_of",
    with_views(
        """SELECT spouse1_id AS person_id, spouse2_id AS spouse_id, id AS marriage_id, marriage_date FROM {marriages}
           UNION ALL SELECT spouse2_id, spouse1_id, id, marriage_date FROM {marriages}"""
    ),
)
def marriages_of(spark, d):
    return relate.marriages_of(bound(spark, d, "marriages"))


@query(
    "roles_union",
    with_views(
        " UNION ALL ".join(
            f"SELECT {r}_id AS person_id, '{r}' AS role, id AS baptism_id, baptism_date FROM {{baptisms}} WHERE {r}_id IS NOT NULL"
            for r in ("child", "father", "mother")
        )
    ),
)
def roles_union(spark, d):
    return relate.baptisms_of(bound(spark, d, "baptisms")).select("person_id", "role", "baptism_id", "baptism_date")


def _detail(section, key, item="NULL", role="NULL", name="NULL", date="NULL", est="NULL", source="", where="TRUE"):
    return (
        f"SELECT {key} AS id, '{section}' AS section, CAST({item} AS VARCHAR) AS item_id, CAST({role} AS VARCHAR) AS role, "
        f"CAST({name} AS VARCHAR) AS name, CAST({date} AS VARCHAR) AS date, CAST({est} AS BOOLEAN) AS estimated FROM {source} WHERE {where}"
    )


@query(
    "person_details",
    with_views(
        f"""WITH wed AS (SELECT spouse1_id AS me, spouse2_id AS other, id, marriage_date FROM {{marriages}}
                 UNION ALL SELECT spouse2_id, spouse1_id, id, marriage_date FROM {{marriages}}),
            kids AS ({CHILDREN_SQL})
        """
        + " UNION ALL ".join(
            [
                _detail("birth", "id", date="birth_date", est="birth_date_estimated", source="{persons}", where="birth_date IS NOT NULL"),
                _detail("death", "id", date="death_date", est="FALSE", source="{persons}", where="death_date IS NOT NULL"),
                *[
                    _detail("parent", "p.id", f"p.{r}_id", f"'{r}'", _label("o"), source=f"{{persons}} p JOIN {{persons}} o ON o.id = p.{r}_id")
                    for r in ("father", "mother")
                ],
                _detail("child", "k.parent_id", "k.child_id", name=_label("o"), source="kids k JOIN {persons} o ON o.id = k.child_id"),
                _detail("marriage", "w.me", "w.id", name=_label("o"), date="w.marriage_date", source="wed w LEFT JOIN {persons} o ON o.id = w.other"),
                *[
                    _detail("baptism", f"{r}_id", "id", f"'{r}'", date="baptism_date", source="{baptisms}", where=f"{r}_id IS NOT NULL")
                    for r in ("child", "father", "mother")
                ],
                _detail("death_record", "deceased_id", "id", date="death_date", source="{deaths}"),
            ]
        )
    ),
)
def person_details(spark, d):
    names = ("persons", "marriages", "baptisms", "deaths")
    return relate.person_details({n: bound(spark, d, n) for n in names})


@query(
    "xref_join",
    with_views(
        """SELECT f.id, f.xref, p.id AS found_id, p.last_name AS found_last FROM
           (SELECT id, source_batch_id, concat('@I', father_id, '@') AS xref FROM {persons}) f
           LEFT JOIN {persons} p ON p.source_batch_id = f.source_batch_id AND p.gedcom_id = f.xref"""
    ),
)
def xref_join(spark, d):
    p = bound(spark, d, "persons")
    rows = p.select("id", "source_batch_id", F.concat(F.lit("@I"), F.coalesce(F.col("father_id").cast("string"), F.lit("")), F.lit("@")).alias("xref"))
    out = records.resolve_xref(rows, p, "xref", "found", [("id", "_id"), ("last_name", "_last")])
    return out.select("id", "xref", "found_id", "found_last")


KINDS = ("person", "baptism", "death")
RECORD_SQL = {
    "person": "SELECT id, coalesce(first_name, '-') AS shown FROM {persons}",
    "baptism": "SELECT id, coalesce(child_name, '-') AS shown FROM {baptisms}",
    "death": "SELECT id, coalesce(deceased_name, '-') AS shown FROM {deaths}",
}
ALL_RECORDS_SQL = " UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM ({s})" for k, s in RECORD_SQL.items())


def _records(spark, d):
    return {k: spark_sql(spark, d, s) for k, s in RECORD_SQL.items()}


@query(
    "enrich_pairs",
    with_views(
        f"""WITH r AS ({ALL_RECORDS_SQL})
            SELECT c.id, c.record_type, a.shown AS first_shown, b.shown AS second_shown FROM {{candidates}} c
            JOIN r a ON a.kind = c.record_type AND a.id = c.record1_id JOIN r b ON b.kind = c.record_type AND b.id = c.record2_id"""
    ),
)
def enrich_pairs(spark, d):
    tables = {k: (t, ["shown"]) for k, t in _records(spark, d).items()}
    out = relate.enrich_candidates(bound(spark, d, "candidates"), tables)
    shown = lambda c: F.get_json_object(c, "$.shown")
    return out.select("id", "record_type", shown("record1").alias("first_shown"), shown("record2").alias("second_shown"))


@query(
    "orphan_pairs",
    with_views(
        f"""WITH r AS ({ALL_RECORDS_SQL})
            SELECT c.id, c.record_type FROM {{candidates}} c
            WHERE NOT EXISTS (SELECT 1 FROM r WHERE kind = c.record_type AND r.id = c.record1_id)
               OR NOT EXISTS (SELECT 1 FROM r WHERE kind = c.record_type AND r.id = c.record2_id)"""
    ),
)
def orphan_pairs(spark, d):
    return relate.orphan_candidates(bound(spark, d, "candidates"), _records(spark, d)).select("id", "record_type")


@query(
    "unprocessed",
    "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def unprocessed(spark, d):
    """Orders as images, line items as results, matched by key without extension."""
    images = spark_sql(spark, d, "SELECT o_orderkey, concat('in/', o_orderkey, '.jpg') AS image FROM {orders}")
    results = spark_sql(spark, d, "SELECT concat('in/', l_orderkey, '.md') AS result FROM {lineitem}")
    return relate.unprocessed(images, results, "image", "result").select("o_orderkey")


@query(
    "companion_join",
    """SELECT o_orderkey, c_custkey AS companion FROM orders LEFT JOIN customer ON c_custkey = o_orderkey""",
)
def companion_join(spark, d):
    images = spark_sql(spark, d, "SELECT o_orderkey, concat('in/a/', o_orderkey, '.jpg') AS image FROM {orders}")
    notes = spark_sql(spark, d, "SELECT c_custkey AS companion, concat('in/a/', c_custkey, '.JSON') AS note FROM {customer}")
    return objects.join_companion(images, notes, "image", "note").select("o_orderkey", "companion")


@query(
    "insert_new",
    with_views(
        """SELECT id, record1_id, record2_id FROM {candidates} c WHERE NOT EXISTS (
             SELECT 1 FROM {marriages} m WHERE least(m.spouse1_id, m.spouse2_id) = least(c.record1_id, c.record2_id)
               AND greatest(m.spouse1_id, m.spouse2_id) = greatest(c.record1_id, c.record2_id))"""
    ),
)
def insert_new(spark, d):
    """Pairs that are not stored in either order."""
    new = bound(spark, d, "candidates").select("id", "record1_id", "record2_id")
    old = bound(spark, d, "marriages").select(F.col("spouse2_id").alias("record1_id"), F.col("spouse1_id").alias("record2_id"))
    return relate.insert_new(new, old, ["record1_id", "record2_id"], unordered=True)


STATUS_SQL = (
    "CASE WHEN missing_count = 0 THEN 'complete' WHEN percent >= 90 THEN 'mostly_complete' WHEN percent >= 50 THEN 'partial' ELSE 'incomplete' END"
)


def _page_keys(spark, d):
    keys = spark_sql(spark, d, "SELECT l_orderkey AS document_id, l_partkey, l_linenumber, CAST(l_suppkey AS BIGINT) AS total_pages FROM {lineitem}")
    return keys, audit.audit_pages(bound(spark, d, "document_pages"))


@query(
    "with_audit",
    with_views(
        f"""SELECT l_orderkey AS document_id, l_partkey, l_linenumber, {STATUS_SQL.replace("ELSE 'incomplete'", "WHEN percent IS NOT NULL THEN 'incomplete'")} AS status,
                   coalesce(expected_pages, l_suppkey) AS total_pages FROM {{lineitem}} LEFT JOIN ({AUDITED_SQL}) ON document_id = l_orderkey"""
    ),
)
def with_audit(spark, d):
    keys, audited = _page_keys(spark, d)
    return relate.with_audit(keys, audited)


@query(
    "only_complete",
    with_views(
        f"SELECT l_orderkey AS document_id, l_partkey, l_linenumber FROM {{lineitem}} WHERE l_orderkey IN (SELECT document_id FROM ({AUDITED_SQL}) WHERE missing_count = 0)"
    ),
)
def only_complete(spark, d):
    keys, audited = _page_keys(spark, d)
    return relate.only_complete(keys, audited).select("document_id", "l_partkey", "l_linenumber")


@query("missing_only", with_views(f"SELECT document_id, missing_count FROM ({AUDITED_SQL}) WHERE missing_count > 0"))
def missing_only(spark, d):
    audited = audit.audit_pages(bound(spark, d, "document_pages"))
    return audit.missing_only(audited).select("document_id", "missing_count")


@query(
    "candidate_stats",
    with_views(
        """SELECT 'status' AS part, status AS name, count(*) AS count FROM {candidates} GROUP BY status
           UNION ALL SELECT 'pending_type', record_type, count(*) FROM {candidates} WHERE status = 'pending' GROUP BY record_type"""
    ),
)
def candidate_stats(spark, d):
    return audit.candidate_stats(bound(spark, d, "candidates"))


@query(
    "import_stats",
    with_views(
        EXACT_SQL
        + """ SELECT source_batch_id AS batch_id, count(*) FILTER (t = 'p') AS persons, count(*) FILTER (t = 'b') AS baptisms,
                  count(*) FILTER (t = 'm') AS marriages, count(*) FILTER (t = 'd') AS deaths, count(*) FILTER (t = 'l') AS parent_links,
                  count(*) FILTER (t = 'x') AS merged, count(*) FILTER (t = 'e') AS errors
           FROM (SELECT source_batch_id, 'p' AS t FROM {persons} UNION ALL SELECT source_batch_id, 'b' FROM {baptisms}
                 UNION ALL SELECT source_batch_id, 'm' FROM {marriages} UNION ALL SELECT source_batch_id, 'd' FROM {deaths}
                 UNION ALL SELECT source_batch_id, 'l' FROM {persons} WHERE father_id IS NOT NULL UNION ALL SELECT source_batch_id, 'l' FROM {persons} WHERE mother_id IS NOT NULL
                 UNION ALL SELECT source_batch_id, 'x' FROM mapping JOIN {copied_persons} USING (id)
                 UNION ALL SELECT source_batch_id, 'e' FROM {marriages} WHERE spouse2_id NOT IN (SELECT id FROM {persons})) GROUP BY 1"""
    ),
)
def import_stats(spark, d):
    """Rows, parent links, merged persons, and marriages whose second spouse isn't there, per batch."""
    tables = {n: bound(spark, d, n) for n in ("persons", "baptisms", "marriages", "deaths")}
    copied = bound(spark, d, "copied_persons")
    mapping = cut_lineage(merge_map(copied, "person"))
    known = tables["persons"].select(F.col("id").alias("spouse2_id"))
    more = {
        "parent_links": records.link_rows(tables["persons"]),
        "merged": copied.join(mapping.select("id"), "id", "left_semi"),
        "errors": tables["marriages"].join(known, "spouse2_id", "left_anti"),
    }
    return records.import_stats({**tables, **more})


@query(
    "success_rate",
    """SELECT user_id, count(*) AS files_processed, count(*) FILTER (event_type <> 'error') AS files_uploaded,
              round(count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE, 6) AS success_rate FROM events GROUP BY user_id""",
)
def success_rate(spark, d):
    out = audit.upload_stats(bound(spark, d, "events"), F.col("event_id").isNotNull(), F.col("event_type") != "error", ["user_id"])
    return out.withColumn("success_rate", F.round("success_rate", 6))


# ---- changes --------------------------------------------------------------

# Pairs are reviewed against the order of their keys; some twice, a rejection before or after a confirmation.
REVIEWS = """
    SELECT o_orderkey AS candidate_id, CASE WHEN (o_custkey + k) % 2 = 0 THEN 'confirm' ELSE 'reject' END AS action,
           1000000000 - o_orderkey * 2 + k * (o_custkey % 7) AS review_no,
           concat('clerk ', o_custkey % 3, '.', k) AS reviewed_by, CAST(NULL AS STRING) AS review_notes
    FROM {orders}, (SELECT 0 AS k UNION ALL SELECT 1) AS n
    WHERE o_orderpriority IN ('2-HIGH', '5-LOW', '1-URGENT') AND (k = 0 OR o_orderkey % 3 = 0)"""
# The pairs once with their ends exchanged: mutual pairs, and chains through both ends.
MIXED = """
    SELECT id, record_type, CASE WHEN id % 5 = 0 THEN record2_id ELSE record1_id END AS record1_id,
           CASE WHEN id % 5 = 0 THEN record1_id ELSE record2_id END AS record2_id, status, composite_score FROM {candidates}
    UNION ALL SELECT id + 4000000000, record_type, record2_id, record1_id, status, composite_score FROM {candidates} WHERE id % 4 = 0"""
ALL_REVIEWS = f"SELECT * FROM ({REVIEWS}) UNION ALL SELECT candidate_id + 4000000000, 'confirm', review_no + 3, reviewed_by, review_notes FROM ({REVIEWS}) WHERE candidate_id % 4 = 0"
_REVIEWED = """
    WITH RECURSIVE cand AS ({mixed}), reviews AS ({reviews}),
    first AS (SELECT candidate_id, min_by(reviewed_by, review_no) AS who, min(review_no) AS no FROM reviews WHERE action = 'confirm' GROUP BY 1),
    turned AS (SELECT candidate_id, max_by(reviewed_by, review_no) AS who FROM reviews WHERE action = 'reject' GROUP BY 1),
    conf AS (SELECT c.id, c.record1_id AS a, c.record2_id AS b, who, row_number() OVER (ORDER BY no, c.id) AS k
             FROM cand c JOIN first f ON f.candidate_id = c.id WHERE status <> 'confirmed'),
    walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone, NULL::BIGINT AS id
             UNION ALL SELECT c.k, CASE WHEN list_contains(w.gone, c.a) OR list_contains(w.gone, c.b) THEN w.gone ELSE list_append(w.gone, c.b) END,
                              CASE WHEN list_contains(w.gone, c.a) OR list_contains(w.gone, c.b) THEN NULL ELSE c.id END
             FROM walk w JOIN conf c ON c.k = w.k + 1),
    stood AS (SELECT w.id, c.record_type, c.record1_id, c.record2_id, f.who FROM walk w JOIN cand c ON c.id = w.id JOIN first f ON f.candidate_id = w.id),
    gone AS (SELECT record_type, record2_id AS id FROM stood)"""
REVIEWED_SQL = _REVIEWED.replace("{reviews}", ALL_REVIEWS).replace("{mixed}", MIXED)


def _reviewed(spark, d):
    return changes.apply_reviews(spark_sql(spark, d, MIXED), spark_sql(spark, d, ALL_REVIEWS), _records(spark, d))


@query(
    "apply_reviews",
    with_views(
        REVIEWED_SQL
        + """
    SELECT c.id, c.record_type, CASE WHEN s.id IS NOT NULL THEN s.who WHEN c.status <> 'confirmed' THEN t.who END AS reviewed_by,
           CASE WHEN s.id IS NOT NULL THEN 'confirmed' WHEN c.status <> 'confirmed' AND t.candidate_id IS NOT NULL THEN 'rejected' ELSE c.status END AS status
    FROM cand c LEFT JOIN stood s ON s.id = c.id LEFT JOIN turned t ON t.candidate_id = c.id
    WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.record_type = c.record_type AND (g.id = c.record1_id OR g.id = c.record2_id)
                      AND NOT (s.id IS NOT NULL AND g.id = c.record2_id))"""
    ),
)
def apply_reviews(spark, d):
    return _reviewed(spark, d)[0].select("id", "record_type", "reviewed_by", "status")


@query(
    "review_resolutions",
    with_views(
        REVIEWED_SQL
        + f""", r AS ({ALL_RECORDS_SQL})
    SELECT m.id AS candidate_id, 'merge' AS action, record1_id AS kept_record_id, record2_id AS merged_record_id, who AS resolved_by, r.shown
    FROM stood m JOIN r ON r.kind = m.record_type AND r.id = m.record2_id"""
    ),
)
def review_resolutions(spark, d):
    out = _reviewed(spark, d)[1]
    return out.select(
        "candidate_id", "action", "kept_record_id", "merged_record_id", "resolved_by",
        F.get_json_object("merged_data", "$.shown").alias("shown"),
    )


@query(
    "review_deletes",
    with_views(
        REVIEWED_SQL
        + f""", r AS ({ALL_RECORDS_SQL})
    SELECT kind, id FROM r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.record_type = r.kind AND g.id = r.id)"""
    ),
)
def review_deletes(spark, d):
    kept = _reviewed(spark, d)[2]
    parts = [t.select(F.lit(k).alias("kind"), "id") for k, t in kept.items()]
    return parts[0].union(parts[1]).union(parts[2])


# Persons named by the expensive urgent orders are to be deleted.
DOOMED = "SELECT DISTINCT o_orderkey AS id FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000"
CLOSURE_SQL = f"""
    WITH RECURSIVE gone AS (
      SELECT p.id FROM {{persons}} p WHERE p.id IN ({DOOMED})
      UNION SELECT p.id FROM {{persons}} p JOIN gone g ON p.father_id = g.id OR p.mother_id = g.id)"""


def _deletable(spark, d):
    return {n: bound(spark, d, n) for n in ("persons", "baptisms", "marriages", "deaths")} | {
        "candidates": bound(spark, d, "candidates")
    }


def _row_keys(tables):
    parts = [t.select(F.lit(n).alias("part"), "id") for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(
    "delete_cascade",
    with_views(
        CLOSURE_SQL
        + """
    SELECT 'persons' AS part, id FROM {persons} WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'baptisms', id FROM {baptisms} WHERE coalesce(child_id NOT IN (SELECT id FROM gone), true)
        AND coalesce(father_id NOT IN (SELECT id FROM gone), true) AND coalesce(mother_id NOT IN (SELECT id FROM gone), true)
    UNION ALL SELECT 'marriages', id FROM {marriages} WHERE spouse1_id NOT IN (SELECT id FROM gone) AND spouse2_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'deaths', id FROM {deaths} WHERE deceased_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'candidates', id FROM {candidates}
        WHERE NOT (record_type = 'person' AND (record1_id IN (SELECT id FROM gone) OR record2_id IN (SELECT id FROM gone)))"""
    ),
)
def delete_cascade(spark, d):
    tables = _deletable(spark, d)
    ids = spark_sql(spark, d, DOOMED).join(tables["persons"].select("id"), "id", "left_semi")
    return _row_keys(changes.delete_persons(tables, ids))


@query(
    "delete_nullify",
    with_views(
        f"""WITH gone AS ({DOOMED})
    SELECT id, CASE WHEN father_id NOT IN (SELECT id FROM gone) THEN father_id END AS father_id,
           CASE WHEN mother_id NOT IN (SELECT id FROM gone) THEN mother_id END AS mother_id
    FROM {{persons}} WHERE id NOT IN (SELECT id FROM gone)"""
    ),
)
def delete_nullify(spark, d):
    tables = {"persons": bound(spark, d, "persons")}
    out = changes.delete_persons(tables, spark_sql(spark, d, DOOMED), on_delete="nullify")
    return out["persons"].select("id", "father_id", "mother_id")


@query(
    "purge_pairs",
    with_views(
        f"""SELECT id, record_type FROM {{candidates}}
            WHERE NOT (record_type = 'person' AND (record1_id IN ({DOOMED}) OR record2_id IN ({DOOMED})))"""
    ),
)
def purge_pairs(spark, d):
    gone = spark_sql(spark, d, DOOMED).withColumn("record_type", F.lit("person"))
    return changes.purge_candidates(bound(spark, d, "candidates"), gone).select("id", "record_type")


@query(
    "latest_status",
    """SELECT c_custkey AS id, coalesce((SELECT max_by(event_type, (ts, event_id)) FROM events WHERE user_id = c_custkey), 'queued') AS processing_status
       FROM customer""",
)
def latest_status(spark, d):
    files = bound(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("queued").alias("processing_status"))
    moves = bound(spark, d, "events").select(
        F.col("user_id").alias("file_id"), F.col("ts").alias("at"), "event_id", F.col("event_type").alias("status")
    )
    return changes.advance_status(files, moves)
