"""Merges that follow from each other, over customers read as persons with their entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import linkage, merging
from ..session import cut_lineage, spread
from .bindings import bound, with_views
from .catalog import query
from .linkage import _person_sql
from .scalars import SCORED, _date_score, _jaccard, _mean, _place_score

VIEWS = {"persons": "kin", "baptisms": "kin_baptisms", "marriages": "kin_marriages", "deaths": "kin_deaths"}


def _exact_events(view: str, groups: list[list[str]], date: str) -> str:
    """Pairs of entries within a week whose score is exact."""
    names = [_mean([f"CASE WHEN a.{n} IS NOT NULL AND b.{n} IS NOT NULL THEN {_jaccard(f'a.{n}_codes', f'b.{n}_codes')} END" for n in group]) for group in groups]
    return f"""
    SELECT id, other FROM (
      SELECT a.id, b.id AS other, list_cosine_similarity(a.embedding, b.embedding) AS v, ({' + '.join(names)}) / {len(names)} AS p,
             {_date_score(f'a.{date}', f'b.{date}')}::DOUBLE AS t, {_place_score('a.parish', 'b.parish')}::DOUBLE AS l
      FROM {{{view}}} a JOIN {{{view}}} b ON a.id <> b.id AND b.{date} BETWEEN a.{date} - 7 AND a.{date} + 7)
    WHERE {SCORED} >= {linkage.EXACT}"""


EXACT = {
    "person": f"SELECT id, other FROM ({_person_sql('kin', linkage.EXACT)})",
    "baptism": _exact_events("kin_baptisms", [["child_name", "father_surname"], ["mother_name"]], "baptism_date"),
    "marriage": _exact_events("kin_marriages", [["spouse1_name", "spouse1_surname"], ["spouse2_name"]], "marriage_date"),
    "death": _exact_events("kin_deaths", [["deceased_name", "deceased_surname"]], "death_date"),
}

#: The smallest number reached by each record: numbers spread along exact pairs and between the
#: results of facts whose arguments have the same number, until nothing changes.
CLOSED = f"""
    WITH RECURSIVE exact AS MATERIALIZED ({' UNION ALL '.join(f"SELECT '{kind}' AS kind, id, other FROM ({sql})" for kind, sql in EXACT.items())}),
    facts AS MATERIALIZED (
      SELECT concat('b|', baptism_date, '|', parish) AS label, child_id AS a, 0 AS b, id AS result FROM {{kin_baptisms}}
      UNION ALL SELECT concat('m|', marriage_date, '|', parish), spouse1_id, spouse2_id, id FROM {{kin_marriages}}
      UNION ALL SELECT concat('d|', death_date, '|', parish), deceased_id, 0, id FROM {{kin_deaths}}
      UNION ALL SELECT concat('child|', gender), e.id, 0, p.id FROM {{kin_baptisms}} e JOIN {{kin}} p ON p.id = e.child_id
      UNION ALL SELECT concat('first|', gender), e.id, 0, p.id FROM {{kin_marriages}} e JOIN {{kin}} p ON p.id = e.spouse1_id
      UNION ALL SELECT concat('second|', gender), e.id, 0, p.id FROM {{kin_marriages}} e JOIN {{kin}} p ON p.id = e.spouse2_id
      UNION ALL SELECT concat('dead|', gender), e.id, 0, p.id FROM {{kin_deaths}} e JOIN {{kin}} p ON p.id = e.deceased_id),
    rows AS MATERIALIZED (
      SELECT 'person' AS kind, id, source_batch_id FROM {{kin}} UNION ALL SELECT 'baptism', id, source_batch_id FROM {{kin_baptisms}}
      UNION ALL SELECT 'marriage', id, source_batch_id FROM {{kin_marriages}} UNION ALL SELECT 'death', id, source_batch_id FROM {{kin_deaths}}),
    state AS (
      SELECT 0 AS i, node, node AS rep FROM (SELECT id AS node FROM rows UNION SELECT b FROM facts)
      UNION ALL
      SELECT i + 1, node, min(rep) FROM (
        SELECT i, node, rep FROM state
        UNION ALL SELECT t.i, e.id, t.rep FROM exact e JOIN state t ON t.node = e.other
        UNION ALL SELECT r.i, f.result, min(r.rep) OVER (PARTITION BY f.label, x.rep, y.rep)
        FROM facts f JOIN state x ON x.node = f.a JOIN state y ON y.node = f.b JOIN state r ON r.node = f.result)
      WHERE i < 30 GROUP BY i, node),
    classes AS (SELECT kind, id, source_batch_id, rep FROM state JOIN rows ON id = node WHERE i = 30),
    kept AS (SELECT kind, rep, min_by(id, (source_batch_id, id)) AS survivor_id FROM classes GROUP BY kind, rep),
    mapping AS (
      SELECT kind, c.id, survivor_id, CASE WHEN e.id IS NOT NULL THEN 1.0::DOUBLE END AS composite_score, CASE WHEN e.id IS NOT NULL THEN 'score' ELSE 'cascade' END AS merged_by
      FROM classes c JOIN kept USING (kind, rep) LEFT JOIN (SELECT DISTINCT kind, id FROM exact) e USING (kind, id) WHERE c.id <> survivor_id)"""


def _tables(spark, d):
    """The four tables, written once by all cores: a small file of customers is read by one task, and the merge reads each table many times."""
    return {name: cut_lineage(spread(bound(spark, d, view), "id")) for name, view in VIEWS.items()}


def _map_sql(kind: str) -> str:
    return with_views(CLOSED + f" SELECT id, survivor_id, composite_score, merged_by FROM mapping WHERE kind = '{kind}'")


def _map(spark, d, name: str):
    found = merging.cascade_maps(_tables(spark, d))[name]
    return found.withColumn("composite_score", F.round("composite_score", 6))


@query("merge_persons", _map_sql("person"))
def merge_persons(spark, d):
    """Persons that an exact match or a merged entry makes one."""
    return _map(spark, d, "persons")


@query("merge_baptisms", _map_sql("baptism"))
def merge_baptisms(spark, d):
    return _map(spark, d, "baptisms")


@query("merge_marriages", _map_sql("marriage"))
def merge_marriages(spark, d):
    return _map(spark, d, "marriages")


@query("merge_deaths", _map_sql("death"))
def merge_deaths(spark, d):
    return _map(spark, d, "deaths")


@query(
    "merge_tables",
    with_views(
        CLOSED
        + """, whose AS (
      SELECT 'person' AS kind, id, father_id AS first_id, CAST(NULL AS BIGINT) AS second_id FROM {kin} UNION ALL SELECT 'baptism', id, child_id, NULL FROM {kin_baptisms}
      UNION ALL SELECT 'marriage', id, spouse1_id, spouse2_id FROM {kin_marriages} UNION ALL SELECT 'death', id, deceased_id, NULL FROM {kin_deaths})
    SELECT w.kind, w.id, coalesce(a.survivor_id, first_id) AS first_id, coalesce(b.survivor_id, second_id) AS second_id
    FROM whose w LEFT JOIN mapping a ON a.kind = 'person' AND a.id = first_id LEFT JOIN mapping b ON b.kind = 'person' AND b.id = second_id
    WHERE NOT EXISTS (SELECT 1 FROM mapping m WHERE m.kind = w.kind AND m.id = w.id)"""
    ),
)
def merge_tables(spark, d):
    """All four tables without merged rows, their references moved to the survivors."""
    tables = _tables(spark, d)
    maps = {name: cut_lineage(m) for name, m in merging.cascade_maps(tables).items()}
    left = merging.apply_cascade(tables, maps)
    none = F.lit(None).cast("long")
    columns = {"persons": ("father_id", none), "baptisms": ("child_id", none), "marriages": ("spouse1_id", F.col("spouse2_id")), "deaths": ("deceased_id", none)}
    parts = [
        left[name].select(F.lit(merging.KIND_OF[name]).alias("kind"), "id", F.col(first).alias("first_id"), second.alias("second_id"))
        for name, (first, second) in columns.items()
    ]
    return reduce(lambda x, y: x.unionByName(y), parts)


@query(
    "merge_audit_pending",
    with_views(
        CLOSED
        + """ SELECT CAST(id AS VARCHAR) AS id, record_type, record1_id, record2_id, status FROM {candidates} c
              WHERE NOT EXISTS (SELECT 1 FROM mapping m WHERE m.kind = record_type AND m.id IN (record1_id, record2_id))
              UNION ALL SELECT sha256(concat(kind, '|', id, '|', survivor_id)), kind, survivor_id, survivor_id, 'confirmed' FROM mapping"""
    ),
)
def merge_audit_pending(spark, d):
    """The candidates after an automatic merge: what is left of the earlier ones, and a confirmed one for each merged row."""
    tables = _tables(spark, d)
    maps = {name: cut_lineage(m) for name, m in merging.cascade_maps(tables).items()}
    left, confirmed = bound(spark, d, "candidates"), []
    for name, kind in merging.KIND_OF.items():
        made, _, left = linkage.merge_audit(maps[name], tables[name], kind, left)
        confirmed.append(made)
    columns = [F.col("id").cast("string").alias("id"), "record_type", "record1_id", "record2_id", "status"]
    return reduce(lambda x, y: x.unionByName(y), [f.select(*columns) for f in [left, *confirmed]])
