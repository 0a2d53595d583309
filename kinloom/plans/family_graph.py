"""The family graph of the derived registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import display_name, gender_rank
from ..operators import graph, relate
from .bindings import bound, spark_sql, with_views
from .catalog import query
from .relational import _label

# Batches get their number as the source key of persons and events.
_SOURCE = "3000000000 + CAST(split_part(source_batch_id, '#', 2) AS BIGINT)"


def _tables(spark, d):
    out = {}
    for name in ("persons", "baptisms", "deaths", "marriages"):
        out[name] = bound(spark, d, name).withColumn("source_batch_id", F.expr(_SOURCE))
    out["batches"] = bound(spark, d, "batches").withColumn("ingested_at", F.lit(None).cast("timestamp"))
    return out


def _graph(spark, d):
    tables = _tables(spark, d)
    return graph.build_vertices(tables), graph.build_edges(tables)


VERTICES_SQL = """
    SELECT id, 'Person' AS label, gedcom_id, first_name, last_name, NULL AS event_type, NULL::DATE AS date, NULL AS place, parish_ AS parish, NULL AS source_name
    FROM (SELECT *, NULL AS parish_ FROM {persons})
    UNION ALL SELECT id, 'Event', gedcom_id, NULL, NULL, 'baptism', baptism_date, village, parish, NULL FROM {baptisms}
    UNION ALL SELECT id, 'Event', gedcom_id, NULL, NULL, 'death', death_date, coalesce(village, cemetery), parish, NULL FROM {deaths}
    UNION ALL SELECT id, 'Source', NULL, NULL, NULL, NULL, NULL, NULL, NULL, source FROM {batches}"""


@query("graph_vertices", with_views(VERTICES_SQL))
def graph_vertices(spark, d):
    v, _ = _graph(spark, d)
    return v.select(
        "id", "label", "gedcom_id", "first_name", "last_name", "event_type", "date", "place", "parish", "source_name"
    )


EDGES_SQL = f"""
    SELECT father_id AS src, id AS dst, 'PARENT_OF' AS type, 'father' AS detail FROM {{persons}} WHERE father_id IS NOT NULL
    UNION ALL SELECT mother_id, id, 'PARENT_OF', 'mother' FROM {{persons}} WHERE mother_id IS NOT NULL AND mother_id IS DISTINCT FROM father_id
    UNION ALL SELECT unnest([a, b]), unnest([b, a]), 'MARRIED_TO', place FROM (
      SELECT least(spouse1_id, spouse2_id) AS a, greatest(spouse1_id, spouse2_id) AS b, min_by(coalesce(village, parish), (marriage_date, gedcom_id)) AS place
      FROM (SELECT DISTINCT spouse1_id, spouse2_id, marriage_date, gedcom_id, NULL AS village, '-' AS parish FROM {{marriages}}) GROUP BY 1, 2)
    UNION ALL SELECT child_id, id, 'BAPTIZED_IN', NULL FROM {{baptisms}}
    UNION ALL SELECT deceased_id, id, 'DIED_IN', NULL FROM {{deaths}}
    UNION ALL SELECT id, {_SOURCE}, 'FROM_SOURCE', NULL FROM (SELECT id, source_batch_id FROM {{persons}} UNION ALL SELECT id, source_batch_id FROM {{baptisms}} UNION ALL SELECT id, source_batch_id FROM {{deaths}})"""
IDS_SQL = f"SELECT id FROM ({VERTICES_SQL})"
VALID_SQL = f"SELECT * FROM ({EDGES_SQL}) WHERE src IN ({IDS_SQL}) AND dst IN ({IDS_SQL})"


@query("graph_edges", with_views(f"SELECT src, dst, type, CASE WHEN type = 'PARENT_OF' THEN detail END AS parent_type FROM ({EDGES_SQL})"))
def graph_edges(spark, d):
    return _graph(spark, d)[1].select("src", "dst", "type", "parent_type")


@query("valid_edges", with_views(f"SELECT src, dst, type FROM ({VALID_SQL})"))
def valid_edges(spark, d):
    v, e = _graph(spark, d)
    return graph.valid_edges(e, v).select("src", "dst", "type")


@query(
    "symmetric_edges",
    with_views("SELECT src, dst, spouse FROM (SELECT spouse1_id AS src, spouse2_id AS dst, id AS spouse FROM {marriages} UNION ALL SELECT spouse2_id, spouse1_id, id FROM {marriages})"),
)
def symmetric_edges(spark, d):
    m = bound(spark, d, "marriages").select(F.col("spouse1_id").alias("src"), F.col("spouse2_id").alias("dst"), F.col("id").alias("spouse"))
    return graph.symmetric(m).select("src", "dst", "spouse")


@query(
    "graph_hide_sources",
    with_views(
        f"""SELECT 'vertex' AS part, id AS a, 0::BIGINT AS b FROM ({VERTICES_SQL}) WHERE label <> 'Source'
            UNION ALL SELECT 'edge', src, dst FROM ({VALID_SQL}) WHERE type <> 'FROM_SOURCE'"""
    ),
)
def graph_hide_sources(spark, d):
    v, e = graph.hide_sources(*_graph(spark, d))
    return v.select(F.lit("vertex").alias("part"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).union(
        e.select(F.lit("edge"), "src", "dst")
    )


@query(
    "graph_stats",
    with_views(
        f"""SELECT 'vertex' AS part, label AS name, count(*) AS count FROM ({VERTICES_SQL}) GROUP BY label
            UNION ALL SELECT 'edge', type, count(*) FROM ({EDGES_SQL}) GROUP BY type"""
    ),
)
def graph_stats(spark, d):
    return graph.graph_stats(*_graph(spark, d))


@query(
    "load_summary",
    with_views(
        f"""SELECT type AS name, count(*) FILTER (NOT stored) AS created, count(*) FILTER (stored) AS skipped, count(*) AS total
            FROM (SELECT type, type = 'PARENT_OF' AND detail = 'father' AS stored FROM ({EDGES_SQL})) GROUP BY type"""
    ),
)
def load_summary(spark, d):
    """A second load over stored father edges creates only the rest."""
    v, e = _graph(spark, d)
    old = graph.parent_edges(bound(spark, d, "persons")).where("parent_type = 'father'")
    _, new = graph.merge_graph(v, e, v, old)
    keys = ["src", "dst", "type"]
    return graph.load_summary(new, e.join(old.select(*keys), keys, "left_semi"), "type")


# Roots: the persons whose numbers are also nation keys.
ROOTS = "SELECT CAST(n_nationkey AS BIGINT) AS id FROM {nation}"
DESCENDANTS_SQL = f"""
    WITH RECURSIVE tree AS (
      SELECT id, 0 AS distance FROM ({ROOTS})
      UNION SELECT c.child, t.distance + 1 FROM tree t JOIN (SELECT father_id AS parent, id AS child FROM {{persons}} UNION SELECT mother_id, id FROM {{persons}}) c ON c.parent = t.id
      WHERE t.distance < 3)"""


@query("descendants", with_views(DESCENDANTS_SQL + " SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM tree GROUP BY id"))
def descendants(spark, d):
    return graph.descendants(graph.parent_edges(bound(spark, d, "persons")), spark_sql(spark, d, ROOTS), 3)


PAYLOAD_SQL = DESCENDANTS_SQL + f""",
    chosen AS (SELECT DISTINCT id FROM tree WHERE id IN (SELECT id FROM {{persons}})),
    out_edges AS (SELECT DISTINCT src, dst, type FROM ({VALID_SQL}) WHERE src IN (SELECT id FROM chosen) AND type NOT IN ('BAPTIZED_IN', 'DIED_IN')),
    shown AS (SELECT id FROM chosen UNION SELECT dst FROM out_edges)"""


@query(
    "graph_payload_nodes",
    with_views(
        PAYLOAD_SQL
        + f""" SELECT p.id, {_label('p')} AS label, 'Person' AS type, p.gender, source_batch_id AS source FROM {{persons}} p WHERE id IN (SELECT id FROM shown)
               UNION ALL SELECT id, source, 'Source', NULL, NULL FROM {{batches}} WHERE id IN (SELECT id FROM shown)"""
    ),
)
def graph_payload_nodes(spark, d):
    v, e = _graph(spark, d)
    nodes, _ = graph.graph_payload(v, graph.valid_edges(e, v), spark_sql(spark, d, ROOTS), 3)
    return nodes.select("id", "label", "type", "gender", "source")


@query("graph_payload_edges", with_views(PAYLOAD_SQL + " SELECT src, dst, replace(type, '_', ' ') AS label FROM out_edges"))
def graph_payload_edges(spark, d):
    v, e = _graph(spark, d)
    _, edges = graph.graph_payload(v, graph.valid_edges(e, v), spark_sql(spark, d, ROOTS), 3)
    return edges.select("src", "dst", "label")


@query(
    "with_source",
    with_views(
        """SELECT id, source_batch_id AS source FROM {persons} UNION ALL SELECT id, source_batch_id FROM {baptisms}
           UNION ALL SELECT id, source_batch_id FROM {deaths} UNION ALL SELECT id, NULL FROM {batches}"""
    ),
)
def with_source(spark, d):
    v, e = _graph(spark, d)
    return graph.with_source(v, e).select("id", "source")


# ---- units and generations ------------------------------------------------

# A person marries inside its pair (2i, 2i+1) and inside its ten (10j, 10j+2), so the
# unit of a person is the first of its ten for the first four, else the first of its pair.
UNIT = "CASE WHEN id % 10 < 4 THEN id - id % 10 ELSE id - id % 2 END"


def _units(spark, d):
    persons, marriages = bound(spark, d, "persons"), bound(spark, d, "marriages")
    edges = graph.parent_edges(persons).unionByName(graph.marriage_edges(marriages), allowMissingColumns=True)
    edges = graph.valid_edges(edges, persons)
    units = graph.family_units(persons, edges)
    return persons, edges, units


@query("family_units", with_views(f"SELECT id, {UNIT} AS unit FROM {{persons}}"))
def family_units(spark, d):
    return _units(spark, d)[2]


UNIT_EDGES_SQL = f"""
    WITH u AS (SELECT id, father_id, mother_id, {UNIT} AS unit FROM {{persons}}),
    ue AS (SELECT DISTINCT p.unit AS parent_unit, c.unit AS child_unit FROM u c JOIN u p ON p.id IN (c.father_id, c.mother_id) WHERE p.unit <> c.unit)"""


@query("unit_edges", with_views(UNIT_EDGES_SQL + " SELECT * FROM ue"))
def unit_edges(spark, d):
    _, edges, units = _units(spark, d)
    return graph.unit_edges(units, edges)


@query(
    "generations",
    with_views(
        UNIT_EDGES_SQL.replace("WITH u", "WITH RECURSIVE u")
        + """, walk AS (SELECT unit, 0 AS level FROM (SELECT DISTINCT unit FROM u) UNION SELECT child_unit, level + 1 FROM walk JOIN ue ON parent_unit = unit)
    SELECT unit, CAST(max(level) AS INTEGER) AS level FROM walk GROUP BY unit"""
    ),
)
def generations(spark, d):
    """Longest path from a unit without parents."""
    from ..session import cut_lineage

    _, edges, units = _units(spark, d)
    units = cut_lineage(units)
    return graph.generations(units, graph.unit_edges(units, edges))


# Suppliers in rings of three by key; the last ring's first one also has a line of its own.
RING = "SELECT s_suppkey AS unit FROM {supplier}"
RING_EDGES = """
    SELECT s_suppkey AS parent_unit, CASE WHEN s_suppkey % 10 = 3 THEN s_suppkey - 2 ELSE s_suppkey + 1 END AS child_unit
    FROM {supplier} WHERE s_suppkey % 10 <> 0"""


@query(
    "generation_cycles",
    "SELECT s_suppkey AS unit FROM supplier WHERE s_suppkey % 10 BETWEEN 1 AND 3",
)
def generation_cycles(spark, d):
    """Units 1, 2, 3 of each ten are a ring; 4 to 9 and the next ten's first are a line of their own."""
    edges = spark_sql(spark, d, RING_EDGES).join(spark_sql(spark, d, RING).withColumnRenamed("unit", "child_unit"), "child_unit", "left_semi")
    return graph.generation_cycles(graph.generations(spark_sql(spark, d, RING), edges))


@query(
    "unit_order_keys",
    with_views(
        f"""SELECT unit, label, place, coalesce(min(y) OVER (PARTITION BY unit), NULL) AS first_year FROM (
              SELECT {UNIT} AS unit, year(birth_date)::INTEGER AS y, {_label('p')} AS label, id,
                     row_number() OVER (PARTITION BY {UNIT} ORDER BY {_label('p')}, id) AS place FROM {{persons}} p)"""
    ),
)
def unit_order_keys(spark, d):
    persons, _, units = _units(spark, d)
    rows = persons.select("id", F.year("birth_date").alias("year"), display_name(F.col("first_name"), F.col("last_name")).alias("label"))
    return graph.unit_order_keys(units, rows, "year", "label").select("unit", "label", "place", "first_year")


@query(
    "spouse_order",
    with_views(
        f"""SELECT id, row_number() OVER (PARTITION BY {UNIT} ORDER BY CASE gender WHEN 'M' THEN 0 WHEN 'F' THEN 1 ELSE 2 END,
                  coalesce(year(birth_date), 9999), {_label('p')}, id) AS place FROM {{persons}} p"""
    ),
)
def spouse_order(spark, d):
    persons, _, units = _units(spark, d)
    label = display_name(F.col("first_name"), F.col("last_name"))
    members = persons.select(
        "id", gender_rank(F.col("gender")).alias("g"), F.coalesce(F.year("birth_date"), F.lit(9999)).alias("y"), label.alias("label")
    ).join(units, "id")
    return graph.spouse_order(members, [F.asc(c) for c in ("g", "y", "label", "id")]).select("id", "place")


@query(
    "neighbours",
    with_views(f"SELECT src AS id, dst AS neighbour_id, type FROM ({EDGES_SQL}) UNION SELECT dst, src, type FROM ({EDGES_SQL})"),
)
def neighbours(spark, d):
    return graph.neighbours(_graph(spark, d)[1])


DOOMED = "SELECT DISTINCT o_orderkey AS id FROM {orders} WHERE o_orderpriority = '1-URGENT'"


@query(
    "graph_delete",
    with_views(
        f"""SELECT 'vertex' AS part, id AS a, 0::BIGINT AS b FROM ({VERTICES_SQL}) WHERE id NOT IN ({DOOMED})
            UNION ALL SELECT 'edge', src, dst FROM ({EDGES_SQL}) WHERE src NOT IN ({DOOMED}) AND dst NOT IN ({DOOMED})"""
    ),
)
def graph_delete(spark, d):
    v, e = graph.delete_from_graph(*_graph(spark, d), spark_sql(spark, d, DOOMED), "person")
    return v.select(F.lit("vertex").alias("part"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).union(
        e.select(F.lit("edge"), "src", "dst")
    )


@query(
    "graph_delete_marriage",
    with_views(
        f"""SELECT least(a, b) AS src, greatest(a, b) AS dst FROM (
              SELECT least(spouse1_id, spouse2_id) AS a, greatest(spouse1_id, spouse2_id) AS b, min_by(gedcom_id, (marriage_date, gedcom_id)) AS g FROM {{marriages}} GROUP BY 1, 2)
            WHERE g NOT IN (SELECT concat('@F', id, '-1@_MARR') FROM ({DOOMED}))"""
    ),
)
def graph_delete_marriage(spark, d):
    """Deleting marriage records removes both directions of their edges."""
    e = graph.marriage_edges(bound(spark, d, "marriages"))
    gone = spark_sql(spark, d, f"SELECT concat('@F', id, '-1@_MARR') AS gedcom_id FROM ({DOOMED})")
    _, left = graph.delete_from_graph(bound(spark, d, "persons"), e, gone, "marriage")
    return left.where("src < dst").select("src", "dst")


@query(
    "graph_merge",
    with_views(
        f"SELECT src, dst, type FROM ({EDGES_SQL}) WHERE NOT (type = 'PARENT_OF' AND detail = 'father')"
    ),
)
def graph_merge(spark, d):
    e = _graph(spark, d)[1]
    old = graph.parent_edges(bound(spark, d, "persons")).where("parent_type = 'father'")
    return relate.insert_new(e, old, ["src", "dst", "type"]).select("src", "dst", "type")
