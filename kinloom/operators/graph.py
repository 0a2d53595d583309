"""The family graph as vertex and edge tables, and its iterative queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import present
from ..functions.text import display_name
from ..session import cut_lineage
from .windows import HOT_ROWS, first_per, hot_keys, rank_within, skew_join

HIDDEN_EDGES = ["BAPTIZED_IN", "DIED_IN"]
# The properties of the three vertex labels.
PERSON_PROPS = [
    "gedcom_id", "first_name", "last_name", "maiden_name", "gender", "birth_date", "death_date",
    "birth_place", "death_place", "occupation",
]
EVENT_PROPS = ["gedcom_id", "event_type", "date", "place", "parish"]
SOURCE_PROPS = ["source_name", "import_date", "description"]


def _either(*columns: str) -> Column:
    return F.coalesce(*[F.when(present(F.col(c)), F.col(c)) for c in columns])


def _has(df: DataFrame, column: str, kind: str = "string") -> Column:
    return F.col(column) if column in df.columns else F.lit(None).cast(kind)


def build_vertices(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, label, properties) of persons, baptisms, deaths and batches."""
    parts = []
    if "persons" in tables:
        p = tables["persons"]
        parts.append(p.select("id", F.lit("Person").alias("label"), *[_has(p, c).alias(c) for c in PERSON_PROPS]))
    for kind, date, place in (
        ("baptism", "baptism_date", ["village"]),
        ("death", "death_date", ["village", "cemetery"]),
    ):
        if kind + "s" in tables:
            t = tables[kind + "s"]
            known = [c for c in place if c in t.columns]
            parts.append(
                t.select(
                    "id",
                    F.lit("Event").alias("label"),
                    _has(t, "gedcom_id").alias("gedcom_id"),
                    F.lit(kind).alias("event_type"),
                    F.col(date).alias("date"),
                    (_either(*known) if known else F.lit(None).cast("string")).alias("place"),
                    "parish",
                )
            )
    if "batches" in tables:
        b = tables["batches"]
        parts.append(
            b.select(
                "id",
                F.lit("Source").alias("label"),
                F.col("source").alias("source_name"),
                F.col("ingested_at").alias("import_date"),
                "description",
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def parent_edges(persons: DataFrame) -> DataFrame:
    """Parent to child; when both parents are one person only the father edge stays."""
    both = F.array(
        F.struct(F.col("father_id").alias("src"), F.lit("father").alias("parent_type")),
        F.struct(F.col("mother_id").alias("src"), F.lit("mother").alias("parent_type")),
    )
    repeated = (F.col("parent_type") == "mother") & F.coalesce(F.col("src") == F.col("father_id"), F.lit(False))
    return (
        persons.select("id", "father_id", F.inline(both))
        .where(F.col("src").isNotNull() & ~repeated)
        .select("src", F.col("id").alias("dst"), F.lit("PARENT_OF").alias("type"), "parent_type")
    )


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.inline(ways), *rest)


def marriage_edges(marriages: DataFrame) -> DataFrame:
    place = _either(*[c for c in ("village", "parish") if c in marriages.columns])
    known = marriages.where(F.col("spouse1_id").isNotNull() & F.col("spouse2_id").isNotNull())
    one_way = known.select(
        F.col("spouse1_id").alias("src"),
        F.col("spouse2_id").alias("dst"),
        F.lit("MARRIED_TO").alias("type"),
        F.col("marriage_date").alias("date"),
        place.alias("place"),
        "gedcom_id",
    )
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    single = one_way.withColumns({"_low": low, "_high": high})
    single = first_per(single, ["_low", "_high"], [F.asc("date"), F.asc("gedcom_id")]).drop("_low", "_high")
    return symmetric(single)


def event_edges(events: DataFrame, person: str, date: str, edge_type: str) -> DataFrame:
    return events.where(F.col(person).isNotNull()).select(
        F.col(person).alias("src"), F.col("id").alias("dst"), F.lit(edge_type).alias("type"), F.col(date).alias("date")
    )


def source_edges(table: DataFrame) -> DataFrame:
    return table.where(F.col("source_batch_id").isNotNull()).select(
        F.col("id").alias("src"), F.col("source_batch_id").alias("dst"), F.lit("FROM_SOURCE").alias("type")
    )


def build_edges(tables: dict[str, DataFrame]) -> DataFrame:
    """All edges; endpoints without a vertex are dropped by ``valid_edges``."""
    parts = []
    if "persons" in tables:
        parts += [parent_edges(tables["persons"]), source_edges(tables["persons"])]
    if "marriages" in tables:
        parts.append(marriage_edges(tables["marriages"]))
    if "baptisms" in tables:
        parts += [
            event_edges(tables["baptisms"], "child_id", "baptism_date", "BAPTIZED_IN"),
            source_edges(tables["baptisms"]),
        ]
    if "deaths" in tables:
        parts += [
            event_edges(tables["deaths"], "deceased_id", "death_date", "DIED_IN"),
            source_edges(tables["deaths"]),
        ]
    if "godparents" in tables:
        # The godchild is the child of the baptism the bridge row names.
        godchild = tables["baptisms"].select(F.col("id").alias("baptism_record_id"), "child_id")
        parts.append(
            tables["godparents"]
            .join(godchild, "baptism_record_id")
            .where(F.col("child_id").isNotNull())
            .select(
                F.col("godparent_id").alias("src"), F.col("child_id").alias("dst"), F.lit("GODPARENT_OF").alias("type")
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def valid_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    ids = vertices.select("id")
    out = skew_join(edges, ids.withColumnRenamed("id", "src"), ["src"], "left_semi")
    out = skew_join(out, ids.withColumnRenamed("id", "dst"), ["dst"], "left_semi")
    return out.select(*edges.columns)


def merge_graph(
    vertices: DataFrame, edges: DataFrame, old_vertices: DataFrame, old_edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Only what is not stored yet; a second load adds nothing."""
    from .relate import insert_new

    return insert_new(vertices, old_vertices, ["id"]), insert_new(edges, old_edges, ["src", "dst", "type"])


def graph_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    by_label = vertices.groupBy(F.lit("vertex").alias("part"), F.col("label").alias("name")).count()
    by_type = edges.groupBy(F.lit("edge").alias("part"), F.col("type").alias("name")).count()
    return by_label.unionByName(by_type)


def load_summary(new: DataFrame, skipped: DataFrame, name: str) -> DataFrame:
    created = new.select(F.col(name).alias("name"), F.lit(1).alias("created"), F.lit(0).alias("skipped"))
    passed = skipped.select(F.col(name).alias("name"), F.lit(0).alias("created"), F.lit(1).alias("skipped"))
    return (
        created.unionByName(passed)
        .groupBy("name")
        .agg(F.sum("created").alias("created"), F.sum("skipped").alias("skipped"), F.count("*").alias("total"))
    )


def hide_sources(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without source vertices, their edges and edges that lost an end."""
    shown = vertices.where(F.col("label") != "Source")
    return shown, valid_edges(edges.where(F.col("type") != "FROM_SOURCE"), shown)


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, neighbour_id, type) in both directions, distinct."""
    return symmetric(edges.select("src", "dst", "type")).distinct().select(
        F.col("src").alias("id"), F.col("dst").alias("neighbour_id"), "type"
    )


def with_source(vertices: DataFrame, edges: DataFrame, name: str = "source") -> DataFrame:
    """Attach the source name of each vertex, null when it has none."""
    batch = edges.where(F.col("type") == "FROM_SOURCE").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("_batch"))
    sources = vertices.where(F.col("label") == "Source").select(
        F.col("id").alias("_batch"), F.col("source_name").alias(name)
    )
    joined = vertices.join(batch, "id", "left")
    return skew_join(joined, sources, ["_batch"], "left").drop("_batch")


def descendants(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(id, distance) of the roots and all their descendants to ``depth``.

    One frontier join per generation; each frontier is written out, so that the next
    one does not redo it, and leaves out vertices already reached.
    """
    children = cut_lineage(edges.where(F.col("type") == "PARENT_OF").select("src", "dst").distinct())
    hot = cut_lineage(hot_keys(children, ["src"]))
    reached = roots.select("id").distinct().withColumn("distance", F.lit(0))
    frontier = reached
    for step in range(1, depth + 1):
        found = skew_join(children, frontier.select(F.col("id").alias("src")), ["src"], "left_semi", hot)
        found = found.select(F.col("dst").alias("id")).distinct().join(reached.select("id"), "id", "left_anti")
        frontier = cut_lineage(found.withColumn("distance", F.lit(step)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def graph_payload(
    vertices: DataFrame, edges: DataFrame, roots: DataFrame | None = None, depth: int = 3, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Persons asked for, their outgoing edges and the vertices these lead to.

    Event vertices and the edges to them are left out; edges are distinct.
    """
    persons = vertices.where(F.col("label") == "Person")
    if roots is not None:
        persons = persons.join(descendants(edges, roots, depth).select("id"), "id", "left_semi")
    if limit is not None:
        persons = persons.orderBy("id").limit(limit)
    out = edges.where(~F.col("type").isin(HIDDEN_EDGES)).select("src", "dst", "type")
    out = skew_join(out, persons.select(F.col("id").alias("src")), ["src"], "left_semi").distinct()
    shown = persons.select("id").union(out.select("dst")).distinct()
    label = F.when(F.col("label") == "Source", F.col("source_name")).otherwise(
        display_name(F.col("first_name"), F.col("last_name"))
    )
    nodes = vertices.where(F.col("label") != "Event").join(shown, "id", "left_semi")
    nodes = with_source(vertices.join(nodes.select("id"), "id", "left_semi"), edges)
    nodes = nodes.select("id", label.alias("label"), F.col("label").alias("type"), "gender", "birth_date", "source")
    return nodes, out.select("src", "dst", "type", F.replace("type", F.lit("_"), F.lit(" ")).alias("label"))


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(id, component): the smallest id reachable from each endpoint.

    Two star contractions per round point every vertex at the smallest neighbour seen
    so far; the number of rounds grows with the logarithm of the graph. A vertex with
    very many edges costs one partial minimum per task and a salted join.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    own = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    stars = cut_lineage(
        pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    last, rows = None, stars.count()
    while True:
        many = rows > HOT_ROWS  # else no vertex can have as many edges
        stars = cut_lineage(_small_star(cut_lineage(_large_star(stars, many)), many))
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last, rows = state, state[0]
    root = stars.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("_root"))
    return own.join(root, "id", "left").select("id", F.coalesce("_root", "id").alias("component"))


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    """Larger neighbours of a vertex move to its smallest neighbour (or itself)."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.where("v > u")
    moved = skew_join(larger, least, ["u"], hot=hot_keys(larger, ["u"]) if many else None).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    """Smaller neighbours of a vertex, and the vertex, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = skew_join(edges, least, ["u"], hot=hot_keys(edges, ["u"]) if many else None).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def family_units(persons: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, unit): persons joined by marriage share a unit, a lone person is one."""
    married = edges.where(F.col("type") == "MARRIED_TO")
    parts = connected_components(married, "src", "dst")
    return (
        persons.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("unit"))
    )


def unit_edges(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent_unit, child_unit) from the parent edges, without loops."""
    born = edges.where(F.col("type") == "PARENT_OF").select("src", "dst")
    up = units.select(F.col("id").alias("src"), F.col("unit").alias("parent_unit"))
    down = units.select(F.col("id").alias("dst"), F.col("unit").alias("child_unit"))
    joined = skew_join(skew_join(born, up, ["src"]), down, ["dst"])
    return joined.where("parent_unit <> child_unit").select("parent_unit", "child_unit").distinct()


def generations(units: DataFrame, unit_edges: DataFrame) -> DataFrame:
    """(unit, level): longest path from a unit without parents, null for a unit in or behind a cycle.

    Units without open parents are peeled off. A pass joins those peeled last with the
    edges and writes only the units that it reached: how many of their parents have come
    and the highest level so far. What is never peeled is in or behind a cycle.
    """
    every = cut_lineage(units.select("unit").distinct())
    parents = unit_edges.groupBy(F.col("child_unit")).agg(F.count("*").alias("parents"))
    edges = cut_lineage(unit_edges.join(parents, "child_unit"))
    hot = hot_keys(edges, ["parent_unit"])
    peeled = cut_lineage(
        every.join(edges.select(F.col("child_unit").alias("unit")), "unit", "left_anti").withColumn("level", F.lit(0))
    )
    done, waiting = peeled, None
    while not peeled.isEmpty():
        reached = skew_join(edges, peeled.withColumnRenamed("unit", "parent_unit"), ["parent_unit"], hot=hot).select(
            F.col("child_unit").alias("unit"), "parents", F.lit(1).cast("long").alias("come"), (F.col("level") + 1).alias("level")
        )
        if waiting is not None:
            reached = reached.unionByName(waiting)
        step = cut_lineage(
            reached.groupBy("unit").agg(F.max("parents").alias("parents"), F.sum("come").alias("come"), F.max("level").alias("level"))
        )
        waiting = step.where("come < parents")
        peeled = step.where("come = parents").select("unit", "level")
        done = done.unionByName(peeled)
    return every.join(done, "unit", "left")


def generation_cycles(levels: DataFrame) -> DataFrame:
    """Units that ``generations`` could not place: in a cycle, or behind one."""
    return levels.where("level is null").select("unit")


def unit_order_keys(units: DataFrame, persons: DataFrame, year: str, label: str) -> DataFrame:
    """(unit, first_year, place, label): earliest birth year and the labels in order.

    The labels of a unit, read by ``place``, are its sort text; they stay rows, since a
    unit can be very large.
    """
    members = skew_join(persons, units, ["id"])
    years = members.groupBy("unit").agg(F.min(year).alias("first_year"))
    placed = rank_within(members.select("unit", "id", label), ["unit"], [F.asc(label), F.asc("id")], "place")
    return skew_join(placed, years, ["unit"])


def spouse_order(members: DataFrame, order: list[Column]) -> DataFrame:
    """Place of each member inside its unit, whatever the unit's size."""
    return rank_within(members, ["unit"], order, "place")


def delete_from_graph(
    vertices: DataFrame, edges: DataFrame, ids: DataFrame, kind: str
) -> tuple[DataFrame, DataFrame]:
    """Remove vertices with their edges; a marriage is its pair of MARRIED_TO edges."""
    if kind == "marriage":
        gone = ids.select("gedcom_id").distinct()
        married = edges.where(F.col("type") == "MARRIED_TO").join(gone, "gedcom_id", "left_anti")
        other = edges.where(F.col("type") != "MARRIED_TO")
        return vertices, other.unionByName(married)
    gone = ids.select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti")
    kept = kept.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return vertices.join(gone, "id", "left_anti"), kept.select(*edges.columns)
