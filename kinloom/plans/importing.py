"""Record files to register tables, links and graph as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, records
from ..operators.features import with_embedding
from ..operators.linkage import apply_merge, merge_map, repoint
from ..operators.merging import apply_cascade, cascade_maps
from ..session import cut_lineage
from ..sources.gedcom import read_gedcom_lines


def tables_of_records(tree: DataFrame) -> dict[str, DataFrame]:
    """All tables of assembled records: persons with parents, events, raw rows.

    The records are gathered in one pass, which every table reads.
    """
    gathered = records.gather_records(tree)
    individuals, families = records.individuals_of(gathered), records.families_of(gathered)
    children = records.children_of_families(gathered)
    built = records.build_persons(individuals)
    persons = records.person_table(built)
    links = records.build_parent_links(children, persons)
    marriages = records.build_marriages(families, persons)
    batches = records.assign_batch(individuals.select("file_id").distinct())
    return {
        "batches": batches.select(
            F.col("source_batch_id").alias("id"),
            F.col("file_id").alias("source"),
            F.current_timestamp().alias("ingested_at"),
            F.concat(F.lit("Record file import "), "source_batch_id").alias("description"),
        ),
        "persons": records.link_parents(persons, links),
        "baptisms": records.build_baptisms(built),
        "marriages": marriages,
        "deaths": records.build_deaths(built),
        "raw": records.build_raw_records(individuals, families, marriages),
        "unresolved": records.unresolved_children(children, persons),
    }


def import_files(spark: SparkSession, paths: str | list[str], vectors: bool = True) -> dict[str, DataFrame]:
    lines, rejected = read_gedcom_lines(spark, paths)
    tables = tables_of_records(records.assemble_records(lines))
    if vectors:
        for name, kind in (("persons", "person"), ("baptisms", "baptism"), ("marriages", "marriage"), ("deaths", "death")):
            tables[name] = with_embedding(tables[name], kind)
    return {**tables, "rejected": rejected}


def merge_all(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(tables, maps): persons and events that match exactly, and what follows from them, merged."""
    maps = {name: cut_lineage(m) for name, m in cascade_maps(tables).items()}
    return apply_cascade(tables, maps), maps


def merge_exact(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Merge persons alone that match exactly and point every reference at the survivor."""
    mapping = merge_map(tables["persons"], "person")
    out = dict(tables)
    out["persons"] = apply_merge(tables["persons"], mapping, ["father_id", "mother_id"])
    for name, columns in (
        ("baptisms", ["child_id"]),
        ("marriages", ["spouse1_id", "spouse2_id"]),
        ("deaths", ["deceased_id"]),
    ):
        for column in columns:
            out[name] = repoint(out[name], mapping, column)
    return out, mapping


def statistics(tables: dict[str, DataFrame], maps: dict[str, DataFrame]) -> DataFrame:
    """What an import did, per batch: rows of each kind that are left, parent links, merged rows, unresolved references.

    ``tables`` are those before the merge, ``maps`` come from ``merge_all``.
    """
    left = {n: tables[n].join(maps[n].select("id"), "id", "left_anti") for n in maps}
    merged = None
    for name, mapping in maps.items():
        rows = tables[name].join(mapping.select("id"), "id", "left_semi").select("source_batch_id")
        merged = rows if merged is None else merged.unionByName(rows)
    more = {"parent_links": records.link_rows(left["persons"]), "merged": merged, "errors": tables["unresolved"]}
    return records.import_stats({**left, **more})


def build_graph(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    vertices = graph.build_vertices(tables)
    return vertices, graph.valid_edges(graph.build_edges(tables), vertices)
