"""Joins and unions of the register tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import stem
from ..functions.text import date_with_flag, display_name
from .windows import hot_keys, skew_join


def with_parents(persons: DataFrame) -> DataFrame:
    """Attach first and last names of both parents."""
    out = persons
    for role in ("father", "mother"):
        names = persons.select(
            F.col("id").alias(f"{role}_id"),
            F.col("first_name").alias(f"{role}_first_name"),
            F.col("last_name").alias(f"{role}_last_name"),
        )
        out = skew_join(out, names, [f"{role}_id"], "left", hot_keys(persons, [f"{role}_id"]))
    return out


def with_status(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Attach a dimension row; Spark broadcasts the dimension only while it is small."""
    return df.join(dim, key, "left")


def with_spouses(marriages: DataFrame, persons: DataFrame) -> DataFrame:
    out = marriages
    for side in ("spouse1", "spouse2"):
        names = persons.select(
            F.col("id").alias(f"{side}_id"), display_name(F.col("first_name"), F.col("last_name")).alias(f"{side}_label")
        )
        out = skew_join(out, names, [f"{side}_id"], "left", hot_keys(marriages, [f"{side}_id"]))
    return out


def children_of(persons: DataFrame) -> DataFrame:
    """(parent_id, child_id) by either parent column, distinct."""
    parents = F.array_distinct(F.array_compact(F.array("father_id", "mother_id")))
    return persons.select(F.explode(parents).alias("parent_id"), F.col("id").alias("child_id"))


def marriages_of(marriages: DataFrame) -> DataFrame:
    """(person_id, spouse_id, marriage_id, date) seen from both spouses."""
    sides = F.array(
        F.struct(F.col("spouse1_id").alias("person_id"), F.col("spouse2_id").alias("spouse_id")),
        F.struct(F.col("spouse2_id").alias("person_id"), F.col("spouse1_id").alias("spouse_id")),
    )
    return marriages.select(F.inline(sides), F.col("id").alias("marriage_id"), "marriage_date").where(
        "person_id is not null"
    )


def baptisms_of(baptisms: DataFrame) -> DataFrame:
    """(person_id, role, baptism_id, date) in the roles child, father and mother."""
    roles = F.array(
        *[F.struct(F.lit(r).alias("role"), F.col(f"{r}_id").alias("person_id")) for r in ("child", "father", "mother")]
    )
    return baptisms.select(F.inline(roles), F.col("id").alias("baptism_id"), "baptism_date").where(
        "person_id is not null"
    )


def person_details(tables: dict[str, DataFrame]) -> DataFrame:
    """Detail page of every person as rows (id, section, item_id, role, name, date, estimated).

    Sections: birth, death, parent, child, marriage, baptism and death record. Rows
    instead of nested lists keep a person with very many relations spread out; a
    filter on ``id`` gives one page.
    """
    persons = tables["persons"]
    label = display_name(F.col("first_name"), F.col("last_name"))
    names = persons.select("id", label.alias("name"))

    def rows(df: DataFrame, section: str, item=None, role=None, name=None, date=None, estimated=None) -> DataFrame:
        text = lambda c: (F.lit(None) if c is None else c).cast("string")
        return df.select(
            F.col("person_id").alias("id"),
            F.lit(section).alias("section"),
            text(item).alias("item_id"),
            text(role).alias("role"),
            text(name).alias("name"),
            text(date).alias("date"),
            (F.lit(None) if estimated is None else estimated).cast("boolean").alias("estimated"),
        )

    def named(df: DataFrame, key: str) -> DataFrame:
        return skew_join(df, names.withColumnRenamed("id", key), [key], "left")

    own = persons.withColumn("person_id", F.col("id"))
    parts = []
    for section in ("birth", "death"):
        flag = f"{section}_date_estimated"
        shown = date_with_flag(F.col(f"{section}_date"), F.col(flag) if flag in persons.columns else F.lit(None))
        dated = own.withColumn("shown", shown).where("shown is not null")
        parts.append(rows(dated, section, date=F.col("shown.date"), estimated=F.col("shown.estimated")))
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_id").alias("other_id")) for r in ("father", "mother")])
    parents = own.select("person_id", F.inline(roles)).where("other_id is not null")
    kids = children_of(persons).select(F.col("parent_id").alias("person_id"), F.col("child_id").alias("other_id"))
    for section, df in (("parent", parents), ("child", kids)):
        role = F.col("role") if section == "parent" else None
        parts.append(rows(named(df, "other_id"), section, F.col("other_id"), role, F.col("name")))
    if "marriages" in tables:
        wed = named(marriages_of(tables["marriages"]), "spouse_id")
        parts.append(rows(wed, "marriage", F.col("marriage_id"), None, F.col("name"), F.col("marriage_date")))
    if "baptisms" in tables:
        parts.append(
            rows(baptisms_of(tables["baptisms"]), "baptism", F.col("baptism_id"), F.col("role"), None, F.col("baptism_date"))
        )
    if "deaths" in tables:
        gone = tables["deaths"].where("deceased_id is not null").withColumn("person_id", F.col("deceased_id"))
        parts.append(rows(gone, "death_record", F.col("id"), None, None, F.col("death_date")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def enrich_candidates(candidates: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Both records of each pair, per record type; pairs that lost a record are not shown."""
    parts = []
    for kind, (table, columns) in tables.items():
        mine = candidates.where(F.col("record_type") == kind)
        for side in ("record1", "record2"):
            body = table.select(
                F.col("id").alias(f"{side}_id"), F.to_json(F.struct(*columns)).alias(side)
            )
            mine = skew_join(mine, body, [f"{side}_id"], hot=hot_keys(candidates, [f"{side}_id"]))
        parts.append(mine)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def orphan_candidates(candidates: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Pairs with a record that no longer exists."""
    ids = None
    for kind, table in tables.items():
        part = table.select(F.lit(kind).alias("record_type"), "id")
        ids = part if ids is None else ids.unionByName(part)
    whole = candidates
    for side in ("record1_id", "record2_id"):
        keys = ["record_type", side]
        whole = skew_join(whole, ids.withColumnRenamed("id", side), keys, "left_semi", hot_keys(candidates, keys))
    return candidates.join(whole.select("id"), "id", "left_anti")


def unprocessed(inputs: DataFrame, outputs: DataFrame, input_key: str, output_key: str) -> DataFrame:
    """Inputs without an output under the same key, extensions ignored."""
    done = outputs.select(stem(F.col(output_key)).alias("_key")).distinct()
    return inputs.withColumn("_key", stem(F.col(input_key))).join(done, "_key", "left_anti").drop("_key")


def insert_new(new: DataFrame, old: DataFrame, keys: list[str], unordered: bool = False) -> DataFrame:
    """Rows of ``new`` whose key is not stored; a pair of keys may match in either order."""
    if not unordered:
        return new.join(old.select(*keys).distinct(), keys, "left_anti").select(*new.columns)
    first, second = keys
    pair = lambda df: df.withColumns({"_low": F.least(first, second), "_high": F.greatest(first, second)})
    return pair(new).join(pair(old).select("_low", "_high").distinct(), ["_low", "_high"], "left_anti").select(*new.columns)


def with_audit(keys: DataFrame, audit: DataFrame) -> DataFrame:
    """Completeness joined back to page keys; the audit's total wins."""
    info = audit.select("document_id", "status", F.col("expected_pages").alias("_total"))
    out = skew_join(keys, info, ["document_id"], "left", hot_keys(keys, ["document_id"]))
    return out.withColumn("total_pages", F.coalesce("_total", "total_pages")).drop("_total")


def only_complete(keys: DataFrame, audit: DataFrame) -> DataFrame:
    done = audit.where(F.col("status") == "complete").select("document_id")
    return skew_join(keys, done, ["document_id"], "left_semi", hot_keys(keys, ["document_id"]))
