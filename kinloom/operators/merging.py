"""Merging of persons and events that follow from each other.

Persons that match exactly are one; events that then name the same person, day and place
are one; and an event has one child, one deceased and one pair of spouses, so its persons are one
too, unless their sexes differ. All these rules have one form: what is the same
function of the same things is the same. ``congruence_classes`` closes any such rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .graph import connected_components
from .linkage import apply_merge, merge_map, repoint
from .windows import hot_keys, skew_join

KEY = ["label", "a", "b"]


def _agreed(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one fact for each label and arguments, equalities between the results of the others and its own)."""
    facts = cut_lineage(facts)
    least = cut_lineage(facts.groupBy(*KEY).agg(F.min("result").alias("_least")))
    rows = skew_join(facts, least, KEY, hot=hot_keys(facts, KEY))
    equal = rows.where("result <> _least").select(F.col("result").alias("x"), F.col("_least").alias("y")).distinct()
    return least.withColumnRenamed("_least", "result"), cut_lineage(equal)


def congruence_classes(facts: DataFrame, equal: DataFrame) -> DataFrame:
    """(id, rep): the nodes that are the same as a smaller one, and the smallest of their class.

    ``facts`` has label, a, b and result, all strings, none null (b may be ''): result is
    what ``label`` makes of a and b. ``equal`` has x and y, nodes given to be the same.
    Facts with the same label and the same arguments have the same result; that is followed until
    nothing changes, so the classes don't depend on the order of rounds.

    Facts are written once. A round works out the components of the new equalities alone and writes
    only the facts whose arguments have moved, with what they meet; the rounds grow with the
    length of a chain of consequences. Empty inputs give no classes.
    """
    base, found = _agreed(facts.select(*KEY, "result").where("a is not null and b is not null and result is not null"))
    base = cut_lineage(base)
    pending = cut_lineage(equal.select("x", "y").where("x <> y").unionByName(found))
    fresh, retired, classes = base.limit(0), base.select(*KEY).limit(0), None
    while not pending.isEmpty():
        parts = connected_components(pending, "x", "y")
        moved = cut_lineage(parts.where("id <> component").select("id", F.col("component").alias("rep")))
        if moved.isEmpty():
            break
        if classes is None:
            classes = moved
        else:
            again = moved.select(F.col("id").alias("rep"), F.col("rep").alias("_to"))
            kept = classes.join(again, "rep", "left").select("id", F.coalesce("_to", "rep").alias("rep"))
            classes = cut_lineage(kept.unionByName(moved))
        live = base.join(retired, KEY, "left_anti").unionByName(fresh)
        new = live
        for side in ("a", "b"):
            new = new.join(moved.select(F.col("id").alias(side), F.col("rep").alias(f"_{side}")), side, "left")
        touched = cut_lineage(new.where("_a is not null or _b is not null"))
        after = cut_lineage(
            touched.select("label", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "result")
        )
        met = live.join(after.select(*KEY).distinct(), KEY, "left_semi").join(touched.select(*KEY), KEY, "left_anti")
        met = cut_lineage(met)
        # results are named as they are now
        rows = after.unionByName(met).join(classes.withColumnRenamed("id", "result"), "result", "left")
        settled, found = _agreed(rows.select(*KEY, F.coalesce("rep", "result").alias("result")))
        gone = touched.select(*KEY).unionByName(met.select(*KEY))
        fresh = cut_lineage(fresh.join(gone, KEY, "left_anti").unionByName(settled))
        retired = cut_lineage(retired.unionByName(gone).distinct())
        pending = found
    if classes is None:
        return pending.select(F.col("x").alias("id"), F.col("y").alias("rep")).limit(0)
    return classes


@dataclass(frozen=True)
class Event:
    """Who an event is about: column and role; and the columns that tell it from others of its persons."""

    table: str
    kind: str
    people: tuple[tuple[str, str], ...]
    told_by: tuple[str, ...]


EVENTS = (
    Event("baptisms", "baptism", (("child_id", "child"),), ("baptism_date", "parish", "village")),
    Event("marriages", "marriage", (("spouse1_id", "spouse1"), ("spouse2_id", "spouse2")), ("marriage_date", "parish", "village")),
    Event("deaths", "death", (("deceased_id", "deceased"),), ("death_date", "parish", "village")),
)
KIND_OF = {"persons": "person", **{e.table: e.kind for e in EVENTS}}


def _node(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def merge_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """What an event is made of, and who the persons of an event are, as facts.

    An event without a date or one of its persons says nothing of itself, but its persons still depend on it.
    """
    sexes = tables["persons"].select(F.col("id").alias("_person"), F.coalesce("gender", F.lit("")).alias("_sex"))
    out = None
    for event in EVENTS:
        table = tables[event.table]
        told = [F.col(c).cast("string") if c in table.columns else F.lit(None).cast("string") for c in event.told_by]
        label = F.to_json(F.struct(F.lit(event.kind).alias("kind"), *[c.alias(n) for c, n in zip(told, event.told_by)]))
        people = [c for c, _ in event.people]
        other = _node("person", people[1]) if len(people) > 1 else F.lit("")
        made = table.where(told[0].isNotNull()).select(
            label.alias("label"), _node("person", people[0]).alias("a"), other.alias("b"), _node(event.kind, "id").alias("result")
        )
        out = made if out is None else out.unionByName(made)
        for column, role in event.people:
            named = table.where(F.col(column).isNotNull()).select("id", F.col(column).alias("_person")).join(sexes, "_person")
            out = out.unionByName(
                named.select(
                    F.concat(F.lit(f"{role}|"), "_sex").alias("label"), _node(event.kind, "id").alias("a"), F.lit("").alias("b"),
                    _node("person", "_person").alias("result"),
                )
            )
    return out


def cascade_maps(tables: dict[str, DataFrame], batch: str = "source_batch_id") -> dict[str, DataFrame]:
    """For each table (id, survivor_id, composite_score, merged_by) of the rows that another one replaces.

    Rows whose scores are exact are merged first, then all that follows from them. The
    survivor is the row of the lowest batch, then the lowest id. ``merged_by`` is `score` with the best
    score of a row that has an exact match, else `cascade`, without one.
    """
    exact = {name: cut_lineage(merge_map(tables[name], kind, batch)) for name, kind in KIND_OF.items()}
    equal = None
    for name, kind in KIND_OF.items():
        rows = exact[name].select(_node(kind, "id").alias("x"), _node(kind, "survivor_id").alias("y"))
        equal = rows if equal is None else equal.unionByName(rows)
    classes = cut_lineage(congruence_classes(merge_facts(tables), equal))
    out = {}
    for name, kind in KIND_OF.items():
        reps = classes.where(F.col("id").startswith(f"{kind}:")).select(F.col("id").alias("_node"), F.col("rep").alias("_class"))
        heads = reps.select(F.col("_class").alias("_node"), "_class").distinct()
        rows = tables[name].select("id", batch, _node(kind, "id").alias("_node"))
        rows = cut_lineage(rows.join(reps.unionByName(heads), "_node").drop("_node"))
        kept = rows.groupBy("_class").agg(F.min(F.struct(batch, "id")).alias("_kept"))
        mapped = skew_join(rows, kept, ["_class"], hot=hot_keys(rows, ["_class"]))
        mapped = mapped.where(F.col("id") != F.col("_kept.id")).select("id", F.col("_kept.id").alias("survivor_id"))
        known = exact[name].select("id", "composite_score").unionByName(
            exact[name].groupBy(F.col("survivor_id").alias("id")).agg(F.max("composite_score").alias("composite_score"))
        )
        by = F.when(F.col("composite_score").isNotNull(), "score").otherwise("cascade")
        out[name] = mapped.join(known, "id", "left").select("id", "survivor_id", "composite_score", by.alias("merged_by"))
    return out


def apply_cascade(tables: dict[str, DataFrame], maps: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without merged rows; every reference to a merged person points at the survivor."""
    persons = maps["persons"]
    out = dict(tables)
    own = [c for c in ("father_id", "mother_id") if c in tables["persons"].columns]
    out["persons"] = apply_merge(tables["persons"], persons, own)
    for event in EVENTS:
        rows = apply_merge(tables[event.table], maps[event.table], [])
        also = [c for c in ("father_id", "mother_id") if c in rows.columns]
        for column in [c for c, _ in event.people] + also:
            rows = repoint(rows, persons, column)
        out[event.table] = rows
    return out

