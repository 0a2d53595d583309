"""Reviews, deletions and status changes as table transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .windows import hot_keys, latest_per, skew_join


def purge_candidates(candidates: DataFrame, deleted: DataFrame) -> DataFrame:
    """Drop pairs that name a deleted record of their type on either side."""
    out = candidates
    for side in ("record1_id", "record2_id"):
        gone = deleted.select("record_type", F.col("id").alias(side)).distinct()
        out = out.join(gone, ["record_type", side], "left_anti")
    return out.select(*candidates.columns)


def standing_confirmations(confirms: DataFrame) -> DataFrame:
    """The confirmations that take effect when made one by one in the order ``at``.

    ``confirms`` has id, record_type, record1_id, record2_id and at. A confirmation
    deletes its second record, so it falls if an earlier standing one deleted either of
    its records. A round decides every confirmation whose earlier rivals are decided;
    only the open ones are written again, and they meet those that stood in the round before:
    the earlier ones they have met already.
    """
    names = ["record_type", "record2_id"]
    open_ = cut_lineage(confirms)
    standing = stands = None
    while not open_.isEmpty():
        first = open_.groupBy(*names).agg(F.min("at").alias("_open"))
        gone = None if stands is None else stands.select(*names, F.col("at").alias("_gone"))
        rows = open_
        for side in ("record1_id", "record2_id"):
            rows = rows.join(first.select("record_type", F.col("record2_id").alias(side), F.col("_open").alias(f"_open_{side}")), ["record_type", side], "left")
            found = F.lit(None)
            if gone is not None:
                rows = rows.join(gone.select("record_type", F.col("record2_id").alias(side), F.col("_gone").alias(f"_gone_{side}")), ["record_type", side], "left")
                found = F.col(f"_gone_{side}")
            rows = rows.withColumn(f"_lost_{side}", F.coalesce(found < F.col("at"), F.lit(False)))
        falls = F.col("_lost_record1_id") | F.col("_lost_record2_id")
        clear = (F.coalesce("_open_record1_id", "at") >= F.col("at")) & (F.col("_open_record2_id") >= F.col("at"))
        decided = cut_lineage(
            rows.select(*confirms.columns, F.when(falls, "falls").when(clear, "stands").otherwise("open").alias("_state"))
        )
        stands = decided.where("_state = 'stands'").drop("_state")
        standing = stands if standing is None else standing.unionByName(stands)
        open_ = decided.where("_state = 'open'").drop("_state")
    return confirms.limit(0) if standing is None else standing


def apply_reviews(
    candidates: DataFrame, reviews: DataFrame, tables: dict[str, DataFrame], order: str = "review_no"
) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(candidates, resolutions, tables) after confirm and reject decisions in the order of their number.

    A confirmation removes the second record, keeps its snapshot in the resolution and
    purges the other pairs that name it, so that later reviews of those do nothing. A
    later confirmation overrules a rejection; nothing overrules a confirmation.
    """
    base = candidates.drop("reviewed_by", "review_notes")
    made = reviews.select(
        F.col("candidate_id").alias("id"), F.col("action").alias("_action"),
        F.struct(F.col(order).alias("no"), F.col("candidate_id").alias("of"), "reviewed_by", "review_notes").alias("_review"),
    )
    by_pair = made.groupBy("id").agg(
        F.min(F.when(F.col("_action") == "confirm", F.col("_review"))).alias("_confirm"),
        F.max(F.when(F.col("_action") == "reject", F.col("_review"))).alias("_reject"),
    )
    joined = cut_lineage(base.join(by_pair, "id", "left"))
    undecided = F.col("status") != "confirmed"
    confirms = joined.where(undecided & F.col("_confirm").isNotNull()).select(
        "id", "record_type", "record1_id", "record2_id", F.struct("_confirm.no", "_confirm.of").alias("at")
    )
    standing = cut_lineage(standing_confirmations(confirms))
    confirmed = joined.join(standing.select("id"), "id", "left_semi")
    deleted = standing.select("record_type", F.col("record2_id").alias("id")).distinct()

    def reviewed(rows: DataFrame, status, review) -> DataFrame:
        return rows.withColumns(
            {"status": status, "reviewed_by": review["reviewed_by"], "review_notes": review["review_notes"]}
        ).drop("_confirm", "_reject")

    rejected = undecided & F.col("_reject").isNotNull()
    others = purge_candidates(joined.join(standing.select("id"), "id", "left_anti"), deleted)
    others = reviewed(others, F.when(rejected, "rejected").otherwise(F.col("status")), F.when(rejected, F.col("_reject")))
    # A confirmed pair survives its own deletion, but not a later one of the record it kept.
    lost = deleted.select("record_type", F.col("id").alias("record1_id"))
    whole = confirmed.where("record1_id <> record2_id").join(lost, ["record_type", "record1_id"], "left_anti")
    whole = whole.unionByName(confirmed.where("record1_id = record2_id"))
    after = others.unionByName(reviewed(whole, F.lit("confirmed"), F.col("_confirm")))

    resolutions, kept = None, {}
    for kind, table in tables.items():
        gone = deleted.where(F.col("record_type") == kind).select("id")
        kept[kind] = table.join(gone, "id", "left_anti")
        snapshot = table.select(F.col("id").alias("record2_id"), F.to_json(F.struct(*table.columns)).alias("merged_data"))
        part = confirmed.where(F.col("record_type") == kind).join(snapshot, "record2_id").select(
            F.col("id").alias("candidate_id"),
            F.lit("merge").alias("action"),
            F.col("record1_id").alias("kept_record_id"),
            F.col("record2_id").alias("merged_record_id"),
            F.col("_confirm.reviewed_by").alias("resolved_by"),
            F.col("_confirm.review_notes").alias("resolution_notes"),
            "merged_data",
        )
        resolutions = part if resolutions is None else resolutions.unionByName(part)
    return after, resolutions, kept


def cascade_ids(persons: DataFrame, ids: DataFrame) -> DataFrame:
    """The given persons and all their descendants over both parent columns."""
    from .relate import children_of

    children = cut_lineage(children_of(persons))
    hot = cut_lineage(hot_keys(children, ["parent_id"]))
    reached = cut_lineage(ids.select("id").distinct())
    frontier = reached
    while True:
        found = skew_join(children, frontier.withColumnRenamed("id", "parent_id"), ["parent_id"], "left_semi", hot)
        found = found.select(F.col("child_id").alias("id")).distinct()
        frontier = cut_lineage(found.join(reached, "id", "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


# The columns of each table that name a person.
PERSON_REFERENCES = {
    "baptisms": ["child_id", "father_id", "mother_id"],
    "marriages": ["spouse1_id", "spouse2_id"],
    "deaths": ["deceased_id"],
}


def delete_persons(
    tables: dict[str, DataFrame], ids: DataFrame, on_delete: str = "cascade"
) -> dict[str, DataFrame]:
    """Delete persons with all that depends on them, or null the references instead."""
    persons = tables["persons"]
    gone = cascade_ids(persons, ids) if on_delete == "cascade" else ids.select("id").distinct()
    out = {**tables, "persons": persons.join(gone, "id", "left_anti")}
    references = dict(PERSON_REFERENCES)
    if on_delete != "cascade":
        references["persons"] = ["father_id", "mother_id"]
    for name, columns in references.items():
        if name not in out:
            continue
        table = out[name]
        for column in columns:
            if column not in table.columns:
                continue
            lost = gone.select(F.col("id").alias(column))
            if on_delete == "cascade":
                table = table.join(lost, column, "left_anti").select(*table.columns)
            else:
                marked = skew_join(table, lost.withColumn("_gone", F.lit(True)), [column], "left")
                table = marked.withColumn(
                    column, F.when(F.col("_gone").isNull(), F.col(column))
                ).select(*table.columns)
        out[name] = table
    if "candidates" in out:
        removed = gone.select("id", F.lit("person").alias("record_type"))
        out["candidates"] = purge_candidates(out["candidates"], removed)
    return out


def advance_status(files: DataFrame, events: DataFrame) -> DataFrame:
    """Files with the status of their latest event, their own when there is none."""
    last = latest_per(events.select("file_id", "at", "event_id", "status"), ["file_id"], ["at", "event_id"])
    last = last.select(F.col("file_id").alias("id"), F.col("status").alias("_status"))
    return files.join(last, "id", "left").withColumn(
        "processing_status", F.coalesce("_status", "processing_status")
    ).drop("_status")
