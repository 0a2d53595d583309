"""Record-file lines to record trees and to the person and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_gedcom_date
from ..functions.text import split_name
from ..session import cut_lineage
from .windows import first_per, running_sum, skew_join

LINE = r"^\s*\uFEFF?(\d+)\s+(?:(@[^@]+@)\s+)?(\w+)(?: (.*))?$"
LINES_PER_CHUNK = 50_000
LEVELS_AT_ONCE = 12


def record_id(*parts) -> Column:
    """Stable key of an imported row."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def split_line(line: Column) -> list[Column]:
    """level, xref, tag and value of one line."""
    return [
        F.regexp_extract(line, LINE, 1).try_cast("int").alias("level"),
        F.nullif(F.regexp_extract(line, LINE, 2), F.lit("")).alias("xref"),
        F.nullif(F.regexp_extract(line, LINE, 3), F.lit("")).alias("tag"),
        F.nullif(F.trim(F.regexp_extract(line, LINE, 4)), F.lit("")).alias("value"),
    ]


def lines_of_text(df: DataFrame, file_id: str, text: str) -> DataFrame:
    """Lines of record texts held in a column; blank ones are not counted."""
    kept = F.filter(F.split(F.col(text), "\r\n|\n|\r"), lambda s: F.regexp_replace(s, r"\s", "") != "")
    lines = df.select(F.col(file_id).alias("file_id"), F.posexplode(kept).alias("pos", "line"))
    return lines.select("file_id", (F.col("pos") + 1).cast("long").alias("line_no"), *split_line(F.col("line")))


def assemble_records(lines: DataFrame, lines_per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """Add ``record_no`` (per level-0 line) and ``parent_line`` (line number, null at level 0).

    Both are worked out in chunks of lines, so a huge file is not one task. A line's parent is the last
    earlier line of its record one level up. The lines are written first, as they are read for
    the chunks' totals too and parsing them costs most.
    """
    lines = cut_lineage(lines.where(F.col("level").isNotNull()))
    deepest = lines.agg(F.max("level")).first()[0] or 0
    chunk = F.floor(F.col("line_no") / lines_per_chunk)
    if deepest > LEVELS_AT_ONCE:
        return _parents_by_level(running_sum(lines, ["file_id"], chunk, [F.asc("line_no")], (F.col("level") == 0).cast("int"), "record_no"))

    # The records begun, and the last line of each level, up to a line: inside its chunk and in those before.
    starts = F.sum((F.col("level") == 0).cast("long"))
    last = [F.max(F.when(F.col("level") == n, F.col("line_no"))) for n in range(deepest + 1)]
    inside = Window.partitionBy("file_id", "_chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunked = lines.withColumn("_chunk", chunk)
    rows = chunked.withColumns({"_starts": starts.over(inside), **{f"_last{n}": c.over(inside) for n, c in enumerate(last)}})
    before = Window.partitionBy("file_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.groupBy("file_id", "_chunk").agg(starts.alias("_s"), *[c.alias(f"_l{n}") for n, c in enumerate(last)])
    totals = totals.select(
        "file_id", "_chunk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s"),
        *[F.max(f"_l{n}").over(before).alias(f"_l{n}") for n in range(deepest + 1)],
    )
    at = [F.greatest(f"_last{n}", f"_l{n}") for n in range(deepest + 1)]  # without nulls
    above = F.get(F.array(*at), F.col("level") - 1)
    joined = rows.join(totals, ["file_id", "_chunk"])
    return joined.select(
        *lines.columns,
        (F.col("_starts") + F.col("_s")).alias("record_no"),
        F.when((F.col("level") > 0) & (above >= F.coalesce(at[0], above)), above).alias("parent_line"),
    )


def _parents_by_level(numbered: DataFrame) -> DataFrame:
    """``parent_line`` whatever the levels: a line is offered to the level below and asks the one above."""
    roles = F.array(
        F.struct(F.col("level").alias("at"), F.lit(True).alias("offers")),
        F.struct((F.col("level") - 1).alias("at"), F.lit(False).alias("offers")),
    )
    offered = numbered.select("*", F.inline(roles))
    above = (
        Window.partitionBy("file_id", "record_no", "at")
        .orderBy("line_no", F.desc("offers"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    parent = F.last(F.when(F.col("offers"), F.col("line_no")), ignorenulls=True).over(above)
    return offered.withColumn("parent_line", parent).where(~F.col("offers")).drop("at", "offers")


def blocks_of(records: DataFrame) -> DataFrame:
    """One row per level-1 line with the first and last DATE and the last PLAC under it."""
    line = F.when(F.col("level") == 2, F.col("parent_line")).otherwise(F.col("line_no"))
    top = F.col("level") == 1
    filled = (F.col("level") == 2) & F.col("value").isNotNull()

    def at(tag: str) -> Column:
        return F.when(filled & (F.col("tag") == tag), F.col("line_no"))

    head = F.col("level") == 0
    return (
        records.where("level <= 2")
        .withColumn("block_line", line)
        .groupBy("file_id", "record_no", "block_line")
        .agg(
            F.max(F.when(head, F.col("xref"))).alias("xref"),
            F.max(F.when(head, F.col("tag"))).alias("record_tag"),
            F.max(F.when(top, F.col("tag"))).alias("tag"),
            F.max(F.when(top, F.col("value"))).alias("value"),
            F.max_by("value", at("DATE")).alias("date"),
            F.min_by("value", at("DATE")).alias("first_date"),
            F.max_by("value", at("PLAC")).alias("place"),
        )
    )


def _first(what: Column, where: Column) -> Column:
    return F.min_by(what, F.when(where, F.col("block_line")))


def _last(what: Column, where: Column) -> Column:
    return F.max_by(what, F.when(where, F.col("block_line")))


def _tag(*names: str) -> Column:
    return F.col("tag").isin(*names)


def gather_records(records: DataFrame) -> DataFrame:
    """One row per individual and family record with all that the tables need of it, written by kind.

    Blocks are built once for both kinds; ``record_tag`` is INDI or FAM. ``children`` are
    the CHIL lines of a record, which is read as a whole anyway.
    """
    filled = F.col("value").isNotNull()
    event = F.struct("date", "place")
    dated = F.col("first_date").isNotNull()
    child = F.struct(F.col("block_line").alias("line_no"), F.col("value").alias("child"))
    rows = (
        blocks_of(records)
        .groupBy("file_id", "record_no")
        .agg(
            F.max("xref").alias("xref"),
            F.max("record_tag").alias("record_tag"),
            _first(F.col("value"), _tag("NAME") & filled).alias("name"),
            _last(F.col("value"), _tag("NAME") & filled).alias("last_name_value"),
            _first(F.col("value"), _tag("SEX") & filled).alias("sex"),
            _last(F.col("value"), _tag("SEX") & filled).alias("last_sex_value"),
            _first(F.col("value"), _tag("OCCU") & filled).alias("occupation"),
            _first(event, _tag("BIRT")).alias("birth"),
            _first(event, _tag("DEAT")).alias("death"),
            _first(event, _tag("BAPM", "CHR")).alias("baptism"),
            _last(F.col("first_date"), _tag("BIRT") & dated).alias("raw_birth"),
            _last(F.col("first_date"), _tag("DEAT") & dated).alias("raw_death"),
            _last(F.col("value"), _tag("HUSB") & filled).alias("husband"),
            _last(F.col("value"), _tag("WIFE") & filled).alias("wife"),
            _first(event, _tag("MARR")).alias("marriage"),
            _last(F.col("first_date"), _tag("MARR") & dated).alias("raw_marriage"),
            F.collect_list(F.when(_tag("CHIL") & filled, child)).alias("children"),
        )
        .where(F.col("record_tag").isin("INDI", "FAM"))
    )
    return cut_lineage(rows, by=["record_tag"])


PERSONAL = ["name", "last_name_value", "sex", "last_sex_value", "occupation", "birth", "death", "baptism", "raw_birth", "raw_death"]
FAMILIAL = ["husband", "wife", "marriage", "raw_marriage"]


def individuals_of(gathered: DataFrame) -> DataFrame:
    """One row per individual record, holding all that persons and events need."""
    rows = gathered.where((F.col("record_tag") == "INDI") & F.col("xref").isNotNull())
    return rows.select("file_id", "record_no", "xref", *PERSONAL)


def families_of(gathered: DataFrame) -> DataFrame:
    rows = gathered.where((F.col("record_tag") == "FAM") & F.col("xref").isNotNull())
    return rows.select("file_id", "record_no", "xref", *FAMILIAL)


def children_of_families(gathered: DataFrame) -> DataFrame:
    """(file_id, record_no, xref, husband, wife, line_no, child) of every CHIL line of a family."""
    rows = gathered.where("record_tag = 'FAM'")
    return rows.select("file_id", "record_no", "xref", "husband", "wife", F.inline("children"))


def assign_batch(files: DataFrame) -> DataFrame:
    """Attach the batch key of each file."""
    return files.withColumn("source_batch_id", record_id(F.lit("batch"), F.col("file_id")))


def build_persons(individuals: DataFrame) -> DataFrame:
    """Persons keyed by (xref, batch); the first record of an xref wins."""
    rows = first_per(assign_batch(individuals), ["source_batch_id", "xref"], [F.asc("record_no")])
    name = split_name(F.col("name"))
    return rows.select(
        record_id("source_batch_id", "xref").alias("id"),
        F.col("xref").alias("gedcom_id"),
        "source_batch_id",
        name["first_name"].alias("first_name"),
        name["last_name"].alias("last_name"),
        F.lit(None).cast("string").alias("maiden_name"),
        F.when(F.col("sex").isin("M", "F"), F.col("sex")).alias("gender"),
        parse_gedcom_date(F.col("birth.date")).alias("birth_date"),
        F.col("birth.place").alias("birth_place"),
        parse_gedcom_date(F.col("death.date")).alias("death_date"),
        F.col("death.place").alias("death_place"),
        "occupation",
        "baptism",
        F.col("death.place").alias("death_parish"),
    )


def person_table(built: DataFrame) -> DataFrame:
    return built.drop("baptism", "death_parish")


def build_baptisms(built: DataFrame) -> DataFrame:
    """Baptisms with a readable date; name, sex and birth date come from the person."""
    date = parse_gedcom_date(F.col("baptism.date"))
    gedcom_id = F.concat("gedcom_id", F.lit("_BAPM"))
    return built.select(
        record_id("source_batch_id", gedcom_id).alias("id"),
        gedcom_id.alias("gedcom_id"),
        "source_batch_id",
        F.col("id").alias("child_id"),
        F.col("first_name").alias("child_name"),
        F.col("gender").alias("child_gender"),
        date.alias("baptism_date"),
        "birth_date",
        F.col("baptism.place").alias("parish"),
    ).where(F.col("baptism_date").isNotNull())


def build_deaths(built: DataFrame) -> DataFrame:
    gedcom_id = F.concat("gedcom_id", F.lit("_DEAT"))
    return built.where(F.col("death_date").isNotNull()).select(
        record_id("source_batch_id", gedcom_id).alias("id"),
        gedcom_id.alias("gedcom_id"),
        "source_batch_id",
        F.col("id").alias("deceased_id"),
        F.col("first_name").alias("deceased_name"),
        F.col("last_name").alias("deceased_surname"),
        "death_date",
        F.col("death_parish").alias("parish"),
    )


def resolve_xref(df: DataFrame, persons: DataFrame, xref: str, prefix: str, columns: list[str]) -> DataFrame:
    """Look up persons of the same batch by xref; unknown ones give nulls."""
    found = persons.select(
        "source_batch_id",
        F.col("gedcom_id").alias(xref),
        *[F.col(c).alias(prefix + suffix) for c, suffix in columns],
    )
    return skew_join(df, found, ["source_batch_id", xref], "left")


SPOUSE_COLUMNS = [("id", "_id"), ("first_name", "_name"), ("last_name", "_surname")]


def build_marriages(families: DataFrame, persons: DataFrame) -> DataFrame:
    """Marriages with a readable date, with the spouses that exist in the batch; persons are read once for both."""
    rows = first_per(assign_batch(families), ["source_batch_id", "xref"], [F.asc("record_no")])
    rows = rows.select(
        "source_batch_id", F.col("xref").alias("_family"), parse_gedcom_date(F.col("marriage.date")).alias("marriage_date"),
        F.col("marriage.place").alias("parish"), "husband", "wife",
    ).where(F.col("marriage_date").isNotNull())
    sides = F.array(*[F.struct(F.lit(n).alias("_side"), F.col(c).alias("_xref")) for n, c in ((1, "husband"), (2, "wife"))])
    asked = rows.select("source_batch_id", "_family", "marriage_date", "parish", F.inline(sides))
    found = resolve_xref(asked, persons, "_xref", "_", [*SPOUSE_COLUMNS, ("maiden_name", "_maiden_name")])
    told = ["__id", "__name", "__surname", "__maiden_name"]
    both = found.groupBy("source_batch_id", "_family").agg(
        F.max("marriage_date").alias("marriage_date"), F.max("parish").alias("parish"),
        *[F.max(F.when(F.col("_side") == n, F.struct(*told))).alias(f"_{n}") for n in (1, 2)],
    )
    gedcom_id = F.concat("_family", F.lit("_MARR"))
    return both.select(
        record_id("source_batch_id", gedcom_id).alias("id"),
        gedcom_id.alias("gedcom_id"),
        "source_batch_id",
        "marriage_date",
        "parish",
        *[F.col(f"_1._{s}").alias(f"spouse1{s}") for s in ("_id", "_name", "_surname")],
        *[F.col(f"_2._{s}").alias(f"spouse2{s}") for s in ("_id", "_name", "_surname", "_maiden_name")],
    )


def build_parent_links(children: DataFrame, persons: DataFrame) -> DataFrame:
    """(id, father_id, mother_id); the first family that knows a parent sets it.

    ``children`` come from ``children_of_families``. A line asks for child, father and mother at once, so persons are read and joined once.
    """
    rows = assign_batch(children.where(F.col("xref").isNotNull()))
    asked = rows.select(
        "source_batch_id", "record_no", "line_no",
        F.inline(F.array(*[F.struct(F.lit(r).alias("_role"), F.col(c).alias("_xref")) for r, c in (("c", "child"), ("f", "husband"), ("m", "wife"))])),
    ).where(F.col("_xref").isNotNull())
    known = persons.select("source_batch_id", F.col("gedcom_id").alias("_xref"), F.col("id").alias("_id"))
    found = skew_join(asked, known, ["source_batch_id", "_xref"])
    lines = found.groupBy("source_batch_id", "record_no", "line_no").agg(
        *[F.max(F.when(F.col("_role") == r, F.col("_id"))).alias(c) for r, c in (("c", "id"), ("f", "father_id"), ("m", "mother_id"))]
    )
    order = F.struct("record_no", "line_no")
    return lines.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.min_by("father_id", F.when(F.col("father_id").isNotNull(), order)).alias("father_id"),
        F.min_by("mother_id", F.when(F.col("mother_id").isNotNull(), order)).alias("mother_id"),
    )


def link_parents(persons: DataFrame, links: DataFrame) -> DataFrame:
    return persons.join(links, "id", "left")


def unresolved_children(children: DataFrame, persons: DataFrame) -> DataFrame:
    known = persons.select("source_batch_id", F.col("gedcom_id").alias("child"))
    asked = assign_batch(children.select("file_id", "record_no", "line_no", "child"))
    return asked.join(known, ["source_batch_id", "child"], "left_anti")


def build_raw_records(individuals: DataFrame, families: DataFrame, marriages: DataFrame) -> DataFrame:
    """Raw payload rows; a family counts only when it gave a marriage."""
    person = F.struct(
        F.col("xref").alias("gedcom_id"),
        F.col("last_name_value").alias("name"),
        F.col("last_sex_value").alias("sex"),
        F.col("raw_birth").alias("birth"),
        F.col("raw_death").alias("death"),
    )
    family = F.struct(
        F.col("xref").alias("gedcom_id"), "husband", "wife", F.col("raw_marriage").alias("marriage_date")
    )
    married = marriages.select("source_batch_id", F.regexp_replace("gedcom_id", "_MARR$", "").alias("xref"))
    keep_nulls = {"ignoreNullFields": "false"}
    indi = assign_batch(individuals).select(
        F.col("source_batch_id").alias("batch_id"),
        F.lit("INDIVIDUAL").alias("record_type"),
        F.to_json(person, keep_nulls).alias("raw_payload"),
        F.col("xref").alias("external_id"),
    )
    fam = (
        assign_batch(families)
        .join(married, ["source_batch_id", "xref"], "left_semi")
        .select(
            F.col("source_batch_id").alias("batch_id"),
            F.lit("FAMILY").alias("record_type"),
            F.to_json(family, keep_nulls).alias("raw_payload"),
            F.col("xref").alias("external_id"),
        )
    )
    return indi.unionByName(fam)


def link_rows(persons: DataFrame) -> DataFrame:
    """(source_batch_id, id, parent_id): one row for each parent that a person has."""
    parents = F.filter(F.array("father_id", "mother_id"), lambda p: p.isNotNull())
    return persons.select("source_batch_id", "id", F.explode(parents).alias("parent_id"))


def import_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per batch and table; links, merged rows and errors are tables like the others."""
    parts = [
        df.groupBy(F.col("source_batch_id").alias("batch_id")).count().withColumn("part", F.lit(name))
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("batch_id").pivot("part", sorted(tables)).agg(F.sum("count")).na.fill(0)
