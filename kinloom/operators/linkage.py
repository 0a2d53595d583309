"""Record linkage: candidate pairs, scores, duplicate lists, merges and their audit.

Records that agree in every scoring column are folded into one profile first, so
many copies of a record cost one comparison. Profiles are paired inside tiles through shared
sound codes and dates (``pairing``); at thresholds above 0.79 no pair can be missed (the
argument is at ``profile_pairs``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.phonetic import phonetic_codes
from ..functions.scores import present
from ..functions.vectors import bind, cosine
from . import pairing
from .graph import connected_components
from .pairing import COMPONENTS, SCORE_DIGITS
from ..session import cut_lineage
from .windows import any_of, hot_counts, hot_keys, skew_join, top_k_per

EXACT = 1.0 - 0.0001


@dataclass(frozen=True)
class Kind:
    """Columns of a record kind that take part in scoring."""

    names: tuple[tuple[str, ...], ...]  # averaged inside a group, then over the groups
    named_by: tuple[str, ...]
    dates: tuple[str, ...]
    places: tuple[str, ...]
    gender: str | None = None
    window_days: int | None = None

    def name_columns(self) -> list[str]:
        return [c for group in self.names for c in group]


KINDS = {
    "person": Kind(
        (("first_name", "last_name", "maiden_name"),),
        ("first_name", "last_name", "maiden_name"),
        ("birth_date", "death_date"),
        ("birth_place", "death_place", "parish", "residence"),
        gender="gender",
    ),
    "baptism": Kind(
        (("child_name", "father_surname"), ("mother_name", "mother_maiden_name")),
        ("child_name", "father_surname", "mother_name"),
        ("baptism_date",),
        ("parish", "village"),
        window_days=7,
    ),
    "marriage": Kind(
        (("spouse1_name", "spouse1_surname"), ("spouse2_name", "spouse2_surname", "spouse2_maiden_name")),
        ("spouse1_name", "spouse2_name"),
        ("marriage_date",),
        ("parish", "village"),
        window_days=7,
    ),
    "death": Kind(
        (("deceased_name", "deceased_surname", "deceased_maiden_name"),),
        ("deceased_name", "deceased_surname"),
        ("death_date",),
        ("parish", "village"),
        window_days=7,
    ),
}


def codes_of(name: str) -> str:
    return f"{name}_codes"


def with_codes(df: DataFrame, kind: str) -> DataFrame:
    """Add what scoring needs and the table lacks: null columns, then sound codes."""
    k = KINDS[kind]
    texts = [*k.name_columns(), *k.places, *([k.gender] if k.gender else [])]
    typed = [(c, "string") for c in texts] + [(c, "date") for c in k.dates]
    absent = {c: F.lit(None).cast(t) for c, t in typed if c not in df.columns}
    df = df.withColumns(absent) if absent else df
    missing = [c for c in KINDS[kind].name_columns() if codes_of(c) not in df.columns]
    return df.withColumns({codes_of(c): phonetic_codes(c) for c in missing}) if missing else df


def scoring_columns(kind: str) -> list[str]:
    k = KINDS[kind]
    names = k.name_columns()
    return [*names, *map(codes_of, names), *k.dates, *k.places, *([k.gender] if k.gender else []), "embedding"]


def both_have(kind: str, a, b) -> dict[str, Column]:
    """Presence of names, dates and places on both sides; a and b map a column name."""
    k = KINDS[kind]

    def on_both(columns, known):
        return any_of([known(a(c)) for c in columns]) & any_of([known(b(c)) for c in columns])

    return {
        "names": on_both(k.named_by, present),
        "dates": on_both(k.dates, lambda c: c.isNotNull()),
        "places": on_both(k.places, present),
    }


def name_score(kind: str, a, b) -> Column:
    groups = [
        scores.name_similarity([(a(c), a(codes_of(c)), b(c), b(codes_of(c))) for c in group])
        for group in KINDS[kind].names
    ]
    return sum(groups[1:], groups[0]) / len(groups)


def date_score(kind: str, a, b) -> Column:
    return scores.mean_present(
        [(a(c).isNotNull() & b(c).isNotNull(), scores.date_similarity(a(c), b(c))) for c in KINDS[kind].dates]
    )


def place_score(kind: str, a, b) -> Column:
    return scores.mean_present(
        [(present(a(c)) & present(b(c)), scores.location_similarity(a(c), b(c))) for c in KINDS[kind].places]
    )


def _vetoed(kind: str, a, b) -> Column:
    gender = KINDS[kind].gender
    if not gender:
        return F.lit(False)
    return F.coalesce(present(a(gender)) & present(b(gender)) & (a(gender) != b(gender)), F.lit(False))


def _components(kind: str, a, b, vetoed: Column) -> list[Column]:
    """Name, date and place scores, null where a side has nothing to compare."""
    have = both_have(kind, a, b)
    return [
        F.when(have["names"] & ~vetoed, name_score(kind, a, b)).alias(COMPONENTS[1]),
        F.when(have["dates"] & ~vetoed, date_score(kind, a, b)).alias(COMPONENTS[2]),
        F.when(have["places"] & ~vetoed, place_score(kind, a, b)).alias(COMPONENTS[3]),
    ]


def composite_score(pairs: DataFrame, kind: str, mode: str = "full") -> DataFrame:
    """Score pairs whose sides are the struct columns ``a`` and ``b``.

    ``mode="vector_only"`` scores by the vectors alone. A vetoed pair scores 0.
    """
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    vetoed = _vetoed(kind, a, b)
    vector = cosine(a("embedding"), b("embedding"))
    if mode == "vector_only":
        parts = [F.lit(None).cast("double").alias(c) for c in COMPONENTS[1:]]
        score = F.col(COMPONENTS[0])
    else:
        parts = _components(kind, a, b, vetoed)
        score = scores.composite(*[F.col(c) for c in COMPONENTS])
    out = pairs.select("*", vector.alias(COMPONENTS[0]), *parts)
    return out.withColumn("composite_score", F.when(vetoed, 0.0).otherwise(score))


def can_reach(kind: str, threshold: float) -> Column:
    """Whether sides ``a`` and ``b`` could reach the threshold if their vectors agreed.

    Bound to a lambda on purpose: compiled into the join it would make one method too
    long for the JVM to optimise, which is many times slower.
    """

    def judged(sides: Column) -> Column:
        a, b = (lambda c: sides["a"][c]), (lambda c: sides["b"][c])
        names, dates, places = _components(kind, a, b, F.lit(False))
        enough = threshold - 1e-9

        def with_names(score: Column) -> Column:
            # Most pairs already fail on their names; the other parts wait for the rest.
            whole = scores.composite(F.lit(1.0), score, dates, places)
            return F.when(scores.composite(F.lit(1.0), score, F.lit(1.0), F.lit(1.0)) < enough, False).otherwise(whole >= enough)

        return F.when(_vetoed(kind, a, b), False).otherwise(bind(names, with_names))

    return bind(F.struct("a", "b"), judged)


def pairs_at_threshold(pairs: DataFrame, kind: str, threshold: float, keys: list[str]) -> DataFrame:
    """The scored pairs that reach a threshold above 0, as (keys, components, composite_score).

    Only pairs that ``can_reach`` it have their vectors compared. The scores are made
    inside one generator, so that no pushed-down filter works them out a second time.
    """
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))

    def whole(m: Column) -> Column:
        score = scores.composite(*[m[c] for c in COMPONENTS])
        return F.struct(*[m[c].alias(c) for c in COMPONENTS], score.alias("composite_score"))

    vector = cosine(a("embedding"), b("embedding")).alias(COMPONENTS[0])
    parts = F.struct(vector, *_components(kind, a, b, F.lit(False)))
    kept = F.filter(F.transform(F.array(parts), whole), lambda m: m["composite_score"] >= threshold)
    return pairs.where(can_reach(kind, threshold)).select(*keys, F.inline(kept))


def profiles_of(df: DataFrame, kind: str) -> DataFrame:
    """Records with the key of their profile."""
    packed = F.to_json(F.struct(*scoring_columns(kind)), {"ignoreNullFields": "false"})
    return df.withColumn("profile", F.unhex(F.md5(packed)))


def profile_pairs(records: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Unordered pairs of different profiles at or above the threshold, each once,
    and the pair of a profile with itself when it has copies.

    Vectors, dates and places give 0.7 at most, so above 0.79 a pair shares a code:
    - codes of two units (name parts, or the two name groups of a record), or
    - a code of the only part known on both sides, or
    - one unit among several: the name score is then 0.5 or less and the dates must
      score (threshold - 0.65) / 0.2, which at 0.85 means the same day.
    An event's dates must also lie in its window; at 0.79 and below that alone counts.
    """
    return pairing.profile_pairs(records, KINDS[kind], threshold)


def record_pairs(df: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(id, other, composite_score): every pair of records at the threshold, the smaller id first."""
    df = with_codes(df, kind)
    return pairing.record_pairs(profiles_of(df.where(F.col("embedding").isNotNull()), kind), KINDS[kind], threshold)


def _eligible(df: DataFrame, kind: str) -> DataFrame:
    from .search import has_identity

    df = df.where(F.col("embedding").isNotNull())
    return has_identity(df) if kind == "person" else df


def find_duplicates(
    df: DataFrame, kind: str, threshold: float = 0.85, limit: int = 10, candidate_mode: str = "blocked"
) -> DataFrame:
    """(id, duplicate_id, rank, components, composite_score): the best ``limit`` per record.

    Persons without enough identity are not looked up, but may be found. ``blocked``
    considers every pair; ``knn`` first cuts to the 2 x limit nearest vectors.
    """
    from .search import identity_condition

    df = with_codes(df, kind)
    if candidate_mode == "knn":
        return _nearest_then_score(df, kind, threshold, limit)
    records = profiles_of(df.where(F.col("embedding").isNotNull()), kind)
    asks = F.coalesce(identity_condition(), F.lit(False)) if kind == "person" else F.lit(True)
    return pairing.best_partners(records, KINDS[kind], threshold, limit, asks)


def _nearest_then_score(df: DataFrame, kind: str, threshold: float, limit: int) -> DataFrame:
    from .nearest import knn

    if KINDS[kind].window_days:
        raise ValueError("the nearest-vector mode is for persons; events are cut by date")
    body = F.struct(*scoring_columns(kind))
    near = knn(df, "id", "embedding", 2 * limit)
    pairs = (
        near.select("id", F.col("neighbour_id").alias("duplicate_id"))
        .join(_eligible(df, kind).select("id", body.alias("a")), "id")
        .join(df.select(F.col("id").alias("duplicate_id"), body.alias("b")), "duplicate_id")
    )
    scored = pairs_at_threshold(pairs, kind, threshold, ["id", "duplicate_id"])
    order = [F.desc(F.round("composite_score", SCORE_DIGITS)), F.asc("duplicate_id")]
    return top_k_per(scored, ["id"], order, limit).select(
        "id", "duplicate_id", "rank", *COMPONENTS, "composite_score"
    )


def partners_within_days(df: DataFrame, block: list[str], date: str, days: int, name: str = "partners") -> DataFrame:
    """Number of other records of the block dated within ``days`` of each record.

    Counts per day are spread over the 2 x days + 1 days that see them and summed, so
    no pair of records is ever formed.
    """
    per_day = df.groupBy(*block, date).count()
    seen = per_day.select(
        *block,
        F.explode(F.sequence(F.date_sub(date, days), F.date_add(date, days))).alias(date),
        "count",
    )
    totals = seen.groupBy(*block, date).agg(F.sum("count").alias("_near"))
    return skew_join(df, totals, [*block, date], hot=hot_counts(per_day, [*block, date], "count")).withColumn(name, F.col("_near") - 1).drop("_near")


# ---- candidates, merges, audit --------------------------------------------


def pair_key(first: str, second: str) -> list[Column]:
    return [F.least(first, second).alias("low_id"), F.greatest(first, second).alias("high_id")]


def save_candidates(found: DataFrame, record_type: str, existing: DataFrame | None = None) -> DataFrame:
    """Pending candidate rows, one per unordered pair, without those already stored."""
    low, high = pair_key("id", "duplicate_id")
    best = found.select(low, high, F.struct("composite_score", *COMPONENTS).alias("m"))
    rows = best.groupBy("low_id", "high_id").agg(F.max("m").alias("m"))
    if existing is not None:
        old = existing.where(F.col("record_type") == record_type).select(*pair_key("record1_id", "record2_id"))
        rows = rows.join(old, ["low_id", "high_id"], "left_anti")
    return rows.select(
        F.lit(record_type).alias("record_type"),
        F.col("low_id").alias("record1_id"),
        F.col("high_id").alias("record2_id"),
        *[F.col(f"m.{c}").alias(c) for c in [*COMPONENTS, "composite_score"]],
        F.lit("pending").alias("status"),
        F.lit("auto").alias("detection_method"),
    )


def review_queue(found: DataFrame) -> DataFrame:
    """Matches that need a person: at the threshold or above, but not exact."""
    return found.where(F.col("composite_score") < EXACT)


def merge_map(df: DataFrame, kind: str, batch: str = "source_batch_id") -> DataFrame:
    """(id, survivor_id, composite_score) for every record that an exact match replaces.

    Exact pairs are joined into components over profiles. The survivor is the record
    of the lowest batch, then the lowest id; the score is the record's best one.
    """
    df = with_codes(df, kind)
    records = profiles_of(_eligible(df, kind), kind)
    exact = cut_lineage(profile_pairs(records, kind, EXACT))
    hot = hot_keys(records, ["profile"])
    merged = connected_components(exact.select(F.col("p").alias("src"), F.col("q").alias("dst")), "src", "dst")
    merged = merged.withColumnRenamed("id", "profile")
    inside = cut_lineage(skew_join(records.select("profile", "id", batch), merged, ["profile"], hot=hot))
    best = (
        exact.select(F.explode(F.array("p", "q")).alias("profile"), "composite_score")
        .groupBy("profile")
        .agg(F.max("composite_score").alias("composite_score"))
    )
    survivors = inside.groupBy("component").agg(F.min(F.struct(batch, "id")).alias("kept"))
    mapped = skew_join(inside, survivors, ["component"], hot=hot_keys(inside, ["component"]))
    mapped = mapped.where(F.col("id") != F.col("kept.id"))
    mapped = mapped.select("profile", "id", F.col("kept.id").alias("survivor_id"))
    return skew_join(mapped, best, ["profile"], hot=hot).drop("profile")


def apply_merge(table: DataFrame, mapping: DataFrame, references: list[str]) -> DataFrame:
    """Drop merged rows of a table and point its own references at the survivors."""
    replaced = mapping.select("id", "survivor_id")
    out = table.join(replaced.select("id"), "id", "left_anti")
    for column in references:
        out = repoint(out, mapping, column)
    return out


def repoint(table: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    moved = mapping.select(F.col("id").alias(column), F.col("survivor_id").alias("_to"))
    return (
        skew_join(table, moved, [column], "left", hot_keys(table, [column]))
        .withColumn(column, F.coalesce("_to", column))
        .drop("_to")
        .select(*table.columns)
    )


def merge_audit(
    mapping: DataFrame, table: DataFrame, kind: str, candidates: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(confirmed candidates, resolutions, pending candidates left) of an automatic merge."""
    candidate_id = F.sha2(F.concat_ws("|", F.lit(kind), "id", "survivor_id"), 256)
    snapshot = F.to_json(F.struct(*[F.col(c) for c in table.columns if c != "embedding"]))
    removed = table.select("id", snapshot.alias("merged_data"))
    rows = mapping.withColumn("candidate_id", candidate_id)
    confirmed = rows.select(
        F.col("candidate_id").alias("id"),
        F.lit(kind).alias("record_type"),
        F.col("survivor_id").alias("record1_id"),
        F.col("survivor_id").alias("record2_id"),
        "composite_score",
        F.lit("confirmed").alias("status"),
        F.lit("auto_merge").alias("detection_method"),
    )
    resolutions = rows.join(removed, "id").select(
        "candidate_id",
        F.lit("merge").alias("action"),
        F.col("survivor_id").alias("kept_record_id"),
        F.col("id").alias("merged_record_id"),
        "merged_data",
    )
    left = None
    if candidates is not None:
        from .changes import purge_candidates

        left = purge_candidates(candidates, mapping.select("id", F.lit(kind).alias("record_type")))
    return confirmed, resolutions, left
