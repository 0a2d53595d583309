"""Features and vectors of persons and event records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phonetic import phonetic_codes
from ..functions.scores import present
from ..functions.text import normalize_location, normalize_text
from ..functions.vectors import record_vector

# Fixed values per record kind: coded names, plain names, places, dates as years.
PHONETIC = {
    "person": ["first_name", "last_name", "maiden_name"],
    "baptism": ["father_name", "father_surname", "mother_name", "mother_maiden_name"],
    "marriage": ["spouse1_name", "spouse1_surname", "spouse2_name", "spouse2_surname", "spouse2_maiden_name"],
    "death": ["deceased_name", "deceased_surname", "deceased_maiden_name"],
}
NORMALIZED = {
    "person": ["first_name", "last_name", "maiden_name"],
    "baptism": ["child_name"],
    "marriage": ["spouse1_status", "spouse2_status"],
    "death": ["marital_status"],
}
PLACES = {
    "person": ["birth_place", "death_place", "parish", "residence"],
    "baptism": ["parish", "village"],
    "marriage": ["parish", "village"],
    "death": ["parish", "village", "cemetery"],
}
YEARS = {
    "person": ["birth_date", "death_date"],
    "baptism": ["baptism_date", "birth_date"],
    "marriage": ["marriage_date"],
    "death": ["death_date", "burial_date"],
}


def _column(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def feature_columns(df: DataFrame, kind: str) -> dict[str, Column]:
    """One column per feature; codes already present are used as they are."""
    out = {}
    for c in PHONETIC[kind]:
        stored = f"{c}_codes"
        codes = F.col(stored) if stored in df.columns else phonetic_codes(_column(df, c))
        out[f"phonetic_{c}"] = F.coalesce(codes, F.array().cast("array<string>"))
    for c in NORMALIZED[kind]:
        out[f"normalized_{c}"] = normalize_text(_column(df, c))
    for c in PLACES[kind]:
        out[f"place_{c}"] = normalize_location(_column(df, c))
    for c in YEARS[kind]:
        out[c.replace("_date", "_year")] = F.year(_column(df, c, "date"))
    if kind == "person":
        birth, death = out["birth_year"], out["death_year"]
        out["age"] = F.when((birth != 0) & (death != 0), death - birth)
        out["gender"] = F.when(present(_column(df, "gender")), _column(df, "gender")).otherwise("Unknown")
        out["has_father"] = _column(df, "father_id").isNotNull()
        out["has_mother"] = _column(df, "mother_id").isNotNull()
    elif kind == "baptism":
        sex = _column(df, "child_gender")
        out["child_gender"] = F.when(present(sex), sex).otherwise("Unknown")
        out["legitimate"] = F.coalesce(_column(df, "legitimate", "boolean"), F.lit(False))
        out["has_godparents"] = present(_column(df, "godfather_name")) | present(_column(df, "godmother_name"))
    elif kind == "marriage":
        out["spouse1_age"] = _column(df, "spouse1_age", "int")
        out["spouse2_age"] = _column(df, "spouse2_age", "int")
        out["has_witnesses"] = F.coalesce(F.size(_column(df, "witnesses", "array<string>")) > 0, F.lit(False))
    else:
        out["age_years"] = _column(df, "age_years", "int")
        out["has_cause_of_death"] = present(_column(df, "cause_of_death"))
        out["sacraments_received"] = F.coalesce(_column(df, "sacraments_received", "boolean"), F.lit(False))
    return out


def record_features(df: DataFrame, kind: str) -> DataFrame:
    return df.select("id", *[c.alias(n) for n, c in feature_columns(df, kind).items()])


def vector_inputs(kind: str, at=F.col) -> tuple[Column, Column, Column, Column, Column]:
    """(codes, birth, death, age, places) of a feature row; ``at`` finds a feature."""
    codes = F.concat(*[at(f"phonetic_{c}") for c in PHONETIC[kind]])
    places = F.filter(F.array(*[at(f"place_{c}") for c in PLACES[kind]]), lambda p: p != "")
    none, zero = F.lit(None).cast("int"), F.lit(0)
    if kind == "person":
        return codes, at("birth_year"), at("death_year"), at("age"), places
    if kind == "baptism":
        return codes, F.coalesce(F.nullif(at("birth_year"), zero), at("baptism_year")), none, none, places
    if kind == "marriage":
        age = F.coalesce(F.nullif(at("spouse1_age"), zero), F.nullif(at("spouse2_age"), zero))
        return codes, at("marriage_year"), none, age, places
    death, age = at("death_year"), at("age_years")
    return codes, F.when((death != 0) & (age != 0), death - age), death, age, places


def with_embedding(df: DataFrame, kind: str) -> DataFrame:
    """Add the name codes and the record vector, in one pass over the rows."""
    names = [c for c in PHONETIC[kind] if c in df.columns and f"{c}_codes" not in df.columns]
    coded = df.withColumns({f"{c}_codes": phonetic_codes(c) for c in names}) if names else df
    features = {f"_f_{n}": c for n, c in feature_columns(coded, kind).items()}
    vector = record_vector(*vector_inputs(kind, lambda n: F.col(f"_f_{n}")))
    return coded.withColumns(features).withColumn("embedding", vector).drop(*features)
