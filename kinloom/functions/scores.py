"""Component similarities of record linkage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bind

# Fixed weights of the composite score and the value of a missing component.
WEIGHTS = {"vector": 0.40, "phonetic": 0.30, "date": 0.20, "location": 0.10}
MISSING = 0.3


def present(c: Column) -> Column:
    """A text that is neither null nor empty."""
    return F.coalesce(c, F.lit("")) != ""


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all codes of two code sets (arrays without repeats), 0.0 if one is empty.

    The sets hold a few codes, so a scan of one for each code of the other beats hashing.
    """
    shared = F.size(F.filter(a, lambda code: F.array_contains(b, code)))
    ratio = bind(shared, lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), ratio).otherwise(F.lit(0.0))


def mean_present(parts: list[tuple[Column, Column]]) -> Column:
    """Mean of the values whose condition holds, 0.0 when none does.

    Plain arithmetic: no part is worked out twice and all of it is compiled.
    """
    total = sum((F.when(known, value).otherwise(0.0) for known, value in parts), F.lit(0.0))
    count = sum((known.cast("int") for known, _ in parts), F.lit(0))
    return F.when(count > 0, total / count).otherwise(0.0)


def date_similarity(a: Column, b: Column) -> Column:
    years = F.abs(F.date_diff(a, b)) / 365.25
    return (
        F.when(a.isNull() | b.isNull(), 0.0)
        .when(years == 0, 1.0)
        .when(years <= 5, 1.0 - years / 10.0)
        .when(years <= 10, 0.5 - (years - 5) / 10.0)
        .otherwise(0.0)
    )


def location_similarity(a: Column, b: Column) -> Column:
    """1.0 equal, 0.6 one inside the other, 0.3 otherwise; 0.0 when a side is empty."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    return (
        F.when(~(present(a) & present(b)), 0.0)
        .when(x == y, 1.0)
        .when(F.contains(x, y) | F.contains(y, x), 0.6)
        .otherwise(0.3)
    )


def name_similarity(parts: list[tuple[Column, Column, Column, Column]]) -> Column:
    """Mean Jaccard over (name a, codes a, name b, codes b) with a name on both sides."""
    return mean_present([(present(na) & present(nb), jaccard(ca, cb)) for na, ca, nb, cb in parts])


def composite(vector: Column, phonetic: Column, date: Column, location: Column) -> Column:
    missing = F.lit(MISSING)
    return (
        WEIGHTS["vector"] * vector
        + WEIGHTS["phonetic"] * F.coalesce(phonetic, missing)
        + WEIGHTS["date"] * F.coalesce(date, missing)
        + WEIGHTS["location"] * F.coalesce(location, missing)
    )
