"""The 128-number record vector and vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed layout of a stored vector.
PHONETIC_DIM, TEMPORAL_DIM, LOCATION_DIM = 64, 16, 48
DIGEST_BYTES, LOCATION_PASSES, ROTATION = 16, 5, 37
YEAR_MIN, YEAR_MAX, AGE_MAX = 1600, 2000, 120


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digest_bytes(words: Column) -> Column:
    """The sixteen MD5 bytes, as integers 0..255, of every non-blank word."""
    digests = F.transform(F.filter(words, lambda w: F.coalesce(w, F.lit("")) != ""), F.md5)
    starts = F.array(*[F.lit(2 * i + 1) for i in range(DIGEST_BYTES)])
    return F.transform(
        digests,
        lambda h: F.transform(starts, lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("int")),
    )


def _mean_rows(rows: Column, words: Column, dims: int) -> Column:
    """Element-wise sum of the rows over the number of all words; zeros without words."""
    zeros = F.array_repeat(F.lit(0.0), dims)
    total = F.aggregate(rows, zeros, lambda acc, row: F.zip_with(acc, row, lambda x, y: x + y))
    scale = 255.0 * F.greatest(F.size(words), F.lit(1))
    return F.transform(total, lambda x: x / scale)


def phonetic_vector(codes: Column) -> Column:
    """64 numbers; an MD5 digest fills the first sixteen."""
    live = _mean_rows(digest_bytes(codes), codes, DIGEST_BYTES)
    return F.concat(live, F.array_repeat(F.lit(0.0), PHONETIC_DIM - DIGEST_BYTES))


def location_vector(places: Column) -> Column:
    """48 numbers: a pass over the digest moves 16 places on, so that of the five
    rotated passes the fourth and fifth fall on the first and second."""

    def passes(row: Column) -> Column:
        def at(*steps: int) -> Column:
            return F.transform(row, lambda b: sum((b + s * ROTATION) % 256 for s in steps).cast("double"))

        per_turn = LOCATION_DIM // DIGEST_BYTES
        return F.concat(*[at(*range(turn, LOCATION_PASSES, per_turn)) for turn in range(per_turn)])

    return _mean_rows(F.transform(digest_bytes(places), passes), places, LOCATION_DIM)


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _year_part(year: Column) -> list[Column]:
    century = F.floor(year / 100) - 16
    zero = F.lit(0.0)
    return [
        F.when(year.isNotNull(), _unit((year - YEAR_MIN) / float(YEAR_MAX - YEAR_MIN))).otherwise(zero),
        F.when(year.isNotNull(), F.lit(1.0)).otherwise(zero),
        F.when(century.between(0, 3), century / 3.0).otherwise(zero),
        F.when(year.isNotNull(), F.floor((year % 100) / 10) / 9.0).otherwise(zero),
    ]


def temporal_vector(birth: Column, death: Column, age: Column) -> Column:
    """16 numbers: birth year, death year, age and life span, four each."""
    zero, one = F.lit(0.0), F.lit(1.0)
    aged = age.isNotNull()
    both = birth.isNotNull() & death.isNotNull()
    band = F.when(age < 18, zero).when(age < 60, F.lit(0.5)).otherwise(one)
    age_part = [
        F.when(aged, _unit(age / float(AGE_MAX))).otherwise(zero),
        F.when(aged, one).otherwise(zero),
        F.when(aged, band).otherwise(zero),
        F.when(aged, F.least(F.floor(age / 10), F.lit(12)) / 12.0).otherwise(zero),
    ]
    middle = F.floor((birth + death) / 2)
    span_part = [
        F.when(both, _unit((death - birth) / float(AGE_MAX))).otherwise(zero),
        F.when(both, one).otherwise(zero),
        F.when(both, _unit((middle - YEAR_MIN) / float(YEAR_MAX - YEAR_MIN))).otherwise(zero),
        F.when(both & (F.floor(death / 100) > F.floor(birth / 100)), one).otherwise(zero),
    ]
    parts = _year_part(birth) + _year_part(death) + age_part + span_part
    return F.array(*[p.cast("double") for p in parts])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def l2_normalize(a: Column) -> Column:
    """Unit length; a vector with almost no length is returned unchanged."""

    def scaled(v: Column) -> Column:
        divisor = F.when(norm(v) < 1e-10, F.lit(1.0)).otherwise(norm(v))
        return bind(divisor, lambda n: F.transform(v, lambda x: x.cast("double") / n))

    return bind(a, scaled)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def record_vector(codes: Column, birth: Column, death: Column, age: Column, places: Column) -> Column:
    parts = F.concat(phonetic_vector(codes), temporal_vector(birth, death, age), location_vector(places))
    return l2_normalize(parts).cast("array<float>")
