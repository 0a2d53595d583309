"""Genealogical date phrases to DATE, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip
from .vectors import bind

# Words that may precede a date; one is removed.
DATE_MODIFIERS = [
    "ABOUT", "BEFORE", "AFTER", "BETWEEN", "ESTIMATED",
    "ABT", "BEF", "AFT", "BET", "CAL", "EST", "ORE", "ER", "AND",
]
MONTHS = [
    "JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE",
    "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER",
]


def _month_number(word: Column) -> Column:
    pairs = []
    for number, name in enumerate(MONTHS, start=1):
        for form in dict.fromkeys([name[:3], name]):
            pairs += [F.lit(form), F.lit(number)]
    return F.try_element_at(F.create_map(*pairs), F.upper(word))


def _last_number(c: Column, quantifier: str) -> Column:
    """Last whole word made of digits; '' when there is none."""
    return F.regexp_extract(c, r"(?s)^(?:.*\s)?([0-9]%s)(?:\s.*)?$" % quantifier, 1)


def _borrow_year(first: Column, rest: Column, quantifier: str) -> Column:
    """``first``, with the last year of ``rest`` behind it when it has none itself."""
    own = first.rlike(r"(^|\s)[0-9]%s$" % quantifier)
    return bind(
        _last_number(rest, quantifier),
        lambda year: F.when(own | (year == ""), first).otherwise(F.concat_ws(" ", first, year)),
    )


def _first_of_range(c: Column) -> Column:
    """``BET x AND y`` or ``BETWEEN x AND y`` to x; without AND the text stays."""

    def at(cut: Column) -> Column:
        first = strip(F.regexp_replace(strip(F.substr(c, F.lit(1), cut - 1)), r"(?i)^(BETWEEN|BET)", ""))
        return F.when(cut > 0, bind(first, lambda f: _borrow_year(f, F.substr(c, cut + 5), "{3,}"))).otherwise(c)

    return bind(F.instr(F.upper(c), " AND "), at)


def _first_of_clipped_range(c: Column) -> Column:
    """Same for the clipped form ``WEEN x AND y``, which wants four-digit years."""

    def at(cut: Column) -> Column:
        first = strip(F.regexp_replace(strip(F.substr(c, F.lit(1), cut - 1)), "WEEN|ween", ""))
        dated = bind(
            first,
            lambda f: F.when(f == "", f).otherwise(_borrow_year(f, F.substr(c, cut + 5), "{4}")),
        )
        return F.when(cut > 0, dated).otherwise(c)

    return bind(F.instr(F.upper(c), " AND "), at)


def _one_date(text: Column) -> Column:
    """``[[day] month] year`` to DATE."""
    pattern = r"^(?:(?:([0-9]+)\s+)?([A-Za-z]+)\s+)?([0-9]+)$"

    def checked(p: Column) -> Column:
        iso = F.format_string("%04d-%02d-%02d", p["year"], p["month"], p["day"])
        fine = p["year"].between(1, 9999) & p["day"].between(1, 31) & p["month"].isNotNull()
        return F.when(fine, iso.try_cast("date"))

    def numbers(w: Column) -> Column:
        return F.struct(
            F.when(w["day"] == "", F.lit(1)).otherwise(w["day"].try_cast("int")).alias("day"),
            F.when(w["month"] == "", F.lit(1)).otherwise(_month_number(w["month"])).alias("month"),
            w["year"].try_cast("int").alias("year"),
        )

    words = F.struct(*[F.regexp_extract(text, pattern, i).alias(n) for i, n in ((1, "day"), (2, "month"), (3, "year"))])
    return bind(words, lambda w: bind(numbers(w), checked))


def parse_gedcom_date(c: Column) -> Column:
    """DATE of a date phrase; null for BC, unknown, impossible and unreadable ones.

    Each step is bound, so the expression grows with the steps, not with their product.
    """
    modifiers = "(?i)^(%s)( |$)" % "|".join(DATE_MODIFIERS)

    def first_date(text: Column) -> Column:
        upper = F.upper(text)
        return (
            F.when(F.contains(upper, F.lit("BETWEEN")) | upper.startswith("BET "), _first_of_range(text))
            .when(upper.startswith("WEEN"), _first_of_clipped_range(text))
            .otherwise(text)
        )

    def readable(text: Column) -> Column:
        upper = F.upper(text)
        dated = ~F.contains(upper, F.lit("BC")) & ~upper.isin("UNKNOWN", "UNK", "")
        one_year = F.regexp_replace(text, "^([0-9]+)/[0-9]*$", "$1")
        single = bind(bind(one_year, first_date), lambda t: strip(F.regexp_replace(t, modifiers, "")))
        return F.when(dated, bind(single, _one_date))

    return F.when(c.isNotNull(), bind(F.regexp_replace(strip(c), r"^[()]+|[()]+$", ""), readable))
