"""Text columns: normalisation, transliteration, names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD_BYTES = 1000  # of a record file, in which its charset is named

# Typographic characters and their ASCII forms.
TYPOGRAPHIC_FROM = "“”‘’–—"
TYPOGRAPHIC_TO = "\"\"''--"

# Slavic letters written with one ASCII letter, lower then upper case.
SLAVIC_SINGLE = [
    # Polish
    ("ąćęłńóśźż", "acelnoszz"),
    ("ĄĆĘŁŃÓŚŹŻ", "ACELNOSZZ"),
    # Czech
    ("čřšžěůúýáéí", "crszeuuyaei"),
    ("ČŘŠŽĚŮÚÝÁÉÍ", "CRSZEUUYAEI"),
    # Slovak
    ("ľŕťďô", "lrtdo"),
    ("ĽŔŤĎÔ", "LRTDO"),
    # Russian
    ("абвгдеёзийклмнопрстуфхыэ", "abvgdeeziyklmnoprstufhye"),
    ("АБВГДЕЁЗИЙКЛМНОПРСТУФХЫЭ", "ABVGDEEZIYKLMNOPRSTUFHYE"),
]
# Letters that disappear, and letters written with several.
SLAVIC_DROPPED = "ъЪьЬ"
SLAVIC_MULTI = {
    "ж": "zh", "Ж": "Zh", "ц": "ts", "Ц": "Ts", "ч": "ch", "Ч": "Ch", "ш": "sh", "Ш": "Sh",
    "щ": "shch", "Щ": "Shch", "ю": "yu", "Ю": "Yu", "я": "ya", "Я": "Ya",
}
# Leading words removed from a place name, in this order.
PLACE_PREFIXES = ["parish of", "village of", "town of", "city of"]


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def fold_typographic(c: Column) -> Column:
    return F.translate(c, TYPOGRAPHIC_FROM, TYPOGRAPHIC_TO)


def normalize_record_text(c: Column) -> Column:
    """Record-file text: ASCII punctuation and no blank lines."""
    lines = F.filter(F.split(fold_typographic(c), "\r\n|\n|\r"), lambda line: strip(line) != "")
    return F.array_join(lines, "\n")


def fold_slavic(c: Column) -> Column:
    source = "".join(a for a, _ in SLAVIC_SINGLE) + SLAVIC_DROPPED
    target = "".join(b for _, b in SLAVIC_SINGLE)
    out = F.translate(F.coalesce(c, F.lit("")), source, target)
    for letter, spelled in SLAVIC_MULTI.items():
        out = F.replace(out, F.lit(letter), F.lit(spelled))
    return out


def normalize_text(c: Column, fold_diacritics: bool = False) -> Column:
    """Lower case, letters a-z, digits and single blanks; null becomes ''.

    Other letters are dropped, as stored vectors expect. ``fold_diacritics`` keeps
    Slavic letters in their ASCII form instead.
    """
    if fold_diacritics:
        c = fold_slavic(c)
    kept = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def normalize_location(c: Column, fold_diacritics: bool = False) -> Column:
    out = normalize_text(c, fold_diacritics)
    for prefix in PLACE_PREFIXES:
        out = F.regexp_replace(out, f"^{prefix} *", "")
    return out


def split_name(c: Column) -> Column:
    """``Given /Surname/`` to struct(first_name, last_name); empty parts are null."""
    slashed = F.split(c, "/", -1)
    bare = strip(c)
    first = F.when(F.contains(c, F.lit("/")), strip(slashed[0])).otherwise(F.regexp_extract(bare, r"^(\S+)", 1))
    last = F.when(F.contains(c, F.lit("/")), strip(F.get(slashed, F.lit(1)))).otherwise(
        F.regexp_replace(bare, r"^\S+\s*", "")
    )
    return F.struct(blank_to_null(first).alias("first_name"), blank_to_null(last).alias("last_name"))


def display_name(first: Column, last: Column) -> Column:
    full = strip(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))
    return F.coalesce(blank_to_null(full), F.lit("Unknown"))


def date_with_flag(date: Column, estimated: Column) -> Column:
    return F.when(
        date.isNotNull(),
        F.struct(date.cast("string").alias("date"), F.coalesce(estimated, F.lit(False)).alias("estimated")),
    )


def title_words(c: Column) -> Column:
    """``parish_register`` to ``Parish Register``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def birth_year_or_max(iso_date: Column, missing: int = 9999) -> Column:
    """Year of an ISO date string; a missing or unreadable one sorts last."""
    year = F.regexp_extract(iso_date, r"^\s*(\d+)", 1).try_cast("int")
    return F.coalesce(year, F.lit(missing))


def gender_rank(c: Column) -> Column:
    folded = F.lower(c)
    return F.when(folded.isin("m", "male"), 0).when(folded.isin("f", "female"), 1).otherwise(2)


def detect_charset(head: Column) -> Column:
    """Charset named in the first HEAD_BYTES of a record file (a binary column)."""
    head = F.substring(head, 1, HEAD_BYTES)
    latin = F.decode(head, "ISO-8859-1")
    utf8 = F.is_valid_utf8(head.cast("string")) & (
        F.contains(latin, F.lit("1 CHAR UTF-8")) | F.contains(latin, F.lit("1 CHAR UTF8"))
    )
    return (
        F.when(utf8, "utf-8")
        .when(F.contains(latin, F.lit("1 CHAR ANSEL")), "ansel")
        .when(F.contains(latin, F.lit("1 CHAR ASCII")), "ascii")
        .otherwise("latin-1")
    )


def extract_record_text(c: Column) -> Column:
    """Record text out of a fenced or mixed reply; null when it has no header."""
    fenced = F.regexp_extract(c, r"(?is)```(?:gedcom)?\s*\n(.*?)\n```", 1)
    has_fence = c.rlike(r"(?is)```(?:gedcom)?\s*\n.*?\n```")
    start = F.instr(c, "0 HEAD")
    return F.when(has_fence, strip(fenced)).when(start > 0, strip(F.substr(c, start)))
