"""Fields and links of fetched catalogue pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, strip

# Labels of the catalogue's side bar.
SIDEBAR_PATTERNS = {
    "place": r"Miejscowość:\s*\n\s*([^\n]+)",
    "unit": r"Jednostka:\s*\n\s*([^\n]+)",
    "years": r"Lata:\s*\n\s*([^\n]+)",
    "page": r"Plik:\s*\n\s*([^\n]+)",
}
COLLECTION_LINK = r"^id\d+$"
UNIT_LINK = r"id\d+-sy\d+"
ANCHOR = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


def visible_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags removed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", "")


def extract_page_fields(
    pages: DataFrame, patterns: dict[str, str] = SIDEBAR_PATTERNS, html: str = "html", as_text: bool = True
) -> DataFrame:
    """One column per pattern, null where a page lacks it."""
    source = visible_text(F.col(html)) if as_text else F.col(html)
    found = pages.withColumn("_source", source)
    fields = {name: blank_to_null(strip(F.regexp_extract("_source", p, 1))) for name, p in patterns.items()}
    return found.withColumns(fields).drop("_source")


def extract_links(pages: DataFrame, pattern: str, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, position, href, name) of the anchors whose href matches."""
    hrefs = F.regexp_extract_all(html, F.lit(ANCHOR), 1)
    names = F.regexp_extract_all(html, F.lit(ANCHOR), 2)
    anchors = F.arrays_zip(hrefs.alias("href"), names.alias("name"))
    links = pages.select(*keys, F.posexplode(anchors).alias("pos", "a"))
    return links.where(F.col("a.href").rlike(pattern)).select(
        *keys,
        (F.col("pos") + 1).alias("position"),
        F.col("a.href").alias("href"),
        strip(visible_text(F.col("a.name"))).alias("name"),
    )


def extract_units(pages: DataFrame, keys: list[str], base: str, html: str = "html") -> DataFrame:
    """Unit links with the third and fifth cell of their table row."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)
    row = pages.select(*keys, F.explode(rows).alias("row"))
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1)
    units = extract_links(row.withColumn("cells", cells), UNIT_LINK, [*keys, "cells"], "row")

    def cell(n: int) -> Column:
        return F.coalesce(strip(visible_text(F.get("cells", F.lit(n)))), F.lit("Unknown"))

    url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(
        F.concat(F.lit(base + "/"), F.regexp_replace("href", "^/+", ""))
    )
    return units.select(
        *keys, url.alias("url"), F.col("name").alias("number"), cell(2).alias("description"), cell(4).alias("file_count")
    )
