"""Storage keys, catalogue fields and metadata precedence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, strip
from .vectors import bind

# Page patterns in order of trial, and folders followed by a document id.
PAGE_PATTERNS = [r"(?i)page[-_](\d+)", r"(?i)\bp(\d+)\b", r"^(\d+)\."]
DOCUMENT_FOLDERS = ["documents", "books", "records", "images"]
# Object tags.
STRING_TAGS = ["document_id", "document_title", "date_range", "location", "record_type", "language", "source"]
INTEGER_TAGS = ["page_number", "total_pages"]
# File name rules of the intake.
TEMPORARY_SUFFIXES = [".tmp", ".temp", ".part", ".crdownload"]
SYSTEM_FILES = ["Thumbs.db", ".DS_Store", "desktop.ini"]
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".tiff", ".tif"]


def parse_uri(uri: Column) -> Column:
    pattern = r"^s3://([^/]+)/(.+)$"
    return F.struct(
        blank_to_null(F.regexp_extract(uri, pattern, 1)).alias("bucket"),
        blank_to_null(F.regexp_extract(uri, pattern, 2)).alias("key"),
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """Key without its extension."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def page_number(name: Column) -> Column:
    hits = [blank_to_null(F.regexp_extract(name, p, 1)) for p in PAGE_PATTERNS]
    return F.coalesce(*hits).try_cast("int")


def path_metadata(uri: Column) -> Column:
    """struct(document_id, collection_id, unit_number, page_number, filename) of an object key."""

    def ids(parts: Column, near: Column) -> Column:
        numeric = F.coalesce(near["collection"].rlike(r"^\d+$") & near["unit"].rlike(r"^\d+$"), F.lit(False))
        named = F.when(near["marker"] > 0, F.try_element_at(parts, near["marker"] + 1))
        document = F.when(numeric, F.concat_ws("-", near["collection"], near["unit"])).otherwise(
            F.coalesce(named, near["unit"])
        )
        return F.struct(
            document.alias("document_id"),
            F.when(numeric, near["collection"]).alias("collection_id"),
            F.when(numeric, near["unit"]).alias("unit_number"),
            page_number(F.element_at(parts, -1)).alias("page_number"),
            F.element_at(parts, -1).alias("filename"),
        )

    def read(parts: Column) -> Column:
        folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
        marker = F.array_position(F.transform(folders, lambda p: p.isin(DOCUMENT_FOLDERS)), F.lit(True))
        near = F.struct(
            F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(-3))).alias("collection"),
            F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).alias("unit"),
            marker.cast("int").alias("marker"),
        )
        return bind(near, lambda n: ids(parts, n))

    key = parse_uri(uri)["key"]
    return F.when(key.isNotNull(), bind(F.split(key, "/"), read))


def result_key_metadata(key: Column, prefix: str) -> Column:
    """Same for a result key: the prefix is dropped and the extension ignored."""
    inner = F.when(key.startswith(prefix), F.substr(key, F.lit(len(prefix) + 1))).otherwise(key)
    meta = path_metadata(F.concat(F.lit("s3://results/"), inner))
    bare = stem(file_name(inner))
    whole = blank_to_null(F.regexp_extract(bare, r"^(\d+)$", 1)).try_cast("int")
    return F.struct(
        F.coalesce(meta["document_id"], bare).alias("document_id"),
        meta["collection_id"].alias("collection_id"),
        meta["unit_number"].alias("unit_number"),
        F.coalesce(meta["page_number"], whole).alias("page_number"),
    )


def tag_metadata(tags: Column) -> Column:
    """Typed object tags; an unreadable integer is dropped."""
    texts = [F.try_element_at(tags, F.lit(t)).alias(t) for t in STRING_TAGS]
    numbers = [F.trim(F.try_element_at(tags, F.lit(t))).try_cast("int").alias(t) for t in INTEGER_TAGS]
    return F.struct(*texts, *numbers)


def page_of_total(c: Column) -> Column:
    """``12-20.jpg (9 z 41)`` to (77, 86); a bare integer is a page."""
    pattern = r"\((\d+)\s+z\s+(\d+)\)"
    page = F.coalesce(
        blank_to_null(F.regexp_extract(c, pattern, 1)), blank_to_null(F.regexp_extract(strip(c), r"^(\d+)$", 1))
    )
    total = blank_to_null(F.regexp_extract(c, pattern, 2))
    return F.struct(page.try_cast("int").alias("page_number"), total.try_cast("int").alias("total_pages"))


def unit_number(unit: Column) -> Column:
    return blank_to_null(F.regexp_extract(strip(unit), r"^(\d+)", 1))


def unit_document_id(unit: Column, collection: Column) -> Column:
    number = unit_number(unit)
    return F.when(number.isNotNull(), F.concat_ws("-", blank_to_null(collection), number))


CATALOGUE_SCHEMA = "place string, unit string, years string, page string, collection_id string, powiat string"


def catalogue_metadata(json: Column) -> Column:
    """Catalogue JSON to a struct; null when none of its four own fields is there."""
    row = F.from_json(json, CATALOGUE_SCHEMA)
    known = F.coalesce(row["place"], row["unit"], row["years"], row["page"]).isNotNull()
    counted = page_of_total(row["page"])
    return F.when(
        known,
        F.struct(
            blank_to_null(row["collection_id"]).alias("collection_id"),
            blank_to_null(row["powiat"]).alias("powiat"),
            row["place"].alias("place"),
            row["unit"].alias("unit"),
            row["years"].alias("years"),
            row["page"].alias("page"),
            unit_document_id(row["unit"], row["collection_id"]).alias("document_id"),
            unit_number(row["unit"]).alias("unit_number"),
            counted["page_number"].alias("page_number"),
            counted["total_pages"].alias("total_pages"),
        ),
    )


def merge_metadata(path: Column, tags: Column, catalogue: Column) -> Column:
    """Path below tags below catalogue; the composite id wins when both its parts are known."""
    collection = F.coalesce(catalogue["collection_id"], path["collection_id"])
    unit = F.coalesce(catalogue["unit_number"], path["unit_number"])
    plain = F.coalesce(catalogue["document_id"], tags["document_id"], path["document_id"])
    composite = F.concat_ws("-", collection, unit)
    both = collection.isNotNull() & unit.isNotNull()
    document = F.when(both & (catalogue.isNotNull() | (plain == unit)), composite).otherwise(plain)
    return F.struct(
        document.alias("document_id"),
        collection.alias("collection_id"),
        unit.alias("unit_number"),
        F.coalesce(catalogue["page_number"], tags["page_number"], path["page_number"]).alias("page_number"),
        F.coalesce(catalogue["total_pages"], tags["total_pages"]).alias("total_pages"),
        path["filename"].alias("filename"),
        *[tags[t].alias(t) for t in STRING_TAGS[1:]],
    )


def output_key(uri: Column, prefix: str, name: Column) -> Column:
    """Prefix + source folder + file name; prefix + file name when there is no folder."""
    folder = F.regexp_extract(uri, r"^s3://[^/]*/(.+)/[^/]*$", 1)
    return F.when(F.coalesce(folder, F.lit("")) != "", F.concat(F.lit(prefix), folder, F.lit("/"), name)).otherwise(
        F.concat(F.lit(prefix), name)
    )


def source_uri(key: Column, prefix: str, bucket: str) -> Column:
    """Image object behind a result key: no prefix, extension replaced by .jpg."""
    inner = F.when(key.startswith(prefix), F.substr(key, F.lit(len(prefix) + 1))).otherwise(key)
    return F.concat(F.lit(f"s3://{bucket}/"), stem(inner), F.lit(".jpg"))


def format_from_extension(path: Column) -> Column:
    ext = F.upper(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "JPG", "JPEG").otherwise(ext)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def is_system_file(path: Column) -> Column:
    name = file_name(path)
    return name.startswith(".") | suffix(path).isin(TEMPORARY_SUFFIXES) | name.isin(SYSTEM_FILES)


def canonical_url(href: Column, base: str) -> Column:
    """Absolute address with zoom=1.0."""
    absolute = F.when(href.startswith("http"), href).otherwise(
        F.concat(F.lit(base + "/"), F.regexp_replace(href, "^/+", ""))
    )
    return F.when(
        F.contains(absolute, F.lit("zoom=")), F.regexp_replace(absolute, "zoom=[^&]*", "zoom=1.0")
    ).otherwise(
        F.concat(absolute, F.when(F.contains(absolute, F.lit("?")), "&").otherwise("?"), F.lit("zoom=1.0"))
    )
