"""Register search: filters, sort orders, pages and list rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import IMAGE_SUFFIXES, suffix
from ..functions.scores import present
from .windows import all_of, any_of, sort_rank


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Every word of ``text`` must occur in some column, in any case; % and _ stay wild."""
    terms = text.split()
    if not terms:
        return df
    return df.where(all_of([any_of([F.col(c).ilike(f"%{t}%") for c in columns]) for t in terms]))


def category_filter(df: DataFrame, column: str, value: str | None) -> DataFrame:
    if not value:
        return df
    if value == "Unknown":
        return df.where(F.col(column).isNull() | (F.col(column) == "Unknown"))
    return df.where(F.col(column) == value)


def flag_filter(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Any text other than ``true`` asks for false."""
    return df if not value else df.where(F.col(column) == F.lit(value == "true"))


def status_filter(df: DataFrame, columns: list[str], text: str | None) -> DataFrame:
    return df if not text else df.where(any_of([F.col(c).ilike(f"%{text}%") for c in columns]))


def filter_candidates(
    df: DataFrame, record_type: str = "all", status: str = "all", min_score: float = 0.0
) -> DataFrame:
    if record_type != "all":
        df = df.where(F.col("record_type") == record_type)
    if status != "all":
        df = df.where(F.col("status") == status)
    return df.where(F.col("composite_score") >= min_score) if min_score > 0 else df


def identity_condition() -> Column:
    """A surname, or a date and a place together."""
    surname = present(F.col("last_name")) | present(F.col("maiden_name"))
    dated = F.col("birth_date").isNotNull() | F.col("death_date").isNotNull()
    placed = any_of([present(F.col(c)) for c in ("birth_place", "death_place", "parish", "residence")])
    return surname | (dated & placed)


def has_identity(df: DataFrame) -> DataFrame:
    return df.where(identity_condition())


def validate_files(
    df: DataFrame,
    name: str,
    size: str,
    content: str | None = None,
    min_size: int = 1024,
    max_size: int = 50 * 1024 * 1024,
    suffixes: list[str] = IMAGE_SUFFIXES,
) -> DataFrame:
    """First failed check per file: extension, size, then the leading bytes when given."""
    ext, n = suffix(F.col(name)), F.col(size)
    reason = (
        F.when(~ext.isin(suffixes), F.concat(F.lit("Unsupported extension: "), ext))
        .when(n < min_size, F.concat(F.lit("File too small: "), n.cast("string"), F.lit(" bytes")))
        .when(n > max_size, F.concat(F.lit("File too large: "), n.cast("string"), F.lit(" bytes")))
    )
    if content:
        head = F.hex(F.substring(F.col(content), 1, 12))
        # JPEG, PNG and the two TIFF byte orders.
        known = any_of([head.startswith(m) for m in ("FFD8FF", "89504E470D0A1A0A", "49492A00", "4D4D002A")])
        reason = reason.when(~known, "Unsupported MIME type")
    reason = reason.otherwise("")
    return df.withColumn("is_valid", reason == "").withColumn("reason", reason)


def parseable(files: DataFrame) -> DataFrame:
    return files.where(~F.col("processing_status").isin("processing", "completed"))


def sort_columns(columns: list[str], by: str, order: str = "asc", default: str | None = None) -> list[Column]:
    """Order of a register list: nulls last, the other name second for name sorts."""
    main = by if by in columns else (default or columns[0])
    second = {"last_name": "first_name", "first_name": "last_name"}.get(main)
    picked = [main] + ([second] if second in columns else [])
    return [F.asc_nulls_last(c) if order == "asc" else F.desc_nulls_last(c) for c in picked]


def sort_by(df: DataFrame, by: str, order: str = "asc", default: str | None = None, tie: str = "id") -> DataFrame:
    return df.orderBy(*sort_columns(df.columns, by, order, default), F.asc(tie))


def paginate(df: DataFrame, page: int, per_page: int, order: list[Column], with_totals: bool = True) -> DataFrame:
    """One page near the start, with total and pages attached.

    Spark turns offset + limit after a sort into a bounded top-n per task, so such a
    page never sorts the table. A page far in is for ``paginate_deep``.
    """
    _check_page(page, per_page)
    rows = df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    return _with_totals(rows, df.count(), per_page) if with_totals else rows


def paginate_deep(df: DataFrame, page: int, per_page: int, order: list[Column], with_totals: bool = True) -> DataFrame:
    """Any page: rows are numbered over range partitions, so no task holds what comes before the page."""
    _check_page(page, per_page)
    placed = sort_rank(df, order, "_position")
    rows = placed.where(F.col("_position").between((page - 1) * per_page + 1, page * per_page)).drop("_position")
    return _with_totals(rows, df.count(), per_page) if with_totals else rows


def _check_page(page: int, per_page: int) -> None:
    if page < 1 or per_page < 1:
        raise ValueError("page and per_page start at 1")


def _with_totals(rows: DataFrame, total: int, per_page: int) -> DataFrame:
    pages = -(-total // per_page)
    return rows.withColumns({"total": F.lit(total).cast("long"), "pages": F.lit(pages).cast("long")})


# Columns of the flat register lists.
LIST_COLUMNS = {
    "person": ["id", "first_name", "last_name", "gender", "birth_date", "death_date", "birth_place"],
    "baptism": ["id", "child_name", "baptism_date", "birth_date", "parish", "child_id"],
    "marriage": ["id", "marriage_date", "spouse1_name", "spouse1_surname", "spouse2_name", "spouse2_surname", "parish"],
    "death": ["id", "deceased_name", "deceased_surname", "death_date", "parish", "deceased_id"],
    "file": ["id", "filename", "file_size", "uploaded_at", "processing_status"],
}


def list_rows(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*[c for c in LIST_COLUMNS[kind] if c in df.columns])
