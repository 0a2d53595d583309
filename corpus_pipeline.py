"""The cleaning pipeline: toxicity, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and decides on all rows its predecessor kept; all
but the last return the columns of documents. Null, empty and very long texts, repeated
rows, empty tables and extra columns pass as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.llm import language, packing, simhash, toxicity
from kinloom.llm.common import cut_lineage, fold, read_text, table, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_row(docs: DataFrame) -> DataFrame:
    """Give each row the key ``_row``, a string that sorts as doc_id (nulls last) and a hash of the text do.
    Rows that share an id but not a text are so judged by themselves."""
    place = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 21, "0")
    h = F.lower(F.lpad(F.hex(F.xxhash64(F.coalesce("text", F.lit("")))), 16, "0"))
    return docs.select(*COLUMNS, F.concat(F.coalesce(place, F.lit("~")), h).alias("_row"))


def without(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """rows but for those whose key is in ``verdicts``."""
    return rows.join(verdicts.select("_row").distinct(), "_row", "left_anti")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the multiple-instance model doesn't predict toxic. It learns from the labels of the rows
    given, but for the held-out fold. Texts without a word are kept."""
    rows = with_row(docs)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit_toxicity(rows.where(fold("doc_id", toxicity.HELD_OUT) != 0), labels)
    scored = toxicity.score_toxicity(rows, model, "_row")
    return without(rows, scored.where(F.col("predicted") == 1)).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows for which a language is found: a null text and one without a letter have none. If nothing could
    be learned, all others are kept. The lang column is learned from, never read for a decision."""
    rows = with_row(docs)
    model = language.fit_languages(rows.where(fold("doc_id", language.HELD_OUT) != 0))
    if not model["names"]:
        return without(rows, language.without_letter(rows, "_row")).select(*COLUMNS)
    found = language.predict_languages(rows, model, "_row")
    return without(rows, found.where(F.col("lang_pred") == language.UNKNOWN)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: the smallest doc_id (nulls last), then the smallest
    hash of its text; of rows that repeat both, one."""
    rows = with_row(docs)
    found = simhash.near_duplicates(rows, "_row")
    first = found.where(F.col("_row") == F.col("component_id")).select("_row").distinct()
    kept = rows.join(first, "_row", "left_semi")
    return one_of_each(kept).select(*COLUMNS)


def one_of_each(rows: DataFrame) -> DataFrame:
    """One of the rows that share ``_row``. Ids are counted first, so that only ids with several rows are sorted."""
    several = rows.groupBy("_row").count().where("count > 1").select("_row")
    single = rows.join(several, "_row", "left_anti")
    order = [F.asc_nulls_last(c) for c in ("lang", "source", "n_chars")]
    repeated = rows.join(several, "_row", "left_semi")
    picked = repeated.withColumn("_n", F.row_number().over(Window.partitionBy("_row").orderBy(*order))).where("_n = 1")
    return single.unionByName(picked.drop("_n"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their sequences."""
    packed = packing.pack_documents(docs, read_text(tokenizer_file("word_bpe_49k.json")))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the trained models nor the fingerprints' hash; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
