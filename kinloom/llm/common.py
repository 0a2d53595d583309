"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import table  # noqa: F401  (used by the operators)
from ..session import cut_lineage  # noqa: F401

#: ASCII white space; a word is a run of anything else.
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(column: str, folds: int) -> Column:
    """crc32 of the value as text, modulo ``folds``; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; KINLOOM_TOKENIZERS names another folder."""
    folder = os.environ.get("KINLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def share(spark: SparkSession, value):
    """Broadcast of a value whose size the caller has bounded."""
    return spark.sparkContext.broadcast(value)


_KEPT: dict[str, tuple[object, object]] = {}


def kept(kind: str, key: object, make):
    """A value made once per Python worker and key; of each kind only the last one is held."""
    if kind not in _KEPT or _KEPT[kind][0] != key:
        _KEPT.pop(kind, None)
        _KEPT[kind] = (key, make())
    return _KEPT[kind][1]


def tokenizer(json_text: str):
    """The tokenizer of a vocabulary, once per worker, on one thread."""
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(json_text)
        made.no_truncation()
        made.no_padding()
        return made

    return kept("tokenizer", hash(json_text), make)


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def slices(n: int, size: int) -> Iterator[slice]:
    for start in range(0, n, size):
        yield slice(start, min(n, start + size))


def bounded_sample(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """``rows`` rows in the order given, the same ones in every run; rows is the documented bound."""
    return df.orderBy(*order).limit(rows)
