"""The frequent words of a corpus, bounded in number and length."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .pieces import LONGEST

TRACKED = 300_000  # words that a task counts at a time
PART = 1 << 24  # bytes of texts that are cut into words at a time


def lossy_counts(texts: Iterable[list[bytes]], least: int, tracked: int = TRACKED) -> Counter:
    """Counts of the words of many texts; whenever too many are tracked, the rare ones are forgotten."""
    counts: Counter = Counter()
    for words in texts:
        counts.update(words)
        while len(counts) > tracked:
            floor = min(counts.values())
            counts = Counter({w: n for w, n in counts.items() if n > floor})
    return Counter({w: n for w, n in counts.items() if n >= least and len(w) <= LONGEST})


def frequent_words(data: DataFrame, column: str, words_of: Callable[[bytes], list[bytes]], most: int, least: int = 3) -> DataFrame:
    """(word, n): at most ``most`` words of at most 64 bytes that occur often.

    All texts are read. Each task keeps a bounded summary, so the counts are lower
    bounds: good for choosing words that are worth broadcasting, not as statistics.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = lossy_counts((words_of(t) for b in batches for t in b[column]), least)
        words, counts = list(found), list(found.values())
        for at in range(0, len(words), 50_000):
            yield pd.DataFrame({"word": words[at : at + 50_000], "n": counts[at : at + 50_000]})

    counted = data.select(column).mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)  # counted once for the histogram and the words
    return at_most(counted, F.col("n"), most)


def at_most(df: DataFrame, size: Column, most: int) -> DataFrame:
    """Rows with the largest ``size``, at most ``most`` of them: whole steps of a logarithmic histogram."""
    step = F.floor(F.log2(size.cast("double")) * 16).cast("int")
    rows = df.groupBy(step.alias("step")).count().collect()  # at most 16 steps for each power of two
    total, cut = 0, None
    for r in sorted(rows, key=lambda r: -r["step"]):
        total += r["count"]
        if total > most:
            break
        cut = r["step"]
    return df.where(F.lit(False) if cut is None else step >= cut)


class Ranks:
    """Place of each word of a broadcast list, made once per worker."""

    def __init__(self, words: bytes):
        self.place = {w: i for i, w in enumerate(words.split())}

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))


def byte_parts(texts: pa.Array, most: int = PART) -> Iterator[slice]:
    """Rows of ``texts`` (binary) of at most ``most`` bytes together; a longer text is a part by itself."""
    total, start = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)), 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(total, total[start] + most, side="right")) - 1)
        yield slice(start, end)
        start = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in lower case, one binary array; their number in each text)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    words, bounds = parts.flatten().cast(pa.binary()), parts.offsets.to_numpy()
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty string
    if not real.all():
        words = words.filter(pa.array(real))
    upto = np.append(0, np.cumsum(real, dtype=np.int64))[bounds - bounds[0]]
    return words, np.diff(upto)
