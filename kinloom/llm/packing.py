"""Packing by cutting-stock column generation over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_text, share, table, text_or_empty, tokenizer_file
from .pieces import word_ids
from .registry import query
from .sharding import number_slots

CAPACITY = 4096
WIDTH = 8  # lengths are counted in classes of this many tokens
END = 2
GAP = 1e-4  # relative gap to the bound at which column generation stops
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens): texts as ids and an end id, cut every ``capacity`` ids.

    ``vocabulary`` is the JSON text of a word vocabulary. A null or empty text is the end
    id alone.
    """
    shared = share(docs.sparkSession, vocabulary)
    step = 4 * capacity

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, tail = word_ids(shared.value), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            at, rows = [], []
            for i, data in enumerate(batch["_data"]):
                ids = codec.of_text(data) + tail
                total = len(ids) // 4
                for low in range(0, len(ids), step):
                    part = ids[low : low + step]
                    at.append(i)
                    rows.append((low // 4, len(part) // 4, zlib.crc32(part), total))
            out = pd.DataFrame(rows, columns=["start", "length", "ids_crc32", "doc_tokens"])
            out.insert(0, key, batch[key].iloc[at].reset_index(drop=True))
            yield out

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_or_empty(text).cast("binary").alias("_data")).mapInPandas(run, f"`{key}` {kind}, {PIECES}")


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern of sizes that fits, by dynamic programming."""
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), "right")
    for w in range(1, room + 1):
        value[w] = value[w - 1]
        if n := fits[w]:
            gained = value[w - sizes[:n]] + prices[:n]
            best = int(gained.argmax())
            if gained[best] > value[w]:
                value[w], choice[w] = gained[best], best
    pattern, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            pattern[choice[w]] += 1
            w -= int(sizes[choice[w]])
    return float(value[room]), pattern


def _relaxed(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """(patterns by column, amounts) of the linear program's optimum, within ``gap`` of its bound."""
    m = len(sizes)
    basis = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / (room // sizes))
    amounts = inverse @ demand
    for step in range(1, 60 * m + 200):
        prices = inverse.sum(axis=0)  # each used sequence costs 1
        value, pattern = _best_pattern(sizes, np.maximum(prices, 0), room)
        # amounts.sum() / value bounds the optimum from below
        if value <= 1 + gap:
            break
        column = inverse @ pattern
        rows = np.flatnonzero(column > 1e-9)
        ratio = amounts[rows] / column[rows]
        out = rows[int(ratio.argmin())]
        basis[:, out] = pattern
        if step % 64 == 0:
            inverse = np.linalg.inv(basis)
            amounts = np.maximum(inverse @ demand, 0)
            continue
        move = max(float(ratio.min()), 0.0)
        amounts = np.maximum(amounts - move * column, 0)
        amounts[out] = move
        pivot = inverse[out] / column[out]
        inverse -= np.outer(column, pivot)
        inverse[out] = pivot
    return np.rint(basis).astype(np.int64), amounts


def plan_sequences(counts: dict[int, int], room: int, gap: float = GAP) -> tuple[np.ndarray, int]:
    """Intervals (class, first rank, first sequence, pieces per sequence) and the number of sequences.

    ``counts`` has the pieces of each length class. Whole parts of the linear program's
    amounts are taken as they are; what they leave, fewer pieces than its patterns hold,
    is placed first-fit by falling size.
    """
    sizes = np.array(sorted(c for c, n in counts.items() if n > 0), dtype=np.int64)
    if not len(sizes):
        return np.zeros((0, 4), np.int64), 0
    left = np.array([counts[int(c)] for c in sizes], dtype=np.int64)
    patterns, amounts = _relaxed(sizes, left.astype(float), room, gap)
    taken: list[tuple[np.ndarray, int]] = []
    for p, amount in zip(patterns.T, amounts):
        times = int(np.floor(amount + 1e-9))
        used = p > 0
        times = min(times, int((left[used] // p[used]).min()))
        if times > 0:
            taken.append((p, times))
            left = left - times * p
    while left.any():
        p, free = np.zeros(len(sizes), np.int64), room
        for i in range(len(sizes) - 1, -1, -1):
            p[i] = min(left[i], free // sizes[i])
            free -= int(p[i] * sizes[i])
        times = int((left[p > 0] // p[p > 0]).min())
        taken.append((p, times))
        left = left - times * p
    rank, sequence, rows = np.zeros(len(sizes), np.int64), 0, []
    for p, times in taken:
        for i in np.flatnonzero(p):
            rows.append((sizes[i], rank[i], sequence, p[i]))
            rank[i] += times * p[i]
        sequence += times
    return np.array(rows, dtype=np.int64), sequence


def pack_pieces(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, width: int = WIDTH) -> DataFrame:
    """Add sequence_id and offset to pieces of 1 to ``capacity`` tokens.

    Pieces are counted by length class (the length rounded up to ``width``): at most
    capacity / width counts reach the driver, however many pieces there are, and so the
    plan is bounded too. Pieces are ranked inside their class; the plan turns a rank
    into a sequence, and a window over each sequence (at most ``capacity`` pieces) turns
    lengths into offsets. Repeated pieces each get a place; no pieces, no sequences.
    """
    classed = pieces.withColumn("__class", F.ceil(F.col(length) / width).cast("int"))
    ranked = number_slots(classed, "__class", "__rank")
    counts = {r["__class"]: r["count"] for r in ranked.groupBy("__class").count().collect()}
    plan, _ = plan_sequences(counts, capacity // width)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    shared = share(pieces.sparkSession, plan[order])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = shared.value
        keys = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            rank = batch["__rank"].to_numpy(np.int64)
            found = np.searchsorted(keys, (batch["__class"].to_numpy(np.int64) << 48) + rank, "right") - 1
            batch["sequence_id"] = plan[found, 2] + (rank - plan[found, 1]) // plan[found, 3]
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)
    placed = ranked.mapInPandas(run, f"{fields}, sequence_id long")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("__class"), "__rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long")).drop("__class", "__rank")


def pack_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their sequences; a text over 4096 ids is cut, no other is."""
    return pack_pieces(token_pieces(docs, vocabulary, key, text))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), read_text(tokenizer_file("word_bpe_49k.json")))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
