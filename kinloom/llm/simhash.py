"""SimHash near-duplicates: bit planes stored vertically, distances counted for 64 rows at once.

Fingerprints that differ in at most ``radius`` bits agree in one of radius + 1 pieces, so
they meet in a bucket. There, 64 fingerprints form the lanes of one word per bit plane.
A row is compared with 64 others by one exclusive-or per plane; carry-save counters keep
64 distances in a few words, and a pair of row and word is given up once all its lanes
exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import cut_lineage, table, text_or_empty
from .registry import query

BITS = 64
BUCKET = 8192  # a larger bucket is split again, then tiled
PAIRS = 1 << 16  # (row, word) pairs compared at once
SEED = 42
SHINGLES = 1 << 15  # shingles whose bits are unpacked at once


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of the ``width``-word shingles, repeats included; 0 without words."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(0, len(words) - width)
    digest = xxhash.xxh64_digest
    lows, highs = starts[: last + 1].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    hashes = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(lows, highs)]), np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SHINGLES):
        bits = np.unpackbits(hashes[at : at + SHINGLES], axis=1)  # most significant bit first
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp): the 64-bit fingerprint of every whole text as a signed long; null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[key]].copy()
            out["fp"] = np.array([fingerprint(t, width) for t in batch["_data"]], dtype=np.int64)
            yield out

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_or_empty(text).cast("binary").alias("_data")).mapInPandas(run, f"`{key}` {kind}, fp long")


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets of a and b; a label is the smallest row of its set."""
    while len(a):
        left, right = labels[a], labels[b]
        apart = left != right
        a, b, left, right = a[apart], b[apart], left[apart], right[apart]
        np.minimum.at(labels, np.maximum(left, right), np.minimum(left, right))
        while not np.array_equal(up := labels[labels], labels):
            labels = up
    return labels


def near_labels(groups: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by group: the smallest row that each reaches by links inside its group."""
    n, width = len(fps), radius.bit_length()
    fps = fps.view(np.uint64)
    new = np.concatenate(([True], groups[1:] != groups[:-1]))
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    place = np.arange(n) - first[group]
    sizes = np.diff(np.append(first, n))
    words = -(-sizes // BITS)
    word_base = np.cumsum(words) - words
    word = word_base[group] + place // BITS
    bit = (place % BITS).astype(np.uint64)
    one = np.uint64(1)
    word_first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    planes = [np.bitwise_or.reduceat(((fps >> np.uint64(b)) & one) << bit, word_first) for b in range(BITS)]
    full = np.bitwise_or.reduceat(one << bit, word_first)
    todo = words[group] - place // BITS  # words from the row's own to the last of its group
    todo[(sizes[group] == 1)] = 0
    labels = np.arange(n)
    bounds = np.concatenate(([0], np.cumsum(todo)))
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PAIRS, "right")) - 1)
        count = todo[at:stop]
        rows = np.repeat(np.arange(at, stop), count)
        at = stop
        if not len(rows):
            continue
        across = word[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        later = ~np.uint64(0) << bit[rows]
        later &= ~(one << bit[rows])
        open_lanes = np.where(across == word[rows], full[across] & later, full[across])
        mine = fps[rows]
        counters = [np.zeros(len(rows), np.uint64) for _ in range(width)]
        over = ~open_lanes
        for b in range(BITS):
            carry = planes[b][across] ^ (np.uint64(0) - ((mine >> np.uint64(b)) & one))
            for c in counters:
                kept = c & carry
                c ^= carry
                carry = kept
            over |= carry
            if b % 8 == 7:
                alive = over != ~np.uint64(0)
                if not alive.all():
                    rows, across, mine, over = rows[alive], across[alive], mine[alive], over[alive]
                    counters = [c[alive] for c in counters]
                if not len(rows):
                    break
        if len(rows):
            hit, lane = np.nonzero(np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            labels = join_labels(labels, rows[hit], word_first[across[hit]] + lane)
    return labels


def _links(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def linked(keys: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
            labels = near_labels(keys, fps, radius)
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            return pd.DataFrame({"src": fps[moved], "dst": fps[labels[moved]]})

        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate((keys, batch["k"].to_numpy(np.int64)))
            fps = np.concatenate((fps, batch["fp"].to_numpy(np.int64)))
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
            if whole:
                yield linked(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield linked(keys, fps)

    return run


def _pieces(value: Column, bits: int, parts: int) -> Column:
    """Array of struct(part, bits of the part, the other bits) for each of ``parts`` equal parts."""
    size = bits // parts
    out = []
    for p in range(parts):
        low, high = p * size, (p + 1) * size
        own = F.shiftrightunsigned(value, low).bitwiseAND((1 << (high - low)) - 1)
        below = value.bitwiseAND((1 << low) - 1) if low else F.lit(0).cast("long")
        above = F.shiftleft(F.shiftrightunsigned(value, high), low) if high < 64 else F.lit(0).cast("long")
        out.append(F.struct(F.lit(p).alias("part"), own.alias("own"), above.bitwiseOR(below).alias("rest")))
    return F.array(*out)


def bucket_rows(fps: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """(k, fp): the buckets in which a fingerprint must be compared; none has over 2 * bucket rows.

    Any two fingerprints within the radius share one. A bucket of more than ``bucket``
    rows is split by the pieces of the bits left; if one is still larger, its rows are
    dealt over tiles, and each pair of tiles is a bucket.
    """
    parts = radius + 1
    first = fps.select("fp", F.explode(_pieces(F.col("fp"), BITS, parts)).alias("p")).select(
        "fp", F.xxhash64("p.part", "p.own").alias("k"), F.col("p.rest").alias("rest")
    )
    sizes = first.groupBy("k").count()
    hot = sizes.where(F.col("count") > bucket).select("k")
    cool = first.join(hot, "k", "left_anti").select("k", "fp")
    hot_rows = first.join(hot, "k", "left_semi")
    again = hot_rows.select("fp", "k", F.explode(_pieces(F.col("rest"), BITS - BITS // parts, parts)).alias("p")).select(
        "fp", F.xxhash64("k", "p.part", "p.own").alias("k")
    )
    again_sizes = again.groupBy("k").count().withColumn("c", F.ceil(F.col("count") / bucket).cast("int")).select("k", "c")
    tiled = again.join(again_sizes, "k").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    tiled = tiled.select("fp", "k", "i", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("j"))
    tiled = tiled.select(F.xxhash64("k", F.least("i", "j"), F.greatest("i", "j")).alias("k"), "fp")
    return cool.unionByName(tiled)


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, bucket: int = BUCKET
) -> DataFrame:
    """(key, fp, component_id): documents whose fingerprints reach each other by links of ``radius`` bits.

    ``component_id`` is the smallest key of the component, itself included (null if all
    its keys are null). Equal fingerprints are one vertex however many rows have it, so
    copies cost nothing. Inside a bucket only a spanning forest leaves the task: every
    link is used, none between near copies is written twice. ``radius`` is 1, 3 or 7.
    Null and empty texts have fingerprint 0 and link like any other; repeated rows are
    kept; an empty table gives an empty one; other columns are ignored.
    """
    if radius not in (1, 3, 7):
        raise ValueError("radius must be 1, 3 or 7")
    marked = cut_lineage(fingerprints(docs, key, text, width))
    vertices = marked.groupBy("fp").agg(F.min(key).alias("least"))
    rows = bucket_rows(vertices.select("fp"), radius, bucket).repartition("k").sortWithinPartitions("k", "fp")
    links = cut_lineage(rows.mapInPandas(_links(radius), "src long, dst long"))
    parts = connected_components(links, "src", "dst")
    placed = vertices.join(parts.withColumnRenamed("id", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    names = placed.select("fp", "component").join(named, "component").select("fp", "component_id")
    return marked.join(names, "fp").select(key, "fp", "component_id")


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents: three-word shingles, three bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
