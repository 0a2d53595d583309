"""Benchmark passages in training texts, found by an FM-index of each shard of them.

A task gathers texts into shards of about SHARD words and indexes the words of each shard.
Words that no benchmark item has are all alike to the search, so a run of them is indexed
as one separator. Every window of the benchmark is searched backwards through wavelet-tree
ranks, its occurrences are located by sampled suffix positions, and the words they cover
are merged to spans. The benchmark comes in blocks of bounded size, one pass over the rows
for each; a pass is a narrow step, so a lost executor costs its own rows again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, share, table
from .fmindex import FMIndex
from .registry import query

WIDTH = 10  # words of a window
SHARD = 1 << 20  # words indexed together; a longer text is indexed in parts that overlap by a window
PIECE = 50_000  # words of an item that travel together
BLOCK = 4_000_000  # bytes of benchmark text in a block, about

LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Digits, letters and bytes over 0x7F stay, A-Z become small, all others separate words.
WORD_BYTES = bytes(b if b in LETTERS else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def benchmark_pieces(benchmark: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(item, words): items in lower case, their words joined by blanks, long ones cut so that every window is in a piece."""
    step = PIECE - width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, pieces = [], []
            for item, body in zip(batch["item"].to_pylist(), batch["words"].to_pylist()):
                words = words_of(body)
                for at in range(0, max(1, len(words) - width + 1) if words else 0, step):
                    items.append(item)
                    pieces.append(b" ".join(words[at : at + PIECE]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(pieces, pa.binary())], ["item", "words"])

    given = benchmark.select(F.col(key).cast("string").alias("item"), F.col(text).cast("binary").alias("words"))
    return given.mapInArrow(run, "item string, words binary")


class Windows:
    """The windows of a block of the benchmark: distinct rows of word numbers, by length, and the items that have each one."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], width: int):
        self.items = sorted({i for i, _ in pieces if i is not None})
        number = {i: n for n, i in enumerate(self.items)} | {None: -1}
        words = sorted({w for _, p in pieces for w in p.split()})
        self.words = {w: n for n, w in enumerate(words, 1)}
        found: dict[int, tuple[list, list]] = {}
        for item, piece in pieces:
            ids = np.array([self.words[w] for w in piece.split()], dtype=np.int32)
            made = np.lib.stride_tricks.sliding_window_view(ids, min(width, len(ids)))
            rows, owners = found.setdefault(made.shape[1], ([], []))
            rows.append(made)
            owners.append(np.full(len(made), number[item], dtype=np.int64))
        self.phrases, self.owners = [], []
        for rows, owners in found.values():
            phrases, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)]), axis=1)
            pairs = pairs[:, pairs[1] >= 0]
            starts = np.searchsorted(pairs[0], np.arange(len(phrases) + 1))
            self.phrases.append(phrases)
            self.owners.append((starts, pairs[1]))

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, which window, where) of all windows in the word numbers ``ids``; 0 is a word of no item."""
        longest = max(p.shape[1] for p in self.phrases)
        for start in range(0, len(ids), SHARD):
            part = ids[start : start + SHARD + longest - 1]
            known = part > 0
            known[1:] |= known[:-1]  # the first of a run of other words separates
            at = np.flatnonzero(known)
            if not len(at):
                continue
            index = FMIndex(part[at], len(self.words) + 1)
            for kind, phrases in enumerate(self.phrases):
                low, high = index.search(phrases)
                counts = high - low
                which = np.repeat(np.arange(len(phrases)), counts)
                rows = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
                if len(rows):
                    yield kind, which, at[index.locate(rows)] + start

    def mark(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hit, pairs) of a shard whose texts end before ``ends``: which words are hit, and the distinct (text, item)."""
        edges, pairs = np.zeros(len(ids) + 1, dtype=np.int64), [np.zeros((2, 0), dtype=np.int64)]
        for kind, which, where in self.occurrences(ids):
            np.add.at(edges, where, 1)
            np.add.at(edges, where + self.phrases[kind].shape[1], -1)
            texts = np.searchsorted(ends, where, side="right")
            once = np.unique(np.stack([texts, which]), axis=1)
            starts, items = self.owners[kind]
            counts = starts[once[1] + 1] - starts[once[1]]
            of = np.repeat(np.arange(once.shape[1]), counts)
            item = items[np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[once[1]][of]]
            pairs.append(np.unique(np.stack([once[0][of], item]), axis=1))
        return np.cumsum(edges[:-1]) > 0, np.unique(np.concatenate(pairs, axis=1), axis=1)


def cut_words(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of ``spans`` and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in WORD.finditer(text)]
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : places[span["start"]][0]])
        at = places[span["end"] - 1][1]
    return b"".join([*kept, text[at:]])


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, keys: list[str] | None = None, text: str = "text", item: str = "item_id", width: int = WIDTH, cleaned: bool = False
) -> DataFrame:
    """(keys, n_words, spans, items), and ``cleaned``: the benchmark windows in every text.

    A window is ``width`` consecutive words of an item's text, or all words of an item that
    has fewer. ``spans`` are the merged (start, end) word numbers that windows cover, ``items``
    the ids (as text, sorted) of the items with a window in the text, ``cleaned`` the text
    without the spans. Every row of docs gives one row, repeated ones too. Null and empty
    texts have no words; an item without words or a null one has no window; rows that share
    an item's id are one item, and one with a null id marks words but isn't listed. Very long
    texts and items are cut into overlapping parts inside. Other columns are ignored, so clashing
    names don't matter. Either table empty: no rows, or rows without hits.
    """
    keys, spark = keys or ["doc_id"], docs.sparkSession
    pieces = cut_lineage(benchmark_pieces(benchmark, item, text, width))
    total = pieces.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = -(-total // BLOCK)
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(max(1, blocks))))
    rows = docs.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(text).cast("binary").alias("_text"),
        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    for block in range(max(1, blocks)):
        held = [(r["item"], bytes(r["words"])) for r in pieces.where(F.col("block") == block).select("item", "words").collect()]
        windows = share(spark, Windows(held, width) if held else None)  # a block is bounded, and so are its windows
        rows = rows.mapInArrow(_pass(windows, cleaned and block + 1 >= blocks), kinds)
    columns = ["n_words", "spans", "items"] + ([F.col("_text").cast("string").alias("cleaned")] if cleaned else [])
    return rows.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *columns)


def _pass(shared, cut: bool):
    """Search of one block in all rows; what earlier passes found is kept. ``cut``: leave out the spans of the text."""

    def searched(pending: list[pa.RecordBatch], numbers: list[np.ndarray], counts: list[int]) -> pa.RecordBatch:
        given = pa.Table.from_batches(pending).combine_chunks()
        ends = np.cumsum(np.array(counts, dtype=np.int64) + 1)  # a 0 follows each text
        ids = np.concatenate(numbers)
        hit, pairs = shared.value.mark(ids, ends) if shared.value else (np.zeros(len(ids), bool), np.zeros((2, 0), np.int64))
        before, earlier = given["spans"].to_pylist(), given["items"].to_pylist()
        for i, spans in enumerate(before):
            for s in spans:
                hit[ends[i] - counts[i] - 1 + s["start"] : ends[i] - counts[i] - 1 + s["end"]] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
        starts, stops = edges[::2], edges[1::2]
        of = np.searchsorted(ends, starts, side="right")
        first = (ends - counts - 1)[of]
        offsets = np.searchsorted(of, np.arange(len(counts) + 1)).astype(np.int32)
        spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(starts - first), pa.array(stops - first)], fields=list(SPAN)))
        names = shared.value.items if shared.value else []
        for i, n in pairs.T:
            earlier[i].append(names[n])
        items = pa.array([sorted(set(e), key=str.encode) if e else e for e in earlier], pa.list_(pa.string()))
        columns = {c: given[c].combine_chunks() for c in given.column_names}
        columns |= {"n_words": pa.array(counts, pa.int64()), "spans": spans, "items": items}
        if cut:
            texts = [None if t is None else cut_words(t, s) for t, s in zip(given["_text"].to_pylist(), spans.to_pylist())]
            columns["_text"] = pa.array(texts, pa.binary())
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.words.get if shared.value else {}.get
        pending, numbers, counts, held = [], [], [], 0
        for batch in batches:
            start, texts = 0, batch["_text"]
            for i in range(len(batch)):
                words = words_of(texts[i].as_py())
                ids = np.zeros(len(words) + 1, dtype=np.int32)
                ids[:-1] = np.fromiter(map(number, words, repeat(0)), np.int32, len(words))
                numbers.append(ids)
                counts.append(len(words))
                held += len(ids)
                if held >= SHARD:
                    yield searched([*pending, batch.slice(start, i + 1 - start)], numbers, counts)
                    pending, numbers, counts, held, start = [], [], [], 0, i + 1
            if start < len(batch):
                pending.append(batch.slice(start))
        if counts:
            yield searched(pending, numbers, counts)

    return run


OP12_SQL = r"""
WITH cut AS (
    SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS n,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
    UNION ALL
    SELECT 'b', item_id, row_number() OVER (),
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
    FROM benchmark
), windows AS (
    SELECT DISTINCT id AS item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
    FROM (SELECT id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM cut WHERE side = 'b' AND len(w) > 0)
), places AS (
    SELECT n, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
    FROM (
        SELECT n, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i
        FROM cut, (SELECT DISTINCT size FROM windows) WHERE side = 'd' AND len(w) >= size
    )
), hits AS (
    SELECT n, i, size, item FROM places JOIN windows USING (size, phrase)
), words AS (
    SELECT n, count(DISTINCT place) AS n_hit FROM (SELECT n, unnest(generate_series(i, i + size - 1)) AS place FROM hits) GROUP BY n
), items AS (
    SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT n, item::VARCHAR AS item FROM hits WHERE item IS NOT NULL) GROUP BY n
)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM cut LEFT JOIN words USING (n) LEFT JOIN items USING (n) WHERE side = 'd'
"""


@query("op12_decontaminate", OP12_SQL)
def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that a window of the benchmark covers, and the items found."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
