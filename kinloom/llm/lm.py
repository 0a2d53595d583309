"""Scoring of whole texts by a causal self-attention model on subword ids.

A word is spelled in subword pieces (byte-level, a space before it). The attention model
reads the sequence of leading pieces and predicts the next one; the rest of a word given
its leading piece comes from counts of all training words, backed off to a chain of
pieces, so every text has a proper probability. Frequent words (bounded in number) are
broadcast with their statistics; those of all other words come by a join.

The attention model learns from every word of all training texts: texts are cut into words
and coded once, then dealt to shards, each trained by a task on from the common parameters,
and the parameters of a round are averaged, each slot by its occurrences.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention
from .common import cut_lineage, fold, kept, read_text, share, slices, table, text_or_empty, tokenizer, tokenizer_file
from .pieces import LONGEST
from .registry import query
from .words import at_most, byte_parts, split_words

HEAD = 1 << 19  # words that are broadcast
STEPS, BATCH, RATE = 750, 128, 0.1  # blocks of a step; a small corpus is read again until so many steps are made
SHARD_BLOCKS = 1 << 16  # blocks that a task trains on before its parameters are averaged with others'
HELD_BLOCKS = 1 << 13  # blocks that are held to be taken in a random order
ROUNDS = (1, 3, 7, 16)  # ends of the rounds, in 16ths of the training rows: each row is in one
PART, LOT = 128, 64  # ids, or slots, of a part of an average; tasks whose parts meet first
JOINED = 1024  # words that are spelled as one text
PIECES = 50_257  # ids of the subword vocabulary; the last isn't a piece and stands for the end
BEFORE, AFTER = 1024, 512  # most frequent pieces whose pairs are counted
LN10 = float(np.log(10.0))


def spell(json_text: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of all words, number of each word's), a space before each word; control strings in it are ordinary text.

    Many words are spelled as one text, in which a piece that begins with the space begins a word. Words with other
    white space in them are spelled one by one.
    """
    encoder = tokenizer(json_text)
    encoder.encode_special_tokens = True
    starts = kept("starts", hash(json_text), lambda: _spaced(encoder.get_vocab()))
    flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    texts = [w.decode() for w in words]
    chunks = [texts[part] for part in slices(len(texts), JOINED)]
    coded = encoder.encode_batch_fast([" " + " ".join(c) for c in chunks], add_special_tokens=False)
    for chunk, code in zip(chunks, coded):
        ids = np.array(code.ids, dtype=np.int32)
        at = np.flatnonzero(starts[ids])
        if len(at) != len(chunk) or " ".join(chunk).split() != chunk:
            alone = [c.ids for c in encoder.encode_batch_fast([" " + w for w in chunk], add_special_tokens=False)]
            ids = np.array([i for one in alone for i in one], dtype=np.int32)
            sizes.append(np.array([len(one) for one in alone], dtype=np.int64))
        else:
            sizes.append(np.diff(np.append(at, len(ids))))
        flat.append(ids)
    return np.concatenate(flat), np.concatenate(sizes)


def _spaced(vocabulary: dict[str, int]) -> np.ndarray:
    """Whether each piece begins with a space."""
    out = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    out[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True
    return out


def word_counts(data: DataFrame) -> DataFrame:
    """(word, n): training occurrences of every word of all texts, 0 for words that only other texts have.

    ``data`` has _data (binary) and _train. A task counts a bounded number of bytes of
    texts, or one text, before it passes the counts on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = batch.column("_train").to_numpy(zero_copy_only=False)
            for part in byte_parts(batch.column("_data")):
                words, lengths = split_words(batch.column("_data")[part])
                found = words.dictionary_encode()
                times = np.bincount(found.indices.to_numpy(), np.repeat(train[part], lengths), len(found.dictionary))
                counted = pa.record_batch([found.dictionary, pa.array(times.astype(np.int64))], names=["word", "n"])
                for some in slices(len(counted), 50_000):
                    yield counted[some]

    passed = data.select("_data", "_train").mapInArrow(run, "word binary, n long")
    return passed.repartition("word").groupBy("word").agg(F.sum("n").alias("n"))  # few words meet before the shuffle


def spelled(counts: DataFrame, vocabulary) -> DataFrame:
    """Add first (leading piece) and rest (the others) to every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, sizes = spell(vocabulary.value, batch.column("word").to_pylist())
            stops = np.cumsum(sizes)
            later = np.ones(len(pieces), bool)
            later[stops - sizes] = False
            bounds = np.append(0, stops - np.arange(1, len(sizes) + 1)).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(bounds), pa.array(pieces[later]))
            yield pa.record_batch([batch.column("word"), batch.column("n"), pa.array(pieces[~later]), rest], names=["word", "n", "first", "rest"])

    return counts.mapInArrow(run, "word binary, n long, first int, rest array<int>")


def corpus_statistics(words: DataFrame, train_docs: int) -> dict:
    """Totals, counts by leading piece, and the chain of pieces that spells new words.

    The chain is learned from the distinct training words: a piece's share of all later
    pieces, mixed with counts of what follows the piece before it. Pairs are counted
    for the BEFORE and AFTER most frequent pieces only, so at most PIECES values and
    BEFORE * AFTER pairs come to the driver.
    """
    by_first = words.groupBy("first").agg(F.sum("n").alias("c"), F.sum((F.col("n") > 0).cast("long")).alias("t")).collect()
    count, types = np.zeros(PIECES), np.zeros(PIECES)
    for r in by_first:
        count[r["first"]], types[r["first"]] = r["c"], r["t"]
    whole = F.arrays_zip(
        F.concat(F.array("first"), "rest").alias("before"), F.concat("rest", F.array(F.lit(PIECES - 1))).alias("piece")
    )
    steps = cut_lineage(words.where("n > 0").select(F.inline(whole)).groupBy("before", "piece").count())
    singles = {c: np.zeros(PIECES) for c in ("before", "piece")}
    for c, total in singles.items():
        for r in steps.groupBy(c).agg(F.sum("count").alias("count")).collect():
            total[r[c]] = r["count"]
    places, common = {}, {}
    for c, most in (("before", BEFORE), ("piece", AFTER)):
        ranked = np.argsort(-singles[c], kind="stable")[:most]
        common[c] = ranked[singles[c][ranked] > 0]
        places[c] = np.full(PIECES, most)  # the last place is for all others
        places[c][common[c]] = np.arange(len(common[c]))
    pairs = np.zeros((BEFORE + 1, AFTER + 1))
    if len(common["piece"]):
        inside = [F.col(c).isin(common[c].tolist()) for c in ("before", "piece")]
        found = steps.where(inside[0] & inside[1]).toPandas()
        pairs[places["before"][found["before"]], places["piece"][found["piece"]]] = found["count"]
    later = singles["piece"] + 0.5
    return {
        "tokens": int(count.sum()) + train_docs, "distinct": int(types.sum()) + (train_docs > 0), "docs": train_docs,
        "count": count, "types": types, "later": later / later.sum(), "places": places, "pairs": pairs,
    }


def chain_log10(statistics: dict, first: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of the later pieces and the end of each word, given its leading piece. ``flat``: later pieces of
    all words, ``sizes``: their number and one."""
    stop = np.cumsum(sizes)
    after, before = np.full(int(sizes.sum()), PIECES - 1), np.zeros(int(sizes.sum()), np.int64)
    inner = np.ones(len(after), bool)
    inner[stop - 1] = False
    after[inner] = flat
    inner[:] = True
    inner[stop - sizes] = False
    before[inner], before[stop - sizes] = flat, first
    row, column = statistics["places"]["before"][before], statistics["places"]["piece"][after]
    pairs = statistics["pairs"]
    followers = np.maximum((pairs > 0).sum(axis=1), 1)
    chance = (pairs[row, column] + followers[row] * statistics["later"][after]) / (pairs.sum(axis=1) + followers)[row]
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), np.log10(chance), len(sizes))


def with_scores(words: DataFrame, statistics) -> DataFrame:
    """(word, n, first, base, inner): log10 probabilities of the base model and of the rest given the first piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = statistics.value
        for batch in batches:
            n, first, rest = batch.column("n").to_numpy().astype(float), batch.column("first").to_numpy().astype(np.int64), batch.column("rest")
            chain = chain_log10(s, first, rest.flatten().to_numpy(), np.diff(rest.offsets.to_numpy()).astype(np.int64) + 1)
            c, t = s["count"][first], s["types"][first]
            known = c + t > 0
            mixed = np.log10(np.where(known, n + t * 10.0**chain, 1) / np.where(known, c + t, 1))
            base = np.log10((n + 1) / (s["tokens"] + s["distinct"] + 1))
            inner = np.where(known, mixed, chain)
            made = [batch.column("word"), batch.column("n"), batch.column("first"), pa.array(base), pa.array(inner)]
            yield pa.record_batch(made, names=["word", "n", "first", "base", "inner"])

    return words.mapInArrow(run, "word binary, n long, first int, base double, inner double")


SUMS = "part int, lot int, at binary, weight binary, mean binary"


def averaged(parts: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, weights, weighted means) of each part over all tasks; ``parts`` has the columns SUMS, made by ``_parts``.
    A bounded number of arrays meet in a task, and an array holds only rows that were seen."""

    def add(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        found = [_unpacked(*row) for row in zip(pdf["at"], pdf["weight"], pdf["mean"])]
        rows = np.unique(np.concatenate([at for at, _, _ in found]))
        weights, total = np.zeros(len(rows)), np.zeros((len(rows), found[0][2].shape[1]))
        for at, weight, mean in found:
            place = np.searchsorted(rows, at)
            weights[place] += weight
            total[place] += mean * weight[:, None]
        return _packed(key[0], key[1] // LOT if len(key) > 1 else 0, rows, weights, total / weights[:, None])

    lots = parts.groupBy("part", "lot").applyInPandas(add, SUMS).groupBy("part").applyInPandas(add, SUMS)
    return {r["part"]: _unpacked(r["at"], r["weight"], r["mean"]) for r in lots.collect()}


def _packed(part: int, lot: int, at: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> pd.DataFrame:
    binary = {"at": at.astype(np.int32), "weight": weight.astype(np.float64), "mean": mean.astype(np.float32)}
    return pd.DataFrame({"part": [part], "lot": [lot], **{c: [v.tobytes()] for c, v in binary.items()}})


def _unpacked(at: bytes, weight: bytes, mean: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(at, np.int32)
    return rows, np.frombuffer(weight), np.frombuffer(mean, np.float32).reshape(len(rows), -1)


def _parts(weight: np.ndarray, means: np.ndarray) -> Iterator[pd.DataFrame]:
    """The rows of positive weight as parts of a task's average."""
    lot = TaskContext.get().partitionId() // LOT
    for i, part in enumerate(slices(len(weight), PART)):
        there = part.start + np.flatnonzero(weight[part])
        if len(there):
            yield _packed(i, lot, there, weight[there], means[there])


def _whole(weight: float, mean: np.ndarray) -> pd.DataFrame:
    """The part -1: one row of another width."""
    return _packed(-1, TaskContext.get().partitionId() // LOT, np.zeros(1), np.array([weight]), mean)


def _rows(found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, weights, means) of all parts but -1."""
    parts = [v for i, v in found.items() if i >= 0]
    return tuple(np.concatenate([p[c] for p in parts]) for c in range(3))


def coded_ids(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Leading pieces of the words of some texts, and the number of words of each."""
    return np.frombuffer(b"".join(batch["ids"]), np.uint16).astype(np.int32), batch["n"].to_numpy(np.int64)


def piece_classes(coded: DataFrame, counts: np.ndarray) -> np.ndarray:
    """Classes of the leading pieces, by the training texts that they occur in."""
    common = attention.most_common(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, moments, times = np.zeros((PIECES, len(common))), np.zeros(2 * len(common) + 1), np.zeros(PIECES)
        for batch in batches:
            for part in slices(len(batch), 256):
                ids, lengths = coded_ids(batch.iloc[part])
                attention.add_contexts(sums, moments, ids, lengths, common)
                times += np.bincount(ids, minlength=PIECES)
        if moments[0]:
            yield from _parts(times, sums / np.maximum(times, 1)[:, None])
            yield _whole(moments[0], moments / moments[0])

    found = averaged(coded.where("_train").select("n", "ids").mapInPandas(run, SUMS))
    sums, moments = np.zeros((PIECES, len(common))), np.zeros(2 * len(common) + 1)
    if -1 in found:
        moments = found[-1][2][0] * found[-1][1][0]
    if len(found) > 1:
        rows, weights, means = _rows(found)
        sums[rows] = means * weights[:, None]
    return attention.classes_of(counts, sums, moments)


def train_attention(coded: DataFrame, model: dict) -> dict:
    """The model after all training rows, each read in one round by one shard; a small corpus is read several times.

    Rows go to rounds and shards by their hash, in the order of their hash, so the shards don't depend on
    how the rows are stored.
    """
    spark = coded.sparkSession
    rows = coded.where("_train")
    blocks = rows.agg(F.sum(F.ceil((F.col("n") + 1) / attention.STRIDE))).first()[0] or 0
    if not blocks:
        return model
    passes = -(-STEPS * BATCH // blocks)
    ends = ROUNDS if blocks > 4 * SHARD_BLOCKS else (ROUNDS[-1],)
    place = F.pmod(F.xxhash64("_k", F.lit("round")), F.lit(ROUNDS[-1]))
    for start, end in zip((0, *ends[:-1]), ends):
        shards = max(1, round(blocks * (end - start) / ROUNDS[-1] / SHARD_BLOCKS))
        mine = rows.where((place >= start) & (place < end)).select("_k", "_m", "n", "ids")
        dealt = mine.repartition(shards, "_k").sortWithinPartitions("_k", "_m").select("n", "ids")
        expected = blocks * (end - start) / ROUNDS[-1] / shards
        model = _taken(model, averaged(dealt.mapInPandas(_shard(share(spark, model), passes, expected, start, end), SUMS)))
    return model


def _shard(shared, passes: int, expected: float, start: int, end: int):
    """Training of a task from the shared parameters; gives them and the steps' past, weighed by what was seen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = shared.value
        net, rates = given["net"].copy(), {n: v.copy() for n, v in given["rates"].items()}
        model, rng = {**given, "net": net, "rates": rates}, np.random.default_rng(1)
        seen, done, held, size = np.zeros(attention.INPUTS + 2), 0, [], 0

        def rate(share_done: float) -> float:
            at = min((done + share_done * size) / expected, 1.0)
            return RATE * (1 - 0.9 * (start + at * (end - start)) / ROUNDS[-1])

        def train() -> None:
            blocks = tuple(np.concatenate(x) for x in zip(*held))
            attention.learn(model, blocks, passes, rate, rng, BATCH)
            np.add(seen, np.bincount(blocks[0].reshape(-1), minlength=len(seen)), out=seen)
            held.clear()

        for batch in batches:
            for part in slices(len(batch), 64):
                held.append(attention.cells(model, *coded_ids(batch.iloc[part])))
                size += len(held[-1][0])
                if size >= HELD_BLOCKS:
                    train()
                    done, size = done + size, 0
        if held:
            train()
        if not seen.any():
            return
        yield from _parts(seen, np.concatenate([x for n in attention.TABLES for x in (getattr(net, n), rates[n])], axis=1))
        yield _whole(seen.sum(), np.concatenate([x.reshape(-1) for n in attention.DENSE for x in (getattr(net, n), rates[n])]))

    return run


def _taken(model: dict, found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> dict:
    """The model with the mean of the shards' parameters; a slot that no shard saw keeps its own."""
    if not found:
        return model
    net, rates = model["net"].copy(), {n: v.copy() for n, v in model["rates"].items()}
    (rows, _, means), at = _rows(found), 0
    for name in attention.TABLES:
        for table in (getattr(net, name), rates[name]):
            table[rows] = means[:, at : at + table.shape[1]]
            at += table.shape[1]
    means, at = found[-1][2][0], 0
    for name in attention.DENSE:
        for table in (getattr(net, name), rates[name]):
            table[...] = means[at : at + table.size].reshape(table.shape)
            at += table.size
    return {**model, "net": net, "rates": rates}


def class_shares(model: dict, statistics: dict) -> np.ndarray:
    """Log probability of each leading piece, and of the end, in its class, from all training words."""
    weight = np.append(statistics["count"] + 0.5, 1.0)
    total = np.bincount(model["classes"], weight, attention.CLASSES)
    return np.log(weight / total[model["classes"]])


#: A leading run of ASCII letters or digits that ends inside a word: a byte-level splitter cuts there, so the run has the word's first piece.
RUN = re.compile(rb"[a-z]+(?=[!-@\[-`{-~])|[0-9]+(?=[!-/:-~])")


class Firsts:
    """Leading pieces of words that aren't broadcast; a worker keeps a bounded number, in two generations."""

    def __init__(self, json_text: str, most: int = 400_000):
        self.json_text, self.half, self.new, self.old = json_text, most // 2, {}, {}
        spec = json.loads(json_text)
        splitter = spec.get("pre_tokenizer") or {}
        self.cut = not spec.get("normalizer") and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True)

    def of(self, words: list[bytes]) -> list[int]:
        if self.cut:
            words = [run.group() if (run := RUN.match(w)) else w for w in words]
        missing = {w for w in words if w not in self.new}
        made = {w: self.old[w] for w in missing if w in self.old}
        strange = list(missing.difference(made))
        pieces, sizes = spell(self.json_text, strange)
        made.update(zip(strange, pieces[np.cumsum(sizes) - sizes].tolist()))
        if len(self.new) + len(made) > self.half:
            self.old, self.new = self.new, {w: self.new[w] for w in words if w in self.new}
        self.new.update(made)
        return [self.new[w] for w in words]


def score_texts(docs: DataFrame, train: str, vocabulary_json: str, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    ``train`` is a boolean column: the rows that are learned from. Tokens are the words
    and one end. Null and empty texts are the end alone. Repeated rows each get a row.
    Without training rows all counts are 0 and the model is untrained, but still scores. Other columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = share(spark, vocabulary_json)
    data = docs.select(key, text_or_empty(text).cast("binary").alias("_data"), F.coalesce(train, F.lit(False)).alias("_train"))
    words = cut_lineage(spelled(word_counts(data), vocabulary))
    learned = corpus_statistics(words, data.where("_train").count())
    statistics = share(spark, learned)
    scored = cut_lineage(with_scores(words, statistics))
    few = at_most(words.where((F.col("n") > 0) & (F.octet_length("word") <= LONGEST)).select("word", "n"), F.col("n"), head)
    names = ["first", "base", "inner"]
    top = scored.join(few.select("word"), "word", "left_semi").select("word", *names).toArrow()
    shared = share(spark, (top.column("word").combine_chunks().cast(pa.binary()), *[np.append(top.column(c).to_numpy().astype(float), 0.0) for c in names]))
    named = data.select("*", F.xxhash64(key, "_data").alias("_k"), F.crc32("_data").alias("_m"), F.monotonically_increasing_id().alias("_id"))
    end_base = float(np.log10((learned["docs"] + 1) / (learned["tokens"] + learned["distinct"] + 1)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, first, base, inner = shared.value
        rare = kept("lm", hash(vocabulary.value), lambda: Firsts(vocabulary.value))
        for batch in batches:
            for part in byte_parts(batch.column("_data")):
                rows = batch[part]
                words, lengths = split_words(rows.column("_data"))
                at = pc.index_in(words, value_set=frequent).fill_null(-1).to_numpy()
                gaps = np.flatnonzero(at < 0)
                strange = words.take(pa.array(gaps)).dictionary_encode()
                number, distinct = strange.indices.to_numpy(), strange.dictionary
                ids = first[at].astype(np.uint16)
                ids[gaps] = np.array(rare.of(distinct.to_pylist()), dtype=np.uint16)[number]
                owner = np.repeat(np.arange(len(lengths)), lengths)
                few = np.bincount(owner[gaps], minlength=len(lengths))
                pairs, times = np.unique(owner[gaps] * max(len(distinct), 1) + number, return_counts=True)
                mine, which = np.divmod(pairs, max(len(distinct), 1))
                bounds = pa.array(np.searchsorted(mine, np.arange(len(lengths) + 1)).astype(np.int32))
                made = {
                    "n": lengths, "head_known": lengths - few, "head_base": np.bincount(owner, base[at], len(lengths)),
                    "head_inner": np.bincount(owner, inner[at], len(lengths)),
                    "ids": [ids[e - n : e].tobytes() for e, n in zip(np.cumsum(lengths), lengths)],
                    "words": pa.ListArray.from_arrays(bounds, distinct.take(pa.array(which))),
                    "times": pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32))),
                }
                copied = {c: rows.column(c) for c in (key, "_k", "_m", "_id", "_train")}
                yield pa.record_batch({**copied, **{c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in made.items()}})

    kind = docs.schema[key].dataType.simpleString()
    row = f"`{key}` {kind}, _k long, _m long, _id long, _train boolean, n long, head_known long, head_base double, head_inner double"
    coded = cut_lineage(named.mapInArrow(code, f"{row}, ids binary, words array<binary>, times array<int>"))
    model = attention.begin(learned["count"], piece_classes(coded, learned["count"]), learned["docs"])
    model = train_attention(coded, model)
    judge = share(spark, (model, class_shares(model, learned)))

    def attend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, within = judge.value
        for batch in batches:
            for part in slices(len(batch), 256):
                rows = batch.iloc[part]
                total = attention.score(model, *coded_ids(rows), within) / LN10
                yield rows.drop(columns=["ids", "head_inner"]).assign(head_score=rows["head_inner"] + total)

    attended = coded.select(key, "_id", "n", "head_known", "head_base", "head_inner", "ids").mapInPandas(
        attend, f"`{key}` {kind}, _id long, n long, head_known long, head_base double, head_score double"
    )
    # the numbers of the rows are written with them, so repeated rows are told apart
    each = F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("times")))
    rare_rows = coded.where(F.size("words") > 0).select("_id", each)
    sums = (
        rare_rows.join(scored.select("word", "n", "base", "inner"), "word")
        .groupBy("_id")
        .agg(
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
            F.sum(F.col("base") * F.col("times")).alias("base"), F.sum(F.col("inner") * F.col("times")).alias("inner"),
        )
    )
    whole = attended.join(sums, "_id", "left")
    zero = F.lit(0.0)
    return whole.select(
        key, (F.col("n") + 1).alias("n_tokens"),
        (F.col("head_known") + F.coalesce("known", F.lit(0)) + int(learned["docs"] > 0)).cast("long").alias("n_known"),
        F.lit(learned["tokens"]).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("base", zero) + end_base).alias("base_score"),
        (F.col("head_score") + F.coalesce("inner", zero)).alias("score"),
    )


FOLDS, HELD = 7, 2


@query("op2_lm")
def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = docs.withColumn("train", fold("doc_id", FOLDS) != HELD)
    found = score_texts(marked, "train", read_text(tokenizer_file("byte_bpe_50k.json")))
    return found.select(
        "doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
