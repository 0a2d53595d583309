"""Toxicity by multiple-instance learning: a document is a bag of sentences.

Only documents are labelled. Each sentence gets a probability from its words and word
beginnings, and a document's is their noisy-or: it is toxic unless no sentence is. The
weights are trained through the noisy-or, so the sentences that carry the label stand out.
A sentence's amount, -log(1 - p), is what its features add to that of a sentence without
any, which has none; so a text doesn't get more toxic by its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp, expm1, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import top_k_per
from .common import cut_lineage, fold, share, table, text_or_empty
from .registry import query

PER_CLASS = 3000  # labelled documents of each class that are learned from
FEATURES = 1024
LEAST_DOCS = 3  # documents that a feature must be in
BIAS = -4.0  # logit of a sentence without a feature, the zero of amounts; the lower, the less weak features add up
STEMS = (4, 5, 6)  # lengths of word beginnings
WORDS = 300_000  # words whose features a worker keeps

SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings, marked."""
    return [word, *[f"{word[:n]}*" for n in STEMS if len(word) >= n]]


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of every sentence that has a word; words are lower-cased."""
    for found in SENTENCE.finditer(text):
        words = WORD.findall(found[0].lower())
        if words:
            yield found.start(), found.end(), words


def choose_features(rows: DataFrame, most: int, least: int) -> list[str]:
    """Features whose documents are most surely toxic more often than others (chi-squared, positive side).

    ``rows`` has _text and _label. A task counts a bounded number of features before it passes its counts on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, toxic = Counter(), Counter()

        def passed() -> pd.DataFrame:
            out = pd.DataFrame({"feature": list(seen), "total": list(seen.values()), "k": [toxic[f] for f in seen]})
            seen.clear()
            toxic.clear()
            return out.astype({"feature": object, "total": "int64", "k": "int64"})

        for batch in batches:
            for text, label in zip(batch["_text"], batch["_label"]):
                found = {f for w in {w for _, _, words in sentences(text) for w in words} for f in features_of(w)}
                seen.update(found)
                if label:
                    toxic.update(found)
                if len(seen) > WORDS:
                    yield passed()
        yield passed()

    n, p = rows.agg(F.count("*"), F.sum(F.col("_label").cast("double"))).first()
    counts = rows.select("_text", "_label").mapInPandas(run, "feature string, total long, k long")
    counts = counts.groupBy("feature").agg(F.sum("total").alias("total"), F.sum("k").alias("k"))
    expected = F.col("total") * p / n
    spread = expected * (1 - p / n) * (1 - F.col("total") / n)
    surer = counts.where((F.col("total") >= least) & (F.col("k") > expected) & (spread > 0))
    valued = surer.withColumn("value", (F.col("k") - expected) ** 2 / spread).where("value > 10")
    return [r["feature"] for r in valued.orderBy(F.desc("value"), "feature").limit(most).collect()]


def feature_sentences(rows: DataFrame, chosen: list[str]) -> DataFrame:
    """(_id, _label, found, times) of every row: the sets of chosen features its sentences have, and in how many each is."""
    shared = share(rows.sparkSession, {f: i for i, f in enumerate(chosen)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = shared.value
        for batch in batches:
            sets, times = [], []
            for text in batch["_text"]:
                counts: Counter = Counter()
                for _, _, words in sentences(text):
                    if found := {place[f] for w in words for f in features_of(w) if f in place}:
                        counts[tuple(sorted(found))] += 1
                sets.append([list(c) for c in sorted(counts)])
                times.append([counts[c] for c in sorted(counts)])
            yield batch[["_id", "_label"]].assign(found=sets, times=times)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("_id", "_label"))
    return rows.mapInPandas(run, f"{kinds}, found array<array<int>>, times array<long>")


def train_noisy_or(
    rows: np.ndarray, columns: np.ndarray, bag_of: np.ndarray, times: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int,
    rounds: int = 400, rate: float = 0.1, strength: float = 1e-3,
) -> np.ndarray:
    """Weights of the sentence model.

    rows, columns: features of the sentences that have any; bag_of: their documents;
    times: how often such a sentence is there. With z a sentence's logit, its amount is
    softplus(z) - softplus(BIAS) and at least 0. log(1 - P) of a document is less the
    sum of the amounts and less a leak that every document has once; the leak takes up
    labels without a feature and isn't part of a score. The gradient of the loss in z is
    p for label 0 and -p (1 - P) / P for label 1; an amount below 0 is pulled up only.
    """
    w, leak = np.zeros(size), -2.0
    moment, square = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, rounds + 1):
        u = np.bincount(rows, w[columns], len(bag_of))
        z = u + BIAS
        p, p_leak = (1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (z, leak))
        amount = np.maximum(np.logaddexp(0, z) - np.logaddexp(0, BIAS), 0)
        none = np.exp(-np.bincount(bag_of, times * amount, len(y)) - np.logaddexp(0, leak))
        pull = weight * np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0)
        g = pull[bag_of] * times * ((u >= 0) | (y[bag_of] > 0))
        of_w = np.bincount(columns, (g * p)[rows], size) / len(y) + strength * w / 10
        grad = np.append(of_w, pull.sum() * p_leak / len(y))
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        step = rate * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        leak -= float(step[-1])
    return w


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    per_class: int = PER_CLASS, features: int = FEATURES,
) -> dict:
    """The model, from at most ``per_class`` documents of each label, of any length.

    Of this sample the distinct feature sets of its sentences reach the driver, not the texts. A document with several labels
    counts as toxic if one is 1; null labels aren't used. The classes are weighed as they
    occur. Without both labels nothing is learned and every score is 0.
    """
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(label).alias("_label"))
    ids = docs.select(F.col(key).alias("_id")).distinct().join(marks, "_id").withColumn("_hash", F.xxhash64("_id"))
    totals = {r["_label"]: r["count"] for r in ids.groupBy("_label").count().collect()}
    if not (totals.get(0) and totals.get(1)):
        return {"weights": {}, "bias": None}
    sample = top_k_per(ids.where(F.col("_label").isin(0, 1)), ["_label"], [F.asc("_hash"), F.asc("_id")], per_class)
    sample = F.broadcast(sample.select("_id", "_label"))
    rows = docs.join(sample, docs[key] == sample["_id"]).select(F.col("_id"), text_or_empty(text).alias("_text"), "_label")
    rows = cut_lineage(rows)
    chosen = choose_features(rows, features, LEAST_DOCS)
    given = feature_sentences(rows, chosen).toPandas()
    given["_order"] = [(i, [list(f) for f in sets], list(n)) for i, sets, n in zip(given["_id"], given["found"], given["times"])]
    given = given.sort_values("_order")
    y = given["_label"].to_numpy(float)
    share_of = {c: totals[c] / max(1, (y == c).sum()) for c in (0, 1)}
    weight = np.where(y > 0, share_of[1], share_of[0])
    weight = weight / weight.mean()
    at, column, bag_of, times = [], [], [], []
    for d, (sets, counts) in enumerate(zip(given["found"], given["times"])):
        for found, n in zip(sets, counts):
            at += [len(bag_of)] * len(found)
            column += list(found)
            bag_of.append(d)
            times.append(n)
    w = train_noisy_or(np.array(at, int), np.array(column, int), np.array(bag_of, int), np.array(times, float), y, weight, len(chosen))
    return {"weights": {f: float(w[i]) for i, f in enumerate(chosen)}, "bias": BIAS}


def softplus(x: float) -> float:
    return max(x, 0.0) + log1p(exp(-abs(x)))


class Scorer:
    """Scores texts; keeps the weights of a bounded number of words."""

    def __init__(self, model: dict):
        self.weights, self.bias, self.known = model["weights"], model["bias"], {}

    def features(self, word: str) -> tuple[str, ...]:
        found = self.known.get(word)
        if found is None:
            found = tuple(f for f in features_of(word) if f in self.weights)
            if len(self.known) >= WORDS:
                self.known.clear()
            self.known[word] = found
        return found

    def amounts(self, text: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, amount) of every sentence with a feature; a feature counts once in a sentence."""
        if self.bias is None:
            return
        for start, end, words in sentences(text):
            if found := {f for w in words for f in self.features(w)}:
                yield start, end, max(0.0, softplus(self.bias + sum(self.weights[f] for f in found)) - softplus(self.bias))

    def score(self, text: str) -> float:
        return max(0.0, -expm1(-sum(a for _, _, a in self.amounts(text))))


def score_toxicity(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every whole text.

    Null and empty texts and texts without a feature score 0, however long they are. Repeated
    rows each get a row; other columns are ignored.
    """
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            out = batch[[key]].copy()
            out["score"] = np.array([scorer.score(t) for t in batch["_text"]], dtype=float)
            out["predicted"] = (out["score"] >= 0.5).astype("int32")
            yield out

    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(key, text_or_empty(text).alias("_text"))
    return given.mapInPandas(run, f"`{key}` {kind}, score double, predicted int")


def toxic_sentences(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(key, start, end, sentence, score): the sentences of every text that score at least ``least``;
    start and end count characters of the text."""
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch["_text"]):
                for start, end, amount in scorer.amounts(value):
                    if (p := -expm1(-amount)) >= least:
                        at.append(i)
                        rows.append((start, end, value[start:end], float(p)))
            out = pd.DataFrame(rows, columns=["start", "end", "sentence", "score"])
            out.insert(0, key, batch[key].iloc[at].reset_index(drop=True))
            yield out

    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(key, text_or_empty(text).alias("_text"))
    return given.mapInPandas(run, f"`{key}` {kind}, start long, end long, sentence string, score double")


HELD_OUT = 5


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit_toxicity(docs.where(fold("doc_id", HELD_OUT) != 0), labels)
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold("doc_id", HELD_OUT) == 0).alias("held_out"), "score", "predicted")
