"""Language identification in two steps: the family, then the languages inside it.

Families are separated by one linear support vector machine each (against the rest);
inside a family every pair of languages has its own (one-versus-one). Features are
hashed relative frequencies of character 1- to 3-grams, so every machine is a table of
weights and a text's margin is the mean weight of its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import top_k_per
from .common import cut_lineage, fold, kept, share, table, text_or_empty
from .registry import query

DIMENSIONS = 1 << 13
PER_LANGUAGE = 500  # labelled documents that a language is learned from
REST = 8000  # documents, the same number of each language, that stand for the rest when a family is learned
UNKNOWN = "und"

#: Language families by code. A code that isn't listed is its own family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt",
    "indic": "hi bn mr ne gu pa ur",
    "semitic": "ar he mt am",
    "celtic": "ga gd cy br",
    "baltic": "lt lv",
}


def family_of(language: str, families: dict[str, str] = FAMILIES) -> str:
    return next((f for f, codes in families.items() if language.lower() in codes.split()), language)


def _letters() -> np.ndarray:
    def make():
        return np.array([chr(c).isalpha() for c in range(0x110000)])

    return kept("letters", None, make)


def ngram_bins(text: str) -> np.ndarray:
    """Bins of the 1-, 2- and 3-grams of the lower-cased text; runs of other characters are one space.
    Empty if the text has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter stays, as a space
    c = np.where(letter, codes, 32)[keep].astype(np.uint32)
    c = np.concatenate((np.array([32], np.uint32), c))
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    parts = [(x * np.uint32(0xC2B2AE35)) >> shift for x in (c, two + np.uint32(7), three + np.uint32(13))]
    return np.concatenate(parts)


def labelled_features(docs: DataFrame, text: str, label: str) -> DataFrame:
    """(label, bins, counts) of every document, as packed int16 and int32; nothing for texts without a letter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value, name in zip(batch["_text"], batch["_label"]):
                bins = ngram_bins(value)
                if len(bins):
                    found, counts = np.unique(bins, return_counts=True)
                    rows.append((name, found.astype(np.int16).tobytes(), counts.astype(np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["label", "bins", "counts"])

    given = docs.select(text_or_empty(text).alias("_text"), F.col(label).alias("_label"))
    return given.mapInPandas(run, "label string, bins binary, counts binary")


class Rows:
    """Sparse rows of relative frequencies, scaled by bin."""

    def __init__(self, bins: list[bytes], counts: list[bytes], scale: np.ndarray):
        found = [np.frombuffer(b, np.int16) for b in bins]
        self.sizes = np.array([len(f) for f in found], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bins = np.concatenate(found)
        shares = [(c / c.sum()).astype(np.float32) for c in (np.frombuffer(c, np.int32) for c in counts)]
        self.values = np.concatenate(shares) * scale[self.bins].astype(np.float32)

    def part(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``rows``, bin, value) of what is in the rows."""
        sizes = self.sizes[rows]
        at = np.arange(sizes.sum()) + np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes)
        return np.repeat(np.arange(len(rows)), sizes), self.bins[at], self.values[at]

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes), self.values * w[self.bins], len(self.sizes))


def train_svm(x: Rows, y: np.ndarray, rounds: int = 400, strength: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine: hinge loss, both classes with equal weight, averaged steps."""
    rng = np.random.default_rng(0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b, mean_w, mean_b = np.zeros(DIMENSIONS), 0.0, np.zeros(DIMENSIONS), 0.0
    for t in range(1, rounds + 1):
        pick = rng.choice(len(y), min(len(y), 256), p=weight / weight.sum())
        row, column, value = x.part(pick)
        inside = y[pick] * (np.bincount(row, value * w[column], len(pick)) + b) < 1
        step = 1.0 / (1.0 + strength * 100 * t) * 0.5
        w *= 1 - step * strength
        if inside.any():
            pull = np.where(inside, y[pick], 0.0)
            w += step * np.bincount(column, pull[row] * value, DIMENSIONS) / len(pick)
            b += step * pull.sum() / len(pick)
        if t > rounds // 2:
            mean_w += w
            mean_b += b
    half = rounds - rounds // 2
    return mean_w / half, mean_b / half


def _steepness(margins: np.ndarray, y: np.ndarray) -> float:
    """Slope of the logistic curve that turns margins into probabilities."""
    grid = np.array([0.5, 1, 2, 3, 5, 8])
    losses = [np.mean(np.logaddexp(0, -a * y * margins)) for a in grid]
    return float(grid[int(np.argmin(losses))])


def mean_shares(rows: DataFrame) -> np.ndarray:
    """Mean relative frequency of every bin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIMENSIONS), 0
        for batch in batches:
            for bins, counts in zip(batch["bins"], batch["counts"]):
                counts = np.frombuffer(counts, np.int32)
                total[np.frombuffer(bins, np.int16)] += counts / counts.sum()
                n += 1
        yield pd.DataFrame([(total.tobytes(), n)], columns=["total", "n"])

    parts = rows.select("bins", "counts").mapInPandas(run, "total binary, n long").collect()
    return sum(np.frombuffer(p["total"]) for p in parts) / sum(p["n"] for p in parts)


def train_machines(rows: DataFrame, jobs: list[tuple], names: list[str], group: dict, scale: np.ndarray) -> list[tuple]:
    """(weights, bias, slope) of every job, each trained by a task of its own.

    A job is (number, label, sign) for each label it reads. A job without a negative
    label is a family against the rest: ``REST`` documents of all languages, as many
    of each, go to every task, and those of other families are its negatives.
    """
    spark = rows.sparkSession
    quota = max(1, min(PER_LANGUAGE, REST // len(names)))
    order = [F.asc(F.xxhash64("bins", "counts")), F.asc("bins"), F.asc("counts")]
    rest = top_k_per(rows, ["label"], order, quota).select("label", "bins", "counts").collect() if len(set(group.values())) > 1 else []
    rest = sorted((r["label"], bytes(r["bins"]), bytes(r["counts"])) for r in rest)
    shared = share(spark, (rest, group, scale))

    def train(given: pd.DataFrame) -> pd.DataFrame:
        rest, group, scale = shared.value
        read = sorted(zip(given["label"], map(bytes, given["bins"]), map(bytes, given["counts"]), given["sign"]))
        if all(sign > 0 for *_, sign in read):
            family = group[read[0][0]]
            read += [(*r, -1) for r in rest if group[r[0]] != family]
        x = Rows([r[1] for r in read], [r[2] for r in read], scale)
        y = np.array([float(r[3]) for r in read])
        w, b = train_svm(x, y)
        slope = _steepness(x.margins(w) + b, y)
        made = (int(given["job"].iloc[0]), (w * scale).astype(np.float32).tobytes(), float(b), slope)
        return pd.DataFrame([made], columns=["job", "weights", "bias", "slope"])

    wanted = F.broadcast(spark.createDataFrame(jobs, "job int, label string, sign int"))  # a few rows a language
    trained = rows.join(wanted, "label").groupBy("job").applyInPandas(train, "job int, weights binary, bias double, slope double")
    found = sorted(trained.collect(), key=lambda r: r["job"])
    return [(np.frombuffer(r["weights"], np.float32), r["bias"], r["slope"]) for r in found]


def fit_languages(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "lang",
    per_language: int = PER_LANGUAGE,
    families: dict[str, str] = FAMILIES,
) -> dict:
    """The model, from at most ``per_language`` documents of each label; all labels are learned.

    The sample is the first documents by a hash of the key, whole texts. The machines are
    trained in Spark tasks; their weights and a bounded number of n-gram counts, not the
    texts, reach the driver. Rows with a null label aren't used.
    """
    known = docs.where(F.col(label).isNotNull())
    ids = known.select(F.col(key).alias("_id"), F.col(label).alias("_of")).withColumn("_hash", F.xxhash64("_id"))
    sample = top_k_per(ids, ["_of"], [F.asc("_hash"), F.asc("_id")], per_language).select("_id", "_of")
    chosen = known.join(sample, (known[key] == sample["_id"]) & (known[label] == sample["_of"]), "left_semi")
    rows = cut_lineage(labelled_features(chosen, text, label))
    model = {"names": [], "families": [], "weights": np.zeros((DIMENSIONS, 0), np.float32), "biases": np.zeros(0), "pairs": {}, "slopes": np.zeros(0)}
    names = sorted(r["label"] for r in rows.select("label").distinct().collect())
    if not names:
        return model
    group = {n: family_of(n, families) for n in names}
    members: dict[str, list[str]] = {}
    for n in names:
        members.setdefault(group[n], []).append(n)
    groups = sorted(members)
    jobs, pairs, n_jobs = [], {}, 0
    if len(groups) > 1:
        jobs += [(i, n, 1) for i, g in enumerate(groups) for n in members[g]]
        n_jobs = len(groups)
    for g in groups:
        for a, b in combinations(members[g], 2):
            jobs += [(n_jobs, a, 1), (n_jobs, b, -1)]
            pairs[(a, b)] = n_jobs
            n_jobs += 1
    machines = train_machines(rows, jobs, names, group, 1 / (np.sqrt(mean_shares(rows)) + 1e-3)) if jobs else []
    model |= {"names": names, "families": groups, "group": group, "pairs": pairs, "slopes": np.array([m[2] for m in machines])}
    if machines:
        model["weights"] = np.stack([m[0] for m in machines], axis=1)
        model["biases"] = np.array([m[1] for m in machines])
    return model


def predict_one(model: dict, text: str) -> tuple[str, float]:
    """(language, probability) of one text: the best family, then the language that wins most pairs in it."""
    bins = ngram_bins(text)
    if not len(bins) or not model["names"]:
        return UNKNOWN, 0.0
    total = np.zeros(model["weights"].shape[1])
    part = max(256, min(1 << 16, (1 << 23) // max(1, len(total))))  # many machines: fewer n-grams at once
    for at in range(0, len(bins), part):
        total += model["weights"][bins[at : at + part]].sum(axis=0)
    chance = 1 / (1 + np.exp(-np.clip(model["slopes"] * (total / len(bins) + model["biases"]), -30, 30)))
    score = 1.0
    family = model["families"][0]
    if len(model["families"]) > 1:
        of_family = chance[: len(model["families"])]
        best = int(of_family.argmax())
        family, score = model["families"][best], float(of_family[best] / of_family.sum())
    inside = [n for n in model["names"] if model["group"][n] == family]
    if len(inside) == 1:
        return inside[0], score
    wins, odds = dict.fromkeys(inside, 0), dict.fromkeys(inside, 0.0)
    for (a, b), machine in model["pairs"].items():
        if a in wins:
            p = float(chance[machine])
            wins[a if p >= 0.5 else b] += 1
            odds[a] += p
            odds[b] += 1 - p
    best_name = max(inside, key=lambda n: (wins[n], odds[n]))
    return best_name, min(1.0, score * odds[best_name] / (len(inside) - 1))


def predict_languages(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every whole text, from the text alone.

    A null text, one without a letter, and any text under a model that learned nothing
    get ``und`` and score 0. Repeated rows each get a row; other columns are ignored.
    """
    shared = share(docs.sparkSession, model)  # DIMENSIONS weights a machine

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            found = [predict_one(model, value) for value in batch["_text"]]
            out = batch[[key]].copy()
            out["lang_pred"] = [f[0] for f in found]
            out["score"] = np.array([f[1] for f in found], dtype=float)
            yield out

    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(key, text_or_empty(text).alias("_text"))
    return given.mapInPandas(run, f"`{key}` {kind}, lang_pred string, score double")


def without_letter(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The keys of the rows whose text is null or has no letter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[not len(ngram_bins(value)) for value in batch["_text"]], [key]]

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_or_empty(text).alias("_text")).mapInPandas(run, f"`{key}` {kind}")


HELD_OUT = 5


@query("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.where(fold("doc_id", HELD_OUT) != 0))
    found = predict_languages(docs, model)
    return found.select("doc_id", (fold("doc_id", HELD_OUT) == 0).alias("held_out"), "lang_pred", "score")
