"""Which sources of a language write differently: smoothed term shares compared exactly.

Words are cut by one pass of ``bytes.translate`` (letters to lower case, separators to
blanks) and ``bytes.split``; a ``Counter`` per document gives frequencies and document
counts, which each task adds up before they are shuffled. Shares, totals and ranks are
tables; pairs of sources are compared in tiles of sources and buckets of terms, over the
terms that occur, as what occurs nowhere in a pair adds the same amount for each term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.windows import top_k_per
from .common import cut_lineage, slices, table, text_or_empty
from .registry import query

LEAST_DOCS = 10  # documents of a language that a term must be in
TOP = 10  # terms reported per group
SCALE = 1_000_000_000
ALPHA = 2  # added to every count
HELD = 1_000_000  # (group, term) pairs that a task holds before it passes them on
TILE = 128  # sources in a tile
BUCKET = 200_000  # rows of a language in a bucket of terms, about
LANES = 512  # terms compared at a time

LETTERS = bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: Letters and bytes over 0x7F stay, A-Z become small, all others separate terms.
TERM_BYTES = bytes(b if b in LETTERS else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def term_counts(docs: DataFrame, groups: list[str], text: str = "text") -> DataFrame:
    """(groups, term, n, docs): occurrences of each term in each group, and documents with it.

    ``groups`` are string columns; null groups and texts count as ''. Every row is a
    document of its own, repeated ones too. A task holds at most HELD pairs at a time.
    Other columns are ignored; an empty table gives an empty one.
    """
    names = [f"_g{i}" for i in range(len(groups))]
    given = docs.select(*[text_or_empty(g).cast("string").alias(n) for g, n in zip(groups, names)], text_or_empty(text).cast("binary").alias("_text"))

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        for group, (docs_with, repeats) in held.items():
            words = list(docs_with)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                columns = [pa.array([v] * len(part), pa.string()) for v in group]
                with_it = list(map(docs_with.__getitem__, part))
                columns += [pa.array(part, pa.binary()), pa.array([d + repeats.get(w, 0) for w, d in zip(part, with_it)], pa.int64()), pa.array(with_it, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for *group, body in zip(*[batch[c].to_pylist() for c in (*names, "_text")]):
                counted = Counter(terms_of(body))
                docs_with, repeats = held.setdefault(tuple(group), (Counter(), Counter()))
                docs_with.update(counted.keys())
                if len(counted) < counted.total():
                    for word, n in counted.items():
                        if n > 1:
                            repeats[word] += n - 1
            if sum(len(d) for d, _ in held.values()) > HELD:
                yield from out(held)
                held = {}
        yield from out(held)

    kinds = ", ".join(f"{n} string" for n in names)
    parts = given.mapInArrow(run, f"{kinds}, term binary, n long, docs long")
    added = parts.groupBy(*names, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return added.select(*[F.col(n).alias(g) for n, g in zip(names, groups)], "term", "n", "docs")


def share(count: str, total: str, terms: str) -> F.Column:
    """1 + floor(SCALE * (count + ALPHA) / (total + ALPHA * terms)), exact at any size."""
    wide = "cast({} as decimal(19, 0))"
    above = f"{wide.format(SCALE)} * {wide.format(f'{count} + {ALPHA}')}"
    return F.expr(f"cast(1 + ({above} div {wide.format(f'{total} + {ALPHA} * {terms}')}) as long)")


def distance(p: str, q: str) -> F.Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


class Shares:
    """The tables that both reports need, for groups (lang, source) inside a language.

    ``kept``: (lang, source, term, n, all_n), the terms of a group that at least
    ``least`` documents of its language hold, with their counts in group and language.
    ``groups``: (lang, source, ordinal, total, lang_total, terms, rare, buckets, tiles),
    every group that occurs: its number inside the language, counts of kept terms in
    group and language, the language's kept terms, the share of a term without
    occurrence (null without terms), and how the pairs of the language are dealt out.
    """

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCS):
        keys = ["lang", "source"]
        counts = cut_lineage(term_counts(docs, keys))
        by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("in_docs"))
        known = cut_lineage(by_term.where(F.col("in_docs") >= least).drop("in_docs"))
        self.kept = cut_lineage(counts.drop("docs").join(known, ["lang", "term"]).select(*keys, "term", "n", "all_n"))
        seen = docs.select(*[text_or_empty(k).cast("string").alias(k) for k in keys]).distinct()
        totals = self.kept.groupBy(*keys).agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
        by_lang = known.groupBy("lang").agg(F.sum("all_n").alias("lang_total"), F.count("*").alias("terms"))
        in_lang = Window.partitionBy("lang")
        groups = seen.join(totals, keys, "left").join(by_lang, "lang", "left").select(
            *keys, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "rows", "lang_total", "terms")],
            (F.row_number().over(in_lang.orderBy("source")) - 1).cast("int").alias("ordinal"),
        )
        groups = groups.withColumn("rare", F.when(F.col("terms") > 0, share("0", "total", "terms")))
        groups = groups.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.sum("rows").over(in_lang) / BUCKET)).cast("int"))
        groups = groups.withColumn("tiles", F.ceil(F.count("*").over(in_lang) / TILE).cast("int"))
        self.groups = cut_lineage(groups.drop("rows"))


def typical_terms(shares: Shares, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): terms that a group has more of than its language, the most telling first.

    Ties go to the term that comes first in UTF-8. Groups without such a term have no row.
    """
    rows = shares.kept.join(shares.groups, ["lang", "source"])
    rows = rows.withColumn("p", share("n", "total", "terms")).withColumn("q", share("all_n", "lang_total", "terms"))
    rows = rows.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), distance("p", "q").alias("value"))
    return top_k_per(rows, ["lang", "source"], [F.desc("value"), F.asc("item")], top)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a - b) ** 2 // (a + b)


def compare_tiles(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """(a, b, part) for every source of both tiles: the distances of the terms that occur in either
    tile, less the distance of as many terms without occurrence.

    A tile has rows (ordinal, t, p); t is the term's number, or -1 in one row for each source,
    which has the share of a term that the source doesn't have.
    """
    terms = np.unique(np.concatenate([left["t"].to_numpy(), right["t"].to_numpy()]))
    terms = terms[terms >= 0]
    sides = []
    for tile in (left, right):
        zero = tile[tile["t"] < 0].sort_values("ordinal")
        found = tile[tile["t"] >= 0].sort_values("t")
        at, of = np.searchsorted(terms, found["t"]), np.searchsorted(zero["ordinal"], found["ordinal"])
        sides.append((zero["ordinal"].to_numpy(), zero["p"].to_numpy(np.int64), at, of, found["p"].to_numpy(np.int64)))
    base = _apart(sides[0][1][:, None], sides[1][1])
    sums = np.zeros(base.shape, dtype=np.int64)
    for span in slices(len(terms), LANES):
        dense = []
        for _, zero, at, of, p in sides:
            i, j = np.searchsorted(at, [span.start, span.stop])
            block = np.repeat(zero[:, None], span.stop - span.start, axis=1)
            block[of[i:j], at[i:j] - span.start] = p[i:j]
            dense.append(block)
        for i, row in enumerate(dense[0]):
            sums[i] += (_apart(row, dense[1]) - base[i][:, None]).sum(axis=1)
    i, j = (x.ravel() for x in np.indices(sums.shape))
    return pd.DataFrame({"a": sides[0][0][i], "b": sides[1][0][j], "part": sums.ravel()})


def source_distances(shares: Shares) -> DataFrame:
    """(lang, source, item, value): each ordered pair of sources of a language, value summed over its kept terms.

    All pairs are what is asked for. Terms are dealt into buckets by hash and sources into tiles,
    so a task holds one bucket of two tiles; a count goes once to each tile it is compared with.
    """
    keys = ["lang", "source"]
    groups = shares.groups.withColumn("rare", F.coalesce("rare", F.lit(1)))
    places = ["lang", "ordinal", "tiles"]
    found = shares.kept.join(groups, keys).select(
        *places, F.pmod(F.xxhash64("term"), "buckets").cast("int").alias("bucket"), "term", share("n", "total", "terms").alias("p")
    )
    without = groups.select(
        *places, F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), F.lit(None).cast("binary").alias("term"), F.col("rare").alias("p")
    )
    tile = F.floor(F.col("ordinal") / TILE).cast("int")
    dealt = found.unionByName(without).withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("lang", "bucket", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "ordinal", "term", "p")

    def compare(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.assign(t=pd.factorize(batch["term"])[0])  # -1 for null
        low, high = batch["i"].iloc[0], batch["j"].iloc[0]
        out = compare_tiles(batch[batch["tile"] == low], batch[batch["tile"] == high])
        out = out[out["a"] < out["b"]]
        return out.assign(lang=batch["lang"].iloc[0])[["lang", "a", "b", "part"]]

    parts = dealt.groupBy("lang", "bucket", "i", "j").applyInPandas(compare, "lang string, a int, b int, part long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    sides = [groups.select("lang", F.col("ordinal").alias(s), F.col("source").alias(f"source_{s}"), F.col("rare").alias(f"rare_{s}"), F.col("terms").alias(f"terms_{s}")) for s in "ab"]
    pairs = sums.join(sides[0], ["lang", "a"]).join(sides[1], ["lang", "b"])
    value = (F.col("part") + F.col("terms_a") * distance("rare_a", "rare_b")).alias("value")
    both = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    return pairs.select("lang", both.alias("_pair"), value).select("lang", "_pair.source", "_pair.item", "value")


def audit_sources(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): ``source_distances`` as part `pair`, all ranks, and ``typical_terms`` as part `term`.

    Null texts, languages and sources count as ''. Every row counts, repeated ones too; texts
    are read whole. Ranks go by value, the largest first, ties to the item that comes first in
    UTF-8. A language with one source has no pairs. Other columns are ignored; an empty table gives no rows.
    """
    shares = Shares(docs, least)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = source_distances(shares).withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    terms = typical_terms(shares, top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.select(*columns).unionByName(terms.select(*columns))


OP11_SQL = r"""
WITH d AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), words AS (
    SELECT lang, source, unnest(terms) AS term FROM d
), held AS (
    SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10
), groups AS (
    SELECT DISTINCT lang, source FROM d
), counts AS (
    SELECT lang, source, term, count(*)::HUGEINT AS n FROM words JOIN held USING (lang, term) GROUP BY ALL
), size AS (
    SELECT lang, count(*)::HUGEINT AS v FROM held GROUP BY lang
), dense AS (
    SELECT g.lang, g.source, h.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v
    FROM groups g JOIN held h USING (lang) JOIN size USING (lang) LEFT JOIN counts c USING (lang, source, term)
), shares AS (
    SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS p FROM dense
), whole AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v)) AS q
    FROM dense GROUP BY lang, term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT s.lang, s.source, t.source AS item, sum(((s.p - t.p) * (s.p - t.p)) // (s.p + t.p)) AS value
        FROM shares s JOIN shares t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source GROUP BY ALL
    ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), telling AS (
    SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM telling
)
SELECT lang, source, part, item, value::BIGINT AS value,
    (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= 10
"""


@query("op11_divergence", OP11_SQL)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language of documents are apart, and the terms that set each one apart."""
    return audit_sources(table(spark, sf_dir, "documents"))
