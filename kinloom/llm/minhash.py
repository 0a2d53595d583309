"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each word shingle is hashed once. The high bits of a hash are its bin, and a bin keeps
its smallest hash. An empty bin borrows from the first filled bin of its own fixed
pseudo-random order of all bins (optimal densification), and each bin is stored as the
low bits of its hash. Two texts agree in a bin with probability J + (1 - J) / 2**bits,
which the likeness turns back into J.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import sort_rank
from .common import SPACE, cut_lineage, table, text_or_empty
from .registry import query

WHITE = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]"
BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 8
WORDS = 5


def _mixed(j: int, salt: int) -> int:
    """A fixed pseudo-random number for bin j."""
    x = (j + 1) * 0x9E3779B97F4A7C15 + salt * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return x >> 32


def _borrow_orders() -> tuple[list[int], list[int]]:
    """Bin j looks at bins start + t * stride for t = 0, 1, ...; strides are odd, so it meets all bins.
    Given are the starts and the inverses of the strides, which turn a bin into its t."""
    starts = [_mixed(j, 1) % BINS for j in range(BINS)]
    inverses = [pow(2 * (_mixed(j, 2) % (BINS // 2)) + 1, -1, BINS) for j in range(BINS)]
    return starts, inverses


def word_hashes(text: Column) -> Column:
    """Hashes of the words in order: runs of anything but ASCII white space, in lower case."""
    plain = F.btrim(F.lower(text), F.lit(WHITE))
    words = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, SPACE))
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: str, width: int = WORDS) -> Column:
    """Hashes of the shingles of an array of word hashes; fewer words than ``width`` are one shingle."""
    n = F.size(words)
    runs = F.arrays_zip(*[F.slice(words, 1 + k, n - (width - 1)).alias(f"w{k}") for k in range(width)])
    return (
        F.when(n == 0, F.array().cast("array<bigint>"))
        .when(n < width, F.array(F.xxhash64(words)))
        .otherwise(F.transform(runs, lambda run: F.xxhash64(run)))
    )


def with_slots(df: DataFrame, shingles: str, slots: str) -> DataFrame:
    """Add ``slots``: BINS signed bytes, the low bits of the smallest hash of every bin; all -128 without shingles."""
    low = (1 << LOW_BITS) - 1
    starts, inverses = (F.array(*[F.lit(v) for v in values]) for values in _borrow_orders())
    kept = df.columns

    def of_bin(x: Column) -> Column:
        return F.shiftright(x, 64 - BIN_BITS) + BINS // 2  # keeps the order of signed hashes

    def borrowed(j: Column) -> Column:
        def place(x: Column) -> Column:
            t = ((of_bin(x) - F.element_at(starts, j + 1)) * F.element_at(inverses, j + 1)).bitwiseAND(BINS - 1)
            return t * (1 << LOW_BITS) + x.bitwiseAND(low)

        return F.array_min(F.transform("__least", place)).bitwiseAND(low)

    def opens_bin(x: Column, i: Column) -> Column:
        return (i == 0) | (F.shiftright(x.bitwiseXOR(F.get(F.col("__sorted"), i - 1)), 64 - BIN_BITS) != 0)

    filled = F.transform("__least", lambda x: F.struct(of_bin(x).cast("int").alias("bin"), x.bitwiseAND(low).alias("low")))
    empty = F.transform("__empty", lambda j: F.struct(j.alias("bin"), borrowed(j).alias("low")))
    all_bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    return (
        df.withColumn("__sorted", F.sort_array(shingles))
        .withColumn("__least", F.filter("__sorted", opens_bin))
        .withColumn("__empty", F.array_except(all_bins, F.transform("__least", lambda x: of_bin(x).cast("int"))))
        .withColumn(
            slots,
            F.when(F.size("__least") == 0, F.array_repeat(F.lit(-128).cast("tinyint"), BINS)).otherwise(
                F.transform(F.sort_array(F.concat(filled, empty)), lambda s: (s["low"] - 128).cast("tinyint"))
            ),
        )
        .select(*kept, slots)
    )


def with_fingerprint(df: DataFrame, text: str, slots: str) -> DataFrame:
    """Add the ``slots`` of a text column; null texts count as empty, whose slots are all -128."""
    marked = df.withColumn("__words", word_hashes(text_or_empty(text))).withColumn("__shingles", shingle_hashes("__words"))
    return with_slots(marked, "__shingles", slots).drop("__words", "__shingles")


def with_edited_fingerprints(df: DataFrame, text: str, kept: str, begin: str, slots: str, edited_slots: str) -> DataFrame:
    """Add the slots of ``text`` and of the text that is ``kept``, a beginning of it, followed by ``begin``.

    The words that end inside ``kept``, and the shingles of those alone, are the text's
    own; only what follows them is hashed again.
    """
    given = df.columns
    whole = F.regexp_count(kept, F.lit(SPACE)) - F.rlike(kept, F.lit(f"^{SPACE}")).cast("int")  # words that end in it
    cut = F.regexp_extract(kept, rf"(?<!{WORD}){WORD}*+\z", 0)  # the beginning of the word that doesn't
    own = F.greatest(F.lit(0), F.col("__whole") - (WORDS - 1))  # shingles of the former
    after = F.size("__rest")
    return (
        with_slots(
            with_slots(
                df.withColumn("__words", word_hashes(F.col(text)))
                .withColumn("__shingles", shingle_hashes("__words"))
                .withColumn("__whole", whole)
                .withColumn("__tail", word_hashes(F.concat(cut, begin)))
                .withColumn("__own", own)
                .withColumn("__rest", F.concat(F.slice("__words", F.col("__own") + 1, F.col("__whole") - F.col("__own")), "__tail"))
                .withColumn(
                    "__edited",
                    F.when((F.col("__own") > 0) & (after < WORDS), F.slice("__shingles", 1, F.col("__own")))
                    .when(F.col("__own") > 0, F.concat(F.slice("__shingles", 1, F.col("__own")), shingle_hashes("__rest")))
                    .otherwise(shingle_hashes("__rest")),
                ),
                "__shingles", slots,
            ),
            "__edited", edited_slots,
        )
        .select(*given, slots, edited_slots)
    )


def packed(slots: str) -> Column:
    """Slots as a string of hexadecimal digits, two for each bin."""
    return F.array_join(F.transform(slots, lambda v: F.lower(F.lpad(F.hex(v.cast("int") + 128), 2, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets: agreement of the slots, less what chance gives."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 1.0 / (1 << LOW_BITS)
    return F.greatest(F.lit(0.0), (same - chance) / (1.0 - chance))


def distinct_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h, text): one row for every key and text; id is the key as a string, empty for null; h is a hash of the text."""
    given = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), text_or_empty(text).alias("text"))
    return given.withColumn("h", F.xxhash64("text")).dropDuplicates(["id", "h"])


def neighbours(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, h, n_chars, copies, next_*, prev_*, want): the place of every document in ascending key order.

    Texts don't move: only keys, hashes and lengths are sorted. The last document is
    followed by the first. ``want`` is the number of characters that the document
    before takes from this one.
    """
    slim = (
        docs.select(
            F.col(key).alias("key"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
            F.xxhash64(text_or_empty(text)).alias("h"), F.char_length(text_or_empty(text)).cast("long").alias("n_chars"),
        )
        .groupBy("key", "id", "h", "n_chars")
        .agg(F.count("*").alias("copies"))
    )
    placed = cut_lineage(sort_rank(slim, [F.asc_nulls_first("key"), F.asc("h")], "pos"))
    n = max(1, placed.count())
    after = placed.select((F.pmod(F.col("pos") - 2, F.lit(n)) + 1).alias("pos"), F.col("id").alias("next_id"), F.col("h").alias("next_h"))
    before = placed.select(
        (F.pmod(F.col("pos"), F.lit(n)) + 1).alias("pos"), F.col("id").alias("prev_id"), F.col("h").alias("prev_h"),
        F.floor(F.col("n_chars") / 4).alias("want"),
    )
    return cut_lineage(placed.join(after, "pos").join(before, "pos").drop("pos"))


def fingerprint_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The edited text ends with the beginning of the next document instead of its own last
    quarter. Returns key, n_chars, edited_sha256, slots, edited_slots, near_edited,
    near_next. Null texts count as empty; a null key comes first; documents that share
    a key follow in the order of a hash of their text; rows that repeat key and text
    are one document in that order and each get its row. Texts are shuffled once.
    """
    places = neighbours(docs, key, text)
    texts = distinct_texts(docs, key, text)
    begun = (
        texts.join(places.select("id", "h", "prev_id", "prev_h", "want"), ["id", "h"])
        .select(F.col("prev_id").alias("id"), F.col("prev_h").alias("h"), F.substring("text", F.lit(1), F.col("want").cast("int")).alias("begin"))
    )
    joined = texts.join(places.select("key", "id", "h", "n_chars", "copies", "next_id", "next_h"), ["id", "h"]).join(begun, ["id", "h"])
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    cut = joined.withColumn("kept", F.substring("text", F.lit(1), kept))
    marked = with_edited_fingerprints(cut, "text", "kept", "begin", "slots", "edited_slots")
    made = cut_lineage(
        marked.select(
            "key", "id", "h", "n_chars", "copies", "next_id", "next_h",
            F.sha2(F.concat("kept", "begin").cast("binary"), 256).alias("edited_sha256"), "slots", "edited_slots",
        )
    )
    following = made.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("slots").alias("next_slots"))
    found = made.join(following, ["next_id", "next_h"])
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", "slots", "edited_slots",
        likeness(F.col("slots"), F.col("edited_slots")).alias("near_edited"),
        likeness(F.col("slots"), F.col("next_slots")).alias("near_next"),
    )


@query("op5_minhash")
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_neighbours(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", packed("slots").alias("fingerprint"),
        packed("edited_slots").alias("edited_fingerprint"), "near_edited", "near_next",
    )
