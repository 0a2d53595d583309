"""Encoding and decoding of whole texts with a public BPE vocabulary, through a table of distinct words.

Texts are split at ASCII white space, which no merge of this vocabulary crosses. The
frequent words (bounded in number and length) are encoded once and broadcast; every
other distinct word is brought together by a shuffle, encoded once there, and its ids
go back to the texts by position. What a text keeps meanwhile is a code for each word,
not the text.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, read_text, share, slices, table, text_or_empty, tokenizer, tokenizer_file
from .pieces import LONGEST, plain_case
from .registry import query
from .words import Ranks, frequent_words

HEAD = 1 << 19  # frequent words that are broadcast, of at most 64 bytes
PART = 4096  # words whose bits are taken apart at once
SALTS = 16  # parts of a word that is too long for the head
ROWS = 512  # texts whose ids are in a Python batch at once


def words_of(text: bytes) -> list[bytes]:
    return plain_case(text).split()


def encode_words(json_text: str, words: list[bytes], unit: str) -> list[bytes]:
    """Ids of each word as little-endian integers of type ``unit``."""
    coded = tokenizer(json_text).encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
    return [np.array(c.ids, dtype=unit).tobytes() for c in coded]


def pack_codes(codes: np.ndarray) -> bytes:
    """Ranks of a text's words (-1: not a frequent one), each as its number of bits, then the bits below the highest.

    The numbers of bits are compressed; the bits themselves are near random, so they are
    only put together. Frequent words so take few bits.
    """
    widths, bits = np.empty(len(codes), np.uint8), []
    for part in slices(len(codes), PART):
        value = codes[part].astype(np.uint32) + np.uint32(2)
        widths[part] = np.frexp(value.astype(np.float64))[1] - 1
        places = np.arange(widths[part].max(), dtype=np.uint32)
        bits.append((value[:, None] >> places & 1).astype(np.uint8)[widths[part, None] > places])
    body = pa.compress(widths.tobytes(), codec="zstd", asbytes=True)
    low = np.packbits(np.concatenate(bits)).tobytes() if bits else b""
    return np.array([len(codes), len(body)], dtype="<u4").tobytes() + body + low


def unpack_codes(packed: bytes) -> np.ndarray:
    n, size = (int(x) for x in np.frombuffer(packed[:8], "<u4"))
    widths = np.frombuffer(pa.decompress(packed[8 : 8 + size], decompressed_size=n, codec="zstd", asbytes=True) if n else b"", np.uint8)
    bits = np.unpackbits(np.frombuffer(packed[8 + size :], np.uint8))
    codes, at = np.empty(n, np.int64), 0
    for part in slices(n, PART):
        places = np.arange(widths[part].max())
        inside = widths[part, None] > places
        value, stop = np.zeros(inside.shape, np.int64), at + int(inside.sum())
        value[inside] = bits[at:stop]
        codes[part] = (value << places).sum(axis=1) + (1 << widths[part].astype(np.int64)) - 2
        at = stop
    return codes


def head_table(spark: SparkSession, data: DataFrame, vocabulary, most: int, unit: str) -> tuple[object, str]:
    """Broadcast of (words joined by spaces, their ids) and a name for it; ``most`` words at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"word": batch["word"], "n": batch["n"], "ids": encode_words(vocabulary.value, list(batch["word"]), unit)})

    rows = frequent_words(data, "_data", words_of, most).mapInPandas(run, "word binary, n long, ids binary").toPandas()
    rows = rows.sort_values(["n", "word"], ascending=[False, True])
    return share(spark, (b" ".join(map(bytes, rows["word"])), list(map(bytes, rows["ids"])))), uuid.uuid4().hex


def pieces_of(vocabulary: str) -> list[str]:
    """The table from id to piece, special tokens included."""
    spec = json.loads(vocabulary)
    pieces = {i: p for p, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [pieces.get(i, "") for i in range(max(pieces) + 1)]


def encode_documents(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", head: int = HEAD, decode: bool = False
) -> DataFrame:
    """(key, ids): the ids of every whole text, as a binary of little-endian unsigned 32-bit integers.

    ``vocabulary`` is the JSON text of a word vocabulary whose pre-tokenizer drops white
    space. ``decode`` adds the text decoded from the ids, as ``decode_documents`` does.
    Null and empty texts have no ids. Rows are told apart by their key and text (80 bits
    of hashes), so null or repeated keys and repeated rows each get their row back;
    other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = pieces_of(vocabulary)
    unit = "<u2" if len(pieces) <= 1 << 16 else "<u4"  # of ids on their way
    shared, piece_list = share(spark, vocabulary), share(spark, decoder_pieces(vocabulary) if decode else [])
    data = docs.select(key, text_or_empty(text).cast("binary").alias("_data"))
    table_, name = head_table(spark, data, shared, head, unit)
    named = data.withColumn("_k", F.xxhash64(key, "_data")).withColumn("_m", (F.crc32("_data") % 65536).cast("int"))
    kind = docs.schema[key].dataType.simpleString()

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = head_words(name, table_).of
        for batch in batches:
            out = batch.drop(columns="_data")
            out["_codes"] = [pack_codes(find(words_of(t))) for t in batch["_data"]]
            yield out

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = head_words(name, table_).place
        for batch in batches:
            words, at, owner = [], [], []
            for i, value in enumerate(batch["_data"]):
                found = [w for w in words_of(value) if w not in place]
                words += found
                at += range(len(found))
                owner += [i] * len(found)
            keys, marks = batch["_k"].to_numpy(), batch["_m"].to_numpy(np.int64) << 32
            for part in slices(len(words), 50_000):
                mine = np.array(owner[part], dtype=np.int64)
                yield pd.DataFrame({"_k": keys[mine], "_at": marks[mine] | np.array(at[part], dtype=np.int64), "_word": words[part]})

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:  # sorted by word
            words = list(batch["_word"])
            distinct = list(dict.fromkeys(words))
            of = dict(zip(distinct, encode_words(shared.value, distinct, unit)))
            places = batch["_at"].to_numpy().astype("<u8").tobytes()  # six bytes of it: position, mark
            yield pd.DataFrame({"_k": batch["_k"], "_found": [places[8 * i : 8 * i + 6] + of[w] for i, w in enumerate(words)]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = kept("head", (name, "ids"), lambda: np.array([*table_.value[1], b""], dtype=object))  # the last is for -1
        piece = kept("pieces", name, lambda: np.array(piece_list.value, dtype=object))
        for batch in batches:
            for part in slices(len(batch), ROWS):
                rows, made, texts = batch.iloc[part], [], []
                for packed, mark, found in zip(rows["_codes"], rows["_m"], rows["_tail"]):
                    code = unpack_codes(packed)
                    parts = ids[code]
                    gaps = np.flatnonzero(code < 0)
                    for entry in found if len(gaps) else ():
                        if int.from_bytes(entry[4:6], "little") == mark:
                            parts[gaps[int.from_bytes(entry[:4], "little")]] = entry[6:]
                    numbers = np.frombuffer(b"".join(parts.tolist()), unit).astype("<u4")
                    made.append(numbers.tobytes())
                    if decode:
                        texts.append(" ".join(piece[numbers].tolist()))
                out = rows[[key]].assign(ids=made)
                yield out.assign(decoded=texts) if decode else out

    long_word = F.octet_length("_word") > LONGEST
    salt = F.when(long_word, F.pmod(F.col("_k"), F.lit(SALTS))).otherwise(F.lit(0))
    tail = named.select("_data", "_k", "_m").mapInPandas(rare, "_k long, _at long, _word binary")
    tail = tail.repartition("_word", salt).sortWithinPartitions("_word").mapInPandas(coded, "_k long, _found binary")
    gathered = tail.groupBy("_k").agg(F.collect_set("_found").alias("_tail"))
    skeletons = named.mapInPandas(codes, f"`{key}` {kind}, _k long, _m int, _codes binary")
    joined = skeletons.join(gathered, "_k", "left").select(key, "_m", "_codes", "_tail")
    return joined.mapInPandas(whole, f"`{key}` {kind}, ids binary" + ", decoded string" * decode)


def head_words(name: str, table_) -> Ranks:
    """Places of the frequent words; a worker holds either these or the words' ids."""
    return kept("head", (name, "words"), lambda: Ranks(table_.value[0]))


def decoder_pieces(vocabulary: str) -> list[str]:
    if json.loads(vocabulary).get("decoder"):
        raise ValueError("a vocabulary with a decoder of its own isn't supported")
    return pieces_of(vocabulary)


def decode_documents(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``: the pieces of the ids, joined by spaces, special tokens included.

    The table from id to piece is the vocabulary, so it is broadcast and joined in the
    tasks. For vocabularies without a decoder of their own.
    """
    shared, name = share(encoded.sparkSession, decoder_pieces(vocabulary)), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece = kept("pieces", name, lambda: np.array(shared.value, dtype=object))
        for batch in batches:
            for part in slices(len(batch), ROWS):
                rows = batch.iloc[part]
                yield rows.assign(decoded=[" ".join(piece[np.frombuffer(i, "<u4")].tolist()) for i in rows[ids]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInPandas(run, f"{fields}, decoded string")


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = read_text(tokenizer_file("word_bpe_49k.json"))
    encoded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary, decode=True)
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
