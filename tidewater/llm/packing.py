"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two of n's binary form, those of the
sequence length as often as they fit. Pieces of equal length share a bucket; each is a sequence of its own, so that no
sequence crosses documents and none is padded. Texts are tokenised where they are read; only pieces are shuffled."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .bpe import word_ids
from .common import Scratch, pieces, read_table, small

SEQUENCE = 4096
END_ID = 2
#: Pieces of one length, on average, that a task numbers at a time.
NUMBERED = 1 << 20


class Encoder:
    """Ids, as little-endian 32-bit bytes, of texts under a tokenizer that drops white space and joins no words over it.

    The tokenizer's pieces lie between white space, and neither its normaliser (NFC, lower case) nor its special strings
    reach over a space, so that a text's ids are those of its words in a row; ids of words seen before are remembered.
    Words end at white space; in a text with one of the four separators that only Python counts as such, words end at the
    six ASCII white-space characters, and what else the tokenizer takes for white space it sees inside the word."""

    def __init__(self, path: str):
        self.ids = word_ids(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.ids.__getitem__
        return [b"".join(map(get, _words(text))) for text in texts]


#: Characters that Python's split() takes for white space and the tokenizer doesn't.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SPACES = str.maketrans("\t\n\r\x0b\x0c", "     ")


def _words(text: str) -> list[str]:
    if any(c in text for c in _SEPARATORS):
        return [w for w in text.translate(_SPACES).split(" ") if w]
    return text.split()


def lengths(n: int, sequence: int = SEQUENCE) -> list[int]:
    """n as sequence lengths and falling powers of two."""
    out = [sequence] * (n // sequence)
    rest = n % sequence
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if wanted).

    sequence must be a power of two. Null and empty texts are documents of the end id alone. Repeated rows, also with
    null or repeated ids, are documents of their own. sequence_id runs from 0 without gaps, longest sequences first,
    those of one length in the order of a hash of id and start; each sequence holds one piece, at offset 0. Other columns are ignored; an empty table gives
    an empty result. No text or document is cut short: long ones give more pieces."""
    if sequence & (sequence - 1):
        raise ValueError("the sequence length must be a power of two")
    spark = docs.sparkSession
    scratch, kind = Scratch(spark, "pack"), dict(docs.dtypes)[id_col]
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        for batch in pieces(batches, 8 << 20):
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, own in enumerate(encoder.encode([t or "" for t in batch["text"].to_pylist()])):
                own += end
                at, n = 0, len(own) // 4
                for size in lengths(n, sequence):
                    part = own[4 * at : 4 * (at + size)]
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if with_ids:
                        ids.append(part)
                    at += size
            columns = [batch["doc_id"].take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    cuts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)
    # Equal lengths share a bucket, and a bucket of many pieces is numbered in sub-buckets.
    cuts = scratch.keep(cuts, "pieces")
    parts = {r.length: max(16, -(-r.n // NUMBERED)) for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row per power of two
    part = F.element_at(F.create_map(*(F.lit(x) for kv in (parts or {1: 1}).items() for x in kv)), F.col("length"))
    cuts = cuts.withColumn("b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), part.cast("long")))
    counts = cuts.groupBy("length", "b").agg(F.count("*").alias("n"))
    # One window over the counts only, a row for NUMBERED pieces.
    first = counts.withColumn("first", F.sum("n").over(W.orderBy(F.desc("length"), "b")) - F.col("n")).drop("n")
    at = F.row_number().over(W.partitionBy("length", "b").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    numbered = cuts.withColumn("at", at.cast("long")).join(small(first, sum(parts.values())), ["length", "b"])
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("at") - 1).alias("sequence_id"),
                           F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
