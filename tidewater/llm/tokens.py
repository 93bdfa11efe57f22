"""Token counts behind a digest cache.

The cache is a table in the shared folder, with a folder per tokenizer version and in it one per batch that was
appended. It holds a row per content digest. Documents' distinct digests are joined to it; only distinct texts that it
lacks are encoded, and their counts are appended to it. Texts are not shuffled to find the distinct ones: the digests
are, and the text is read again for one row per missing digest. Counts come back to the documents by digest; digests
that many documents share are sent to all tasks, so that copies don't meet in one."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import piece_counts
from .common import Scratch, attach, pieces, read_table, shared_dir, small

LIMIT = 512
#: A space between characters that are not white space: the byte-level pattern always begins a new piece there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_NEAR = re.compile(r"\s | \s|\A\s|\s\Z")


def version(path: str) -> str:
    """Digest of a tokenizer's file and of the library's version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()[:32]


class Counter:
    """Token counts of texts under a byte-level tokenizer of the `tokenizers` library.

    A text is cut before each space that parts two other characters. No piece of the tokenizer's pattern reaches over
    such a cut, special strings hold no space, and the pattern looks no further back, so that counts add up; counts of
    cuts seen before are remembered."""

    def __init__(self, path: str):
        self.first, self.counts = piece_counts(path)

    def count(self, texts: list[str]) -> list[int]:
        get, out = self.counts.__getitem__, []
        for text in texts:
            own = _CUT.split(text) if _NEAR.search(text) else text.split(" ")
            out.append(self.first[own[0]] + sum(map(get, own[1:])) if text else 0)
        return out


def _digest(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"):
    """Returns (counts, additions): doc_id, n_bytes and n_tokens of every row of docs, and the cache rows to append
    (digest binary, tokenizer string, n_tokens long), each distinct missing text encoded once; additions is None if the
    cache has all.

    cache: an earlier table of such rows, of any tokenizers; rows of other versions don't count, and a digest that it
    repeats counts once. The content is normalised as the tokenizer does, which for the byte-level ones is not at all:
    texts that differ in one byte have digests of their own. A null text counts as the empty one, of no tokens. Repeated
    rows and repeated or null ids each get a row. Other columns are ignored; an empty table gives empty results."""
    scratch, ver = Scratch(docs.sparkSession, "tokens"), version(tokenizer_path)
    seen = scratch.keep(docs.select(F.col(id_col).alias("doc_id"), _digest(text_col).alias("digest"),
                                    F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")), "digests")
    one = seen.groupBy("digest").agg(F.min("doc_id").alias("own"), F.count("*").alias("n"))
    if cache is None:
        stored = one.withColumn("n_tokens", F.lit(None).cast("long"))
    else:
        known = cache.where(F.col("tokenizer") == ver).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        stored = one.join(known, "digest", "left")
    stored = scratch.keep(stored, "distinct")
    misses = stored.where("n_tokens is null").select("digest", "own")
    distinct, missing, rows = stored.agg(F.count("*"), F.count(F.when(F.col("n_tokens").isNull(), 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    additions = None
    if missing:
        texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", _digest("text"))
        # The rows to encode, or else those to leave out, whichever list is short enough to send to all tasks.
        match = [F.col("digest") == F.col("m_digest"), F.col("doc_id").eqNullSafe(F.col("m_id"))]
        if rows - missing <= 200_000:
            owners = stored.select("digest", "own", F.col("n_tokens").isNull().alias("miss"), "n")
            left = attach(seen, owners, ["digest"], distinct, rows, 200_000).where(~(F.col("miss") & F.col("doc_id").eqNullSafe(F.col("own"))))
            texts = texts.join(F.broadcast(left.select(F.col("digest").alias("m_digest"), F.col("doc_id").alias("m_id")).distinct()), match, "left_anti")
        else:
            texts = texts.join(small(misses.select(F.col("digest").alias("m_digest"), F.col("own").alias("m_id")), missing, 200_000), match, "left_semi")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = Counter(tokenizer_path)
            for batch in pieces(batches, 8 << 20):
                yield pa.RecordBatch.from_arrays([batch["digest"], pa.array(counter.count(batch["text"].to_pylist()), pa.int64())], names=["digest", "n_tokens"])

        # Rows that repeat both id and text are encoded again, and meet here.
        new = texts.select("digest", "text").mapInArrow(encode, "digest binary, n_tokens long").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
        additions = scratch.keep(new.select("digest", F.lit(ver).alias("tokenizer"), "n_tokens"), "additions")
        found = stored.select("digest", "n", F.col("n_tokens").alias("old")).join(additions.select("digest", "n_tokens"), "digest", "left")
        stored = scratch.keep(found.select("digest", "n", F.coalesce("old", "n_tokens").alias("n_tokens")), "counts")
    counts = attach(seen, stored.select("digest", "n", "n_tokens"), ["digest"], distinct, rows, 200_000)
    return counts.select("doc_id", "n_bytes", "n_tokens"), additions


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame | None:
    """The rows (digest, tokenizer, n_tokens) appended so far; None before the first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("digest binary, n_tokens long, tokenizer string, batch string").parquet(cache_path).select("digest", "tokenizer", "n_tokens")


def append(additions: DataFrame | None, cache_path: str) -> None:
    """Adds new rows to the cache, in a batch folder of their own below their version's. Jobs that append at the same time
    don't meet; digests that two of them add, or rows that a failed one left, count once when the cache is read."""
    if additions is not None:
        additions.withColumn("batch", F.lit(uuid.uuid4().hex)).write.mode("append").partitionBy("tokenizer", "batch").parquet(cache_path)


def cached_counts(docs: DataFrame, tokenizer_path: str, cache_path: str) -> DataFrame:
    """count_tokens' counts against the cache at cache_path, to which what it lacked is appended."""
    counts, additions = count_tokens(docs, tokenizer_path, read_cache(docs.sparkSession, cache_path))
    append(additions, cache_path)
    return counts


def op9_token_counts(spark: SparkSession, sf_dir: str, cache_path: str | None = None) -> DataFrame:
    """The cache lies in the shared folder, for this and later runs."""
    counts = cached_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache_path or f"{shared_dir(spark)}/tidewater-token-cache")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
