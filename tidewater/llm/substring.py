"""Substring dedup by De Bruijn compaction.

The k-mers of words (k = WINDOW) are the edges of a De Bruijn graph; a document is a walk over them. The job finds the
edges that also lie in a document with a smaller id:

1. Anchors. Each edge has an anchor, the least hash among its shorter ANCHOR-word grams; equal edges have equal anchors,
   and neighbours mostly share one. Only anchors are shuffled, about a fifth of the words. Those found in two documents
   or more go into a bit filter. It is sized by their number up to FILTER_BITS; beyond that it lets more edges through
   and costs more, but loses none.
2. Copies. Consecutive edges that pass the filter are cut into pieces where an edge's hash ends in zeros, so in all copies
   at the same places. A join marks every later copy of a piece, known by the hash of its edges and a digest of its words,
   so that of many copies one goes on.
3. Graph. The edges of what is left that several documents have are the repeated edges. Aggregations count how many
   repeated edges lead into and out of their nodes, and a walk's runs of edges with no branching node between them, on one
   diagonal to their source, are compacted to paths.
4. Verification. The words of each path are compared with those at its source coordinates, by 128-bit digests of both. The
   edges of paths that differ (hashes that collided) are told apart by the digests of their own words.

The marked spans, with source coordinates, meet their documents again to be cut out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import Scratch, WordHashes, attach, dense, mix, pieces, read_table, signed, small, texts, window_hashes

WINDOW = 13
ANCHOR = 5
#: log2 of the most bits of the anchor filter that goes to every task (32 MB).
FILTER_BITS = 28
#: A piece is cut at one edge in 2 ** CUT_BITS.
CUT_BITS = 4


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    out, width = h, 1
    while width < n:
        step = min(width, n - width)
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out


def _edges(split: list[list[bytes]], memo: WordHashes, window: int, hash_bits: int = 64):
    """Of all edges of documents, given as words: hash, anchor, document's number, first word."""
    size = np.array([len(w) for w in split], np.int64)
    h = memo.of([x for w in split for x in w])
    if len(h) < window:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    doc = np.repeat(np.arange(len(split)), size)
    short = min(ANCHOR, window)
    whole = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
    own = doc[whole]
    edges = window_hashes(h, window)[whole]
    if hash_bits < 64:
        edges &= np.uint64((1 << hash_bits) - 1)
    return edges, _least(window_hashes(h, short), window - short + 1)[whole], own, whole - (np.cumsum(size) - size)[own]


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, low, high): the smallest and largest id that a batch has the anchor in."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in pieces(batches, 4 << 20):
            ids = batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
            _, anchor, doc, _ = _edges([t.split() for t in texts(batch["text"])], memo, window)
            if len(anchor):
                # Neighbours mostly share their anchor.
                new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
                anchor, owner = anchor[new], ids[doc[new]]
                order = np.argsort(anchor)
                anchor, owner = anchor[order], owner[order]
                first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchor[first])), pa.array(np.minimum.reduceat(owner, first)), pa.array(np.maximum.reduceat(owner, first))],
                    names=["anchor", "low", "high"])

    return docs.mapInArrow(scan, "anchor long, low long, high long")


def _pieces(docs: DataFrame, bits, window: int, hash_bits: int) -> DataFrame:
    """(piece, check, doc_id, start, edges): the runs of edges whose anchors pass the filter, cut by content."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, filled = WordHashes(), bits.value
        mask = np.uint64(len(filled) * 8 - 1)
        for batch in pieces(batches, 4 << 20):
            split = [t.split() for t in texts(batch["text"])]
            edge, a, doc, at = _edges(split, memo, window, hash_bits)
            a &= mask
            on = np.flatnonzero(filled[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8) & 1)
            if not len(on):
                continue
            edge, doc, at = edge[on], doc[on], at[on]
            cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (edge[1:] & np.uint64((1 << CUT_BITS) - 1) == 0))))
            size, doc, at = np.diff(np.append(cut, len(edge))), doc[cut], at[cut]
            piece = mix(np.add.reduceat(mix(edge), cut) + size.astype(np.uint64))
            check = [xxh3_64_intdigest(b" ".join(split[d][s:e])) for d, s, e in zip(doc.tolist(), at.tolist(), (at + size + window - 1).tolist())]
            ends = np.append(cut, len(edge)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(piece)), pa.array(signed(np.array(check, np.uint64))), batch["doc_id"].take(pa.array(doc)), pa.array(at), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(edge)))],
                names=["piece", "check", "doc_id", "start", "edges"])

    return docs.mapInArrow(scan, "piece long, check long, doc_id long, start long, edges array<long>")


def _digests(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, start, words, digest): 128-bit digests of the words of documents (doc_id, text) at wanted (id, start, words)."""
    by_id = scratch.keep(wanted.distinct().groupBy("id").agg(F.collect_list(F.struct("start", "words")).alias("at")), "wanted")
    own = docs.join(small(by_id.select(F.col("id").alias("doc_id")), by_id.count()), "doc_id", "left_semi")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20):
            row, start, words, digest = [], [], [], []
            for i, text in enumerate(texts(batch["text"])):
                split = text.split()
                for x in batch["at"][i].as_py():
                    row.append(i)
                    start.append(x["start"])
                    words.append(x["words"])
                    digest.append(xxh3_128_digest(b" ".join(split[x["start"] : x["start"] + x["words"]])))
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(words, pa.int64()), pa.array(digest, pa.binary())],
                                             names=["id", "start", "words", "digest"])

    met = own.join(by_id, F.col("doc_id") == F.col("id")).select("id", "at", "text")
    # Rows that repeat an id with other texts have further digests; one row for each.
    return scratch.keep(met.mapInArrow(scan, "id long, start long, words long, digest binary").distinct(), "digests")


def _compacted(met: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(doc_id, start, edges, source, source_start, words): paths of repeated edges met (edge, doc_id, start, source,
    source_start) in documents after their source, without a branching node inside."""
    walk = W.partitionBy("doc_id").orderBy("start", "edge")
    after = F.when(F.lead("start").over(walk) == F.col("start") + 1, F.lead("edge").over(walk))
    before = F.when(F.lag("start").over(walk) == F.col("start") - 1, F.lag("edge").over(walk))
    linked = scratch.keep(met.withColumn("after", after).withColumn("before", before), "linked")
    degrees = linked.groupBy("edge").agg(*(f(c).alias(f"{n}_{c}") for c in ("after", "before") for n, f in (("low", F.min), ("high", F.max))))
    out, in_ = F.col("low_after") < F.col("high_after"), F.col("low_before") < F.col("high_before")
    forks = scratch.keep(degrees.where(out | in_).select("edge", F.coalesce(out, F.lit(False)).alias("forks"), F.coalesce(in_, F.lit(False)).alias("joins")), "forks")
    told = linked.join(small(forks, forks.count()), "edge", "left").where(F.col("doc_id") > F.col("source"))
    diagonal = F.col("source_start") - F.col("start")
    told = told.select("*", F.lag(F.struct("start", "source", diagonal.alias("diagonal"), F.coalesce("forks", F.lit(False)).alias("forks"))).over(walk).alias("last"))
    same = (F.col("last.start") == F.col("start") - 1) & (F.col("last.source") == F.col("source")) & (F.col("last.diagonal") == diagonal) & ~F.col("last.forks") & ~F.coalesce("joins", F.lit(False))
    told = told.withColumn("path", F.sum(F.when(same, 0).otherwise(1)).over(walk))
    paths = told.groupBy("doc_id", "path").agg(F.min("start").alias("start"), F.count("*").alias("edges"), F.first("source").alias("source"), F.min("source_start").alias("source_start"))
    return paths.select("doc_id", "start", "edges", "source", "source_start", (F.col("edges") + window - 1).alias("words"))


def _verified(paths: DataFrame, met: DataFrame, docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(doc_id, start, edges, source, source_start): the paths whose words are those at their source's coordinates, and,
    of the others, the edges whose words a smaller document has."""
    place = [F.col(c) for c in ("id", "start", "words")]
    own, sources = paths.select(F.col("doc_id").alias("id"), "start", "words"), paths.select(F.col("source").alias("id"), F.col("source_start").alias("start"), "words")
    digests = _digests(docs, own.unionByName(sources), scratch)
    # A passage in very many documents has one source slice: heavy ones are sent to all tasks.
    by_source = sources.groupBy(*place).agg(F.count("*").alias("n")).join(digests, ["id", "start", "words"]).select(
        F.col("id").alias("source"), F.col("start").alias("source_start"), "words", F.col("digest").alias("want"), "n")
    by_source = scratch.keep(by_source, "by_source")
    n_by, total = by_source.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    told = attach(paths, by_source, ["source", "source_start", "words"], n_by, total).join(
        digests.select(F.col("id").alias("doc_id"), "start", "words", "digest"), ["doc_id", "start", "words"])
    # With repeated ids any text of the id counts.
    told = scratch.keep(told.groupBy("doc_id", "start", "words", "edges", "source", "source_start").agg(F.max(F.col("digest") == F.col("want")).alias("equal")), "told-paths")
    columns = ["doc_id", "start", "edges", "source", "source_start"]
    good, bad = told.where("equal").select(*columns), told.where("not equal")
    if bad.isEmpty():
        return good
    spots = bad.select("doc_id", F.explode(F.sequence("start", F.col("start") + F.col("edges") - 1)).alias("start")).distinct()
    suspects = scratch.keep(met.join(spots, ["doc_id", "start"]).select("edge").distinct(), "suspects")
    held = met.select("edge", F.col("doc_id").alias("id"), "start").join(suspects, "edge").select("id", "start", F.lit(window).cast("long").alias("words"))
    held = _digests(docs, held, scratch)
    first = held.groupBy("digest").agg(F.min("id").alias("source"), F.min_by("start", "id").alias("source_start"), F.max("id").alias("high")).where("source < high").drop("high")
    again = held.join(first, "digest").where(F.col("id") > F.col("source")).select(F.col("id").alias("doc_id"), "start", F.lit(1).cast("long").alias("edges"), "source", "source_start")
    return good.unionByName(again)


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """(doc_id, start, edges, source, source_start): runs of `edges` windows from word `start` on, each of which also
    starts in the document `source`, which has a smaller id (from word source_start on).

    Ids are whole numbers. Null texts have no words; rows with a null id take no part. Rows that repeat an id are one
    document: their texts don't mark each other. Other columns are ignored. What is found by hashes of hash_bits (fewer
    find more to tell apart, and the same spans) is verified by digests of the words: whole pieces by 64 bits besides the
    64 of their edges' hashes, paths and single edges by 128 bits."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    shared = _anchors(docs, window).groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("anchor")
    shared = scratch.keep(shared, "anchors")
    bits = min(FILTER_BITS, max(16, (16 * shared.count()).bit_length()))
    at = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1))
    filled = dense(shared.select(at.alias("i"), F.lit(1).cast("long").alias("v")).distinct(), bits, np.uint8, as_bits=True)
    scratch.drop(shared)

    cut = _pieces(docs, spark.sparkContext.broadcast(filled), window, hash_bits)
    sources = scratch.keep(cut.groupBy("piece").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("source"), F.min_by("start", "doc_id").alias("source_start"),
        F.min_by("check", "doc_id").alias("source_check")).where("n > 1").drop("n"), "sources")
    later = (F.col("doc_id") > F.col("source")) & (F.col("check") == F.col("source_check"))
    told = scratch.keep(cut.join(sources, "piece", "left").select(
        "doc_id", "start", F.when(later, F.lit(None)).otherwise(F.col("edges")).alias("edges"), F.size("edges").cast("long").alias("n"),
        F.when(later, F.col("source")).alias("source"), F.when(later, F.col("source_start")).alias("source_start")), "told")
    scratch.drop(sources)
    copied = told.where("source is not null").select("doc_id", "start", F.col("n").alias("edges"), "source", "source_start")
    opened = told.where("source is null").select("doc_id", "start", F.posexplode("edges").alias("i", "edge")).select("edge", "doc_id", (F.col("start") + F.col("i")).alias("start"))
    first = opened.groupBy("edge").agg(
        F.min("doc_id").alias("source"), F.max("doc_id").alias("high"), F.min_by("start", "doc_id").alias("source_start")).where("source < high").drop("high")
    met = scratch.keep(opened.join(scratch.keep(first, "first"), "edge"), "repeated")
    paths = scratch.keep(_compacted(met, window, scratch), "paths")
    return copied.unionByName(_verified(paths, met, docs, window, scratch))


def _cut(docs: DataFrame, spans: DataFrame, window: int, kind: str) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept): documents without the words that the spans' windows cover."""
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "edges")).alias("spans"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 8 << 20):
            total, removed, kept = [], [], []
            for text, spans in zip(texts(batch["text"]), batch["spans"]):
                words = text.split()
                n = len(words)
                total.append(n)
                if spans.is_valid:
                    own = spans.values
                    edge = np.zeros(n + 1, np.int64)
                    begin = own.field("start").to_numpy()
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, np.minimum(begin + own.field("edges").to_numpy() + window - 1, n), -1)
                    stay = np.flatnonzero(np.cumsum(edge[:n]) == 0)
                    words = [words[k] for k in stay.tolist()]
                removed.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text"], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "text", "n_words", "n_removed", "kept"])

    return docs.join(by_doc, "doc_id", "left").mapInArrow(scan, f"doc_id {kind}, text string, n_words long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row of docs; see repeated_spans.

    A null text has no words and keeps ''. Rows with a null id keep all their words. Rows that repeat an id each lose
    what spans of that id cover, which for copies is the same. An empty table gives an empty result."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _cut(docs, repeated_spans(docs, window, hash_bits=hash_bits), window, dict(docs.dtypes)["doc_id"]).drop("text")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM split WHERE len(w) >= 13)),
first AS (SELECT s, min(doc_id) AS m FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM windows JOIN first USING (s) WHERE doc_id > m),
words AS (SELECT doc_id, k, w[k] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM split)),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS t, count(*) AS n
  FROM words LEFT JOIN gone USING (doc_id, k) WHERE gone.doc_id IS NULL GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""
