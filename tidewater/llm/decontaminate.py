"""Benchmark decontamination with suffix arrays over the training text.

Every Arrow batch of documents is a shard. The task builds the shard's suffix array over words, binary-searches every
suffix of the benchmark items in it, and so gets each suffix's longest verbatim match and its locations. Words that no
item uses cannot lie in a match: they end the runs of words that the array is built over, and a run too short to hold
a window is left out. Documents need no shuffle: each batch holds whole documents. The benchmark is read in blocks of
at most BLOCK_BYTES, each sent to all tasks and released before the next; further blocks are further passes over the
same rows, each written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, by_place, pieces, read_table, texts

WINDOW = 10
#: Most bytes of benchmark text that one pass sends to every task.
BLOCK_BYTES = 16 << 20

#: Letters and digits keep their place (A-Z lower-cased), bytes from 0x80 on too; all others part words.
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of codes in order of their first `depth` codes at least (prefix doubling)."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    n, length = len(codes), 1
    while length < depth and n:
        ahead = np.zeros(n, np.int64)
        ahead[: n - length] = rank[length:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        step = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = step
        length *= 2
        if n and step[-1] == n - 1:
            break
    return order


class Items:
    """Benchmark items as codes: words numbered from 1, items laid end to end with 0 between them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        split = [(i, w) for i, t in items if (w := words(t))]
        self.code = {w: k for k, w in enumerate(sorted({x for _, ws in split for x in ws}), 1)}
        self.ids = np.array([i for i, _ in split], dtype=object)
        self.seq = np.array([c for _, ws in split for c in (*(self.code[x] for x in ws), 0)], np.int32)
        length = np.array([len(ws) for _, ws in split], np.int64)
        begin = np.concatenate(([0], np.cumsum(length + 1)[:-1])).astype(np.int64) if split else np.empty(0, np.int64)
        #: Of each suffix: its start in seq, item, words to the item's end, and words that must match (0: not a window's start).
        self.start = np.concatenate([np.arange(b, b + n) for b, n in zip(begin, length)] or [np.empty(0, np.int64)])
        self.item = np.repeat(np.arange(len(split)), length)
        self.left = np.repeat(begin + length, length) - self.start
        full = np.repeat(np.minimum(length, window), length)
        self.need = np.where(self.left >= full, full, 0)
        self.shortest = int(np.minimum(length, window).min()) if split else 0
        self.longest = int(length.max()) if split else 0
        self.padded = np.concatenate([self.seq, np.zeros(self.longest + 1, np.int32)])

    def lengths(self, codes: np.ndarray, at: np.ndarray, most: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Words that suffix of[i] of the items and suffix at[i] of codes (zero-padded) share, up to most[i]."""
        same, live = np.zeros(len(at), np.int64), np.arange(len(at))
        while len(live):
            live = live[same[live] < most[live]]
            live = live[codes[at[live] + same[live]] == self.padded[self.start[of[live]] + same[live]]]
            same[live] += 1
        return same

    def bound(self, codes: np.ndarray, order: np.ndarray, need: np.ndarray, of: np.ndarray, after: bool) -> np.ndarray:
        """Binary search: the first place in order whose suffix is not below (after: above) the item suffix's first need words."""
        low, high = np.zeros(len(of), np.int64), np.full(len(of), len(order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            at, own = order[mid], of[open_]
            same = self.lengths(codes, at, need[open_], own)
            full = same >= need[open_]
            k = np.minimum(same, np.maximum(need[open_] - 1, 0))
            below = ~full & (codes[at + k] < self.padded[self.start[own] + k])
            right = below | (full & after)
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        return low

    def search(self, docs: list[bytes]):
        """Per document its number of words, and for all: (document, item suffix, word offset, match length) of each
        suffix's longest matches and (document, item, first word, words) of each occurrence of a window."""
        counts, codes, owner, offset = [], [], [], []
        get = self.code.get
        for d, text in enumerate(docs):
            ws = words(text)
            counts.append(len(ws))
            if not self.code or not ws:
                continue
            c = np.fromiter((get(w, 0) for w in ws), np.int32, len(ws))
            edge = np.flatnonzero(np.diff(np.concatenate(([0], c != 0, [0]))))
            for b, e in zip(edge[::2], edge[1::2]):
                if e - b >= self.shortest:
                    codes += [c[b:e], np.zeros(1, np.int32)]
                    owner += [np.full(e - b + 1, d)]
                    offset += [np.arange(b, e + 1)]
        if not codes:
            none = np.empty(0, np.int64)
            return counts, (none,) * 4, (none,) * 5
        codes, owner, offset = np.concatenate(codes), np.concatenate(owner), np.concatenate(offset)
        order = suffix_array(codes, self.longest)
        codes = np.concatenate([codes, np.zeros(self.longest + 1, np.int32)])
        every = np.arange(len(self.start))
        place = self.bound(codes, order, self.left, every, False)
        near = [self.lengths(codes, order[np.clip(p, 0, len(order) - 1)], self.left, every) for p in (place - 1, place)]
        longest = np.maximum(*near)
        hit = np.flatnonzero(longest > 0)
        at = order[np.clip(np.where(near[1] >= near[0], place, place - 1), 0, len(order) - 1)][hit]
        longest_matches = owner[at], hit, offset[at], longest[hit]
        own = np.flatnonzero((self.need > 0) & (longest >= self.need))
        first = self.bound(codes, order, self.need[own], own, False)
        last = self.bound(codes, order, self.need[own], own, True)
        n = last - first
        at = order[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        own = np.repeat(own, n)
        return counts, longest_matches, (owner[at], self.item[own], offset[at], self.need[own], self.start[own])


def longest_runs(doc, item, first, size, place) -> dict[int, tuple[int, int, int, int]]:
    """doc -> (words, first word, item, item's word in seq) of its longest verbatim match: occurrences of windows that
    follow one another in both texts are one match; ties go to the earlier word, then the earlier item."""
    order = np.lexsort((first, first - place, item, doc))
    doc, item, first, size, place = (x[order] for x in (doc, item, first, size, place))
    new = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(first - place) != 0) | (np.diff(first) != 1))) if len(doc) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(doc)) - 1 if len(doc) else begin
    words = first[end] + size[end] - first[begin]
    out = {}
    for d, n, f, i, p in sorted(zip(doc[begin].tolist(), (-words).tolist(), first[begin].tolist(), item[begin].tolist(), place[begin].tolist())):
        out.setdefault(d, (-n, f, i, p))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    """The items by block (one empty block, if there are none); a streaming read, so that the driver holds one block's texts."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).where("t is not null")
    block, room = [], BLOCK_BYTES
    for r in rows.orderBy("i", "t").toLocalIterator():
        if len(r.t) > room and block:
            yield block
            block, room = [], BLOCK_BYTES
        block.append((r.i if r.i is not None else "", bytes(r.t)))
        room -= len(r.t)
    yield block


_RUNS = "array<struct<first: long, words: long>>"
_LONGEST = "struct<words: long, first: long, item: string>"


def _found(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """docs (columns c0, c1, ...) with n_words, hits, items and longest."""
    spark = docs.sparkSession
    runs = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
    longest = pa.struct([("words", pa.int64()), ("first", pa.int64()), ("item", pa.string())])
    schema = "".join(f"{n} {t}, " for n, t in docs.dtypes) + f"n_words long, hits {_RUNS}, items array<string>, longest {_LONGEST}"
    out = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.expr(f"cast(array() as {_RUNS})").alias("hits"),
                      F.expr("cast(array() as array<string>)").alias("items"), F.expr(f"cast(null as {_LONGEST})").alias("longest"))
    scratch, kept, sent = Scratch(spark, "decontaminate"), None, None
    for block in _blocks(benchmark, item_col, item_text_col):
        if sent is not None:
            # One block at a time: what the last one found is written before it is released.
            written = scratch.keep(out, "found")
            sent.destroy()
            scratch.drop(kept)
            out = kept = written
        sent = spark.sparkContext.broadcast(Items(block, window))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                counts, _, (doc, item, first, size, place) = sent.value.search(texts(batch[text_col]))
                ids = sent.value.ids
                old_hits, old_items, old_best = batch["hits"], batch["items"], batch["longest"]
                best = {d: {"words": n, "first": f, "item": ids[i]} for d, (n, f, i, _) in longest_runs(doc, item, first, size, place).items()}
                hits, items = [[] for _ in counts], [set() for _ in counts]
                for d, i, f, n in zip(doc.tolist(), ids[item].tolist(), first.tolist(), size.tolist()):
                    hits[d].append((f, f + n))
                    items[d].add(i)
                merged, names, most = [], [], []
                for d, own in enumerate(hits):
                    own += [(x["first"], x["first"] + x["words"]) for x in old_hits[d].as_py()] if len(old_hits[d]) else []
                    union: list[list[int]] = []
                    for b, e in sorted(set(own)):
                        if union and b <= union[-1][1]:
                            union[-1][1] = max(union[-1][1], e)
                        else:
                            union.append([b, e])
                    merged.append([{"first": b, "words": e - b} for b, e in union])
                    names.append(sorted(items[d] | set(old_items[d].as_py())))
                    both = [x for x in (old_best[d].as_py(), best.get(d)) if x]
                    most.append(min(both, key=lambda x: (-x["words"], x["first"], x["item"]), default=None))
                kept = [c for c in batch.schema.names if c not in ("n_words", "hits", "items", "longest")]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c] for c in kept), pa.array(counts, pa.int64()), pa.array(merged, runs), pa.array(names, pa.list_(pa.string())), pa.array(most, longest)],
                    names=[*kept, "n_words", "hits", "items", "longest"])

        out = out.mapInArrow(scan, schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs with n_words int, hits array<struct<first, words>> (merged runs of words that windows of items cover), items
    array<string> (sorted ids of items of which a window occurs) and longest struct<words, first, item> (the longest
    verbatim match of a window or more, its first word and its item; ties go to the earlier word, then the smaller item
    id; null without hits).

    A window is `window` consecutive words of an item, or the whole of a shorter one. Null and empty texts have no words
    and no hits; an item without words, or an empty benchmark, hits nothing. Repeated rows are judged alike, each for
    itself; repeated item ids count once. A null item id counts as ''. All columns of docs stay, in their order, but for
    columns of the four new names, which the new ones replace."""
    plain, name = by_place(docs)
    new = ("n_words", "hits", "items", "longest")
    stay = [i for i, c in enumerate(docs.columns) if c.lower() not in new]
    out = _found(plain, benchmark, window, name(text_col), item_col, item_text_col)
    return out.select(*(f"c{i}" for i in stay), *new).toDF(*(docs.columns[i] for i in stay), *new)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """For each shard and item suffix the longest verbatim match of `least` words or more: item_id, item_offset,
    match_words, doc_id, doc_offset. Offsets count words. Null texts have no words; ties go to the earlier suffix in
    the shard's suffix array."""
    spark = docs.sparkSession
    out = None
    for block in _blocks(benchmark, "item_id", "text"):
        sent = spark.sparkContext.broadcast(Items(block, least))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in pieces(batches):
                _, (doc, suffix, at, n), _ = own.search(texts(batch["text"]))
                far = np.flatnonzero(n >= least)
                ids = batch["doc_id"].take(pa.array(doc[far]))
                begin = np.searchsorted(own.item, own.item)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.ids[own.item[suffix[far]]].tolist(), pa.string()), pa.array(suffix[far] - begin[suffix[far]]), pa.array(n[far]), ids, pa.array(at[far])],
                    names=["item_id", "item_offset", "match_words", "doc_id", "doc_offset"])

        kind = dict(docs.dtypes)[id_col]
        part = docs.select(F.col(id_col).alias("doc_id"), "text").mapInArrow(
            scan, f"item_id string, item_offset long, match_words long, doc_id {kind}, doc_offset long")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of an item occurs, with the columns of docs, whatever their names.

    Rows with a null or empty text stay, as do all rows if the benchmark is empty; repeated rows stay or go together."""
    plain, name = by_place(docs)
    found = _found(plain, benchmark, window, name("text"), "item_id", "text")
    return found.where(F.size("hits") == 0).select(*plain.columns).toDF(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
                        F.coalesce("longest.words", F.lit(0)).alias("longest_words"), F.col("longest.first").alias("longest_first"), F.col("longest.item").alias("longest_item"))


ORACLE = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
docs AS (SELECT doc_id, coalesce(w, []) AS w FROM folded),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, i AS j, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, j, p.n FROM places p JOIN windows USING (n, s)),
matches AS (
  SELECT doc_id, CAST(item_id AS VARCHAR) AS item, min(i) - 1 AS f, max(i) - min(i) + n AS m
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, n, i - j ORDER BY i) AS g FROM hits) GROUP BY doc_id, item_id, n, i - j, g),
longest AS (SELECT doc_id, item, f, m FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, f, item) AS r FROM matches) WHERE r = 1),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(m, 0) AS BIGINT) AS longest_words, CAST(f AS BIGINT) AS longest_first, item AS longest_item
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
