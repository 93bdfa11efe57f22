"""N-gram Jaccard self-join with vertical partitioning.

Documents with equal n-gram sets are one node from the start. The global n-gram order (rarer n-grams first, by a
frequency sketch of fixed size, ties by hash) gives each node a prefix that must share an n-gram with the prefix of
any node it links with. The order is cut into fragments: the rarest n-grams, among which are the edits of near copies, and
two halves of the others. Each candidate pair's overlap is counted fragment by fragment and summed per pair, which is exact.
Before that, candidates whose bitmaps differ in too many bits are left out: each bit that one set has alone stands for an
n-gram, or more, that the other lacks, so that no link is lost, and fragments are moved for near enough pairs only.
Nodes with very many pairs have copies of their bitmaps and fragments, so that their pairs share out.

Candidates come in two rounds, so that a group of near copies doesn't cost a pair for every two of its members. Round
one tries each member of an n-gram's posting list with the one before it and with the first, the least edited member
(as many pairs as members). Lists of common n-grams are cut into parts, whose first members meet likewise. Round two takes
every pair of a posting list of near enough sizes whose members round one left in different components, so that no link
that could join two components is missed, and keeps those whose prefixes share enough n-grams. The order and the sketch decide the cost only, never the result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from xxhash import xxh3_128_digest

from .common import Scratch, WordHashes, dense, pieces, read_table, signed, small, texts, window_hashes
from .components import components

WORDS = 5
#: Similarity as a ratio of whole numbers: linked if PART * union <= WHOLE * intersection.
PART, WHOLE = 80, 100
#: Fragments of the order.
FRAGMENTS = 3
#: log2 of the frequency sketch's counters.
SKETCH_BITS = 20
#: log2 of the members, about, of a part of a posting list.
PART_BITS = 13
#: Pairs of one node from which on it has copies.
HUB = 4096
#: Bits of a set's bitmap for each of its n-grams, at least; up to twice as many make it a power of two.
BITS = 2


def gram_set(text: bytes, memo: WordHashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text, or of its whole sequence of words if there are fewer."""
    h = memo.of(text.lower().split())
    return np.unique(window_hashes(h, min(n, len(h)))) if len(h) else np.empty(0, np.uint64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """The set's bitmap as longs: the lowest bits of its hashes. The one of half the width is the OR of its halves."""
    width = 1 << max(6, (BITS * len(s) - 1).bit_length())
    bits = np.zeros(width if len(s) else 0, bool)
    bits[s.astype(np.int64) & (width - 1)] = True
    return np.packbits(bits, bitorder="little").view(np.int64)


def _digests(docs: DataFrame, kind: str) -> DataFrame:
    """A row (doc_id, n_shingles, digest, bits) per document, and rows (bucket, seen) of n-grams that a batch holds twice."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in pieces(batches, 16 << 20):
            sets = [gram_set(t, memo) for t in texts(batch["text"])]
            grams, seen = np.unique(np.concatenate(sets or [np.empty(0, np.uint64)]), return_counts=True)
            bucket = (grams[seen > 1] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            seen = seen[seen > 1]
            buckets, at = np.unique(bucket, return_inverse=True)
            sums = np.bincount(at, seen, len(buckets)).astype(np.int64)
            n, m = batch.num_rows, len(buckets)
            bits = [bitmap(s) for s in sets]
            ends = np.cumsum([0, *map(len, bits)])
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([batch["doc_id"], pa.nulls(m, batch["doc_id"].type)]),
                pa.array([len(s) for s in sets] + [None] * m, pa.int64()),
                pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets] + [None] * m, pa.binary()),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(buckets)]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(sums)]),
                pa.ListArray.from_arrays(pa.array(np.append(ends, np.full(m, ends[-1])).astype(np.int32)), pa.array(np.concatenate(bits or [np.empty(0, np.int64)]))),
            ], names=["doc_id", "n_shingles", "digest", "bucket", "seen", "bits"])

    return docs.mapInArrow(scan, f"doc_id {kind}, n_shingles long, digest binary, bucket long, seen long, bits array<long>")


def _prefixes(docs: DataFrame, weight, kind: str) -> DataFrame:
    """Posting rows (gram, parts, doc_id, size, at) of each document's prefix in the global order; parts: into how many the
    n-gram's list is cut."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in pieces(batches, 16 << 20):
            grams, row, size, at, parts = [], [], [], [], []
            for i, text in enumerate(texts(batch["text"])):
                s = gram_set(text, memo)
                n = len(s)
                if n:
                    keep = n - -(-PART * n // WHOLE) + 1
                    w = weight.value[s >> np.uint64(64 - SKETCH_BITS)]
                    order = np.argsort(w, kind="stable")[:keep]
                    grams.append(s[order])
                    parts.append(w[order])
                    row.append(np.full(keep, i))
                    size.append(np.full(keep, n))
                    at.append(np.arange(keep))
            if grams:
                cut = np.int64(1) << np.maximum(np.concatenate(parts).astype(np.int64) - PART_BITS, 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(grams))), pa.array(cut), batch["doc_id"].take(pa.array(np.concatenate(row))), pa.array(np.concatenate(size)), pa.array(np.concatenate(at))],
                    names=["gram", "parts", "doc_id", "size", "at"])

    return docs.mapInArrow(scan, f"gram long, parts long, doc_id {kind}, size long, at long")


def fragment_ends(mass: dict[int, int]) -> np.ndarray:
    """Places in the order (weight in the highest 8 bits, then the hash) at which fragments end, but the last: after the
    weight 0, and where the n-grams of other weights (mass: how many by weight; hashes spread evenly) are cut into halves."""
    goal, before = sum(n for w, n in mass.items() if w) / 2, 0
    for w, n in sorted(mass.items()):
        if w and before + n >= goal:
            return np.array([1 << 56, (w << 56) + min((1 << 56) - 1, int((goal - before) / n * (1 << 56)))], np.uint64)
        before += n if w else 0
    return np.array([1 << 56, 1 << 63], np.uint64)


def _segments(docs: DataFrame, weight, ends: np.ndarray, kind: str) -> DataFrame:
    """Rows (doc_id, f0, f1, ...): each document's n-grams in each fragment of the order."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in pieces(batches, 16 << 20):
            sets, cuts = [], []
            for text in texts(batch["text"]):
                s = gram_set(text, memo)
                place = weight.value[s >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
                order = np.argsort(place, kind="stable")
                sets.append(s[order])
                cuts.append(np.concatenate(([0], np.searchsorted(place[order], ends), [len(s)])))
            columns = []
            for f in range(FRAGMENTS):
                own = [signed(s[c[f] : c[f + 1]]) for s, c in zip(sets, cuts)]
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32)), pa.array(np.concatenate(own))))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", *(f"f{f}" for f in range(FRAGMENTS))])

    return docs.mapInArrow(scan, f"doc_id {kind}" + "".join(f", f{f} array<long>" for f in range(FRAGMENTS)))


def _possible(n_x, at_x, shared_x, n_y, at_y, shared_y):
    """Whether two sets that share the n-gram at these places of their orders can be similar enough.

    Common n-grams before it lie in both prefixes, so among those that other prefixes hold too; after it there are at
    most as many as the shorter rest has."""
    most = F.least(shared_x, shared_y) + F.least(n_x - at_x, n_y - at_y)
    return _enough(most, n_x, n_y)


def _hubs(pairs: DataFrame, side: str, scratch: Scratch) -> DataFrame | None:
    """(side, copies): ids with more than HUB pairs, so many copies of which share them out; None if there are none."""
    hubs = scratch.keep(pairs.groupBy(side).agg(F.ceil(F.count("*") / HUB).cast("long").alias("copies")).where("copies > 1"), "hubs")
    n = hubs.count()
    return small(hubs, n) if n else None


def _meet(pairs: DataFrame, sets: DataFrame, side: str, column: str, hubs: DataFrame | None) -> DataFrame:
    """pairs with g<side>: the column of sets (a bitmap, a fragment) for the id in `side`. Pairs of a hub go to copies of its row."""
    own = sets.select(F.col("doc_id").alias(side), F.col(column).alias(f"g{side}"))
    if hubs is None:
        return pairs.join(own, side)
    copies, other = F.coalesce("copies", F.lit(1).cast("long")), "b" if side == "a" else "a"
    own = own.join(hubs, side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("copies")
    salted = pairs.join(hubs, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), copies)).drop("copies")
    return salted.join(own, [side, "salt"]).drop("salt")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()


def _enough(most, n_a, n_b):
    """Whether sets of these sizes are similar enough if they share as many n-grams as `most`."""
    return most * (WHOLE + PART) >= (n_a + n_b) * PART


def _near_bits(na, nb, ga, gb):
    """Whether sets with these sizes and bitmaps can be similar enough. Sizes within PART / WHOLE have widths of a factor of
    two at most, and the wider bitmap is folded once."""

    def folded(x, y):
        half = F.shiftright(F.size(x), 1)
        return F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseOR(q))).otherwise(x)

    def alone(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda n, k: n + k)

    x, y = folded(ga, gb), folded(gb, ga)
    return (F.least(na, nb) * WHOLE >= F.greatest(na, nb) * PART) & _enough(F.least(na - alone(x, y), nb - alone(y, x)), na, nb)


def _verified(pairs: DataFrame, docs: DataFrame, bits: DataFrame, weight, ends: np.ndarray, kind: str, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of pairs (a, b, na, nb) that are similar enough: of those that their bitmaps (doc_id, bits) leave,
    partial overlaps by fragment, summed per pair.

    Fragments go one after the other; pairs that couldn't reach the similarity if all n-grams to come were shared drop
    out, and theirs aren't moved any more."""
    hubs = {side: _hubs(pairs, side, scratch) for side in "ab"}
    ids = scratch.keep(_ids(pairs), "ids")
    bits = scratch.keep(bits.join(small(ids, ids.count()), "doc_id", "left_semi"), "bits")
    met = _meet(_meet(pairs, bits, "a", "bits", hubs["a"]), bits, "b", "bits", hubs["b"])
    near = scratch.keep(met.where(_near_bits(*map(F.col, ("na", "nb", "ga", "gb")))).select("a", "b", "na", "nb").distinct(), "near")
    scratch.drop(bits, ids)
    ids = scratch.keep(_ids(near), "ids")
    parts = scratch.keep(_segments(docs.join(small(ids, ids.count()), "doc_id", "left_semi"), weight, ends, kind), "segments")
    # left_a, left_b: n-grams in the fragments to come.
    alive, old = near.select("*", F.lit(0).cast("long").alias("both"), F.col("na").alias("left_a"), F.col("nb").alias("left_b")), near
    for f in range(FRAGMENTS):
        met = _meet(_meet(alive, parts, "a", f"f{f}", hubs["a"]), parts, "b", f"f{f}", hubs["b"])
        met = met.select("a", "b", "na", "nb", (F.col("both") + F.size(F.array_intersect("ga", "gb"))).alias("both"),
                         (F.col("left_a") - F.size("ga")).alias("left_a"), (F.col("left_b") - F.size("gb")).alias("left_b"))
        alive = scratch.keep(met.where(_enough(F.col("both") + F.least("left_a", "left_b"), F.col("na"), F.col("nb"))), "alive")
        scratch.drop(old)
        old = alive
    scratch.drop(parts, ids)
    return alive.select("a", "b")


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_shingles, class_id (the smallest id with the same set) and component_id of every row of docs.

    Words are runs without ASCII white space, A-Z lower-cased. Null texts and texts without words have the empty set,
    link with nothing and are their own class and component. Rows that repeat an id are copies of one document, each with
    a row; rows with a null id count no links and have null class and component. Other columns are ignored. Set sizes and overlaps count 64-bit
    hashes of n-grams."""
    spark = docs.sparkSession
    scratch, kind = Scratch(spark, "ngram"), dict(docs.dtypes)[id_col]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    scanned = scratch.keep(_digests(docs, kind), "digests")
    rows = scanned.where("bucket is null").select("doc_id", "n_shingles", "digest")
    bits = scanned.where("bucket is null").select("doc_id", "bits")
    sketch = scanned.where("bucket is not null").groupBy("bucket").agg(F.sum("seen").alias("seen")).where("seen > 7")
    sketch = scratch.keep(sketch.select(F.col("bucket").alias("i"), F.floor(F.log2("seen")).cast("long").alias("v"), "seen"), "sketch")
    weight = spark.sparkContext.broadcast(dense(sketch.select("i", "v"), SKETCH_BITS, np.uint8))
    mass = {r.v: r.n for r in sketch.groupBy("v").agg(F.sum("seen").alias("n")).collect()}  # 64 rows at most
    ends = fragment_ends(mass)

    classes = rows.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n"))
    classes = scratch.keep(classes.where("n > 1").select("digest", "class_id"), "classes")
    members = rows.join(classes, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
    members = scratch.keep(members, "members")
    copies = members.where("class_id <> doc_id").select("doc_id").distinct()
    single = docs.where("doc_id is not null").join(small(copies, members.where("class_id <> doc_id").count()), "doc_id", "left_anti")

    # Postings that share their n-gram with another prefix, and how many of those each document has before. A list that is
    # cut into parts stays whole here, which only makes the bound a weaker one.
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part")
    in_list = W.partitionBy("gram", "part").orderBy("doc_id")
    met = _prefixes(single, weight, kind).select("*", part).select("*", F.lag("doc_id").over(in_list).alias("before"), F.lead("doc_id").over(in_list).alias("after"))
    met = met.where("before is not null or after is not null or parts > 1").drop("before", "after")
    shared = F.row_number().over(W.partitionBy("doc_id").orderBy("at")).cast("long") - 1
    alone = F.col("size") - F.ceil(F.col("size") * PART / WHOLE) + 1 - F.count("*").over(W.partitionBy("doc_id"))
    posted = scratch.keep(met.select("*", shared.alias("shared"), alone.cast("long").alias("alone")), "postings")
    # Members with the fewest n-grams of their own come first, in all lists alike: the least edited of near copies is the
    # hub, and a member meets much the same neighbours in all of its lists.
    member = F.struct("doc_id", "size", "at", "shared")

    def tried_with_neighbours(rows: DataFrame, *keys: str) -> DataFrame:
        plain = W.partitionBy(*keys).orderBy("alone", "size", "doc_id")
        star = rows.select("*", F.lag(member).over(plain).alias("before"), F.first(member).over(plain).alias("hub"))
        star = star.select("doc_id", "size", "at", "shared", F.explode(F.array("before", "hub")).alias("x")).where(F.col("x").isNotNull() & (F.col("x.doc_id") != F.col("doc_id")))
        return star.where(_possible(*(F.col(c) for c in ("size", "at", "shared", "x.size", "x.at", "x.shared")))).select(
            F.col("x.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("x.size").alias("na"), F.col("size").alias("nb"))

    firsts = F.row_number().over(W.partitionBy("gram", "part").orderBy("alone", "size", "doc_id"))
    heads = posted.where("parts > 1").withColumn("r", firsts).where("r = 1").drop("r")
    star = tried_with_neighbours(posted, "gram", "part").unionByName(tried_with_neighbours(heads, "gram"))
    tried = scratch.keep(_ordered(star).distinct(), "star")
    links = _verified(tried, docs, bits, weight, ends, kind, scratch)
    found = components(links, scratch)

    own = scratch.keep(posted.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
                       .select("gram", "doc_id", "size", "at", "shared", F.coalesce("component", "doc_id").alias("c")), "labelled")
    mixed = own.groupBy("gram").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("gram")
    open_ = scratch.keep(own.join(mixed, "gram"), "open")
    scratch.drop(own, posted)
    # Sizes of a linked pair lie within PART / WHOLE of each other, so in the same class of that width or the next.
    step = F.floor(F.log("size") / np.log(WHOLE / PART)).cast("long")
    x, y = (open_.select("gram", c.alias("step"), *(F.col(k).alias(f"{k}_{s}") for k in ("doc_id", "size", "at", "shared", "c")))
            for s, c in (("x", step), ("y", F.explode(F.sequence(step - 1, step + 1)))))
    cross = x.join(y, (x.gram == y.gram) & (x.step == y.step) & (F.col("doc_id_x") < F.col("doc_id_y")) & (F.col("c_x") != F.col("c_y"))
                   & _possible(*(F.col(f"{k}_{s}") for s in "xy" for k in ("size", "at", "shared"))))
    cross = cross.select(F.col("doc_id_x").alias("a"), F.col("doc_id_y").alias("b"), F.col("size_x").alias("na"), F.col("size_y").alias("nb"))
    # N-grams that both prefixes hold lie in lists that are open, so each gives a row here; after the end of the prefix that
    # ends first in the order, sets share no more than the rest of that one.
    cross = cross.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("met"))
    rest = F.greatest(*(F.ceil(F.col(n) * PART / WHOLE) - 1 for n in ("na", "nb")))
    cross = cross.where(_enough(F.col("met") + rest, F.col("na"), F.col("nb"))).drop("met")
    cross = scratch.keep(cross.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "cross")
    if not cross.isEmpty():
        more = _verified(cross, docs, bits, weight, ends, kind, scratch)
        if not more.isEmpty():
            found = components(links.unionByName(more), scratch)
    found = scratch.keep(found, "components")
    return members.join(found.withColumnRenamed("id", "class_id"), "class_id", "left").select(
        "doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """The pairs with a < b."""
    swap = F.col("a") > F.col("b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"),
                        F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is its component's, and rows without an id; rows that repeat an id stay or go
    together."""
    linked = link_documents(docs)
    gone = linked.where("doc_id <> component_id").select("doc_id").distinct()
    n = linked.where("doc_id <> component_id").count()
    kept = docs.join(small(gone, n), "doc_id", "left_anti")
    return kept.select(*docs.columns)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared_grams AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared_grams JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, sides.b FROM reach JOIN sides ON sides.a = reach.r)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, least(documents.doc_id, m) AS component_id
FROM documents LEFT JOIN sizes ON sizes.doc_id = documents.doc_id
  LEFT JOIN (SELECT doc_id, min(r) AS m FROM reach GROUP BY 1) q ON q.doc_id = documents.doc_id
"""
