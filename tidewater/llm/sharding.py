"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that stays together. Best fit looks at sizes only, so that the driver gets the
groups' sizes with their counts (at most the square root of twice the total bytes, as that many different sizes add up to it) and
packs each run of equal sizes at once: the bin with the tightest remaining capacity, found in a balanced search tree,
takes as many of them as fit, then the next tightest. The result is that of packing every group on its own. The capacity is the
smallest, to within about a ten-thousandth, at which the groups fit into the wanted number of shards. The executors then
number the groups of a size, and a group's number says which bin has it. Only group sizes are shuffled, never texts."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import Scratch, attach, read_table, small

SHARDS = 40
#: Groups of one size, or rows of a shard, that a task numbers at a time, on average.
NUMBERED = 1 << 19


class CapacityTree:
    """Treap of (remaining capacity, bin). Insert, remove and tightest fit take logarithmic time."""

    def __init__(self, seed: int = 7):
        self.root, self.rng = None, random.Random(seed)

    def _split(self, node, key):
        """Nodes with keys below `key`, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            left, right = self._split(node[3], key)
            node[3] = left
            return node, right
        left, right = self._split(node[2], key)
        node[2] = right
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, remaining: int, bin_: int) -> None:
        left, right = self._split(self.root, (remaining, bin_))
        self.root = self._merge(self._merge(left, [(remaining, bin_), self.rng.random(), None, None]), right)

    def take_tightest(self, size: int):
        """Removes and returns the smallest (remaining, bin) with remaining >= size; None if there is none."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        node = right
        while node[2] is not None:
            node = node[2]
        found = node[0]
        _, rest = self._split(right, (found[0], found[1] + 1))
        self.root = self._merge(left, rest)
        return found


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """((size, bin, number of items) in the order of packing, bins opened) of runs (size, count) in descending order of
    size. An item above the capacity gets a bin alone. With `most`, packing stops once more bins than that are open.

    A bin that is the tightest for one item is so for the next of the same size as well, as long as that fits."""
    tree, out, opened = CapacityTree(), [], 0
    for size, count in runs:
        while count:
            found = tree.take_tightest(size) if size <= capacity else None
            if found is None:
                if opened == most:
                    return out, opened + 1
                found, opened = (max(capacity, size), opened), opened + 1
            n = min(count, found[0] // size)
            out.append((size, found[1], n))
            count -= n
            if size <= capacity:
                tree.insert(found[0] - n * size, found[1])
    return out, opened


def pack(runs: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """(size, bin from 0 to bins - 1, number of items) for runs (size, count) in descending order of size, at the smallest
    capacity tried that needs no more bins."""
    if not runs:
        return []
    # Items above their fair share stand alone; the others share what bins are left.
    largest = [size for size, count in runs[:bins] for _ in range(min(count, bins))][:bins]
    alone, rest = 0, sum(size * count for size, count in runs)
    while alone < min(bins - 1, len(largest)) and largest[alone] * (bins - alone) > rest:
        rest, alone = rest - largest[alone], alone + 1
    low = max(-(-rest // max(1, bins - alone)), largest[alone] if alone < len(largest) else 1, 1)
    step, capacity = max(1, low // 10_000), low
    while True:
        out, opened = best_fit_decreasing(runs, capacity, bins)
        if opened <= bins:
            return out
        capacity, step = capacity + step, step * 2 if capacity > low + 20 * step else step


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, size, text_crc32, shard and slot of every row of docs.

    size is the text's UTF-8 bytes plus 16. A null text has no bytes and no CRC but 0, and all null texts are one group;
    an empty text is another. Repeated rows (also repeated or null ids) are rows of their own, each with a slot. Groups of
    one size are told apart by their texts' digests. Other columns are ignored. Slots of a shard run from 0 without gaps,
    in the order of a hash of the id, then of id and CRC. An empty table gives an empty result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    key = F.when(F.col(text_col).isNull(), F.lit(b"")).otherwise(F.unhex(F.md5(F.col(text_col).cast("binary"))))
    rows = scratch.keep(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        key.alias("g"),
    ), "rows")
    groups = scratch.keep(rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    sizes = groups.groupBy("bytes").agg(F.count("*").alias("c"), F.sum("n").alias("n")).orderBy(F.desc("bytes")).toPandas()
    n_groups, n_rows = int(sizes["c"].sum()), int(sizes["n"].sum())
    packed = pd.DataFrame(pack(list(zip(sizes["bytes"].tolist(), sizes["c"].tolist())), shards), columns=["bytes", "shard", "k"], dtype="int64")
    # Of a size's groups, numbered from 0, those below the first end go to the first bin, and so on.
    packed["end"] = packed.groupby("bytes")["k"].cumsum()
    ends = packed.groupby("bytes", sort=False).agg(ends=("end", list), shards=("shard", list)).reset_index()
    dealt_to = spark.createDataFrame(ends, "bytes long, ends array<long>, shards array<int>") if len(ends) else spark.createDataFrame([], "bytes long, ends array<long>, shards array<int>")
    parts = max(1, -(-int(sizes["c"].max() or 0) // NUMBERED)) if len(sizes) else 1
    numbered = groups.withColumn("b", F.pmod(F.xxhash64("g"), F.lit(parts)).cast("int"))
    first = numbered.groupBy("bytes", "b").agg(F.count("*").alias("c"))
    first = first.select("bytes", "b", (F.sum("c").over(W.partitionBy("bytes").orderBy("b")) - F.col("c")).alias("first")).join(small(dealt_to, len(ends)), "bytes")
    at = F.row_number().over(W.partitionBy("bytes", "b").orderBy("g"))
    numbered = numbered.withColumn("at", at).join(small(first, len(ends) * parts, 100_000), ["bytes", "b"])
    rank = F.col("first") + F.col("at") - 1
    own = F.get("shards", F.size(F.filter("ends", lambda e: e <= rank)))
    of_group = scratch.keep(numbered.select("g", "n", own.alias("shard")), "packed")
    dealt = scratch.keep(attach(rows, of_group, ["g"], n_groups, n_rows, 50_000).drop("g"), "dealt")
    scratch.drop(rows, groups, of_group)
    parts = max(64, -(-n_rows // (shards * NUMBERED)))
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("shard", "b").agg(F.count("*").alias("n"))
    before = counts.withColumn("first", F.sum("n").over(W.partitionBy("shard").orderBy("b")) - F.col("n")).drop("n")
    slot = F.row_number().over(W.partitionBy("shard", "b").orderBy("doc_id", "text_crc32")).cast("long")
    return dealt.withColumn("at", slot).join(small(before, shards * parts), ["shard", "b"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at") - 1).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
