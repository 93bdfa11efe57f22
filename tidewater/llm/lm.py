"""Language-model scores by context-tree weighting.

A text is a sequence of bytes (A-Z lower-cased) and an end. Each byte is eight binary decisions; a decision's context is
the bits before it in the byte and up to DEPTH bytes before that. Every node of the tree, down to DEPTH, holds the
Krichevsky-Trofimov estimate of its decisions in the training texts, and the weighting mixes the estimates of all depths.
The trained tree is then fixed: a decision's probability is the mixture down its path, as far as training has visited it.

Jobs: (1) count the grams of DEPTH + 1 bytes over all documents, with the training texts' counts, and the training
texts' words; (2) weigh the tree from the leaves: tasks weigh the subtrees below the four latest bytes, at most 2 ** 16
grams at a time, and the levels above are keyed sums; (3) give each gram its log probability: what the levels above the
third make of a probability is one scale and one offset per node of the third, which goes along with that node; (4) sum
over documents. Step 4 sends the gram table to the tasks if it has at most MODEL_ROWS rows. Otherwise each batch of
documents names the distinct grams it holds, those are joined, and what is found meets the batch's texts again: a gram
is moved once for a batch, not for each of its bytes. Both ways sum the same numbers in the same order. Frequent words'
counts are sent likewise, up to HEAD_WORDS; the rest are joined."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest

from .common import Scratch, WordHashes, pieces, read_table, signed, texts

DEPTH = 5
#: Rows of the gram table up to which it is sent to the tasks (some 50 bytes each in a worker's memory).
MODEL_ROWS = 3_000_000
#: Bytes of text in a batch that joins its grams, about.
BATCH = 32 << 20
#: Words whose counts are sent to the tasks.
HEAD_WORDS = 1_000_000
END = b"\xff"
END_WORD = xxh3_64_intdigest(b"")


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def grams(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All (DEPTH + 1)-grams of the documents as whole numbers, latest byte lowest, and each document's number of them."""
    pad = b"\x00" * DEPTH
    laid = np.frombuffer(b"".join(pad + d + END for d in docs), np.uint8)
    size = np.array([len(d) + 1 for d in docs], np.int64)
    real = np.ones(len(laid), bool)
    begin = np.cumsum(size + DEPTH) - size - DEPTH
    for k in range(DEPTH):
        real[begin + k] = False
    wide = laid.astype(np.uint64)
    out = np.zeros(len(laid), np.uint64)
    for back in range(DEPTH, -1, -1):
        out <<= np.uint64(8)
        out[back:] |= wide[: len(wide) - back] if back else wide
    return out[real], size


class Tally:
    """Counts of keys, merged as they grow; `flush` hands them over."""

    def __init__(self, most: int = 1_500_000):
        self.parts, self.rows, self.most = [], 0, most

    def add(self, keys: np.ndarray, weight: int) -> None:
        if len(keys):
            k, n = np.unique(keys, return_counts=True)
            self.parts.append((k, n * weight))
            self.rows += len(k)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        keys, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.add.reduceat(n, first)

    def full(self) -> bool:
        if self.rows > 2 * self.most:
            self.parts = [self.merged()]
            self.rows = len(self.parts[0][0])
        return self.rows > self.most

    def flush(self, kind: int) -> pa.RecordBatch:
        keys, n = self.merged()
        self.parts, self.rows = [], 0
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(signed(keys)), pa.array(n, pa.int64())], names=["kind", "key", "n"])


GRAM, WORD = 0, 1


def _counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n): training counts of grams (0 for those of held-out texts only) and of words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, by_gram, by_word = WordHashes(), Tally(), Tally()
        for batch in pieces(batches, 4 << 20):
            held = [held_out(i) for i in batch["doc_id"].to_pylist()]
            lower = [t.lower() for t in texts(batch["text"])]
            for flag in (False, True):
                own = [t for t, h in zip(lower, held) if h is flag]
                if own:
                    by_gram.add(grams(own)[0], 0 if flag else 1)
                    if not flag:
                        by_word.add(np.concatenate([*(memo.of(t.split()) for t in own), np.full(len(own), END_WORD, np.uint64)]), 1)
            if by_gram.full():
                yield by_gram.flush(GRAM)
            if by_word.full():
                yield by_word.flush(WORD)
        yield by_gram.flush(GRAM)
        yield by_word.flush(WORD)

    return docs.mapInArrow(scan, "kind int, key long, n long")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, seven steps up."""
    z, low = x + 7.0, np.ones_like(x)
    for k in range(7):
        low = low * (x + k)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(low)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


HALF = math.log(0.5)


class Level:
    """Nodes of one depth: sorted keys (context, decision), counts, log weighted probability."""

    def __init__(self, keys, zeros, ones, below):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = log_kt(zeros, ones)
        self.weighted = own if below is None else np.logaddexp(HALF + own, HALF + below)
        #: Weight of the node's own estimate against the deeper ones.
        self.stop = np.ones(len(own)) if below is None else np.exp(HALF + own - self.weighted)


class Nodes:
    """The third level's nodes that a chunk needs, with what the levels above make of their probabilities: scale * p plus
    an offset for the bits 0 and 1."""

    columns = ("zeros", "ones", "stop", "scale", "offset0", "offset1")

    def __init__(self, keys: np.ndarray, values: list[np.ndarray]):
        self.keys = keys
        self.zeros, self.ones, self.stop, self.scale, self.offset0, self.offset1 = values


def _decisions(key: np.ndarray):
    """For each gram and each of its eight decisions: node in the byte's tree (1 to 255) and the bit."""
    x = (key & np.uint64(255)).astype(np.int64)[:, None]
    j = np.arange(8)
    return (1 << j) | (x >> (8 - j)), (x >> (7 - j)) & 1


def _subtree(key: np.ndarray, n: np.ndarray, least: int = 4):
    """Levels DEPTH down to `least` over the grams, and each decision's node per level."""
    node, bit = _decisions(key)
    context = (key >> np.uint64(8)).astype(np.int64)[:, None]
    full = (context << 8) | node
    keys, at = np.unique(full, return_inverse=True)
    at = at.reshape(full.shape)
    weight = np.broadcast_to(n[:, None].astype(np.float64), full.shape)
    zeros = np.bincount(at.ravel(), (weight * (bit == 0)).ravel(), len(keys))
    ones = np.bincount(at.ravel(), (weight * bit).ravel(), len(keys))
    levels, places = [Level(keys, zeros, ones, None)], [at]
    for depth in range(DEPTH - 1, least - 1, -1):
        # The older bytes are the higher ones: dropping the oldest keeps the lowest 8 * depth bits of the context.
        last = levels[-1]
        short = (last.keys >> 8 & ((1 << 8 * depth) - 1)) << 8 | (last.keys & 255)
        k, up = np.unique(short, return_inverse=True)
        levels.append(Level(k, np.bincount(up, last.zeros, len(k)), np.bincount(up, last.ones, len(k)), np.bincount(up, last.weighted, len(k))))
        places.append(up[places[-1]])
    return levels, places, bit


def _mixed(predicted, visited, level: Level, at, bit):
    """Probability of the bits at a level, from that one level deeper."""
    a, b = level.zeros[at], level.ones[at]
    own = (np.where(bit == 1, b, a) + 0.5) / (a + b + 1)
    stop = level.stop[at]
    return np.where(visited, stop * own + (1 - stop) * predicted, own), a + b > 0


def _chunks(batches: Iterator[pa.RecordBatch], most: int = 60_000) -> Iterator[tuple[Nodes | None, np.ndarray, np.ndarray]]:
    """(nodes, key, n): whole groups of grams with the same four latest context bytes, some `most` grams at a time, and the
    nodes that came before them (rows with a node; there are none in the first pass)."""
    keys, ns, held, tops = [], [], 0, None
    for batch in batches:
        key, n = batch["key"].to_numpy().view(np.uint64), batch["n"].to_numpy()
        if "node" in batch.schema.names:
            gram = batch["node"].is_null().to_numpy(zero_copy_only=False)
            own = np.flatnonzero(~gram)
            if len(own):
                more = [key[own].astype(np.int64), *(batch[c].to_numpy(zero_copy_only=False)[own] for c in Nodes.columns)]
                tops = more if tops is None else [np.concatenate(x) for x in zip(tops, more)]
            key, n = key[gram], n[gram]
        if not len(key):
            continue
        keys.append(key)
        ns.append(n)
        held += len(key)
        if held > most:
            key, n = np.concatenate(keys), np.concatenate(ns)
            group = key >> np.uint64(8) & np.uint64(0xFFFFFFFF)
            cut = np.flatnonzero(group != group[-1])
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if cut:
                yield tops and Nodes(tops[0], tops[1:]), key[:cut], n[:cut]
                if tops is not None:
                    # Nodes are sorted like the grams: those of earlier contexts are done with.
                    rest = tops[0] >> 8 >= int(key[cut] >> np.uint64(8) & np.uint64(0xFFFFFF))
                    tops = [x[rest] for x in tops]
            keys, ns, held = [key[cut:]], [n[cut:]], len(key) - cut
    if held:
        yield tops and Nodes(tops[0], tops[1:]), np.concatenate(keys), np.concatenate(ns)


def _in_order(children: str):
    """The sum of at most 256 children, always in the same order, so that it has the same digits in every run."""
    return F.aggregate(F.array_sort(F.collect_list(children)), F.lit(0.0), lambda a, x: a + x)


def _level(df: DataFrame) -> DataFrame:
    """(c, node, zeros, ones, below) with the node's weighted probability and the weight of its own estimate."""

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            level = Level(None, b["zeros"].to_numpy(), b["ones"].to_numpy(), b["below"].to_numpy())
            yield pa.RecordBatch.from_arrays([b["c"], b["node"], b["zeros"], b["ones"], pa.array(level.weighted), pa.array(level.stop)],
                                             names=["c", "node", "zeros", "ones", "weighted", "stop"])

    return df.select("c", "node", "zeros", "ones", "below").mapInArrow(weighted, "c long, node long, zeros double, ones double, weighted double, stop double")


def _above(level: DataFrame, bits: int) -> DataFrame:
    """The level above, whose contexts are the lowest `bits` bits of level's."""
    up = level.groupBy(F.col("c").bitwiseAND(F.lit((1 << bits) - 1)).alias("c"), "node")
    return _level(up.agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), _in_order("weighted").alias("below")))


def _with_tail(third: DataFrame, second: DataFrame, first: DataFrame, root: DataFrame) -> DataFrame:
    """third with scale, offset0 and offset1: a probability p of a bit at the third level is scale * p + offset at the root.

    At each level it becomes stop * own + (1 - stop) * p if the node below was visited in training, else own."""
    out = third
    for name, level, bits in (("second", second, 16), ("first", first, 8), ("root", root, 0)):
        total = F.col("zeros") + F.col("ones") + 1
        part = level.select(F.col("c").alias(f"c_{name}"), F.col("node").alias(f"node_{name}"), F.col("stop").alias(f"stop_{name}"),
                            ((F.col("zeros") + 0.5) / total).alias(f"own0_{name}"), ((F.col("ones") + 0.5) / total).alias(f"own1_{name}"), (total > 1).alias(f"met_{name}"))
        # The first level and the root have at most 256 * 255 nodes.
        part = part if name == "second" else F.broadcast(part)
        out = out.join(part, (F.col("c").bitwiseAND(F.lit((1 << bits) - 1)) == F.col(f"c_{name}")) & (F.col("node") == F.col(f"node_{name}")))
    scale, offset, met = F.lit(1.0), [F.lit(0.0), F.lit(0.0)], F.col("zeros") + F.col("ones") > 0
    for name in ("second", "first", "root"):
        stop = F.col(f"stop_{name}")
        keep = F.when(met, 1 - stop).otherwise(0.0)
        scale = scale * keep
        offset = [keep * offset[bit] + F.when(met, stop).otherwise(1.0) * F.col(f"own{bit}_{name}") for bit in (0, 1)]
        met = F.col(f"met_{name}")
    return out.select("c", "node", "zeros", "ones", "stop", scale.alias("scale"), offset[0].alias("offset0"), offset[1].alias("offset1"))


def weigh(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, logp): natural log probability of each gram's latest byte after the bytes before it; counts: (key, n)."""
    of = lambda bits: F.shiftright("key", 8).bitwiseAND(F.lit((1 << bits) - 1))
    grams = counts.select(of(24).alias("c"), of(32).alias("c4"), "key", "n")

    def fourth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, n in _chunks(batches):
            top = _subtree(key, n)[0][-1]
            up, at = np.unique((top.keys >> 8 & 0xFFFFFF) << 8 | top.keys & 255, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(up >> 8), pa.array(up & 255), *(pa.array(np.bincount(at, x, len(up))) for x in (top.zeros, top.ones, top.weighted))],
                                             names=["c", "node", "zeros", "ones", "below"])

    # All parts of a node of the third level come from one task, in its order.
    parts = grams.repartition("c").sortWithinPartitions("c", "c4", "key").select("key", "n").mapInArrow(fourth, "c long, node long, zeros double, ones double, below double")
    third = scratch.keep(_level(parts.groupBy("c", "node").agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "below")))), "third")
    second = scratch.keep(_above(third, 16), "second")
    first = scratch.keep(_above(second, 8), "first")
    root = scratch.keep(_above(first, 0), "root")
    nodes = _with_tail(third, second, first, root)
    nodes = nodes.select("c", F.col("node").alias("c4"), F.col("c").bitwiseAND(F.lit(0xFFFFFF)).alias("key"), F.lit(0).cast("long").alias("n"), "node", *Nodes.columns)
    nodes = nodes.withColumn("key", F.shiftleft("key", 8).bitwiseOR(F.col("node")))
    rows = nodes.unionByName(grams, allowMissingColumns=True).repartition("c").sortWithinPartitions(
        "c", F.col("node").isNull(), "c4", "key").select("key", "n", "node", *Nodes.columns)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, key, n in _chunks(batches):
            levels, places, bit = _subtree(key, n)
            p, visited = np.full(bit.shape, 0.5), np.zeros(bit.shape, bool)
            for level, at in zip(levels, places):
                p, visited = _mixed(p, visited, level, at, bit)
            at = np.searchsorted(nodes.keys, (key >> np.uint64(8) & np.uint64(0xFFFFFF)).astype(np.int64)[:, None] << 8 | _decisions(key)[0])
            p, _ = _mixed(p, visited, nodes, at, bit)
            p = nodes.scale[at] * p + np.where(bit == 1, nodes.offset1[at], nodes.offset0[at])
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(np.log(p).sum(axis=1))], names=["key", "logp"])

    return rows.mapInArrow(scored, "key long, logp double")


class Lookup:
    """key -> value by open addressing; the slots are filled once in each worker."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.used = keys, values, None

    def _fill(self) -> None:
        self.bits = max(4, (2 * len(self.keys)).bit_length())
        slots, left = np.full(1 << self.bits, -1, np.int32), np.arange(len(self.keys), dtype=np.int32)
        at = self._home(self.keys)
        while len(left):
            free = slots[at] < 0
            slots[at[free]] = left[free]
            lost = slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
        self.used = slots >= 0
        self.slot_keys = np.append(self.keys, np.uint64(0))[slots]
        self.slot_values = np.append(self.values, self.values.dtype.type(0))[slots]
        self.keys = self.values = None

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where a key isn't there), and whether it is."""
        if self.used is None:
            self._fill()
        at = self._home(keys)
        used = self.used[at]
        found = (self.slot_keys[at] == keys) & used
        values = np.where(found, self.slot_values[at], 0)
        live = np.flatnonzero(~found & used)
        at = at[live]
        while len(live):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.used[at]
            same = there & (self.slot_keys[at] == keys[live])
            values[live[same]] = self.slot_values[at[same]]
            found[live[same]] = True
            go = there & ~same
            live, at = live[go], at[go]
        return values, found


def _to_lookup(df: DataFrame, value: str, kind) -> Lookup:
    t = df.select("key", value).toArrow()
    return Lookup(t["key"].to_numpy().view(np.uint64), t[value].to_numpy().astype(kind))


def _by_document(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the grams' log probabilities, in the order of the text."""
    return np.bincount(np.repeat(np.arange(len(size)), size), p, len(size))


def _joined(told: DataFrame, model: DataFrame) -> DataFrame:
    """(uid, lm): the sums for batches whose grams are joined; no more than a batch's texts and grams meet in a task."""
    found = told.where("grams is not null").select("batch", F.explode("grams").alias("key")).join(model, "key").select(F.col("batch").alias("of"), "key", "logp")

    def add(docs: pa.Table, found: pa.Table) -> pa.Table:
        model, out, own = Lookup(found["key"].to_numpy().view(np.uint64), found["logp"].to_numpy()), [], docs["text"].combine_chunks()
        for i in range(0, len(own), 1024):
            g, size = grams(own[i : i + 1024].to_pylist())
            out.append(_by_document(model.get(g)[0], size))
        return pa.table({"uid": docs["uid"], "lm": np.concatenate(out or [np.empty(0)])})

    return told.where("uid is not null").select("batch", "uid", "text").groupBy("batch").cogroup(found.groupBy("of")).applyInArrow(add, "uid long, lm double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text and its end)
    and bits_per_byte of every row of docs.

    Training texts are those whose crc32(doc_id as text) mod 10 is not 0 (a null id counts as the text ''). Null texts are
    empty: one end token. Repeated rows train as often as they occur and each get a row. Other columns are ignored. If
    no text trains, every decision has probability 1/2 and the base is undefined (null). An empty table gives an empty
    result."""
    spark = docs.sparkSession
    scratch, kind = Scratch(spark, "lm"), dict(docs.dtypes)[id_col]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = scratch.keep(_counts(docs).groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    total, distinct = words.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    norm = math.log10(total + 0.1 * (distinct + 1)) if total else float("nan")
    # 64 rows at most: words by the power of two of their count.
    rank = {r.b: r.c for r in words.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count("*").alias("c")).collect()}
    power, head = 64, 0
    while power > 0 and head + rank.get(power - 1, 0) <= HEAD_WORDS:
        power, head = power - 1, head + rank.get(power - 1, 0)
    frequent = spark.sparkContext.broadcast(_to_lookup(words.where(F.col("n") >= F.lit(1 << power)) if power < 63 else words.limit(0), "n", np.int64))
    model = scratch.keep(weigh(counts.where(F.col("kind") == GRAM).select("key", "n"), scratch), "model")
    rows = model.count()
    table = spark.sparkContext.broadcast(_to_lookup(model, "logp", np.float64)) if rows <= MODEL_ROWS else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, uid = WordHashes(), TaskContext.get().partitionId() << 40
        own, named, room, last = uid, np.empty(0, np.uint64), BATCH, None

        def names() -> pa.RecordBatch:
            """A row that names the distinct grams of batch `own`."""
            columns = {f.name: pa.nulls(1, f.type) for f in last.schema}
            columns |= {"batch": pa.array([own]), "grams": pa.array([signed(named)], pa.list_(pa.int64()))}
            return pa.RecordBatch.from_arrays(list(columns.values()), schema=last.schema)

        for batch in pieces(batches, 4 << 20):
            n = batch.num_rows
            lower = [t.lower() for t in texts(batch["text"])]
            of = [np.append(memo.of(t.split()), np.uint64(END_WORD)) for t in lower]
            ends = np.cumsum([0, *map(len, of)])
            h = np.concatenate(of)
            c, there = frequent.value.get(h)
            row = np.repeat(np.arange(n), np.diff(ends))
            base = np.bincount(row, np.where(there, np.log10(c + 0.1), 0), n)
            known = np.bincount(row, there, n).astype(np.int64)
            rare = np.flatnonzero(~there)
            rare_ends = np.searchsorted(rare, ends).astype(np.int32)
            keys, size = grams(lower)
            if table is not None:
                sums, text = pa.array(_by_document(table.value.get(keys)[0], size)), pa.nulls(n, pa.binary())
            else:
                sums, text = pa.nulls(n, pa.float64()), pa.array(lower, pa.binary())
                named, room = np.union1d(named, keys), room - len(keys)
            last = pa.RecordBatch.from_arrays([
                pa.array(np.arange(uid, uid + n)), pa.array(np.full(n, own)), batch["doc_id"], pa.array([held_out(i) for i in batch["doc_id"].to_pylist()]),
                pa.array(np.diff(ends)), pa.array(known), pa.array(base), sums, pa.array([len(t) for t in lower], pa.int64()),
                pa.ListArray.from_arrays(pa.array(rare_ends), pa.array(signed(h[rare]))), text, pa.nulls(n, pa.list_(pa.int64())),
            ], names=["uid", "batch", "doc_id", "held_out", "n_tokens", "known", "base", "lm", "n_bytes", "rare", "text", "grams"])
            yield last
            uid += n
            if room <= 0:
                yield names()
                own, named, room = uid, named[:0], BATCH
        if len(named):
            yield names()

    told = scratch.keep(docs.mapInArrow(scan, f"uid long, batch long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, lm double, n_bytes long, rare array<long>, text binary, grams array<long>"), "told")
    rare = told.select("uid", F.explode("rare").alias("key")).groupBy("uid", "key").agg(F.count("*").alias("k"))
    rare = rare.join(words.where(F.col("n") < F.lit(1 << power)) if power < 63 else words, "key", "left").groupBy("uid").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_base"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("rare_known"))
    out = told.where("uid is not null").drop("rare", "text", "grams").join(rare, "uid", "left")
    if table is None:
        out = out.drop("lm").join(_joined(told, model), "uid")
    log10 = F.col("lm") / math.log(10)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score") if total else F.lit(None).cast("double").alias("base_score"),
        log10.alias("score"), (-F.col("lm") / math.log(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
