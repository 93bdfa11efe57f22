"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest

#: Base of the rolling word-window hash, and the constants of its finishing mix (splitmix64).
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Words that one Python worker keeps hashes or scores of.
MEMO_WORDS = 300_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, where it is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidewater.shared.dir", None)
    if not path:
        if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("tidewater.shared.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables that an operator writes to the shared folder: they cut the lineage, outlive a lost executor and can be
    read more than once. `drop` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidewater-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidewater_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            if table is not None:
                path = jvm.org.apache.hadoop.fs.Path(table._tidewater_path)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of 8-byte keys up to which a side may be broadcast (32 MB raw); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit, else df itself (a shuffled join)."""
    return F.broadcast(df) if rows <= limit else df


#: A key is heavy if it has more than this part of all rows; there are at most HEAVY of those.
HEAVY = 20_000


def attach(rows: DataFrame, by: DataFrame, keys: list[str], n_by: int, total: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows with the columns of by (a row per key, no nulls in keys; its column n, the rows that have the key, goes).

    A short list is sent to all tasks. Of a long one only the heavy keys are, HEAVY of them at most, so that a key with
    a third of all rows doesn't meet in one task; the other keys' rows are shuffled."""
    if n_by <= limit:
        return rows.join(F.broadcast(by.drop("n")), keys)
    heavy = F.col("n") * HEAVY >= total
    hot = F.broadcast(by.where(heavy).drop("n"))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(by.where(~heavy).drop("n"), keys))


def by_place(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """docs with columns named c0, c1, ... by place, and the new name of a column: whatever docs calls its columns, they
    don't meet the operator's own."""
    names = [c.lower() for c in docs.columns]
    return docs.toDF(*(f"c{i}" for i in range(len(names)))), lambda name: f"c{names.index(name.lower())}"


class WordHashes(dict):
    """Hashes of words, kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every bit of x over all 64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of n consecutive words, from the words' hashes (none if there are fewer words).

    Windows are put together from those of the powers of two in n."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    part, width, out, have = h, 1, None, 0
    while True:
        if n & width:
            size = len(h) - have - width + 1
            out = part if out is None else part[:size] * np.uint64(pow(int(_BASE), have, 1 << 64)) + out[width : width + size]
            have += width
        if 2 * width > n:
            return mix(out + np.uint64(n))
        part = part[:-width] * np.uint64(pow(int(_BASE), width, 1 << 64)) + part[width:]
        width *= 2


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives no bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], size: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut at rows where they hold more than about `size` bytes."""
    for batch in batches:
        n = max(1, -(-batch.nbytes // size))
        step = max(1, -(-batch.num_rows // n))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def dense(df: DataFrame, bits: int, dtype, as_bits: bool = False) -> np.ndarray:
    """df (i long, v long, no repeated i) as an array of 2 ** bits values, or with as_bits as packed bits of v's truth.

    Blocks are laid out by the executors, so that the driver gets at most 2 ** 12 rows of bytes."""
    low = max(0, bits - 12, min(bits, 14))

    def lay(key: tuple, group: pa.Table) -> pa.Table:
        out = np.zeros(1 << low, dtype)
        out[group["i"].to_numpy() & ((1 << low) - 1)] = group["v"].to_numpy()
        data = np.packbits(out.astype(bool), bitorder="little").tobytes() if as_bits else out.tobytes()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

    blocks = df.withColumn("block", F.shiftright("i", low)).groupBy("block").applyInArrow(lay, "block long, data binary").collect()
    size = (1 << low) // 8 if as_bits else (1 << low) * np.dtype(dtype).itemsize
    out = bytearray(size << (bits - low))
    for r in blocks:
        out[r.block * size : (r.block + 1) * size] = r.data
    return np.frombuffer(bytes(out), np.uint8 if as_bits else dtype)


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)
