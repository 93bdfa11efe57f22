"""Structured Streaming jobs: epoch-wise ledger, windows, joins and single-key state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import ledger


def lines(spark: SparkSession, path: str, files_per_epoch: int = 1) -> DataFrame:
    """Text lines of files as they arrive."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_epoch).text(path)


def kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Text lines of a topic; needs Spark's Kafka package on the class path."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return source.select(F.col("value").cast("string").alias("value"))


def tables(spark: SparkSession, path: str, schema, files_per_epoch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_epoch).parquet(path)


def _epochs(events: DataFrame, start: DataFrame, out: str, checkpoint: str, run: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], keep: int, every: str | None) -> StreamingQuery:
    """Runs run(batch, state) -> (results, new state) epoch by epoch: results under out/results/epoch=N, the state after
    each under out/state/N, of which the last `keep` stay. every: the trigger's period, such as '10 seconds'; without it an
    epoch follows the other as data arrives.

    An epoch reads the state its predecessor wrote and overwrites its own folders, so that one that is run again after
    a failure writes the same: at least two states must stay. Serial numbers must not fall from epoch to epoch."""
    spark = events.sparkSession

    def epoch(batch: DataFrame, n: int) -> None:
        state = start if n == 0 else spark.read.parquet(f"{out}/state/{n - 1}")
        results, after = run(batch, state)
        results.write.mode("overwrite").parquet(f"{out}/results/epoch={n}")
        after.write.mode("overwrite").parquet(f"{out}/state/{n}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/state/{n - max(2, keep)}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    writer = events.writeStream.foreachBatch(epoch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer).start()


def transfer_ledger(events: DataFrame, accounts: DataFrame, out: str, checkpoint: str, keep: int = 3, every: str | None = None) -> StreamingQuery:
    """Runs transfers (bid, src, dest, amount) epoch by epoch, see _epochs. Stopping the query pauses the ledger; a new one
    with the same folders goes on where it stopped."""

    def run(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        done = ledger.transfers(batch, state)
        return ledger.results(done), ledger.final_balances(done, state)

    return _epochs(events, accounts, out, checkpoint, run, keep, every)


def mixed_ledger(events: DataFrame, state: DataFrame, out: str, checkpoint: str, keep: int = 3, every: str | None = None) -> StreamingQuery:
    """Runs deposits and transfers (bid, flag, src, dest, amount, is_abort) over several tables, as transfer_ledger does."""

    def run(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        done = ledger.mixed(batch, state)
        return ledger.mixed_results(done), ledger.mixed_state(done, batch, state)

    return _epochs(events, state, out, checkpoint, run, keep, every)


def state_of(spark: SparkSession, out: str, epoch: int) -> DataFrame:
    return spark.read.parquet(f"{out}/state/{epoch}")


def windowed(events: DataFrame, ts: str, length: str, slide: str | None = None, late: str = "0 seconds", by: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Counts and sums per (tumbling or sliding) time window; works on batch and streaming frames. Events later than
    `late` behind the newest are dropped from a stream."""
    frame = events.withWatermark(ts, late) if events.isStreaming else events
    at = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = frame.groupBy(at.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str = "0 seconds") -> DataFrame:
    """(key, session_start, session_end, n): runs of events with less than `gap` between them."""
    frame = events.withWatermark(ts, late) if events.isStreaming else events
    out = frame.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def symmetric_join(left: DataFrame, right: DataFrame, key: str, ts: str, within: str, late: str = "1 minute") -> DataFrame:
    """Pairs of equal keys at most `within` apart, from two streams or tables: (key, left_ts, right_ts, left_value, right_value)."""
    a, b = (x.select(F.col(key).alias(f"{s}_key"), F.col(ts).alias(f"{s}_ts"), F.col("value").alias(f"{s}_value")) for s, x in (("left", left), ("right", right)))
    a, b = (x.withWatermark(f"{s}_ts", late) if x.isStreaming else x for s, x in (("left", a), ("right", b)))
    near = F.expr(f"left_key = right_key and right_ts >= left_ts - interval {within} and right_ts <= left_ts + interval {within}")
    return a.join(b, near).select(F.col("left_key").alias(key), "left_ts", "right_ts", "left_value", "right_value")


def keyed_fold(events: DataFrame, key: str, columns: list[str], start: float, step: Callable[[float, pd.DataFrame], tuple[float, list[float]]], order: str) -> DataFrame:
    """(key, order, state): a running state per key over a stream. `step` takes the state and a key's new rows in order
    and returns the new state and the state after each row."""
    kind = dict(events.dtypes)

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = state.get[0] if state.exists else start
        rows = pd.concat(frames).sort_values(order)
        own, after = step(own, rows)
        state.update((own,))
        yield pd.DataFrame({key: group[0], order: rows[order].to_numpy(), "state": after})

    return events.select(key, order, *columns).groupBy(key).applyInPandasWithState(
        fold, f"{key} {kind[key]}, {order} {kind[order]}, state double", "state double", "append", GroupStateTimeout.NoTimeout)
