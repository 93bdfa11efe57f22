"""Benchmark workloads as DataFrame jobs: multi-key sums, windowed sums, road tolls, dependency edges, batch metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .versions import BASE, prefix_sum, previous, read_latest, read_window


def grep_sum(reads: DataFrame, log: DataFrame) -> DataFrame:
    """(bid, n_found, total): the sum over an event's keys of the newest versions below its bid.

    reads: (bid, keys array); log: (key, bid, value). A key that an event repeats counts as often; keys without a
    version add nothing."""
    probes = reads.select("bid", F.posexplode("keys").alias("i", "key"))
    found = read_latest(log, probes, ["key"])
    return found.groupBy("bid").agg(F.count("read_value").alias("n_found"), F.coalesce(F.sum("read_value"), F.lit(0)).alias("total"))


def windowed_grep_sum(reads: DataFrame, log: DataFrame, size: int) -> DataFrame:
    """(bid, n_found, total) over all versions of the keys with bids in [bid - size, bid - 1]."""
    probes = reads.select("bid", F.posexplode("keys").alias("i", "key"))
    found = read_window(log, probes, ["key"], size)
    return found.groupBy("bid").agg(F.sum("n_versions").alias("n_found"), F.coalesce(F.sum("sum_versions"), F.lit(0)).alias("total"))


def segment_stats(reports: DataFrame) -> DataFrame:
    """(segment, minute, n_vehicles, avg_speed); reports: (vid, time in seconds, segment, speed)."""
    by = reports.withColumn("minute", F.floor(F.col("time") / 60).cast("long"))
    return by.groupBy("segment", "minute").agg(F.countDistinct("vid").alias("n_vehicles"), F.avg("speed").alias("avg_speed"))


def tolls(reports: DataFrame, crowd: int = 50, slow: float = 40.0) -> DataFrame:
    """(vid, segment, minute, toll): a vehicle's toll in a segment and minute is 2 * (vehicles - crowd) ** 2 where more
    than `crowd` vehicles went slower than `slow` on average in the minute before, else 0."""
    stats = segment_stats(reports).select("segment", (F.col("minute") + 1).alias("minute"), "n_vehicles", "avg_speed")
    entries = reports.select("vid", "segment", F.floor(F.col("time") / 60).cast("long").alias("minute")).distinct()
    over = F.col("n_vehicles") - crowd
    toll = F.when((F.col("avg_speed") < slow) & (over > 0), 2 * over * over).otherwise(0).cast("long")
    return entries.join(stats, ["segment", "minute"], "left").select("vid", "segment", "minute", toll.alias("toll"))


def daily_spending(charged: DataFrame, minutes: int = 1440) -> DataFrame:
    """(vid, day, spent) from tolls."""
    return charged.groupBy("vid", F.floor(F.col("minute") / minutes).cast("long").alias("day")).agg(F.sum("toll").alias("spent"))


def account_balance(requests: DataFrame, charged: DataFrame) -> DataFrame:
    """requests (qid, vid, minute) with `balance`: the tolls charged to the vehicle before that minute (0 if none).

    charged: (vid, segment, minute, toll)."""
    tolls_ = charged.groupBy("vid", "minute").agg(F.sum("toll").alias("__toll")).withColumn("qid", F.lit(None).cast(dict(requests.dtypes)["qid"]))
    rows = tolls_.unionByName(requests.select("vid", "minute", "qid", F.lit(None).cast("long").alias("__toll")))
    rows = rows.withColumn("__asked", F.col("__toll").isNull())
    return prefix_sum(rows, ["vid"], "__toll", "balance", bid="minute").where("__asked").select("qid", "vid", "minute", F.col("balance").cast("long").alias("balance"))


def expenditure(requests: DataFrame, charged: DataFrame, minutes: int = 1440) -> DataFrame:
    """requests (qid, vid, day) with `spent`: the vehicle's tolls of that day (0 if none)."""
    return requests.join(daily_spending(charged, minutes), ["vid", "day"], "left").select("qid", "vid", "day", F.coalesce("spent", F.lit(0)).cast("long").alias("spent"))


def latest_average_velocity(reports: DataFrame, minutes: int = 5) -> DataFrame:
    """(segment, minute, lav): the average speed of all reports from the segment in the `minutes` before each minute for
    which it has reports."""
    by = reports.groupBy("segment", F.floor(F.col("time") / 60).cast("long").alias("minute")).agg(F.sum("speed").cast("double").alias("total"), F.count("speed").alias("n"))
    later = by.select("segment", F.explode(F.sequence(F.col("minute") + 1, F.col("minute") + minutes)).alias("minute"), "total", "n")
    sums = later.groupBy("segment", "minute").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return by.select("segment", "minute").join(sums, ["segment", "minute"]).select("segment", "minute", (F.col("total") / F.col("n")).alias("lav"))


def accidents(reports: DataFrame, repeats: int = 2, slowest: int = 0) -> DataFrame:
    """(segment, time, n_stopped): places and times at which at least `repeats` vehicles report a speed of `slowest` or less."""
    return reports.where(F.col("speed") <= slowest).groupBy("segment", "time").agg(F.countDistinct("vid").alias("n_stopped")).where(F.col("n_stopped") >= repeats)


def dependencies(operations: DataFrame) -> DataFrame:
    """(source, target, kind): on which earlier transaction each operation waits.

    operations: (bid, op, key, reads array of other keys). 'temporal': the operation before on the same key. 'functional':
    the last earlier writer of each key that is read. 'logical': other operations on the transaction's first."""
    temporal = previous(operations.select("bid", "op", "key"), ["key"], ["bid", "op"], "bid", "source").where("source is not null").select(
        "source", F.col("bid").alias("target"), F.lit("temporal").alias("kind"))
    writes = operations.select("key", "bid", F.col("bid").alias("value"))
    probes = operations.select("bid", F.explode("reads").alias("key"))
    functional = read_latest(writes, probes, ["key"]).where("read_value is not null").select(
        F.col("read_value").alias("source"), F.col("bid").alias("target"), F.lit("functional").alias("kind"))
    logical = operations.where("op > 0").select(F.col("bid").alias("source"), F.col("bid").alias("target"), F.lit("logical").alias("kind"))
    return temporal.unionByName(functional).unionByName(logical)


def epochs(events: DataFrame, size: int, bid: str = "bid") -> DataFrame:
    """events with `epoch`: the batch of `size` serial numbers that each belongs to."""
    return events.withColumn("epoch", F.floor(F.col(bid) / size).cast("long"))


def epoch_metrics(events: DataFrame, size: int, ts: str) -> DataFrame:
    """(epoch, n_events, first_ts, last_ts, per_second) per batch of serial numbers."""
    by = epochs(events, size).groupBy("epoch").agg(F.count("*").alias("n_events"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    seconds = (_micros(F.col("last_ts")) - _micros(F.col("first_ts"))) / 1e6
    return by.withColumn("per_second", F.when(seconds > 0, F.col("n_events") / seconds))


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_latency(events: DataFrame, size: int, ts: str) -> DataFrame:
    """(epoch, min_latency, max_latency, avg_latency, total_latency) in microseconds: an event waits from its own time to
    its batch's last, when the batch is evaluated."""
    by = epochs(events, size)
    ends = by.groupBy("epoch").agg(F.max(_micros(F.col(ts))).alias("__end"))
    waited = by.join(ends, "epoch").select("epoch", (F.col("__end") - _micros(F.col(ts))).alias("w"))
    return waited.groupBy("epoch").agg(F.min("w").alias("min_latency"), F.max("w").alias("max_latency"), F.avg("w").alias("avg_latency"), F.sum("w").alias("total_latency"))


__all__ = ["BASE", "accidents", "account_balance", "daily_spending", "dependencies", "epoch_latency", "epoch_metrics", "epochs", "expenditure", "grep_sum", "latest_average_velocity",
           "segment_stats", "tolls", "windowed_grep_sum"]
