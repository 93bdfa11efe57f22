"""Versioned state: reads of a version log as of an event.

A log has one row per version: key columns, the serial number `bid` of the event that wrote it, and a value. Base rows
have bid -1. An event with number b reads versions below b. Reads and sums are window frames within ranges of bids, and
what a range needs of earlier ones comes from an aggregation, so that a hot key's rows share out over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BASE = -1
#: Serial numbers in a range.
WIDTH = 65_536


def _same(keys: list[str]) -> Column:
    """Equality of a row's keys and range with those of a table of ranges, whose names begin with __at_."""
    on = F.col("__range") == F.col("__at_range")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__at_{k}"))
    return on


def _carried(cut: DataFrame, keys: list[str], value: Column, order: Column) -> DataFrame:
    """Per key and range (columns __at_*) the last `value` of earlier ranges in `order`, as __carried: a row per range,
    aggregated before it is shuffled."""
    ends = cut.groupBy(*keys, "__range").agg(F.max_by(value, order).alias("__end"))
    earlier = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    return ends.select(*(F.col(k).alias(f"__at_{k}") for k in keys), F.col("__range").alias("__at_range"), F.last("__end", ignorenulls=True).over(earlier).alias("__carried"))


def read_latest(log: DataFrame, probes: DataFrame, keys: list[str], value: str = "value", bid: str = "bid", least: int | Column | None = None, width: int = WIDTH) -> DataFrame:
    """probes with `read_bid` and `read_value`: the newest version of the key below the probe's bid.

    Both are null if there is none, or if it is older than `least` (a bid, or a column of probes). RANGE frames give all
    probes of one bid the same version. Null values are versions too; null keys have versions of their own."""
    extra = [c for c in probes.columns if c not in (*keys, bid)]
    version = F.struct(F.col(bid).alias("b"), F.col(value).alias("v"))
    a = log.select(*keys, bid, version.alias("__version"), *(F.lit(None).cast(dict(probes.dtypes)[c]).alias(c) for c in extra), F.lit(False).alias("__probe"))
    b = probes.select(*keys, bid, F.lit(None).cast(a.schema["__version"].dataType).alias("__version"), *extra, F.lit(True).alias("__probe"))
    cut = a.unionByName(b).withColumn("__range", F.floor(F.col(bid) / width).cast("long"))
    before = W.partitionBy(*keys, "__range").orderBy(bid).rangeBetween(W.unboundedPreceding, -1)
    own = cut.withColumn("__own", F.last("__version", ignorenulls=True).over(before)).where("__probe")
    out = own.join(_carried(cut, keys, F.col("__version"), F.col("__version.b")), _same(keys)).withColumn("__read", F.coalesce("__own", "__carried"))
    if least is not None:
        out = out.withColumn("__read", F.when(F.col("__read.b") >= least, F.col("__read")))
    return out.select(*probes.columns, F.col("__read.b").alias("read_bid"), F.col("__read.v").alias("read_value"))


def previous(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, width: int = WIDTH) -> DataFrame:
    """rows with `out`: the `value` of the key's row before, in the order of columns of which the first is a serial number
    (null for the first row)."""
    cut = rows.withColumn("__range", F.floor(F.col(order[0]) / width).cast("long"))
    inside = W.partitionBy(*keys, "__range").orderBy(*order)
    own = cut.withColumn("__own", F.lag(F.struct(F.col(value).alias("v"))).over(inside))
    met = own.join(_carried(cut, keys, F.struct(F.col(value).alias("v")), F.struct(*order)), _same(keys))
    return met.select(*rows.columns, F.coalesce("__own", "__carried")["v"].alias(out))


def read_window(log: DataFrame, probes: DataFrame, keys: list[str], size: int, value: str = "value", bid: str = "bid", width: int = WIDTH) -> DataFrame:
    """probes with `n_versions` and `sum_versions` of the key's versions with bids in [bid - size, bid - 1]; the base
    versions lie outside. No versions give 0 and null. A version near its range's end counts in the next range too."""
    width = max(width, 8 * size)
    extra = [c for c in probes.columns if c not in (*keys, bid)]
    at = F.floor(F.col(bid) / width).cast("long")
    reach = F.floor((F.col(bid) + size) / width).cast("long")
    a = log.where(F.col(bid) > BASE).select(*keys, bid, F.col(value).alias("__v"), F.lit(1).alias("__one"), *(F.lit(None).cast(dict(probes.dtypes)[c]).alias(c) for c in extra), F.lit(False).alias("__probe"),
                                            F.explode(F.sequence(at, reach)).alias("__range"))
    b = probes.select(*keys, bid, F.lit(None).cast(a.schema["__v"].dataType).alias("__v"), F.lit(None).cast("int").alias("__one"), *extra, F.lit(True).alias("__probe"), at.alias("__range"))
    frame = W.partitionBy(*keys, "__range").orderBy(bid).rangeBetween(-size, -1)
    return a.unionByName(b).withColumn("n_versions", F.count("__one").over(frame)).withColumn("sum_versions", F.sum("__v").over(frame)).where("__probe").select(
        *probes.columns, "n_versions", "sum_versions")


def snapshot(log: DataFrame, keys: list[str], before: int, value: str = "value", bid: str = "bid") -> DataFrame:
    """Per key the newest version below `before`: keys, bid, value."""
    return log.where(F.col(bid) < before).groupBy(*keys).agg(F.max_by(value, bid).alias(value), F.max(bid).alias(bid)).select(*keys, bid, value)


def compact(log: DataFrame, keys: list[str], value: str = "value", bid: str = "bid") -> DataFrame:
    """Per key the newest version as the next base (bid -1)."""
    return log.groupBy(*keys).agg(F.max_by(value, bid).alias(value)).select(*keys, F.lit(BASE).cast("long").alias(bid), value)


def prefix_sum(rows: DataFrame, keys: list[str], value: str, out: str, bid: str = "bid", width: int = WIDTH, span: int | None = None) -> DataFrame:
    """rows with `out`: the sum of `value` over the key's rows with smaller bids (0 if none; nulls add nothing).

    span: a bound of how far the bids lie apart, if it is known; within one range there is nothing to add up.

    Bids are cut into ranges of `width`: sums per key and range are aggregated before they are shuffled and added up over
    ranges, and rows are ordered within a key's range only."""
    if span is not None and span <= width:
        before = W.partitionBy(*keys).orderBy(bid).rangeBetween(W.unboundedPreceding, -1)
        return rows.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))
    cut = rows.withColumn("__range", F.floor(F.col(bid) / width).cast("long"))
    totals = cut.groupBy(*keys, "__range").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__total"))
    earlier = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*(F.col(k).alias(f"__at_{k}") for k in keys), F.col("__range").alias("__at_range"), F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    inside = W.partitionBy(*keys, "__range").orderBy(bid).rangeBetween(W.unboundedPreceding, -1)
    summed = cut.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(totals, _same(keys)).select(*rows.columns, (F.col("__own") + F.col("__before")).alias(out))
