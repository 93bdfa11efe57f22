"""Transactional events as text or JSON lines, and generated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import scalar

FIELDS = "keys map<string, array<string>>, vals map<string, string>, types map<string, string>, flag string, is_abort boolean"


def _map(text: Column) -> Column:
    """'name:value,...' as a map; text without a colon has a null value; '' is an empty map."""
    pairs = F.filter(F.split(text, ","), lambda p: p != "")
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.element_at(F.split(p, ":"), 1).alias("k"), F.get(F.split(p, ":"), 1).alias("v"))))


def parse_text(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with the fields of `table:key:...,...;name:value,...;name:type,...;flag;true|false`.

    Lines without exactly five fields (the word 'pause', empty or null lines) are dropped. A repeated table or name in a
    line is an error of Spark's map functions."""
    parts = F.split(column, ";", -1)
    tables = F.filter(F.split(parts[0], ","), lambda p: p != "")
    keys = F.map_from_entries(F.transform(tables, lambda p: F.struct(
        F.element_at(F.split(p, ":"), 1).alias("k"), F.slice(F.split(p, ":"), 2, F.size(F.split(p, ":"))).alias("v"))))
    return lines.where(F.size(parts) == 5).select("*", keys.alias("keys"), _map(parts[1]).alias("vals"), _map(parts[2]).alias("types"), parts[3].alias("flag"),
                                                  (F.lower(parts[4]) == "true").alias("is_abort"))


def parse_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with the same fields from JSON objects subJson0 to subJson4; lines that aren't such objects are dropped."""
    kind = "subJson0 map<string, array<string>>, subJson1 map<string, string>, subJson2 map<string, string>, subJson3 string, subJson4 string"
    own = lines.withColumn("__j", F.from_json(column, kind)).where("__j.subJson3 is not null")
    return own.select(*lines.columns, F.col("__j.subJson0").alias("keys"), F.col("__j.subJson1").alias("vals"), F.col("__j.subJson2").alias("types"),
                      F.col("__j.subJson3").alias("flag"), (F.lower("__j.subJson4") == "true").alias("is_abort"))


def to_text(events: DataFrame) -> Column:
    """The text line of parsed events; entries in the order of their names."""
    def joined(m: Column, value) -> Column:
        return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(":", e["key"], value(e["value"]))), ",")

    return F.concat_ws(";", joined(F.col("keys"), lambda v: F.array_join(v, ":")), joined(F.col("vals"), lambda v: v), joined(F.col("types"), lambda v: v),
                       F.col("flag"), F.col("is_abort").cast("string"))


def numbered(events: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """events with `bid` from 0 without gaps in the order of unique columns: ranges (one for about a million rows, 64 at
    least) are counted, then numbered apart."""
    ranges = ranges or max(64, -(-events.count() // 1_000_000))
    ranged = events.repartitionByRange(ranges, *order).withColumn("__p", F.spark_partition_id())
    ranged = ranged.withColumn("__i", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"))  # one row per range
    first = sizes.select(F.col("__p").alias("__q"), (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__first"))
    return ranged.join(F.broadcast(first), F.col("__p") == F.col("__q")).select(*events.columns, (F.col("__first") + F.col("__i") - 1).alias("bid"))


def generate_ledger(spark: SparkSession, n: int, accounts: int, skew: float = 0.0, deposit_share: float = 0.5, abort_share: float = 0.0, seed: int = 0) -> DataFrame:
    """n events (bid, flag, src, dest, amount, is_abort): deposits (dest null) and transfers with src <> dest, keys by
    Zipf, amounts 0 to 9999; all decided by hashes of bid and seed."""
    u = lambda k: scalar.uniform(seed * 16 + k, F.col("bid"))
    src = scalar.zipf(u(1), accounts, skew)
    dest = F.pmod(src + 1 + scalar.flat(u(2), 0, accounts - 1), F.lit(accounts))
    deposit = u(0) < deposit_share
    return spark.range(n).select(F.col("id").alias("bid")).select(
        "bid", F.when(deposit, "deposit").otherwise("transfer").alias("flag"), src.alias("src"), F.when(~deposit, dest).alias("dest"),
        scalar.flat(u(3), 0, 10_000).alias("amount"), (u(4) < abort_share).alias("is_abort"))
