"""Table statistics, histograms, pivots, distinct sets and set membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def histogram(table: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """(bucket, low, high, n): equal widths over [min, max], the last bucket closed. Nulls don't count; a constant column
    fills bucket 0; an empty one gives no rows."""
    low, high = table.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None:
        return table.sparkSession.createDataFrame([], "bucket int, low double, high double, n long")
    width = (high - low) / buckets
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(buckets - 1)).cast("int") if width else F.lit(0)
    n = table.where(F.col(column).isNotNull()).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
    return n.select("bucket", (F.lit(low) + F.col("bucket") * width).alias("low"), (F.lit(low) + (F.col("bucket") + 1) * width).alias("high"), "n")


def estimated_rows(buckets: DataFrame, start: float, end: float) -> DataFrame:
    """(estimate): rows in [start, end), buckets counting by the part of them that lies inside."""
    part = (F.least("high", F.lit(end)) - F.greatest("low", F.lit(start))) / (F.col("high") - F.col("low"))
    return buckets.agg(F.coalesce(F.sum(F.col("n") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), part))), F.lit(0.0)).alias("estimate"))


def column_stats(table: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: name, rows, nulls, ndv (exact) and the extremes as text; one pass."""
    made = table.agg(*(x for c in columns for x in (
        F.count("*").alias(f"{c}.rows"), F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}.nulls"), F.countDistinct(c).alias(f"{c}.ndv"),
        F.min(c).cast("string").alias(f"{c}.low"), F.max(c).cast("string").alias(f"{c}.high"))))
    rows = [F.struct(F.lit(c).alias("name"), *(F.col(f"`{c}.{k}`").alias(k) for k in ("rows", "nulls", "ndv", "low", "high"))) for c in columns]
    return made.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def pivot_sums(table: DataFrame, row: str, column: str, values: list, value: str | None = None) -> DataFrame:
    """A contingency table with the given column values, and each row's total; cells without rows are 0."""
    cell = F.sum(value) if value else F.count(F.lit(1))
    out = table.groupBy(row).pivot(column, values).agg(cell).na.fill(0)
    return out.withColumn("total", sum((F.col(f"`{v}`") for v in values), F.lit(0)))


def distinct_sets(table: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_distinct): sizes of the keys' value sets; null is no member. Pairs are made distinct before they meet."""
    return table.select(key, value).distinct().groupBy(key).agg(F.count(value).alias("n_distinct"))


def members(table: DataFrame, of: DataFrame, column: str, inside: bool = True) -> DataFrame:
    """Rows whose column is (or isn't) in `of`: exact, where a Bloom filter would guess. Spark adds its own filter where
    that pays."""
    return table.join(of.select(column).distinct(), column, "left_semi" if inside else "left_anti")


def decayed_counts(events: DataFrame, key: str, weight: str, ts: str, half_life: float, at: float) -> DataFrame:
    """(key, level): the sum of weights, each halved for every half_life between its time and `at` (in the unit of ts);
    later events don't count."""
    age = F.lit(at) - F.col(ts)
    return events.where(age >= 0).groupBy(key).agg(F.sum(F.col(weight) * F.pow(F.lit(0.5), age / half_life)).alias("level"))
