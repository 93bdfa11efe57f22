"""A small relational query builder over DataFrames, and table maintenance by rewriting.

The builder collects a query's parts and hands them to Catalyst as one DataFrame; scans, pushdown, join order and join
algorithm are Spark's."""

from __future__ import annotations

import dataclasses
import enum

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


class Predicate(enum.Enum):
    EQUALS = "eq"
    NOT_EQUALS = "ne"
    LESS_THAN = "lt"
    LESS_THAN_EQUALS = "le"
    GREATER_THAN = "gt"
    GREATER_THAN_EQUALS = "ge"

    def on(self, column: Column, literal) -> Column:
        """Ordinary comparison of the column's type; null is never selected."""
        return {"eq": column == literal, "ne": column != literal, "lt": column < literal, "le": column <= literal,
                "gt": column > literal, "ge": column >= literal}[self.value]


#: Join algorithms by name, as hints; None leaves the choice to Spark.
JOIN_HINTS = {None: None, "hash": "shuffle_hash", "sort_merge": "merge", "nested_loop": "shuffle_replicate_nl", "broadcast": "broadcast"}
#: Rows of the joined side up to which a hint to copy it to all tasks, or to meet every row with it, is followed.
SMALL_SIDE = {"broadcast": 100_000, "nested_loop": 1_000}


@dataclasses.dataclass(frozen=True)
class Query:
    """select, join, group, aggregate, order and project over named tables. Methods return a longer query.

    Columns may be qualified by table or alias; an unqualified name that two tables have, or none has, is an error of
    analysis. Joins are inner equi-joins whose two columns must have one type. A grouped query may project its group
    column and aggregates only. Integer sums are bigint, averages double; a global average of no rows is 0."""

    frame: DataFrame
    aggregates: tuple[tuple[str, str | None], ...] = ()
    group: str | None = None
    columns: tuple[str, ...] = ()
    order: tuple[str, bool, int | None] | None = None

    @staticmethod
    def table(frame: DataFrame, alias: str | None = None) -> Query:
        return Query(frame.alias(alias) if alias else frame)

    def where(self, column: str, predicate: Predicate, literal) -> Query:
        return dataclasses.replace(self, frame=self.frame.where(predicate.on(F.col(column), literal)))

    def join(self, other: DataFrame, left: str, right: str, alias: str | None = None, algorithm: str | None = None) -> Query:
        side = other.alias(alias) if alias else other
        kinds = self.frame.select(left).dtypes[0][1], side.select(right).dtypes[0][1]
        if kinds[0] != kinds[1]:
            raise TypeError(f"join of {left} {kinds[0]} with {right} {kinds[1]}")
        most = SMALL_SIDE.get(algorithm)
        # A side that is too long for the algorithm asked for is joined as Spark chooses.
        if JOIN_HINTS[algorithm] and (most is None or other.limit(most + 1).count() <= most):
            side = side.hint(JOIN_HINTS[algorithm])
        return dataclasses.replace(self, frame=self.frame.join(side, F.col(left) == F.col(right), "inner"))

    def group_by(self, column: str) -> Query:
        return dataclasses.replace(self, group=column)

    def count(self) -> Query:
        return dataclasses.replace(self, aggregates=(*self.aggregates, ("count", None)))

    def sum(self, column: str) -> Query:
        return dataclasses.replace(self, aggregates=(*self.aggregates, ("sum", column)))

    def average(self, column: str) -> Query:
        return dataclasses.replace(self, aggregates=(*self.aggregates, ("average", column)))

    def project(self, *columns: str) -> Query:
        if not columns or self.columns:
            raise ValueError("a query projects once, and something")
        return dataclasses.replace(self, columns=columns)

    def order_by(self, column: str, ascending: bool = True, limit: int | None = None) -> Query:
        return dataclasses.replace(self, order=(column, ascending, limit))

    def to_df(self) -> DataFrame:
        out = self.frame
        if self.aggregates or self.group:
            made = {"count": lambda c: F.count("*").alias("countAgg"), "sum": lambda c: F.sum(c).alias("sumAgg"),
                    "average": lambda c: (F.avg(c) if self.group else F.coalesce(F.avg(c), F.lit(0.0))).alias("averageAgg")}
            if any(c != self.group for c in self.columns):
                raise ValueError("a grouped query projects its group column only")
            aggregates = [made[k](c) for k, c in self.aggregates] or [F.count("*").alias("countAgg")]
            out = out.groupBy(*[self.group] if self.group else []).agg(*aggregates)
        elif self.columns:
            out = out.select(*self.columns)
        if self.order:
            column, ascending, limit = self.order
            out = out.orderBy(F.col(column).asc() if ascending else F.col(column).desc())
            out = out if limit is None else out.limit(limit)
        return out


#: Value types of table configurations.
TYPES = {"int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
         "string": T.StringType(), "byte": T.ByteType(), "short": T.ShortType(), "timestamp": T.TimestampType(), "decimal": T.DecimalType(38, 12)}


def schema(key: str, values: dict[str, str]) -> T.StructType:
    """A string key and typed value columns; an unknown type name is a string."""
    return T.StructType([T.StructField(key, T.StringType(), False), *(T.StructField(n, TYPES.get(t, T.StringType())) for n, t in values.items())])


def initial_state(spark: SparkSession, rows: int, values: dict[str, str], key: str = "Key") -> DataFrame:
    """Rows 0 to rows - 1: the key as text, the first value column equal to it, other values null."""
    own = schema(key, values)
    cast = [F.col("id").cast(f.dataType).alias(f.name) if i <= 1 else F.lit(None).cast(f.dataType).alias(f.name) for i, f in enumerate(own.fields)]
    return spark.range(rows).select(*cast)


def temp_table(table: DataFrame, name: str) -> DataFrame:
    """The table under a name of the session, for SQL; an earlier one of that name is replaced. It holds no rows of its own."""
    table.createOrReplaceTempView(name)
    return table.sparkSession.table(name)


def drop_temp_table(spark: SparkSession, name: str) -> bool:
    """Whether there was one."""
    return spark.catalog.dropTempView(name)


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with rows added, by name; missing or extra columns are errors."""
    return table.unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without the rows whose key is in keys; rows with a null key stay."""
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the columns of changes in the rows of its keys. A key that changes holds twice is an error of the
    caller's: its rows multiply. Nulls in changes overwrite."""
    own = [c for c in changes.columns if c != key]
    side = changes.select(F.col(key).alias("__key"), F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in own))
    met = table.join(side, F.col(key) == F.col("__key"), "left")
    return met.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in table.columns))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of their keys, and new keys are inserted; rows must have the table's columns."""
    return delete(table, rows, key).unionByName(rows)
