"""Jobs as named stages of DataFrames, and their settings."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.events import generate_ledger


@dataclasses.dataclass(frozen=True)
class JobConfig:
    """Settings of a ledger job; a wrong value is an error when it is made."""

    name: str
    events: int = 10_000
    accounts: int = 4_500
    epoch: int = 1_000
    window: int = 1_024
    skew: float = 0.0
    deposit_share: float = 0.5
    abort_share: float = 0.0
    seed: int = 0

    def __post_init__(self):
        if self.events <= 0 or self.accounts < 2 or self.epoch <= 0 or self.window <= 0:
            raise ValueError("events, epoch and window must be positive, accounts two or more")
        if not 0 <= self.deposit_share <= 1 or not 0 <= self.abort_share <= 1 or self.skew < 0:
            raise ValueError("shares lie between 0 and 1, and the skew isn't negative")


    def ledger(self, spark: SparkSession) -> DataFrame:
        """The job's events, see sources.events.generate_ledger."""
        return generate_ledger(spark, self.events, self.accounts, self.skew, self.deposit_share, self.abort_share, self.seed)


def shuffled(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def by_fields(df: DataFrame, n: int, *fields: str) -> DataFrame:
    return df.repartition(n, *fields)


def partial_key_sums(df: DataFrame, key: str, value: str, salts: int = 16) -> DataFrame:
    """(key, total): sums of a hot key shared out over salts first, then added up."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    return salted.groupBy(key, "__salt").agg(F.sum(value).alias("__part")).groupBy(key).agg(F.sum("__part").alias("total"))


class Topology:
    """Sources, operators and sinks by unique name, each operator on the frames of earlier names."""

    def __init__(self):
        self.frames: dict[str, DataFrame] = {}
        self.sinks: dict[str, Callable[[DataFrame], object]] = {}
        self.parents: dict[str, tuple[str, ...]] = {}

    def _claim(self, name: str, parents: tuple[str, ...]) -> None:
        if name in self.parents:
            raise ValueError(f"{name} is taken")
        if missing := [p for p in parents if p not in self.frames]:
            raise ValueError(f"{name} has no parent {', '.join(missing)}")
        self.parents[name] = parents

    def source(self, name: str, frame: DataFrame) -> Topology:
        self._claim(name, ())
        self.frames[name] = frame
        return self

    def operator(self, name: str, make: Callable[..., DataFrame], *parents: str) -> Topology:
        self._claim(name, parents)
        self.frames[name] = make(*(self.frames[p] for p in parents))
        return self

    def stream(self, name: str, parent: str, condition: Column) -> Topology:
        """A named output of an operator: its rows that fulfil a condition."""
        return self.operator(name, lambda df: df.where(condition), parent)

    def sink(self, name: str, write: Callable[[DataFrame], object], parent: str) -> Topology:
        self._claim(name, (parent,))
        self.sinks[name] = write
        return self

    def run(self) -> dict[str, object]:
        return {name: write(self.frames[self.parents[name][0]]) for name, write in self.sinks.items()}
