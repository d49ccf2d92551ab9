"""Aggregates that can be taken in parts: a part's state merges with others, in any order, to that of the whole.

The same list of folds gives the batch form (one part), a running table (a part per micro-batch) and its
compaction. States are columns of numbers, moments, ``struct<at, value>`` and sets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    """``kind``: sum, max, newest (the value with the greatest ``at``) or seen (the set of values).

    Rows that don't satisfy ``when`` leave no trace.
    """

    name: str
    kind: str
    value: Column
    when: Column | None = None
    at: Column | None = None

    def _masked(self, value: Column) -> Column:
        return value if self.when is None else F.when(self.when, value)

    def part(self) -> Column:
        if self.kind == "sum":
            return F.sum(self._masked(self.value)).alias(self.name)
        if self.kind == "max":
            return F.max(self._masked(self.value)).alias(self.name)
        if self.kind == "newest":
            return F.max(self._masked(F.struct(self.at.alias("at"), self.value.alias("value")))).alias(self.name)
        return F.collect_set(self._masked(self.value)).alias(self.name)

    def merged(self) -> Column:
        if self.kind == "sum":
            return F.sum(self.name).alias(self.name)
        if self.kind == "seen":
            return F.array_distinct(F.flatten(F.collect_set(self.name))).alias(self.name)
        return F.max(self.name).alias(self.name)


def count(name: str, when: Column | None = None) -> Fold:
    """How many rows satisfy ``when``."""
    return Fold(name, "sum", F.lit(1).cast("bigint") if when is None else F.when(when, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))


def parts(rows: DataFrame, keys: Sequence[str], folds: Sequence[Fold]) -> DataFrame:
    """One state per key."""
    return rows.groupBy(*keys).agg(*[f.part() for f in folds])


def merge(states: DataFrame, keys: Sequence[str], folds: Sequence[Fold]) -> DataFrame:
    """States of several parts as one per key."""
    return states.groupBy(*keys).agg(*[f.merged() for f in folds])
