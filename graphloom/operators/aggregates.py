"""Grouped accumulation, keyed indexes, counters and matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NAMED = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "avg": F.avg}


def accumulate(df: DataFrame, keys: Sequence[str], measures: dict[str, tuple[str, str]], order: Sequence[str]) -> DataFrame:
    """A row for each group: the group's first row by the order columns, with the measures (column: (name of an aggregate, column it reads)) in their places. A partial aggregate runs before the shuffle; no group is gathered."""
    kept = [c for c in df.columns if c not in keys and c not in measures]
    by = F.struct(*order)
    first = [F.min_by(F.struct(*kept), by).alias("__first")] if kept else []
    out = df.groupBy(*keys).agg(*first, *[_NAMED[f.lower()](c).alias(f"__{name}") for name, (f, c) in measures.items()])
    return out.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in kept], *[F.col(f"__{n}").alias(n) for n in measures])


def exact_sum(column: str, scale: int = 4) -> Column:
    """A sum of numbers by way of decimals, so that it does not depend on the order of rows."""
    return F.sum(F.col(column).cast(f"decimal(28,{scale})"))


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False, drop_null_keys: bool = False) -> DataFrame:
    """The first (or last) row of each key by the order columns: an aggregate with a partial step, so a frequent key does not gather in a task."""
    if drop_null_keys:
        df = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    out = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("__row"))
    return out.select(*keys, "__row.*").select(*df.columns)


def next_number(df: DataFrame, column: str) -> DataFrame:
    """One row, next: the greatest number and one, 1 for none."""
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next"))


def first_gap(df: DataFrame, column: str) -> DataFrame:
    """One row, next: the least number after one that exists which itself does not; 1 for none. A join of the numbers with their followers, without a sort of all rows in a task."""
    have = df.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("n")).distinct()
    free = have.select((F.col("n") + 1).alias("n")).join(have, "n", "left_anti")
    return free.agg(F.coalesce(F.min("n"), F.lit(1).cast("long")).alias("next"))


def matrix(df: DataFrame, row: str, column: str, values: Sequence, measure: Column, fill=0) -> DataFrame:
    """A column for each of the values, a row for each row key, the measure in the cells."""
    return df.groupBy(row).pivot(column, list(values)).agg(measure).na.fill(fill)


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` rows of each key; Spark keeps that many of each key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= most).drop("__rank")
