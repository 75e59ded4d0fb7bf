"""Unions, set operators and combinations of collections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concat(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


def ordered_merge(key: str, order: Sequence[str], *frames: DataFrame) -> DataFrame:
    """Several ordered streams as one: by key, of equal keys the earlier stream's first, then each stream's own order. Column stream tells where a row is from."""
    tagged = [f.withColumn("stream", F.lit(i)) for i, f in enumerate(frames)]
    return concat(*tagged).orderBy(key, "stream", *order)


def tagged_feed(frames: dict[str, DataFrame], width: int | None = None) -> DataFrame:
    """Rows of several types as one table: type_name, then every value as text, c0, c1, ... with nulls up to the widest type."""
    width = width or max(len(f.columns) for f in frames.values())
    rows = [f.select(F.lit(name).alias("type_name"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(f.columns)], *[F.lit(None).cast("string").alias(f"c{i}") for i in range(len(f.columns), width)]) for name, f in frames.items()]
    return reduce(lambda a, b: a.union(b), rows)


def split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the condition, and those that do not or cannot tell."""
    met = F.coalesce(condition, F.lit(False))
    return df.where(met), df.where(~met)


def flatten(items: Column | str) -> Column:
    """Nested arrays as one, without null arrays and elements."""
    c = F.col(items) if isinstance(items, str) else items
    return F.array_compact(F.flatten(F.array_compact(c)))


def each(df: DataFrame, items: str, name: str) -> DataFrame:
    """A row for each element; none for null and empty arrays."""
    return df.withColumn(name, F.explode(items))
