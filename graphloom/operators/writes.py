"""Keyed writes over immutable tables: each returns the table's next state, to be written as a new version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.aggregates import first_by_key


def latest(incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with one key, the last by the order columns: the one rule for duplicates in any write."""
    return first_by_key(incoming, keys, order, last=True)


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Incoming rows in the place of the target's rows of equal keys, and the target's other rows. Rows with a null key are always new."""
    new = latest(incoming.where(" and ".join(f"`{k}` is not null" for k in keys)), keys, order)
    nulls = incoming.where(" or ".join(f"`{k}` is null" for k in keys))
    return target.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*target.columns)).unionByName(nulls.select(*target.columns))


def update_from(target: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The target's rows with the given columns from the change of equal key; a null in a change keeps the old value."""
    new = latest(changes.select(*keys, *columns, *[c for c in order if c not in keys and c not in columns]), keys, order).select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns])
    out = target.join(new, list(keys), "left")
    return out.select(*[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def set_where(target: DataFrame, condition: Column, values: dict[str, Column], stamp: str | None = None, now: Column | None = None) -> DataFrame:
    """New values in the rows that meet the condition, which also get the stamp."""
    met = F.coalesce(condition, F.lit(False))
    if stamp:
        values = values | {stamp: now if now is not None else F.current_timestamp()}
    return target.withColumns({c: F.when(met, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_keys(target: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(gone.select(*keys), list(keys), "left_anti")


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is unknown stay."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def delete_missing(target: DataFrame, condition: Column, listed: DataFrame, key: str) -> DataFrame:
    """Of the rows that meet the condition only those whose key is listed stay; the other rows stay."""
    met = F.coalesce(condition, F.lit(False))
    keys = listed.select(F.col(key).alias("__key"), F.lit(True).alias("__listed")).distinct()
    return target.join(keys, F.col(key) == F.col("__key"), "left").where(~met | F.col("__listed")).drop("__key", "__listed")


def purge_orphans(target: DataFrame, column: str, referred: DataFrame, referred_key: str, nullable: bool) -> DataFrame:
    """References to rows that do not exist: set to null where the column may be, else their rows go. Null references stay."""
    keys = referred.select(F.col(referred_key).alias("__key")).distinct()
    out = target.join(keys, F.col(column) == F.col("__key"), "left")
    orphan = F.col(column).isNotNull() & F.col("__key").isNull()
    if nullable:
        return out.withColumn(column, F.when(~orphan, F.col(column))).select(*target.columns)
    return out.where(~orphan).select(*target.columns)


def changed_since(frames: dict[str, DataFrame], moment, created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """Rows created or updated after the moment (None: all), of every type, as one feed."""
    from graphloom.operators.sets import tagged_feed

    if moment is None:
        return tagged_feed(frames)
    at = F.lit(moment)
    late = lambda c: F.coalesce(F.col(c) > at, F.lit(False))
    return tagged_feed({n: f.where(late(created) | late(updated)) for n, f in frames.items()})


def schema_changes(have: DataFrame, want: dict[str, str], renamed: dict[str, str] | None = None) -> list[tuple[str, ...]]:
    """What makes have's columns (name: type) those wanted, in order: ("rename", old, new), ("retype", name, type), ("add", name, type), ("drop", name)."""
    now, steps = dict(have.dtypes), []
    for old, new in (renamed or {}).items():
        if old in now and new in want and new not in now:
            now[new] = now.pop(old)
            steps.append(("rename", old, new))
    steps += [("retype", c, t) for c, t in want.items() if c in now and now[c] != t]
    steps += [("add", c, t) for c, t in want.items() if c not in now]
    return steps + [("drop", c) for c in now if c not in want]


def evolve(df: DataFrame, steps: list[tuple[str, ...]]) -> DataFrame:
    """The table after the steps; a value that does not fit its new type is null."""
    for kind, *x in steps:
        if kind == "rename":
            df = df.withColumnRenamed(*x)
        elif kind == "retype":
            df = df.withColumn(x[0], F.col(x[0]).try_cast(x[1]))
        elif kind == "add":
            df = df.withColumn(x[0], F.lit(None).cast(x[1]))
        else:
            df = df.drop(x[0])
    return df


def row_hash(df: DataFrame, columns: Sequence[str] | None = None, name: str = "state_hash") -> DataFrame:
    """A hash of each row's values."""
    return df.withColumn(name, F.xxhash64(*(columns or df.columns)))
