"""Order-sensitive operators. Rows have no order of their own in Spark, so each takes the columns to order by, and keys within which it works.

With keys, a window per key does the work. Without keys a plain window would gather all rows in one task; `indexed` numbers rows in parallel instead, and the other operators build on its numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that are numbered side by side when there are no keys: these at least, twice the session's shuffle partitions, MOST_PARTS at most.
PARTS, MOST_PARTS = 64, 512


def _range_of(order: Column, bounds: list[Column], low: int = 0) -> Column:
    """How many of the ascending bounds are at or below the order, by halving."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(order >= bounds[mid], _range_of(order, bounds[mid + 1 :], low + mid + 1)).otherwise(_range_of(order, bounds[:mid], low))


def indexed(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "index") -> DataFrame:
    """A running number from 0. Without keys: rows fall into ranges of the order columns, more of them the larger the session's exchanges are, and each range's numbers begin after the rows of those before it."""
    if keys:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    # A bounded sample only gives the bounds of the parts; what counts is exact, over all rows.
    kinds = [df.schema[c].dataType for c in order]
    parts = max(PARTS, min(MOST_PARTS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    some = df.select(*order).distinct().orderBy(F.xxhash64(*order)).limit(parts * 16).orderBy(*order).collect()
    bounds = [F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(r, kinds, order, strict=True)]) for r in some[16::16]]
    placed = df.withColumn("__part", _range_of(F.struct(*order), bounds))
    before = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = before.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    # At most MOST_PARTS rows are broadcast.
    return placed.withColumn(name, inside).join(F.broadcast(before), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def pairwise(df: DataFrame, columns: Sequence[str], order: Sequence[str], keys: Sequence[str], prefix: str = "previous_") -> DataFrame:
    """Each row but a key's first, beside the row before it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumns({f"{prefix}{c}": F.lag(c).over(w) for c in columns} | {"__n": F.row_number().over(w)})
    return out.where("__n > 1").drop("__n")


def _failed(condition: Column, order: Sequence[str], keys: Sequence[str]) -> Column:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.max((~F.coalesce(condition, F.lit(False))).cast("int")).over(w)


def take_while(df: DataFrame, condition: Column, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """A key's rows up to the first that fails the condition."""
    return df.withColumn("__failed", _failed(condition, order, keys)).where("__failed = 0").drop("__failed")


def skip_while(df: DataFrame, condition: Column, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """A key's rows from the first that fails the condition on."""
    return df.withColumn("__failed", _failed(condition, order, keys)).where("__failed = 1").drop("__failed")


def neighbour(df: DataFrame, condition: Column, order: Sequence[str], keys: Sequence[str], after: bool = False) -> DataFrame:
    """The row just before (or after) each key's first match; no row where there is none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("__n", F.row_number().over(w)).withColumn("__hit", F.coalesce(condition, F.lit(False)))
    first = F.min(F.when(F.col("__hit"), F.col("__n"))).over(Window.partitionBy(*keys))
    return numbered.withColumn("__first", first).where(F.col("__n") == F.col("__first") + (1 if after else -1)).drop("__n", "__hit", "__first")


def chunks(df: DataFrame, columns: Sequence[str], size: int, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Arrays of `size` consecutive rows of a key, the last one shorter: (keys, chunk, items)."""
    if size < 1:
        raise ValueError(f"a chunk of {size} rows")
    numbered = indexed(df, order, keys, "__n")
    items = F.array_sort(F.collect_list(F.struct("__n", F.struct(*columns).alias("row"))))
    return numbered.groupBy(*keys, F.floor(F.col("__n") / size).alias("chunk")).agg(F.transform(items, lambda x: x["row"]).alias("items"))


def index_of(df: DataFrame, condition: Column, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, index): where each key's first match is, from 0; -1 without one."""
    numbered = indexed(df, order, keys, "__n")
    return numbered.groupBy(*keys).agg(F.coalesce(F.min(F.when(condition, F.col("__n"))), F.lit(-1)).alias("index"))


def take(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows: each task keeps n at most."""
    return df.orderBy(*order).limit(n)


def part(df: DataFrame, start: int, count: int, order: Sequence[str]) -> DataFrame:
    """count rows from place `start` on."""
    return df.orderBy(*order).offset(start).limit(count)


def sample(df: DataFrame, n: int, seed: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """n rows at random without replacement (all, if fewer). With keys: those whose hash of seed and keys comes first, which depends on nothing else; without: the same ones for the same seed and layout of the input."""
    r = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])) if keys else F.rand(seed)
    return df.withColumn("__r", r).orderBy("__r", *keys).limit(n).drop("__r")
