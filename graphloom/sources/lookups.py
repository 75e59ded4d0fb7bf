"""Reads of one entity: filtered, ordered and paged fetches, point look-ups, and SQL texts with bound parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Rows of a page when a negative limit asks for the usual one.
USUAL_PAGE = 50


def ordering(column: str, descending: bool = False, tie: str | None = None) -> list[Column]:
    """Nulls first in ascending, last in descending order; the tie-break goes the same way."""
    one = lambda c: F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first()
    return [one(column)] + ([one(tie)] if tie and tie != column else [])


def page(df: DataFrame, skip: int | None = None, limit: int | None = None) -> DataFrame:
    """A negative limit means USUAL_PAGE rows; a negative skip is an error."""
    if skip is not None and skip < 0:
        raise ValueError(f"skip is negative: {skip}")
    df = df.offset(skip) if skip else df
    return df if limit is None else df.limit(USUAL_PAGE if limit < 0 else limit)


def page_number(number: int, size: int) -> tuple[int, int]:
    """Skip and limit of a page; pages begin with 1."""
    return (number - 1) * size, size


def fetch(df: DataFrame, where: Column | None = None, order_by: str | None = None, descending: bool = False, skip: int | None = None, limit: int | None = None, identifier: str | None = None) -> DataFrame:
    """Filter, order (ties by identifier) and page: lazy, the filter and the columns reach the scan."""
    out = df if where is None else df.where(where)
    by = order_by or (identifier if skip or limit is not None else None)
    out = out.orderBy(*ordering(by, descending, identifier)) if by else out
    return page(out, skip, limit)


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The row of that key, or none."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def first_or_none(df: DataFrame) -> Row | None:
    return df.head()


def exists(df: DataFrame, key: str, value) -> DataFrame:
    """One row, Value: how many rows have that key."""
    return df.where(F.col(key) == F.lit(value)).agg(F.count("*").alias("Value"))


def any_rows(df: DataFrame, where: Column | None = None) -> DataFrame:
    """One row, Value: whether any row meets the condition; the scan ends at the first."""
    hit = (df if where is None else df.where(where)).select(F.lit(1)).limit(1)
    return hit.agg((F.count("*") > 0).alias("Value"))


def key_map(df: DataFrame, wanted: DataFrame, from_key: str, to_key: str) -> DataFrame:
    """(from_key, to_key) of the wanted keys that exist; Spark broadcasts the side that it measures to be small."""
    return df.select(from_key, to_key).join(wanted.select(from_key).distinct(), from_key, "left_semi")


def ensure_row(df: DataFrame, where: Column, default: DataFrame) -> DataFrame:
    """The first row that matches, or the default if none does."""
    hit = df.where(where).limit(1)
    missing = default.join(hit.agg(F.count("*").alias("__n")), F.col("__n") == 0).drop("__n")
    return hit.unionByName(missing)


def run_sql(spark: SparkSession, text: str, **parameters) -> DataFrame:
    """SQL with :name parameters, bound and never pasted into the text."""
    return spark.sql(text, args=parameters)


def stream_rows(df: DataFrame) -> Iterator[Row]:
    """Rows partition by partition, the next one fetched meanwhile: the driver holds two partitions, never the result."""
    return df.toLocalIterator(prefetchPartitions=True)


def scalar(df: DataFrame):
    row = df.head()
    return row[0] if row else None


def rows_as_dicts(df: DataFrame) -> Iterator[dict]:
    return (r.asDict(recursive=True) for r in stream_rows(df))


_CALLS: dict[str, Callable[..., DataFrame]] = {}


def named_call(name: str, function: Callable[..., DataFrame] | None = None, **arguments) -> DataFrame | None:
    """With a function: register it under the name. Without: the table that the registered function returns for the arguments."""
    if function is not None:
        _CALLS[name] = function
        return None
    return _CALLS[name](**arguments)
