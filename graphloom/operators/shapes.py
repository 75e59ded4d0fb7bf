"""Rows in other shapes: renamed, mapped by name, as keys and values, across two groups, checked by length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under other names (old: new); names that are no columns are left out, other columns stay."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def mapped_into(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The columns of a schema (name: type) by name, whatever its case; what does not fit its type, and what there is no column for, is null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[n.lower()]}`").try_cast(t) if n.lower() in have else F.lit(None).cast(t)).alias(n) for n, t in schema.items()])


def key_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """(keys, name, value as text): a row for each of the columns, all but the keys if not given; nulls stay."""
    columns = [c for c in df.columns if c not in keys] if columns is None else list(columns)
    texts = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot(list(keys), columns, "name", "value")


def first_member(items: Column | str, member: str) -> Column:
    """A member of a list's first element; null for null and empty lists."""
    return F.get(F.col(items) if isinstance(items, str) else items, 0)[member]


def length_between(column: Column | str, least: int = 0, most: int | None = None) -> Column:
    """Whether a text has so many characters; null has none."""
    n = F.coalesce(F.char_length(F.col(column) if isinstance(column, str) else column), F.lit(0))
    return n >= least if most is None else n.between(least, most)


def cross_matrix(rows: DataFrame, columns: DataFrame, on: Column, row: str, column: str, values: Sequence, measure: Column, fill=0) -> DataFrame:
    """A row for each row key of the first table, a column for each of the values of the second, and the measure of what the join pairs in the cells; row keys that pair with nothing have the fill in all."""
    return rows.join(columns, on, "left").groupBy(row).pivot(column, list(values)).agg(measure).na.fill(fill)
