"""Loose comparison: two-valued tests between columns of any type, written as Column expressions.

Texts compare without case, numbers within 1e-9, dates as dates; null is the lowest value and equals only null. Every test is true or false, never null.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers nearer than this are equal.
NEAR = 1e-9


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def _text(c: Column) -> Column:
    return F.lower(c.cast("string"))


def same(a, b) -> Column:
    """Both null; or both numbers and near; or equal texts without case."""
    a, b = _col(a), _col(b)
    x, y = _number(a), _number(b)
    one = F.when(x.isNotNull() & y.isNotNull(), (F.abs(x - y) < NEAR) | x.eqNullSafe(y)).otherwise(_text(a) == _text(b))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(one)


def differs(a, b) -> Column:
    return ~same(a, b)


def _order(a, b, number, text) -> Column:
    x, y = _number(a), _number(b)
    s, t = a.cast("string").try_cast("timestamp"), b.cast("string").try_cast("timestamp")
    return F.when(x.isNotNull() & y.isNotNull(), number(x, y)).when(s.isNotNull() & t.isNotNull(), number(s, t)).otherwise(text(_text(a), _text(b)))


def below(a, b) -> Column:
    """Null is below everything but null; then by number, else by date, else by text without case."""
    a, b = _col(a), _col(b)
    less = lambda x, y: x < y
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNotNull()).otherwise(_order(a, b, less, less))


def at_most(a, b) -> Column:
    return ~below(b, a)


def above(a, b) -> Column:
    return below(b, a)


def at_least(a, b) -> Column:
    return ~below(a, b)


def among(a, values: Iterable) -> Column:
    """Loosely equal to one of the values; of none, false."""
    out = F.lit(False)
    for v in values:
        out = out | same(a, v)
    return out


def like(a, pattern: str) -> Column:
    """% for any text and _ for any character, without case, over the whole text; null is the empty text; a backslash is itself."""
    return F.coalesce(_col(a).cast("string"), F.lit("")).ilike(pattern.replace("\\", "\\\\"))


def contains(a, part) -> Column:
    return F.coalesce(_text(_col(a)), F.lit("")).contains(F.coalesce(_text(_col(part)), F.lit("")))


def starts(a, part) -> Column:
    return F.coalesce(_text(_col(a)), F.lit("")).startswith(F.coalesce(_text(_col(part)), F.lit("")))


def ends(a, part) -> Column:
    return F.coalesce(_text(_col(a)), F.lit("")).endswith(F.coalesce(_text(_col(part)), F.lit("")))


def lower(a) -> Column:
    return F.lower(F.coalesce(_col(a).cast("string"), F.lit("")))


def upper(a) -> Column:
    return F.upper(F.coalesce(_col(a).cast("string"), F.lit("")))


def truth(a: Column, kind: str) -> Column:
    """A bare value as a condition, by its type: null is false, a boolean itself, a text true unless empty, a number unless 0, others true."""
    if kind == "boolean":
        return F.coalesce(a, F.lit(False))
    if kind == "string":
        return F.coalesce(a != "", F.lit(False))
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.coalesce(a != 0, F.lit(False))
    return a.isNotNull()
