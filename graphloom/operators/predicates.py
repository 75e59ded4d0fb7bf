"""Typed predicates: comparison, null, string-match and membership rules as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a string column compares with a value for equality.
EXACT, IGNORE_CASE, CONTAINING, STARTING, ENDING = "exact", "ignore_case", "containing", "starting_with", "ending_with"
#: More values than this are joined rather than listed in the plan.
LISTED = 1000


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def eq(column: Column | str, value, mode: str = EXACT) -> Column:
    """Equal; None means IS NULL. The mode is for string values on the right: other forms of match than equality, case-sensitive but for IGNORE_CASE."""
    c = _column(column)
    if value is None:
        return c.isNull()
    if mode == EXACT or not isinstance(value, str):
        return c == value
    if mode == IGNORE_CASE:
        return F.lower(c) == F.lower(F.lit(value))
    return {CONTAINING: c.contains, STARTING: c.startswith, ENDING: c.endswith}[mode](F.lit(value))


def ne(column: Column | str, value) -> Column:
    """Not equal, three-valued; None means IS NOT NULL."""
    c = _column(column)
    return c.isNotNull() if value is None else c != value


def gt(column: Column | str, value) -> Column:
    return _column(column) > value


def ge(column: Column | str, value) -> Column:
    return _column(column) >= value


def lt(column: Column | str, value) -> Column:
    return _column(column) < value


def le(column: Column | str, value) -> Column:
    return _column(column) <= value


def both(*conditions: Column | None) -> Column:
    """AND of what is given; of nothing, true."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def either(*conditions: Column | None) -> Column:
    """OR of what is given; of nothing, false."""
    return reduce(lambda a, b: a | b, [c for c in conditions if c is not None], F.lit(False))


def contains(column: Column | str, text: str) -> Column:
    """Literal text anywhere: % and _ stand for themselves."""
    return _column(column).contains(F.lit(text))


def starts_with(column: Column | str, text: str) -> Column:
    return _column(column).startswith(F.lit(text))


def ends_with(column: Column | str, text: str) -> Column:
    return _column(column).endswith(F.lit(text))


def parse_integer(column: Column | str) -> Column:
    """The integer that a text spells, null if it spells none."""
    return F.trim(_column(column)).try_cast("bigint")


def is_in(column: Column | str, values: Iterable | None, nullable: bool = True, negated: bool = False) -> Column:
    """Membership as a collection of values has it, nulls among them: never unknown.

    No values (or None): false. With a null among them a nullable column's nulls are members; other columns ignore it. negated: the opposite, so nulls stay in unless null is a member.
    """
    c = _column(column)
    values = [] if values is None else list(values)
    some = [v for v in values if v is not None]
    null = nullable and len(some) < len(values)
    member = c.isin(some) if some else F.lit(False)
    if null:
        member = member | c.isNull() if some else c.isNull()
    if not negated:
        return F.coalesce(member, F.lit(False))
    if not some and not null:
        return F.lit(True)
    if null:
        return F.coalesce(~member, F.lit(False)) & c.isNotNull()
    return (~c.isin(some)) | c.isNull() if nullable else ~c.isin(some)


def member_rows(df: DataFrame, column: str, values: DataFrame, negated: bool = False) -> DataFrame:
    """Membership in a table of values of any size: a semi or anti join whose side Spark picks by measured size. Null keys match null values, as in is_in."""
    keys = values.select(F.col(values.columns[0]).alias("__value")).distinct()
    return df.join(keys, F.col(column).eqNullSafe(F.col("__value")), "left_anti" if negated else "left_semi")


def any_of(items: Column | str, condition=None) -> Column:
    """Some element that is not null (and meets the condition); false for null and empty collections."""
    test = (lambda x: x.isNotNull()) if condition is None else (lambda x: x.isNotNull() & F.coalesce(condition(x), F.lit(False)))
    return F.coalesce(F.exists(_column(items), test), F.lit(False))


def all_of(items: Column | str, condition) -> Column:
    """Every element meets the condition, a null element does not; true for null and empty collections."""
    return F.coalesce(F.forall(_column(items), lambda x: x.isNotNull() & F.coalesce(condition(x), F.lit(False))), F.lit(True))


def when_given(column: Column | str, value) -> Column | None:
    """Equality, or no condition for None: for optional filters with both()."""
    return None if value is None else eq(column, value)


def not_before(column: Column | str, text: str | None) -> Column | None:
    """From a moment given as yyyy-MM-dd or yyyy-MM-dd_HH-mm-ss; no condition if the text is neither."""
    return _bound(column, text, lambda c, t: c >= t)


def not_after(column: Column | str, text: str | None) -> Column | None:
    return _bound(column, text, lambda c, t: c <= t)


def _bound(column, text, compare) -> Column | None:
    from datetime import datetime

    for form in ("%Y-%m-%d", "%Y-%m-%d_%H-%M-%S"):
        try:
            return compare(_column(column), F.lit(datetime.strptime(text or "", form)).cast("timestamp_ntz"))
        except ValueError:
            continue
    return None


def by_fields(df: DataFrame, conditions: dict) -> Column:
    """A dynamic filter: texts by containing, other values by equality, joined by AND; names that are no columns are left out."""
    known = {c.lower(): c for c in df.columns}
    return both(*[contains(known[k.lower()], v) if isinstance(v, str) else eq(known[k.lower()], v) for k, v in conditions.items() if k.lower() in known])
