"""Scalar functions over columns: text, dates, numbers, formats, maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def or_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def is_empty(x: Column | str) -> Column:
    return or_empty(x) == ""


def without(x: Column | str, part: str) -> Column:
    return F.replace(_c(x), F.lit(part), F.lit(""))


def replaced(x: Column | str, part: str, by: str) -> Column:
    """Every occurrence of the part, taken literally."""
    return F.replace(_c(x), F.lit(part), F.lit(by))


def pattern_replaced(x: Column | str, pattern: str, by: str) -> Column:
    """Every match of the pattern; $1 and so on stand for its groups."""
    return F.regexp_replace(_c(x), pattern, by)


def matches(x: Column | str, pattern: str) -> Column:
    """Null matches nothing."""
    return F.coalesce(_c(x).rlike(pattern), F.lit(False))


def extract(x: Column | str, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract(_c(x), pattern, group), F.lit(""))


def glob(x: Column | str, pattern: str) -> Column:
    """* for any text and ? for any character, over the whole text."""
    parts = "".join(".*" if ch == "*" else "." if ch == "?" else f"\\Q{ch}\\E" for ch in pattern)
    return matches(x, f"(?s)^{parts}$")


def is_base64(x: Column | str) -> Column:
    c = _c(x)
    return F.coalesce((F.length(c) % 4 == 0) & (c != "") & ~c.rlike(r"\s") & F.try_to_binary(c, F.lit("base64")).isNotNull(), F.lit(False))


def start_of_day(x: Column | str) -> Column:
    return F.date_trunc("day", _c(x))


def end_of_day(x: Column | str) -> Column:
    """The day's last whole second."""
    return F.date_trunc("day", _c(x)) + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59), F.lit(59))


def rounded(x: Column | str, places: int = 0) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(_c(x), places)


def mapped(x: Column | str, low: float, high: float, to_low: float, to_high: float) -> Column:
    """Linear from one range to another, held within the second."""
    c = _c(x).cast("double")
    y = (c - low) / (high - low) * (to_high - to_low) + to_low
    return F.when(c.isNotNull(), F.greatest(F.least(y, F.lit(float(max(to_low, to_high)))), F.lit(float(min(to_low, to_high)))))


def in_base(x: Column | str, from_base: int, to_base: int) -> Column:
    return F.conv(_c(x).cast("string"), from_base, to_base)


def is_prime(x: Column | str) -> Column:
    """By trial of the divisors up to the root; null and numbers under 2 are none."""
    c = _c(x).cast("long")
    root = F.greatest(F.floor(F.sqrt(c)).cast("long"), F.lit(1))
    divided = F.exists(F.sequence(F.lit(1).cast("long"), root), lambda d: (d > 1) & (c % d == 0))
    return F.coalesce((c >= 2) & ~divided, F.lit(False))


def fibonacci(x: Column | str) -> Column:
    """The number at that place: 0 and 1 at places 0 and 1; null below 0 and above 92, the last one of 64 bits."""
    c = _c(x).cast("int")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    steps = F.when(c > 0, F.sequence(F.lit(1), c)).otherwise(F.array().cast("array<int>"))
    # The follower may pass 64 bits at the last place, where it is not read.
    last = F.aggregate(steps, F.struct(zero.alias("a"), one.alias("b")), lambda s, _: F.struct(s["b"].alias("a"), F.try_add(s["a"], s["b"]).alias("b")))
    return F.when(c.between(0, 92), last["a"])


def as_map(*columns: str) -> Column:
    """A map of the columns' names to their values as text."""
    return F.create_map(*[part for c in columns for part in (F.lit(c), F.col(c).cast("string"))])


def byte_size(x: Column | str) -> Column:
    """A number of bytes for people: 1536 is 1.50 KB."""
    c = _c(x).cast("double")
    out = F.format_string("%d B", _c(x).cast("long"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        out = F.when(c >= 1024.0**k, F.format_string(f"%.2f {unit}", c / 1024.0**k)).otherwise(out)
    return out


def money(x: Column | str, symbol: str = "$") -> Column:
    return F.concat(F.lit(symbol), F.format_number(_c(x), 2))


def digest(x: Column | str, bits: int = 256) -> Column:
    return F.sha2(_c(x).cast("binary"), bits)


def as_json(*columns: str) -> Column:
    """An object of the columns, nulls written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def at_path(json: Column | str, path: str) -> Column:
    """The value at a path like a.b[0] of a JSON text; null where there is none."""
    return F.get_json_object(_c(json), f"$.{path}")


def attempted(value: Column, kind: str) -> Column:
    """A struct (ok, value, error) of a conversion that may fail."""
    out = value.try_cast(kind)
    failed = value.isNotNull() & out.isNull()
    return F.struct((~failed).alias("ok"), out.alias("value"), F.when(failed, F.concat(F.lit("not a "), F.lit(kind), F.lit(": "), value.cast("string"))).alias("error"))


def filled(template: str, **values: Column | str) -> Column:
    """The template with each {name} replaced by its value as text; null is the empty text."""
    import string

    parts = []
    for text, name, form, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            c = _c(values[name])
            parts.append(or_empty(F.date_format(c, form) if form and any(k in form for k in "yMdHms") else F.format_number(c, int(form)) if form else c.cast("string")))
    return F.concat(*parts) if parts else F.lit("")
