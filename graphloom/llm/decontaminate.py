"""Benchmark decontamination by template windows: items are found again with other numbers, names and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import let, text_or_empty

#: Words after a number that are its unit.
UNITS = ["km", "m", "cm", "mm", "kg", "g", "mg", "l", "ml", "s", "min", "h", "hours", "hour", "days", "day", "miles", "mile", "feet", "inches", "pounds", "percent", "dollars", "euros", "cents"]
#: Template tokens that stand for a slot.
_SLOTS = ["#", "~", "%"]
_SEED = 42


#: What stands between the digits of one number.
_POINT = ".,'\u2019\u00a0\u202f"


def _tokens(text: Column) -> Column:
    """Words and numbers in lower case; a number keeps its separators, a run of capitalised words inside a sentence is one name, and each of its words begins with ~."""
    marked = F.regexp_replace(text, r"(?<=[\p{Ll},;] )(?=\p{Lu}\p{Ll})", "~")
    named = F.regexp_replace(marked, r" (?=~)(?<=~[\p{L}\p{M}]{1,40} )", "")
    word = r"[a-z0-9~\p{L}\p{M}\p{N}]++"
    return F.regexp_extract_all(F.lower(named), F.lit(rf"{word}(?:(?<=[0-9])[{_POINT}](?=[0-9]){word})*+"), F.lit(0))


def _template(tokens: Column, then=lambda t: t) -> Column:
    """then(template token) of each token: numbers become #, names ~, units after a number %."""
    digit = lambda t: (t >= "0") & (t < ":")  # noqa: E731  its first character

    def one(t: Column, i: Column) -> Column:
        unit = t.isin(UNITS) & digit(F.coalesce(F.get(tokens, i - 1), F.lit("")))
        return then(F.when(digit(t), "#").when(t.startswith("~"), "~").when(unit, "%").otherwise(t))

    return F.transform(tokens, one)


def _windows(rows: DataFrame, tokens: Column, widths: list[int]) -> DataFrame:
    """rows' columns with (place, width, h): the windows of the tokens' template at every token, of each of the widths. A window's hash is made of its tokens' hashes, each taken once."""
    ahead = [f"__{k}" for k in range(max(widths))]

    def places(hashes: Column) -> Column:
        return F.transform(hashes, lambda h, i: F.struct((i + 1).alias("place"), *[(F.get(hashes, i + k) if k else h).alias(name) for k, name in enumerate(ahead)]))

    at = rows.select(*rows.columns, F.inline(let(tokens, lambda t: let(_template(t, F.xxhash64), places))).alias("place", *ahead))
    each = [F.struct(F.lit(w).alias("width"), F.when(F.col(ahead[w - 1]).isNotNull(), F.xxhash64(*ahead[:w])).alias("h")) for w in widths]
    return at.select(*rows.columns, "place", F.inline(F.array(*each))).where("h is not null")


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, share: float = 0.8, enough: int = 13, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, item_tokens, slots, reparameterised): one row for each document and benchmark item that it holds, itself or with other values in its slots.

    Documents and items become templates. Windows at every token of both meet in a hash join; a meeting fixes how the item lies in the document, and there all tokens are compared: as many must agree as `share` of the item, `enough` at the most. Slots must be consistent: one value of the item's always becomes the same value in the document. An item's windows are as wide as the run of agreeing tokens that is left wherever the others fall when `share` of it agrees, `width` at the most; so none that agrees in `share` is missed, and what an item gives depends on no other item. One that agrees in `enough` only is found if such a run is among them.
    Null and empty texts hold nothing; items under `width` tokens are too short to find and give nothing; rows that share an id count as one; rows without an id are left out; empty tables give no rows.
    """
    items = items.select(F.col(item_col).cast("long").alias("item_id"), _tokens(text_or_empty(text_col)).alias("it")).where("item_id is not null")
    items = items.withColumn("im", _template(F.col("it"))).where(F.size("it") >= width)
    # The same words without names too: a text all in capitals shows none.
    bare = items.select("item_id", F.filter(F.flatten(F.transform("it", lambda t: F.split(t, "~"))), lambda t: t != "").alias("it"))
    bare = bare.withColumn("im", _template(F.col("it")))
    items = items.unionByName(bare).dropDuplicates(["item_id", "it"]).withColumn("form", F.xxhash64("it"))
    size = F.size("it")
    agreeing = F.ceil(size * share).cast("int")
    items = items.withColumn("width", F.least(F.lit(width), F.ceil(agreeing / (size - agreeing + 1)).cast("int")))
    # So many windows are whole wherever the tokens fall that need not agree.
    items = items.withColumn("least", size - F.col("width") + 1 - F.col("width") * (size - F.least(F.lit(enough), agreeing)))
    widths = [r["width"] for r in items.select("width").distinct().orderBy("width").collect()] or [width]
    known = _windows(items.select("item_id", "form", "least", F.col("width").alias("own"), "it"), F.col("it"), widths).where("width = own").select("item_id", "form", "least", F.col("place").alias("item_place"), "h")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).where("doc_id is not null")
    seen = _windows(texts, _tokens(F.col("text")), widths).select("doc_id", F.col("place").alias("doc_place"), "h")
    met = seen.join(known, "h").groupBy("doc_id", "item_id", "form", "least", (F.col("doc_place") - F.col("item_place")).alias("shift")).agg(F.count("*").alias("windows")).where("windows >= least").drop("least")
    laid = met.join(texts, "doc_id").join(items, ["item_id", "form"])
    # What lies where the item is said to lie: the document's tokens and template tokens there, null beyond its ends.
    aligned = lambda a: F.transform("it", lambda _, i: F.get(a, (i + F.col("shift")).cast("int")))
    there = let(_tokens(F.col("text")), lambda t: F.struct(aligned(t).alias("dt"), let(_template(t), aligned).alias("dm")))
    found = laid.select("doc_id", "item_id", "it", "im", there.alias("there"))
    both = F.arrays_zip(F.col("it").alias("it"), F.col("im").alias("im"), F.col("there.dt").alias("dt"), F.col("there.dm").alias("dm"))
    found = found.select("doc_id", "item_id", size.alias("item_tokens"), F.filter(both, lambda x: x["im"] == x["dm"]).alias("agree"))
    slots = F.array_distinct(F.transform(F.filter("agree", lambda x: x["im"].isin(_SLOTS)), lambda x: F.struct(x["it"].alias("a"), x["dt"].alias("b"))))
    found = found.select("doc_id", "item_id", "item_tokens", F.size("agree").alias("matched"), slots.alias("slots"))
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda p: p["a"])))
    found = found.where((F.col("matched") >= F.least(F.lit(enough), F.ceil(F.col("item_tokens") * share))) & consistent)
    found = found.select("doc_id", "item_id", "matched", "item_tokens", F.size("slots").alias("slots"), F.exists("slots", lambda p: p["a"] != p["b"]).alias("reparameterised"))
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("matched"), "reparameterised", "slots", "item_tokens")
    return found.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")
