"""Line removal by a tree of log templates: lines whose template recurs across documents are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialise, text_or_empty


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _masked(text: Column) -> Column:
    """Digit runs are variable everywhere."""
    return F.regexp_replace(text, "[0-9]+", "#")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, at, line, n) for every line with more than blanks; its tokens, n, are what stands between blanks."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t"))
    lines = text.select("id", F.xxhash64("t").alias("th"), F.posexplode(_lines(F.col("t"))).alias("at", "line")).where(F.col("line").rlike("[^ \\t\\r]"))
    return lines.withColumn("n", F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1)


def _path(depth: int) -> Column:
    """The leaf of the tree that a line comes to: its token count, then its leading tokens."""
    return F.xxhash64("n", _masked(F.substring_index("line", " ", depth)))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_texts: int = 10, depth: int = 3, long: int = 12, passage: int = 50, min_passage: int = 2, fixed: float = 0.5, with_counts: bool = True) -> DataFrame:
    """All columns of docs with the text's recurring lines gone, and, if asked for, n_lines and n_dropped (in the place of columns so named).

    The tree: a line's token count, then its `depth` leading tokens; digit runs are variable everywhere. Below such a leaf, a token that `min_texts` lines have at its place is fixed, any other is a variable field: that makes the line's template, if `fixed` of its tokens are so. Lines of under `long` tokens are templates as they are, but for digits.
    A template recurs if it is in at least `min_texts` different texts; a line of `passage` tokens or more also if it is in `min_passage` texts as it is, but for digits, for such lines do not recur by chance. Copies of a document count once, so they do not make each other's lines recur; near copies count as different texts. Lines of a recurring template are dropped from every text but the first that has it (that of the smallest id), and from that text's copies alike. Lines that differ in a leading token without digits have different templates. Texts, leaves and templates are told apart by 64-bit hashes.
    Blank lines stay; null texts stay null, with no lines; an empty text is one blank line. Rows that share an id are dealt with as texts of their own; rows without an id are never a template's first if a row with one has it. An empty table gives no rows.
    """
    keyed = _keyed(docs, id_col, text_col)
    late = F.coalesce("id", F.lit((1 << 63) - 1))
    short, wide = F.col("n") < long, F.col("n") >= passage
    leaf = lambda whole, key: F.struct(F.lit(whole).alias("whole"), key.alias("key"))
    whole, path = leaf(True, F.xxhash64(_masked(F.col("line")))), leaf(False, _path(depth))
    leaves = materialise(keyed.select("id", "th", "at", "n", F.inline(F.when(short, F.array(whole)).when(wide, F.array(path, whole)).otherwise(F.array(path)))))
    one = leaves.groupBy("key").agg(F.first("whole").alias("whole"), F.first("n").alias("n"), F.count("*").alias("lines"), F.min("th").alias("a"), F.max("th").alias("b"))
    often = materialise(one.where((F.col("a") != F.col("b")) & (F.col("lines") >= F.when(F.col("whole") & wide, min_passage).otherwise(min_texts))).select("key", "n", "whole")).hint("merge")  # it grows with the lines, as does what follows: no size is proven, so none is broadcast
    whole = leaves.where("whole").select("id", "th", "at", "key").join(often.where("whole").select("key", "n"), "key")
    # Of the longer lines, only those at leaves that many lines come to are told token by token, copies of a text once.
    under = keyed.where(~short).withColumn("key", _path(depth)).join(often.where("not whole").select("key"), "key")
    under = materialise(under.groupBy("key", "th", "at").agg(F.min("id").alias("id"), F.first("line").alias("line")))
    under = under.withColumn("tokens", F.split(_masked(F.col("line")), " "))
    each = under.select("key", "th", "at", "id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("place", "token")).withColumn("token", F.xxhash64("place", "token"))
    common = materialise(each.where(F.col("place") >= depth).groupBy("key", "token").count().where(F.col("count") >= min_texts).select("key", "token", F.lit(1).alias("one"))).hint("merge")
    template = each.join(common, ["key", "token"], "left").groupBy("key", "th", "at").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.sum(F.coalesce("one", (F.col("place") < depth).cast("int"))).alias("f"), F.bit_xor(F.when(F.col("one").isNotNull(), F.col("token"))).alias("x"))
    template = template.where(F.col("f") >= F.col("n") * fixed).select("id", "th", "at", F.xxhash64("key", "f", "x").alias("key"), F.lit(0).alias("n"))
    found = materialise(whole.select("id", "th", "at", "key", "n").unionByName(template))
    texts = found.groupBy("key", "th").agg(F.min(late).alias("id"), F.first("n").alias("n"))
    recurring = texts.groupBy("key").agg(F.first("n").alias("n"), F.count("*").alias("texts"), F.min(F.struct("id", "th"))["th"].alias("first"))
    recurring = materialise(recurring.where(F.col("texts") >= F.when(F.col("n") >= passage, min_passage).otherwise(min_texts)).select("key", "first")).hint("merge")
    # Copies of a text lose the same lines, so what is dropped is a matter of texts, not of rows.
    gone = materialise(found.select("th", "at", "key").join(recurring, "key").where("th <> first").groupBy("th").agg(F.collect_set("at").alias("gone"))).hint("merge")
    columns = [c for c in docs.columns if not with_counts or c not in ("n_lines", "n_dropped")]
    rows = docs.select(*columns, F.xxhash64(text_or_empty(text_col)).alias("__th"))
    joined = rows.join(gone.select(F.col("th").alias("__th"), F.col("gone").alias("__gone")), "__th", "left")
    lines = _lines(F.col(text_col))
    none = F.array().cast("array<int>")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.coalesce("__gone", none), i))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    new = [text.alias(c) if c == text_col else F.col(c) for c in columns]
    counts = [F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.size(F.coalesce("__gone", none)).alias("n_dropped")]
    return joined.select(*new, *(counts if with_counts else []))
