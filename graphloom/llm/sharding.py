"""Histogram sort: shards of near-equal bytes from exact counts below candidate key boundaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialise, text_or_empty

#: Bits of the key that one round of probes resolves, and rounds for each half of the key.
_BITS, _ROUNDS = 12, 5
_WIDTH = _BITS * _ROUNDS


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The sort key is (h, g): a hash of the text, so that equal texts are neighbours, then one of the id."""
    text = text_or_empty(text_col)
    top = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - _WIDTH)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        top(text).alias("h"),
        top(F.coalesce(F.col(id_col).cast("long"), F.lit(-1))).alias("g"),
    )


def _probe(keys: DataFrame, depth: int, prefixes: list[tuple[int, int]]) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    """Exact bytes and rows in each of the 4,096 parts of every open prefix: at most 39 x 4,096 sums come back, whatever the input."""
    digit = lambda c, k: F.shiftrightunsigned(c, _WIDTH - _BITS * (k + 1))
    zero = F.lit(0).cast("long")
    if depth < _ROUNDS:
        ph, pg, d = digit(F.col("h"), depth - 1) if depth else zero, zero, digit(F.col("h"), depth)
        keep = ph.isin([h for h, _ in prefixes])
    else:
        k = depth - _ROUNDS
        ph, pg, d = F.col("h"), digit(F.col("g"), k - 1) if k else zero, digit(F.col("g"), k)
        keep = reduce(lambda a, b: a | b, [(ph == h) & (pg == g) for h, g in prefixes])
    rows = keys.where(keep).groupBy(ph.alias("ph"), pg.alias("pg"), d.bitwiseAND((1 << _BITS) - 1).alias("d")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    out: dict = {p: [] for p in prefixes}
    for r in rows:
        out[(r["ph"], r["pg"])].append((r["d"], r["b"], r["n"]))
    return {p: sorted(x) for p, x in out.items()}


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """shards - 1 keys (h, g): the rows below the i-th hold i/shards of all bytes, within `tolerance` of a shard's bytes or as near as whole rows allow."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    done: dict[int, tuple[int, int]] = {}
    where = {i: ((0, 0), 0) for i in range(1, shards)}  # the prefix that holds the target, and the bytes below it
    for depth in range(2 * _ROUNDS):
        if not where:
            break
        seen = _probe(keys, depth, sorted({p for p, _ in where.values()}))
        then = {}
        for i, ((ph, pg), below) in where.items():
            target, at, best = total * i / shards, below, None
            inside = None
            for d, b, n in seen[(ph, pg)]:
                for edge, bytes_below in ((d, at), (d + 1, at + b)):
                    if best is None or abs(bytes_below - target) < best[0]:
                        best = (abs(bytes_below - target), edge)
                if at <= target <= at + b and inside is None:
                    inside = (d, at, n)
                at += b
            k = depth % _ROUNDS
            up = lambda x, k=k: x << (_WIDTH - _BITS * (k + 1))
            full = lambda d, ph=ph, pg=pg, k=k, up=up: (up((ph << _BITS) + d), 0) if depth < _ROUNDS else (ph, up((pg << _BITS) + d))
            if inside is None or inside[2] == 1 or best[0] <= tolerance * total / shards or depth == 2 * _ROUNDS - 1:
                done[i] = full(best[1])
            elif depth < _ROUNDS:
                then[i] = (((ph << _BITS) + inside[0], 0), inside[1])
            else:
                then[i] = ((ph, (pg << _BITS) + inside[0]), inside[1])
        where = then
    return [done[i] for i in sorted(done)]


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, tolerance: float = 0.001) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row: shards of near-equal bytes, slots gapless from 0 in each.

    Rounds of probes count exact bytes below candidate boundaries over all rows, each resolving 12 more bits of the open splitters' keys, until every splitter is within `tolerance` of its target; then the rows are exchanged once. Equal texts stay in one shard unless a splitter within tolerance needs to pass through them.
    Null text: no bytes (size 16); rows that share an id, or have none, keep a row each; an empty table gives no rows; fewer rows than shards leave shards empty.
    """
    keys = materialise(_keys(docs, id_col, text_col))
    cuts = splitters(keys, shards, tolerance)
    shard = reduce(lambda a, b: a + b, [((F.col("h") > h) | ((F.col("h") == h) & (F.col("g") >= g))).cast("int") for h, g in cuts], F.lit(0))
    # A cell is what one task numbers: a part of the key space, and where that has many times its share of rows, a part of it by g.
    part = F.shiftrightunsigned("h", _WIDTH - _BITS)
    counts = keys.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    crowded = [r["part"] for r in counts if r["n"] > 4 * sum(x["n"] for x in counts) / len(counts)]
    fine = F.when(part.isin(crowded), F.shiftrightunsigned("g", _WIDTH - _BITS)).otherwise(F.lit(0).cast("long")) if crowded else F.lit(0).cast("long")
    placed = keys.select("*", shard.alias("shard"), part.alias("part"), fine.alias("fine"))
    cell = ["shard", "part", "fine"]
    before = placed.groupBy(*cell).agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part", "fine").rowsBetween(Window.unboundedPreceding, -1)))
    slot = F.coalesce(F.col("before"), F.lit(0).cast("long")) + F.row_number().over(Window.partitionBy(*cell).orderBy("h", "g", "doc_id")) - 1
    return placed.join(before.select(*cell, "before"), cell).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))
