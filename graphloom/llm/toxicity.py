"""A linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.llm.common import arrow_rows, materialise, text_or_empty

#: Character n-grams of these lengths are hashed into 2^BITS features.
ORDERS, BITS = (3, 4, 5), 20
#: Counts of features to choose from, and the part (one in so many) of the fit's rows that the choice is tried on.
SIZES, FOLDS = (1 << 9, 1 << 10, 1 << 11, 1 << 12), 4
#: Code points that are handled at once, if no single text is longer.
_CHUNK = 1 << 19
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ToxicityModel:
    """weight: of each hashed n-gram's presence, the log-count ratio times its coefficient; 0 for features not in use."""

    weight: np.ndarray
    bias: float


def _present(texts: Iterable[str], used: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts (first text, row, feature): the distinct features of every whole text, of those in use."""
    held: list[str] = []
    size = first = 0
    for t in chain(texts, [None]):
        if t is not None:
            held.append(t.lower())
            size += len(held[-1]) + 1
        if held and (t is None or size >= _CHUNK):
            yield first, *_features(held, used)
            first += len(held)
            held, size = [], 0


def _features(texts: list[str], used: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[: len(cp)]
    found = []
    with np.errstate(over="ignore"):
        h = cp * _MULTIPLIER
        for n in range(2, max(ORDERS) + 1):
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _MULTIPLIER + cp[n - 1 :]
            if n in ORDERS:
                bucket = ((h ^ (h >> np.uint64(31))) * _MULTIPLIER >> np.uint64(64 - BITS)).astype(np.int64)
                inside = row[: len(h)] == row[n - 1 :] if len(h) else np.zeros(0, bool)
                if used is not None:
                    inside &= used[bucket]
                at = np.flatnonzero(inside)
                found.append((row[at] << BITS) | bucket[at])
    key = np.unique(np.concatenate(found))
    return key >> BITS, key & ((1 << BITS) - 1)


def _fit(row: np.ndarray, feature: np.ndarray, x_scale: np.ndarray, y: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient steps with momentum; row and feature list the present features, sorted by row."""
    w, b, vw, vb = np.zeros(len(x_scale)), 0.0, np.zeros(len(x_scale)), 0.0
    n = len(y)
    size = np.bincount(row, weights=x_scale[feature] ** 2, minlength=n)
    rate = 4.0 / max(1.0, float(np.percentile(size, 90)))
    for _ in range(steps):
        z = np.bincount(row, weights=(w * x_scale)[feature], minlength=n) + b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw = np.bincount(feature, weights=g[row], minlength=len(w)) * x_scale / n + l2 * w
        vw = 0.9 * vw - rate * gw
        vb = 0.9 * vb - rate * g.mean()
        w, b = w + vw, b + vb
    return w, b


def _best_size(row: np.ndarray, feature: np.ndarray, ratio: np.ndarray, y: np.ndarray, tried: np.ndarray, sizes: Sequence[int], l2: float, steps: int) -> int:
    """The count of features (those of the first ranks) whose fit on the other rows gives the least log loss on the tried ones; the greatest if either part lacks a class."""
    if len(set(y[tried])) < 2 or len(set(y[~tried])) < 2:
        return max(sizes)
    place = np.cumsum(~tried) - 1
    losses = []
    for size in sorted(sizes):
        inside = feature < size
        own = inside & ~tried[row]
        w, b = _fit(place[row[own]], feature[own], ratio[:size], y[~tried], l2, steps)
        z = np.bincount(row[inside], weights=(w * ratio[:size])[feature[inside]], minlength=len(y))[tried] + b
        losses.append((float(np.logaddexp(0, np.where(y[tried] > 0, -z, z)).mean()), size))
    return min(losses)[1]


def train_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 4000, sizes: Sequence[int] = SIZES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", l2: float = 1e-3, steps: int = 600) -> ToxicityModel:
    """Fit on labelled rows: at most `fit_rows` of each class, those whose hashed ids come first, with their whole texts. The bias is then set for the share of the classes among all labelled rows. How many features are in use is chosen from `sizes` on these rows alone: features, ratios and fits of three quarters of them, by the log loss on the last quarter.

    Labels other than 0 and 1 and null ids are left out. With one class only, or none, every score is that class's share, or 0.5.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not (share.get(0) and share.get(1)):
        n = sum(share.values())
        p = (share.get(1, 0) + 0.5) / (n + 1)
        return ToxicityModel(np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p))))
    order = [F.xxhash64("id"), F.col("id")]
    picked = known.where("y = 1").orderBy(*order).limit(fit_rows).unionByName(known.where("y = 0").orderBy(*order).limit(fit_rows))
    # At most 2 x fit_rows ids are broadcast, so the texts stay where they are.
    sample = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(picked), "id")
    sample = sample.select("text", "y", (F.pmod(F.xxhash64(F.lit("tried"), "id"), F.lit(FOLDS)) == 0).cast("int").alias("tried"))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("y", pa.int32()), ("tried", pa.int32()), ("f", pa.binary())])
        for b in batches:
            y, tried = np.asarray(b.column(1)), np.asarray(b.column(2))
            for first, row, feature in _present(b.column(0).to_pylist()):
                cuts = np.searchsorted(row, np.arange(row[-1] + 2)) if len(row) else [0]
                for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    yield arrow_rows(schema, y=[y[first + k]], tried=[tried[first + k]], f=[feature[i:j].astype("<u4").tobytes()])

    rows = materialise(sample.mapInArrow(present, "y int, tried int, f binary"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64()) for c in ("f", "neg", "pos", "tried_neg", "tried_pos")])
        sums = np.zeros((4, 1 << BITS), np.int64)
        for b in batches:
            for y, tried, f in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                sums[y + 2 * tried][np.frombuffer(f, "<u4")] += 1
        f = np.flatnonzero(sums.sum(0))
        neg, pos, tried_neg, tried_pos = sums[:, f]
        yield arrow_rows(schema, f=f, neg=neg + tried_neg, pos=pos + tried_pos, tried_neg=tried_neg, tried_pos=tried_pos)

    counts = rows.coalesce(8).mapInArrow(tally, "f long, neg long, pos long, tried_neg long, tried_pos long").groupBy("f").agg(*[F.sum(c).alias(c) for c in ("neg", "pos", "tried_neg", "tried_pos")])
    counts = materialise(counts)
    seen = {(r["y"], r["tried"]): r["n"] for r in rows.groupBy("y", "tried").agg(F.count("*").alias("n")).collect()}
    n = [seen.get((k, 0), 0) + seen.get((k, 1), 0) for k in (0, 1)]

    def ranked(pos: Column, neg: Column, of: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Of the hashed n-grams those whose presence tells most, in that order: log-count ratio by the root of the rows that have it."""
        ratio = F.log((pos + 1) / (of[1] + 2) / ((neg + 1) / (of[0] + 2)))
        some = counts.where(pos + neg >= 3).select("f", ratio.alias("r"), (F.abs(ratio) * F.sqrt(F.least(pos + neg, F.lit(400)))).alias("gain"))
        top = some.orderBy(F.desc("gain"), "f").limit(max(sizes)).collect()
        return np.array([x["f"] for x in top], np.int64), np.array([x["r"] for x in top], float)

    pos, neg = F.col("pos"), F.col("neg")
    f, r = ranked(pos, neg, n)
    of_others, r_of_others = ranked(pos - F.col("tried_pos"), neg - F.col("tried_neg"), [seen.get((k, 0), 0) for k in (0, 1)])
    ranks = np.full((2, 1 << BITS), -1, np.int32)
    ranks[0, f], ranks[1, of_others] = np.arange(len(f)), np.arange(len(of_others))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("y", pa.int32()), ("tried", pa.int32()), ("all", pa.binary()), ("others", pa.binary())])
        for b in batches:
            own = [ranks[:, np.frombuffer(x, "<u4")] for x in b.column(2).to_pylist()]
            yield arrow_rows(schema, y=b.column(0), tried=b.column(1), **{c: [x[k][x[k] >= 0].astype("<i4").tobytes() for x in own] for k, c in enumerate(("all", "others"))})

    # At most 2 x fit_rows rows with the ranks of their own among max(sizes) features.
    got = rows.mapInArrow(chosen, "y int, tried int, all binary, others binary").collect()
    y, tried = np.array([x["y"] for x in got], float), np.array([x["tried"] for x in got], bool)

    def listed(column: str) -> tuple[np.ndarray, np.ndarray]:
        own = [np.frombuffer(x[column], "<i4") for x in got]
        return np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate([np.zeros(0, np.int32), *own]).astype(np.int64)

    size = _best_size(*listed("others"), r_of_others, y, tried, sizes, l2, steps)
    row, feature = listed("all")
    inside = feature < size
    f, r = f[:size], r[:size]
    w, b = _fit(row[inside], feature[inside], r, y, l2, steps)
    weight = np.zeros(1 << BITS, np.float32)
    weight[f] = w * r
    return ToxicityModel(weight, float(b + np.log(share[1] / share[0]) - np.log(n[1] / n[0])))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None, text_col: str = "text", name: str = "score") -> DataFrame:
    """The kept columns (all but those so named, if not given) and the score, the probability of the label 1, for every row. Null and empty texts have no features: the bias alone."""
    keep = [c for c in docs.columns if c != name] if keep is None else keep
    # A text that is kept goes to Python once, and its batch is read text by text: two copies of a batch of long texts are many MB.
    once = text_col in keep and docs.schema[text_col].dataType == StringType()
    columns = docs.select(*keep) if once else docs.select(*keep, text_or_empty(text_col).alias("__text"))
    place = keep.index(text_col) if once else len(keep)
    bits = np.packbits(model.weight != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.unpackbits(bits).astype(bool)
        for b in batches:
            z = np.full(b.num_rows, model.bias)
            for first, row, feature in _present((x.as_py() or "" for x in b.column(place)), used):
                part = np.bincount(row, weights=model.weight[feature])
                z[first : first + len(part)] += part
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(score)], names=[*keep, name])

    return columns.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[: len(keep)]) + f", `{name}` double")
