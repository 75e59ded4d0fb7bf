"""Mixture-controlled packing: every window takes from each source queue its target share of tokens, deficits carried exactly."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_rows, materialise, text_or_empty
from graphloom.llm.pretokens import encoder

#: Queues at most, which bounds what every task holds. With more sources, the largest have a queue each and the others share the last one.
QUEUES = 4096
#: Numbers (windows times queues) that a task works on at once.
CELLS = 1 << 18
#: Rows of a batch that a task works on at once.
ROWS = 2500


def token_ids(docs: DataFrame, ranks: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, block, at, n, ids): a row's ids with the end id, as unsigned 16-bit values; block is the task that encoded it, at the ids of its source in that block before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
        so_far: dict[str | None, int] = {}
        block = TaskContext.get().partitionId()
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            ids, at = encoder(ranks).encode(b.column(2).to_pylist()), []
            source = b.column(1).to_pylist()
            for q, x in zip(source, ids, strict=True):
                at.append(so_far.get(q, 0))
                so_far[q] = at[-1] + len(x) + 1
            yield arrow_rows(schema, doc_id=b.column(0), source=source, block=[block] * b.num_rows, at=at, n=[len(x) + 1 for x in ids], ids=[np.append(x, np.uint16(end_id)).astype("<u2").tobytes() for x in ids])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, source string, block long, at long, n long, ids binary")


@dataclass(frozen=True)
class Mixture:
    """Queues of totals ids each, mixed by weights: queue q's k-th id is due at (k + 1/2) / weights[q], and a window takes the `length` ids due next, those of lower queues first at a tie.

    This is deficit round-robin in closed form: after every window each queue that is not dry is within about an id of its exact share, its deficit carried to the next, and any task can tell the state at any window without those before it. A dry queue's share goes to the others by their weights.
    """

    totals: np.ndarray
    weights: np.ndarray
    length: int

    def _dry(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Times at which queues run dry, in order from 0; ids given until then, as real numbers; and the ids given a time unit from then on."""
        dry = self.totals / self.weights
        order = np.argsort(dry, kind="stable")
        time = np.concatenate([[0.0], dry[order]])
        rate = self.weights.sum() - np.concatenate([[0.0], np.cumsum(self.weights[order])])
        given = np.concatenate([[0.0], np.cumsum(np.diff(time) * rate[:-1])])
        return time, given, np.maximum(rate, 1e-300)

    def near(self, queue: int, k: np.ndarray) -> np.ndarray:
        """About how many ids are due before the queue's k-th."""
        time, given, rate = self._dry()
        t = (k + 0.5) / self.weights[queue]
        j = np.clip(np.searchsorted(time, t, "right") - 1, 0, len(time) - 1)
        return given[j] + (t - time[j]) * rate[j]

    def allotted(self, windows: np.ndarray) -> np.ndarray:
        """Ids that each queue has given before each window (windows x queues)."""
        totals, weights = self.totals.astype(np.int64), self.weights
        want = np.minimum(windows.astype(np.int64) * self.length, totals.sum())
        time, given, rate = self._dry()
        j = np.clip(np.searchsorted(given, want, "right") - 1, 0, len(time) - 1)
        t = time[j] + (want - given[j]) / rate[j]
        out = np.clip(np.floor(np.minimum(t, time[-1] + 1)[:, None] * weights + 0.5), 0, totals).astype(np.int64)
        short = want - out.sum(1)
        while (short > 0).any():
            on = np.flatnonzero(short > 0)
            pick = np.where(out[on] < totals, (out[on] + 0.5) / weights, np.inf).argmin(1)
            out[on, pick] += 1
            short[on] -= 1
        while (short < 0).any():
            on = np.flatnonzero(short < 0)
            due = np.where(out[on] > 0, (out[on] - 0.5) / weights, -np.inf)
            out[on, due.shape[1] - 1 - due[:, ::-1].argmax(1)] -= 1
            short[on] += 1
        return out

    def pieces(self, queue: int, start: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Rows of a queue that hold its ids [start, start + n): blocks of (row, start in the row, ids, window, place in the window) of every piece.

        Each block looks at a bounded number of windows: a window or a few for each id where a queue gives less than an id a window, those that a row's ids reach over where it gives more.
        """
        slack = len(self.totals) // self.length + 2
        most = max(1, CELLS // len(self.totals) // (2 * slack + 2))
        window = lambda k: np.maximum(self.near(queue, k) // self.length, 0).astype(np.int64)
        rare = self.length * self.weights[queue] < self.weights.sum()
        step = most if rare else max(1, int(most * self.length * self.weights[queue] / self.weights.sum()))
        # Rows are cut into spans of at most `step` ids, and spans are taken together as far as `step` goes.
        cuts = -(-n // step)
        row = np.repeat(np.arange(len(n)), cuts)
        lo = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * step
        size = np.minimum(n[row] - lo, step)
        group = np.cumsum(size) // step
        for g in np.split(np.arange(len(row)), np.flatnonzero(np.diff(group)) + 1):
            first, last = start[row[g]] + lo[g], start[row[g]] + lo[g] + size[g] - 1
            if rare:
                ids = np.concatenate([np.arange(a, z + 1) for a, z in zip(first, last, strict=True)])
                windows = np.unique(window(ids)[:, None] + np.arange(-slack, slack + 2))
            else:
                windows = np.unique(np.concatenate([np.arange(a - slack, z + slack + 2) for a, z in zip(window(first), window(last), strict=True)]))
            windows = windows[windows >= 0]
            given = self.allotted(windows)
            edge = given[:, queue]
            if rare:  # an id by itself; those in one window are a piece
                owner = np.repeat(g, size[g])
                w = np.searchsorted(edge, ids, "right") - 1
                new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (w[1:] != w[:-1])]))
                owner, w, a, z = owner[new], w[new], ids[new], np.append(ids[new[1:] - 1], ids[-1]) + 1
            else:
                i, j = np.searchsorted(edge, first, "right") - 1, np.searchsorted(edge, last, "right") - 1
                owner = np.repeat(g, j - i + 1)
                w = np.concatenate([np.arange(x, y + 1) for x, y in zip(i, j, strict=True)])
                a = np.maximum(edge[w], np.repeat(first, j - i + 1))
                z = np.minimum(edge[w + 1], np.repeat(last + 1, j - i + 1))
            kept = z > a
            owner, w, a, z = owner[kept], w[kept], a[kept], z[kept]
            ahead = (given[w + 1, :queue] - given[w, :queue]).sum(1)
            yield row[owner], a - start[row[owner]], z - a, windows[w], ahead + a - edge[w]


def pack(docs: DataFrame, ranks: str | None = None, end_id: int = 0, length: int = 1024, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = True, weights: dict[str | None, float] | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for, as unsigned 32-bit values): one row for each piece, every sequence full but the last.

    Each source is a queue; null is one too. Sequences are mixed by `weights` (source to positive weight; a source that is not named weighs its share of the ids relative to the largest weight's), or, without, by the queues' shares of all ids, where no queue runs dry before another. When a queue runs dry, the others fill its place by their weights. Beyond QUEUES sources, those named in weights and the largest have queues of their own; the others share one, in which they follow each other as they were read.
    Encoded once and written; the offsets are sums for each task and source. Null text: the end id alone; rows that share an id are packed each on its own; an empty table gives no rows.
    """
    if weights and (len(weights) >= QUEUES or min(weights.values()) <= 0):
        raise ValueError(f"weights must be positive, and fewer than {QUEUES}")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = materialise(token_ids(docs, ranks, end_id, id_col, text_col, source_col))
    sums = materialise(coded.groupBy("source", "block").agg(F.sum("n").alias("sum")))
    each = sums.groupBy("source").agg(F.sum("sum").alias("t"))
    named = F.lit(False)
    for w in weights or {}:
        named = named | F.col("source").eqNullSafe(F.lit(w))
    # At most QUEUES rows come back; the ids of all other sources are one sum.
    top = each.orderBy(named.desc(), F.desc("t"), F.col("source").asc_nulls_first()).limit(QUEUES - 1).collect()
    order = sorted((r["source"] for r in top), key=lambda x: (x is not None, x or ""))
    size = {r["source"]: r["t"] for r in top}
    total = sums.agg(F.sum("sum")).first()[0] or 0
    totals = np.array([size[q] for q in order] + [total - sum(size.values())], np.int64)
    share = totals / max(1, total)
    if weights:
        share = np.array([weights.get(q, float(x) * max(weights.values())) if q in size else x for q, x in zip([*order, ...], share, strict=True)])
    mixture = Mixture(np.maximum(totals, 0), np.maximum(share, 1e-12), length)
    number = {q: k for k, q in enumerate(order)}
    queues = docs.sparkSession.createDataFrame([(q, k) for q, k in number.items()], "of string, queue int")
    # At most QUEUES rows are broadcast.
    dealt = sums.join(F.broadcast(queues), F.col("source").eqNullSafe(F.col("of")), "left").withColumn("queue", F.coalesce("queue", F.lit(len(order)))).drop("of")
    ahead = Window.partitionBy("queue").orderBy("block", "source").rowsBetween(Window.unboundedPreceding, -1)
    base = materialise(dealt.select(F.col("source").alias("of"), F.col("block").alias("in"), "queue", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("base")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            q, start, n = (np.asarray(batch.column(k)) for k in (1, 2, 3))
            for k in np.unique(q):
                mine = np.flatnonzero(q == k)
                for row, lo, size, window, offset in mixture.pieces(int(k), start[mine], n[mine]):
                    own, back = np.unique(row, return_inverse=True)
                    data = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in batch.column(4).take(pa.array(mine[own])).to_pylist()]
                    cut = [data[r][4 * a : 4 * (a + m)] for r, a, m in zip(back.tolist(), lo.tolist(), size.tolist(), strict=True)]
                    yield arrow_rows(schema, doc_id=batch.column(0).take(pa.array(mine[row])), start=lo, length=size, ids_crc32=[zlib.crc32(x) for x in cut], doc_tokens=n[mine][row], sequence_id=window, offset=offset, ids=cut if with_ids else [None] * len(cut))

    placed = coded.join(base, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("in")))
    return placed.select("doc_id", "queue", (F.col("base") + F.col("at")).alias("s"), "n", "ids").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary").drop(*([] if with_ids else ["ids"]))
