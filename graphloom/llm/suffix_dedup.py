"""Exact substring removal: repeated byte strings are found by suffix and common-prefix arrays of content-dealt shards."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_rows, fan_out, materialise, sliced, text_or_empty, utf8
from graphloom.llm.induced_sort import suffixes_descending
from graphloom.llm.pretokens import every_hash, prefix_sums, range_hashes_at

#: A window's anchor is its least-hashed run of so many bytes.
GRAM = 24
#: Bytes that are handled at once; a longer text is cut into overlapping parts.
CHUNK = 1 << 20
#: Bytes of segments that a shard is dealt: their sort takes some thirty times as much of its executor's disk.
SHARD = 1 << 20
#: An id for rows that have none: they come last.
NO_ID = (1 << 63) - 1
#: Rows, about, whose runs tell which are common, the runs' kinds (2^BITS) that are told apart to find them, and the fewer kinds (2^FEW) that are looked up. Common runs are anchors of last resort: this is for even shards alone, results do not depend on it.
SAMPLE, BITS, FEW = 8192, 24, 18

#: A document is known by its id and, if other rows share the id or it has none, by a hash of its text (tie; else 0).
_SEGMENT = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("start", "<i8"), ("size", "<i4"), ("at", "u1")])
_SPAN = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("start", "<i8"), ("end", "<i8")])
_ASK = np.dtype([("anchor", "<u8"), ("start", "<i8"), ("size", "<i4"), ("at", "u1")])


def _by_place(rows: np.ndarray, *first: np.ndarray) -> np.ndarray:
    """The order of rows by the first keys (the last of them foremost), document and start."""
    return np.lexsort((rows["start"], *([rows["tie"]] if rows["tie"].any() else []), rows["doc"], *first))


def _new_doc(rows: np.ndarray) -> np.ndarray:
    """Which rows begin a document; rows lie document by document."""
    return np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tie"][1:] != rows["tie"][:-1])])[: len(rows)]


def _common_runs(docs: DataFrame, text: Column) -> np.ndarray | None:
    """For each kind of run (the top FEW bits of its hash) whether over 1 in 256 sampled rows has a common run of it. At most SAMPLE rows, about, are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for b in batches:
            for t in b.column(0).to_pylist():
                found.append(np.unique(every_hash(prefix_sums(np.frombuffer(t, np.uint8)), GRAM) >> np.uint64(64 - BITS)))
        kind, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        yield arrow_rows(pa.schema([("kind", pa.int64()), ("n", pa.int64())]), kind=kind[n > 1].astype(np.int64), n=n[n > 1])

    rows = docs.count()
    some = docs.select(text.alias("t")).sample(min(1.0, SAMPLE / max(1, rows)), 1).repartition(8)
    seen = some.mapInArrow(run, "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n")).where(F.col("n") > max(8, min(rows, SAMPLE) // 256)).collect()
    out = np.zeros(1 << FEW, bool)
    out[[r["kind"] >> (BITS - FEW) for r in seen]] = True
    return out if seen else None


def _segments(data: np.ndarray, bounds: np.ndarray, doc: np.ndarray, tie: np.ndarray, base: np.ndarray, length: int, common: np.ndarray | None = None) -> np.ndarray:
    """Segments of the texts in data: each holds the consecutive windows of `length` bytes that share an anchor occurrence, so equal windows lie in segments of equal anchors, at equal distances from them."""
    windows = len(data) - length + 1
    if windows <= 0:
        return np.zeros(0, _SEGMENT)
    sums = prefix_sums(data)
    h = every_hash(sums, GRAM)
    place = np.uint64(len(data).bit_length())
    key = h >> np.uint64(1)
    if common is not None:
        key |= common[h >> np.uint64(64 - FEW)].astype(np.uint64) << np.uint64(63)
    key = (key >> place << place) | np.arange(len(key), dtype=np.uint64)
    w = length - GRAM + 1
    least, wide = key, 1  # of each run of `wide` keys
    while 2 * wide <= w:
        least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
    least = np.minimum(least[: len(least) - (w - wide)], least[w - wide :])
    anchor = (least & np.uint64((1 << int(place)) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(doc)), np.diff(bounds))
    inside = np.flatnonzero(text[:windows] == text[length - 1 :])
    if not len(inside):
        return np.zeros(0, _SEGMENT)
    new = np.concatenate([[True], (np.diff(inside) > 1) | (np.diff(anchor[inside]) != 0) | (np.diff(text[inside]) != 0)])
    first = inside[new]
    last = inside[np.append(np.flatnonzero(new)[1:] - 1, len(inside) - 1)] + length
    out = np.empty(len(first), _SEGMENT)
    out["anchor"], out["content"] = h[anchor[first]], range_hashes_at(sums, first, last)
    out["doc"], out["tie"], out["start"], out["size"] = doc[text[first]], tie[text[first]], base[text[first]] + first - bounds[text[first]], last - first
    out["at"] = anchor[first] - first
    return out


_STEPS = ("doc", "tie", "start")


def _packed(rows: np.ndarray) -> bytes:
    """Column by column in the order of the texts, which Spark's codec shortens much better than row by row."""
    rows = rows[_by_place(rows)]
    columns = (np.diff(rows[name], prepend=0) if name in _STEPS else rows[name] for name in _SEGMENT.names)
    return b"".join(np.ascontiguousarray(x).tobytes() for x in columns)


def _unpacked(bodies: list[bytes]) -> np.ndarray:
    sizes = [len(b) // _SEGMENT.itemsize for b in bodies]
    out = np.empty(sum(sizes), _SEGMENT)
    at = 0
    for body, n in zip(bodies, sizes, strict=True):
        part, k = out[at : at + n], 0
        for name in _SEGMENT.names:
            column = np.frombuffer(body, _SEGMENT[name], n, k)
            part[name] = np.cumsum(column) if name in _STEPS else column
            k += column.nbytes
        at += n
    return out


def _ranked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments by anchor, content, document and start; and which of them are copies of an earlier one."""
    rows = rows[_by_place(rows, rows["content"], rows["anchor"])]
    same = (rows["anchor"][1:] == rows["anchor"][:-1]) & (rows["content"][1:] == rows["content"][:-1])
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    first = rows[np.repeat(head, np.diff(np.append(head, len(rows))))]
    return rows, (rows["doc"] != first["doc"]) | (rows["tie"] != first["tie"]) | (rows["start"] != first["start"])


def _whole(rows: np.ndarray) -> np.ndarray:
    """The segments' spans."""
    out = np.empty(len(rows), _SPAN)
    out["doc"], out["tie"], out["start"], out["end"] = rows["doc"], rows["tie"], rows["start"], rows["start"] + rows["size"]
    return out


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans of each document in order, those that touch or overlap as one."""
    if not len(spans):
        return spans
    spans = spans[_by_place(spans)]
    cut = _new_doc(spans)
    group = np.cumsum(cut) - 1
    width = np.int64(max(int(spans["end"].max()), 1) + 1)
    reach = np.maximum.accumulate(spans["end"] + group * width) - group * width
    new = cut | np.concatenate([[True], spans["start"][1:] > reach[:-1]])
    at = np.flatnonzero(new)
    out = spans[at].copy()
    out["end"] = reach[np.append(at[1:] - 1, len(spans) - 1)]
    return out


_OUT = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
_FOUND = "id long, tie long, kind int, body binary"


def _by_doc(rows: np.ndarray, of: np.ndarray, kind: int) -> pa.RecordBatch:
    """A row for each document, its records as bytes; of: the documents of the rows, which lie document by document."""
    at = np.flatnonzero(_new_doc(of))
    return arrow_rows(_OUT, id=of["doc"][at], tie=of["tie"][at], kind=[kind] * len(at), body=[x.tobytes() for x in np.split(rows, at[1:])] if len(at) else [])


def _cut(length: int, shards: int, common: np.ndarray | None):
    """Documents to packed segments, one row for each shard and chunk. Copies within the chunk are settled here: an anchor and content goes out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])

        def chunk(parts: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum([len(x) for *_, x in parts])])
            rows = _segments(np.concatenate([x for *_, x in parts]), bounds, *(np.array([p[k] for p in parts], np.int64) for k in range(3)), length, common)
            rows, copy = _ranked(rows) if len(rows) else (rows, np.zeros(0, bool))
            spans, rows = _merged(_whole(rows[copy])), rows[~copy]
            shard, kind, body = [], [], []
            for k, part, to in ((0, rows, rows["anchor"] % np.uint64(shards)), (1, spans, (spans["doc"] ^ spans["tie"]) % shards)):
                order = np.argsort(to, kind="stable")
                part, to = part[order], to[order]
                at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
                shard += to[at].tolist()
                kind += [k] * len(at)
                body += [_packed(x) if k == 0 else x.tobytes() for x in np.split(part, at[1:])] if len(at) else []
            return arrow_rows(schema, shard=shard, kind=kind, body=body)

        held: list = []
        size = 0
        for b in batches:
            data, at = utf8(b.column(2))
            for doc, tie, i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for k in range(i, max(j - length + 1, i + 1), CHUNK):
                    held.append((doc, tie, k - i, data[k : min(j, k + CHUNK + length - 1)]))
                    size += len(held[-1][3])
                    if size >= CHUNK:
                        yield chunk(held)
                        held, size = [], 0
        if held:
            yield chunk(held)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's segments: copies of an earlier segment go whole (kind 1); anchors with several contents are asked for (kind 2)."""
    got: dict[int, list[bytes]] = {0: [], 1: []}
    for b in batches:
        for kind, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            got[kind].append(body)
    rows = _unpacked(got[0])
    spans = np.frombuffer(b"".join(got[1]), _SPAN)
    got.clear()
    if len(rows):
        rows, copy = _ranked(rows)
        spans = np.concatenate([spans, _whole(rows[copy])])
        rows = rows[np.concatenate([[True], (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["content"][1:] != rows["content"][:-1])])]
        head = np.flatnonzero(np.concatenate([[True], rows["anchor"][1:] != rows["anchor"][:-1]]))
        several = np.diff(np.append(head, len(rows)))
        rows = rows[np.repeat(several, several) > 1]
        rows = rows[_by_place(rows)]
        ask = np.empty(len(rows), _ASK)
        for name in _ASK.names:
            ask[name] = rows[name]
        yield _by_doc(ask, rows, 2)
    spans = _merged(spans)
    yield _by_doc(spans, spans, 1)


def _fetch(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("anchor", pa.int64()), ("at", pa.int32()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("segment", pa.binary())])
        for b in batches:
            for doc, tie, text, bodies in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                ask = np.frombuffer(b"".join(bodies), _ASK)
                start = ask["start"].tolist()
                yield arrow_rows(schema, shard=(ask["anchor"] % np.uint64(shards)).astype(np.int32), anchor=ask["anchor"].astype(np.int64), at=ask["at"].astype(np.int32), doc=[doc] * len(ask), tie=[tie] * len(ask), start=start, segment=[text[i : i + n] for i, n in zip(start, ask["size"].tolist(), strict=True)])

    return run


def _sharing(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by anchor without those that cannot share `length` bytes around it with another one, and the others without the bytes that cannot be in such a string. Those that are then copies of an earlier one come as spans, with their batch.

    A shared string reaches some way to both sides of the anchor. With the length besides the anchor in equal steps, all but one of them lie whole in it: so two rows that share it agree, for some i, on the anchor with i steps to its left and the rest but one to its right.
    """
    steps = max(1, (length - GRAM) // 4)
    unit = (length - GRAM) // steps

    def kept(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        data, at = utf8(rows.column(6))
        anchor, offset = np.asarray(rows.column(1)), np.asarray(rows.column(2))
        place = at[:-1] + offset
        least, most = np.full(len(anchor), steps), np.full(len(anchor), -1)
        sums = prefix_sums(data)
        for left in range(steps):
            a, z = place - unit * left, place + GRAM + unit * (steps - 1 - left)
            whole = np.flatnonzero((a >= at[:-1]) & (z <= at[1:]))
            key = range_hashes_at(sums, a[whole], z[whole]) ^ anchor[whole].view(np.uint64)
            _, back, n = np.unique(key, return_inverse=True, return_counts=True)
            hit = whole[n[back] > 1]
            least[hit], most[hit] = np.minimum(least[hit], left), left
        rest = length - GRAM - unit * steps + unit
        on = np.flatnonzero(most >= 0)
        a = np.maximum(at[:-1][on], place[on] - unit * most[on] - rest)
        z = np.minimum(at[1:][on], place[on] + GRAM + unit * (steps - 1 - least[on]) + rest)
        cut = np.empty(len(on), _SEGMENT)
        cut["anchor"], cut["content"], cut["doc"], cut["tie"] = anchor[on].view(np.uint64), range_hashes_at(sums, a, z), np.asarray(rows.column(3))[on], np.asarray(rows.column(4))[on]
        cut["start"], cut["size"] = np.asarray(rows.column(5))[on] + a - at[:-1][on], z - a
        order = _by_place(cut, cut["content"], cut["anchor"])
        own = cut[order]
        new = np.concatenate([[True], (own["anchor"][1:] != own["anchor"][:-1]) | (own["content"][1:] != own["content"][:-1])])[: len(own)]
        head = np.repeat(np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(own))))
        copy = np.zeros(len(on), bool)
        copy[order] = ~new
        spans = _whole(own[(own["size"] >= length) & (_whole(own) != _whole(own[head]))])
        on, a, z, start = on[~copy], a[~copy], z[~copy], cut["start"][~copy]
        offsets = np.concatenate([[0], np.cumsum(z - a)]).astype(np.int32)
        segment = pa.Array.from_buffers(pa.binary(), len(on), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[sliced(a, z - a)]))])
        picked = rows.take(pa.array(on))
        return pa.RecordBatch.from_arrays([*picked.columns[:5], pa.array(start, pa.int64()), segment], schema=rows.schema), spans

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        anchors = np.asarray(b.column(1))
        cut = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on in the next batch
        if held and (cut or held[-1].column(1)[-1].as_py() != anchors[0]):
            yield kept(pa.concat_batches([*held, b.slice(0, cut)]))
            held = []
        elif cut:
            yield kept(b.slice(0, cut))
        held.append(b.slice(cut))
    if held:
        yield kept(pa.concat_batches(held))


def _repeats(length: int):
    """A shard's suffix array: of the windows that begin alike for `length` bytes, all but the earliest are spans to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.mkdtemp(prefix="repeats-")
        try:
            docs, ties, starts, sizes, copies = [], [], [], [], [np.zeros(0, _SPAN)]
            with open(os.path.join(folder, "text"), "wb") as f:
                for b, spans in _sharing(batches, length):
                    copies.append(spans)
                    data, at = utf8(b.column(6))
                    docs.append(np.asarray(b.column(3)))
                    ties.append(np.asarray(b.column(4)))
                    starts.append(np.asarray(b.column(5)))
                    sizes.append(np.diff(at))
                    out = np.zeros(len(data) + b.num_rows, np.uint16)
                    out[np.arange(len(data)) + np.repeat(np.arange(b.num_rows), sizes[-1])] = data.astype(np.uint16) + 1
                    f.write(out.tobytes())
            if not docs or not sum(map(len, docs)):
                return
            doc, tie, start, size = (np.concatenate(x) for x in (docs, ties, starts, sizes))
            begin = np.cumsum(size + 1) - size - 1
            text = np.memmap(os.path.join(folder, "text"), np.uint16, "r")
            spool = open(os.path.join(folder, "runs"), "wb")
            state = {"run": 0, "last": -1, "in": False}

            def on(pos: np.ndarray, prefix: np.ndarray) -> None:
                long = prefix >= length
                run = state["run"] + np.cumsum(~long)
                kept = long | np.append(long[1:], False)
                if len(long) and long[0] and not state["in"]:
                    spool.write(np.array([[state["run"], state["last"]]], np.int64).tobytes())
                spool.write(np.stack([run[kept], pos[kept]], 1).astype(np.int64).tobytes())
                if len(pos):
                    state.update(run=int(run[-1]), last=int(pos[-1]), **{"in": bool(kept[-1])})

            suffixes_descending(text, on, length, folder)
            spool.close()
            rows = np.fromfile(os.path.join(folder, "runs"), np.int64).reshape(-1, 2)
            segment = np.searchsorted(begin, rows[:, 1], "right") - 1
            found = np.empty(len(rows), _SPAN)
            found["doc"], found["tie"], found["start"] = doc[segment], tie[segment], start[segment] + rows[:, 1] - begin[segment]
            found["end"] = found["start"] + length
            order = _by_place(found, rows[:, 0])
            run, found = rows[order, 0], found[order]
            head = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
            spans = _merged(np.concatenate([*copies, found[found != found[np.repeat(head, np.diff(np.append(head, len(run))))]]]))
            yield _by_doc(spans, spans, 1)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def _apply(with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
        for b in batches:
            out: dict[str, list] = {k: [] for k in schema.names[1:]}
            for text, bodies in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                spans = _merged(np.frombuffer(b"".join(bodies or []), _SPAN))
                cuts = [0, *np.stack([spans["start"], spans["end"]], 1).ravel().tolist(), len(text)]
                kept = b"".join(text[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True))
                for k, x in zip(out, (len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_kept else None), strict=True):
                    out[k].append(x)
            yield arrow_rows(schema, doc_id=b.column(0), **out)

    return run


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if asked for) for every row: each byte goes that is covered by a string of `length` bytes which also starts earlier, in a smaller document or earlier in the same one.

    Windows of `length` bytes are dealt by content: a segment is the run of windows that share an anchor, equal windows meet under equal anchors, and windows with an anchor of their own need nothing more. Equal segments are pre-aggregated (a copy of an earlier segment goes whole); where an anchor has several contents, the shard's suffixes are sorted by external induced sorting, and common prefixes of `length` show the windows that repeat. A shard's text, queues and runs are files; its suffix types and orders are arrays in memory, some 50 bytes a character, which shards of about 1 MB keep small.
    Anchors are chosen among runs of bytes that are not common, as far as a window has any, so that no anchor's segments are many. Segments are held equal if two 64-bit hashes, of the anchor and of the whole, agree; in the sort, bytes are compared.
    Null text: empty. Rows without an id come last. Of rows that share an id or have none, those of equal texts are one document that is repeated: none removes bytes of another at equal places, and each gets the document's result; those of different texts are documents of their own, in the order of a hash of their texts. Texts shorter than `length` keep everything. An empty table gives no rows.
    """
    own = F.col(id_col).cast("long")
    shared = materialise(docs.select(own.alias("id")).where("id is not null").groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("shared")))
    base = docs.select(F.coalesce(own, F.lit(NO_ID)).alias("id"), own.alias("own"), text_or_empty(text_col).cast("binary").alias("t"))
    base = base.join(shared, "id", "left") if shared.limit(1).count() else base.withColumn("shared", F.lit(False))
    base = base.select("id", F.when(F.col("own").isNull() | F.col("shared"), F.xxhash64("t")).otherwise(0).alias("tie"), "own", "t")
    n = fan_out(docs)
    cut = base.select("id", "tie", "t").mapInArrow(_cut(length, n, _common_runs(base, F.col("t"))), "shard int, kind int, body binary")
    met = materialise(cut.repartition(n, "shard").mapInArrow(_meet, _FOUND))
    asked = met.where("kind = 2").groupBy("id", "tie").agg(F.collect_list("body").alias("bodies"))
    texts = base.join(asked, ["id", "tie"])
    asked_bytes = met.where("kind = 2").agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(n, asked_bytes * (length + GRAM) // _ASK.itemsize // SHARD)
    found = texts.select("id", "tie", "t", "bodies").mapInArrow(_fetch(shards), "shard int, anchor long, at int, doc long, tie long, start long, segment binary").repartition(shards, "shard").sortWithinPartitions("anchor").mapInArrow(_repeats(length), _FOUND)
    gone = met.where("kind = 1").unionByName(found).groupBy("id", "tie").agg(F.collect_list("body").alias("bodies"))
    return base.join(gone, ["id", "tie"], "left").select("own", "t", "bodies").mapInArrow(_apply(with_kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").drop(*([] if with_kept else ["kept"]))
