"""Embedding near-duplicates: a hierarchical navigable small-world graph for each shard, queried by every vector of the same label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_rows, fan_out, materialise
from graphloom.llm.components import components

#: Vectors of one graph, about.
SHARD = 4096
#: Shards of queries that one task's graph answers, at most; and bytes of vectors in a row that is exchanged, about.
SPAN, ROW = 8, 8192
#: Neighbours of a vector on the upper layers (twice as many on the lowest), and the beam while a graph is built.
LINKS, BUILD_BEAM = 16, 64
#: Queries that are searched for together.
_BLOCK = 256


class Graph:
    """A navigable small-world graph over unit vectors; similarities are inner products. Vectors are inserted in batches: each searches the graph so far and is linked to diverse near vectors, of the batch too."""

    def __init__(self, x: np.ndarray, seed: int = 11):
        self.x = x.astype(np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 6)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(int(level.max(initial=0)), -1, -1):
            at = np.flatnonzero(level >= k)
            if len(at):
                self.layers.append((at, self._build(at, 2 * LINKS if k == 0 else LINKS)))

    def packed(self) -> bytes:
        sizes = np.array([len(self.layers), *(v for at, near in self.layers for v in near.shape)], "<i4")
        return b"".join([sizes.tobytes(), *(part.astype("<i4").tobytes() for layer in self.layers for part in layer)])

    @staticmethod
    def unpacked(body: bytes, x: np.ndarray) -> Graph:
        graph = Graph.__new__(Graph)
        graph.x, graph.layers = x.astype(np.float32), []
        flat = np.frombuffer(body, "<i4")
        n, at = int(flat[0]), 1 + 2 * int(flat[0])
        for rows, most in flat[1 : 1 + 2 * n].reshape(n, 2).tolist():
            own, near = flat[at : at + rows].astype(np.int64), flat[at + rows : at + rows + rows * most].reshape(rows, most).astype(np.int64)
            graph.layers.append((own, near))
            at += rows * (most + 1)
        return graph

    def _choose(self, q: np.ndarray, ids: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates (-1: none), up to `most`: first those nearer to q than to any chosen before, then the nearest others."""
        sim = np.where(ids >= 0, np.einsum("bd,bcd->bc", q, self.x[at[np.maximum(ids, 0)]]), -2)
        order = np.argsort(-sim, 1, kind="stable")
        ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
        v = self.x[at[np.maximum(ids, 0)]]
        among = np.einsum("bcd,bed->bce", v, v)
        chosen = np.zeros(ids.shape, bool)
        nearest = np.full(ids.shape, -2.0)
        for c in range(ids.shape[1]):
            ok = (ids[:, c] >= 0) & (sim[:, c] > nearest[:, c]) & (chosen.sum(1) < most)
            chosen[:, c] = ok
            nearest = np.where(ok[:, None], np.maximum(nearest, among[:, c]), nearest)
        rank = np.argsort(~chosen, 1, kind="stable")[:, :most]
        return np.take_along_axis(ids, rank, 1)

    def _build(self, at: np.ndarray, most: int) -> np.ndarray:
        """Neighbour lists, as positions in at."""
        n = len(at)
        near = np.full((n, most), -1, np.int64)
        done = 0
        while done < n:
            size = min(n - done, max(1, min(_BLOCK, done)))
            new = np.arange(done, done + size)
            q = self.x[at[new]]
            found = self._beam(q, at, near, np.zeros((size, 1), np.int64), min(BUILD_BEAM, max(1, done)))[0] if done else np.full((size, 1), -1)
            inner = q @ q.T
            inner[np.arange(size)[:, None] <= np.arange(size)] = -2  # of the batch, those before
            k = min(LINKS, size)
            own = np.argpartition(-inner, k - 1, 1)[:, :k]
            own = np.where(np.take_along_axis(inner, own, 1) > -2, own + done, -1)
            near[new] = np.pad(c := self._choose(q, np.concatenate([found, own], 1), at, most), ((0, 0), (0, most - c.shape[1])), constant_values=-1)
            # Links go both ways: a list that grows too long is chosen from anew.
            a, b = np.repeat(new, most), near[new].ravel()
            a, b = a[b >= 0], b[b >= 0]
            order = np.argsort(b, kind="stable")
            a, b = a[order], b[order]
            head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
            count = np.diff(np.append(head, len(b)))
            for lo in range(0, len(head), _BLOCK):
                h, m = head[lo : lo + _BLOCK], count[lo : lo + _BLOCK]
                to, wide = b[h], int(m.max())
                grid = h[:, None] + np.arange(wide)
                extra = np.where(np.arange(wide) < m[:, None], a[np.minimum(grid, len(a) - 1)], -1)
                near[to] = np.pad(c := self._choose(self.x[at[to]], np.concatenate([near[to], extra], 1), at, most), ((0, 0), (0, most - c.shape[1])), constant_values=-1)
            done += size
        return near

    def _beam(self, q: np.ndarray, at: np.ndarray, near: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best `beam` found for each query and their similarities, from the entry positions on; -1 and -2 where fewer were reached."""
        rows = np.arange(len(q))[:, None]
        width = max(4, beam // 16)  # of a query's open vectors, so many are followed at once
        seen = np.zeros((len(q), len(at)), bool)
        ids, sim = np.full((len(q), beam), -1), np.full((len(q), beam), -2.0, np.float32)
        entry = entry[:, :beam]
        ids[:, : entry.shape[1]] = entry
        sim[:, : entry.shape[1]] = np.where(entry >= 0, np.einsum("bd,bcd->bc", q, self.x[at[np.maximum(entry, 0)]]), -2)
        seen[np.broadcast_to(rows, entry.shape)[entry >= 0], entry[entry >= 0]] = True
        open_ = ids >= 0
        while open_.any():
            live = np.flatnonzero(open_.any(1))
            score = np.where(open_[live], sim[live], -3)
            w = min(width, beam)
            top = np.argpartition(-score, w - 1, 1)[:, :w]
            good = np.take_along_axis(open_[live], top, 1)
            open_[live[:, None], top] = False
            step = near[np.where(good, ids[live[:, None], top], 0)]
            step = np.where(good[:, :, None], step, -1).reshape(len(live), -1)
            step = np.sort(step, 1)
            step[:, 1:][step[:, 1:] == step[:, :-1]] = -1
            fresh = (step >= 0) & ~seen[live[:, None], np.maximum(step, 0)]
            r, c = np.nonzero(fresh)
            seen[live[r], step[r, c]] = True
            new = np.full(step.shape, -2.0, np.float32)
            new[r, c] = np.einsum("nd,nd->n", q[live[r]], self.x[at[step[r, c]]])
            all_ids = np.concatenate([ids[live], np.where(fresh, step, -1)], 1)
            all_sim = np.concatenate([sim[live], new], 1)
            all_open = np.concatenate([open_[live], fresh], 1)
            order = np.argsort(-all_sim, 1, kind="stable")[:, :beam]
            ids[live], sim[live] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sim, order, 1)
            open_[live] = np.take_along_axis(all_open, order, 1)
        return ids, sim

    def _entries(self, q: np.ndarray) -> np.ndarray:
        """Where the search of the lowest layer begins: the nearest found on the layers above."""
        entry = np.zeros((len(q), 1), np.int64)
        for (at, near), (below, _) in zip(self.layers[:-1], self.layers[1:], strict=True):
            ids, _ = self._beam(q, at, near, entry, 4)
            entry = np.where(ids >= 0, np.searchsorted(below, at[np.maximum(ids, 0)]), -1)
        return entry

    def within(self, q: np.ndarray, least: float, beam: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) of similarity `least` or more; the beam of a query is widened until its worst vector is below, or it holds all. Not whole: what the first beam finds."""
        out_q, out_v = [], []
        at, near = self.layers[-1]
        for lo in range(0, len(q), _BLOCK):
            part = np.arange(lo, min(len(q), lo + _BLOCK))
            entry, size = self._entries(q[part]), min(beam, len(at))
            while len(part):
                few = max(8, _BLOCK * BUILD_BEAM // max(size, BUILD_BEAM))
                each = [self._beam(q[part[k : k + few]], at, near, entry[k : k + few], size) for k in range(0, len(part), few)]
                ids, sim = (np.concatenate(x) for x in zip(*each, strict=True))
                full = (sim[:, -1] >= least) & (size < len(at)) & whole
                r, c = np.nonzero((sim >= least) & ~full[:, None])
                out_q.append(part[r])
                out_v.append(at[ids[r, c]])
                part, entry, size = part[full], ids[full], min(4 * size, len(at))
        return np.concatenate([np.zeros(0, np.int64), *out_q]), np.concatenate([np.zeros(0, np.int64), *out_v])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def audit_pairs(q: np.ndarray, x: np.ndarray, same: bool, threshold: float, probes: int, least: int) -> tuple[np.ndarray, set[tuple[int, int]]]:
    """Evenly spread probes among the queries, and their links by brute force, not counting a vector with itself; if there are fewer than `least`, the closest pairs up to that number: so there is always something to find."""
    probe = np.unique(np.linspace(0, len(q) - 1, min(probes, len(q))).astype(int))
    sim = q[probe] @ x.T
    if same:
        sim[np.arange(len(probe)), probe] = -2
    many = int((sim >= threshold).sum())
    take = min(max(many, least), int((sim > -2).sum()))
    flat = np.argpartition(-sim.ravel(), take - 1)[:take] if take else np.zeros(0, np.int64)
    i, j = np.divmod(flat, len(x))
    return probe, {(int(a), int(b)) for a, b in zip(probe[i], j, strict=True)}


def _audited(graph: Graph, q: np.ndarray, exact_x: np.ndarray, same: bool, threshold: float, recall: float, audit: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs found with cosine of at least the threshold in double precision; beams are widened until a brute-force audit finds `recall` of its pairs."""
    probe, pairs = audit_pairs(q, exact_x, same, threshold, audit, audit // 2)
    floor = min([threshold, *(float(exact_x[j] @ q[i]) for i, j in pairs)])
    beam = BUILD_BEAM // 2
    while pairs:
        a, b = graph.within(q[probe].astype(np.float32), floor - 1e-4, beam, whole=False)
        found = {(int(probe[i]), int(j)) for i, j in zip(a, b, strict=True)}
        if len(pairs & found) >= recall * len(pairs) or beam >= len(exact_x):
            break
        beam *= 2
    a, b = graph.within(q.astype(np.float32), threshold - 1e-4, beam)
    kept = np.concatenate([np.zeros(0, bool), *(np.einsum("nd,nd->n", q[a[k : k + 65536]], exact_x[b[k : k + 65536]]) >= threshold for k in range(0, len(a), 65536))])
    return a[kept], b[kept]


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes reaches by the pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _read(bodies: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exchanged rows to ids, class sizes and unit vectors, in the order of the ids."""
    rep, size = (np.concatenate([np.frombuffer(x[k], "<i8") for x in bodies]) for k in (0, 1))
    x = _unit(np.frombuffer(b"".join(x[2] for x in bodies), "<f8").reshape(len(rep), -1))
    order = np.argsort(rep)
    return rep[order], size[order], x[order]


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A graph for each shard; rows (g, own, rep, n, vectors) come shard by shard."""
    schema = pa.schema([("g", pa.int64()), ("own", pa.int64()), ("graph", pa.binary())])
    now, held = None, []
    for b in batches:
        for g, own, *body in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if (g, own) != now and held:
                yield arrow_rows(schema, g=[now[0]], own=[now[1]], graph=[Graph(_read(held)[2]).packed()])
                held = []
            now = (g, own)
            held.append(body)
    if held:
        yield arrow_rows(schema, g=[now[0]], own=[now[1]], graph=[Graph(_read(held)[2]).packed()])


def _links(threshold: float, recall: float, audit: int, block: int):
    """Tasks of a graph and some shards of queries. Rows (unit, kind, own, rep, n, body) come unit by unit: the graph (kind 0), its vectors (1), its vectors as queries (2, if they are), then other shards' vectors (3), which are answered `block` at a time."""
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def itself(graph: Graph, own: np.ndarray, size: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        a, b = _audited(graph, x, x, True, threshold, recall, audit)
        a, b = np.divmod(np.unique(np.concatenate([a * len(x) + b, b * len(x) + a])), len(x))  # a pair found from either end is a pair
        a, b = a[a != b], b[a != b]
        return arrow_rows(schema, rep=own, links=np.bincount(a, size[b], len(x)).astype(np.int64), root=own[_forest(a, b, len(x))])

    def others(graph: Graph, own: np.ndarray, size: np.ndarray, x: np.ndarray, held: list) -> pa.RecordBatch:
        rep, weight, q = _read(held)
        a, b = _audited(graph, q, x, False, threshold, recall, audit)
        every = np.concatenate([rep, own])
        rank = np.argsort(np.argsort(every))
        label = np.sort(every)[_forest(rank[a], rank[len(rep) + b], len(every))]
        links = np.concatenate([np.bincount(a, size[b], len(rep)), np.bincount(b, weight[a], len(own))]).astype(np.int64)
        kept = links > 0
        return arrow_rows(schema, rep=every[kept], links=links[kept], root=label[rank][kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, graph, index, held, count, ready = None, b"", [], [], 0, None
        for batch in batches:
            for unit, kind, rep, n, body in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if unit != now:
                    if held:
                        yield others(*ready, held)
                    now, graph, index, held, count, ready = unit, b"", [], [], 0, None
                if kind == 0:
                    graph = body
                elif kind == 1:
                    index.append((rep, n, body))
                else:
                    if ready is None:
                        own, size, x = _read(index)
                        ready, index = (Graph.unpacked(graph, x), own, size, x), []
                    if kind == 2:
                        yield itself(*ready)
                        continue
                    held.append((rep, n, body))
                    count += len(rep) // 8
                    if count >= block:
                        yield others(*ready, held)
                        held, count = [], 0
        if held:
            yield others(*ready, held)

    return run


def similar_vectors(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.999, audit: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links are pairs of equal label and cosine of at least the threshold.

    Equal vectors of a label are one class, counted by size. A label's classes are dealt to shards of about `shard` vectors, whose graphs are built once and written. Every two shards of a label meet once: the one's vectors query the other's graph, by turns, so that all shards have as much to do; a task holds one graph and answers up to SPAN shards of queries, `shard` vectors at a time. Beams are widened until they find what a brute-force audit found. What is found is verified in double precision; tasks return a row for each vector (links and the least vector reached), never the pairs. Vectors are exchanged once for every two shards of their label, so work grows with the square of a label's rows over `shard`.
    Null labels, and null, empty or zero vectors or such with null or non-finite components, link with nothing; neither do vectors of different lengths. Rows that share an id get the same component, each counted. An empty table gives no rows.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    ok = v.isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False)))
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    group = F.xxhash64(F.col("label").cast("string"), F.size("v"))
    classes = materialise(rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("g", group))
    shards = materialise(classes.groupBy("g").agg(F.ceil(F.count("*") / shard).cast("long").alias("s")))
    parts = fan_out(classes)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of one shard, sorted by shard, as rows of about ROW bytes."""
        schema = pa.schema([("g", pa.int64()), ("own", pa.int64()), ("s", pa.int64()), ("rep", pa.binary()), ("n", pa.binary()), ("body", pa.binary())])
        for b in batches:
            g, own, s, rep, n = (np.asarray(b.column(k)) for k in range(5))
            flat, at = np.asarray(b.column(5).flatten()).astype("<f8"), np.asarray(b.column(5).offsets)
            at = at - at[0] if len(at) else at
            new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (own[1:] != own[:-1])])[: len(g)])
            cuts = [(k, min(k + m, z)) for a, z in zip(new.tolist(), [*new[1:].tolist(), len(g)], strict=True) for m in [max(1, ROW // 8 // int(at[a + 1] - at[a]))] for k in range(a, z, m)]
            first = [k for k, _ in cuts]
            yield arrow_rows(schema, g=g[first], own=own[first], s=s[first], rep=[rep[a:z].astype("<i8").tobytes() for a, z in cuts], n=[n[a:z].astype("<i8").tobytes() for a, z in cuts], body=[flat[at[a] : at[z]].tobytes() for a, z in cuts])

    dealt = classes.join(shards, "g").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("s"))).select("g", "own", "s", "rep", "n", "v")
    blocks = materialise(dealt.repartition(parts, "g", "own").sortWithinPartitions("g", "own", "rep").mapInArrow(packed, "g long, own long, s long, rep binary, n binary, body binary"))
    graphs = materialise(blocks.repartition(parts, "g", "own").sortWithinPartitions("g", "own").select("g", "own", "rep", "n", "body").mapInArrow(_graphs, "g long, own long, graph binary"))
    none = F.lit(None).cast("binary")
    unit = lambda index, queries: F.xxhash64("g", index, F.floor(queries / SPAN))
    # Of shards i < j, i has the graph if i + j is odd, else j: a shard's graph meets about half of the others.
    answers = lambda i, j: (i == j) | (((i + j) % 2 == 1) == (i < j))
    graph = graphs.join(shards, "g").select("g", "own", "s", F.lit(0).alias("kind"), none.alias("rep"), none.alias("n"), F.col("graph").alias("body"))
    index = blocks.select("g", "own", "s", F.lit(1).alias("kind"), "rep", "n", "body").unionByName(graph)
    index = index.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("s") - 1) / SPAN))))
    index = index.select(unit(F.col("own"), F.col("q") * SPAN).alias("unit"), "kind", F.lit(-1).cast("long").alias("of"), "rep", "n", "body")
    queries = blocks.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1))).where(answers(F.col("i"), F.col("own")) & (F.col("i") != F.col("own")))
    queries = queries.select(unit(F.col("i"), F.col("own")).alias("unit"), F.lit(3).alias("kind"), F.col("own").alias("of"), "rep", "n", "body")
    itself = graphs.select(unit(F.col("own"), F.col("own")).alias("unit"), F.lit(2).alias("kind"), F.col("own").alias("of"), none.alias("rep"), none.alias("n"), none.alias("body"))
    work = index.unionByName(queries).unionByName(itself)
    found = materialise(work.repartition(parts, "unit").sortWithinPartitions("unit", "kind", "of").select("unit", "kind", "rep", "n", "body").mapInArrow(_links(threshold, recall, audit, shard), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where("rep <> root").select("rep", "root"))
    named = classes.select("label", "v", "rep", "n").join(links, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    named = named.select("label", "v", F.lit(True).alias("ok"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(named, ["label", "v", "ok"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
