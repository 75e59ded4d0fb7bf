"""SimHash near-duplicates through an inverted index over positional bytes of the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_rows, fan_out, materialise, text_or_empty
from graphloom.llm.components import components

#: Row b: the bits of byte b, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Hashes of so many shingles are counted at once.
_BLOCK = 1 << 16
#: Up to so many fingerprints, posting lists are compared pair by pair, many at once; a longer one is searched as a tree.
_SHORT = 32
#: Candidates of a fingerprint that a long list gives in the first round after its tree; each later round gives so many times more.
_MORE = 64
#: Bits of a sketch of a shingle set.
_SKETCH = 1024


def _shingles(text: bytes, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """A text's words joined by spaces, and where in it each shingle starts and ends: A-Z in lower case, words between ASCII white space, `shingle` words (all of them, if fewer)."""
    words = text.lower().split()
    n = max(len(words) - shingle + 1, min(1, len(words)))
    if not n:
        return b"", [], []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return b" ".join(words), np.concatenate([[0], ends[: n - 1] + 1]).tolist(), ends[len(words) - n :].tolist()


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    joined, first, last = _shingles(text, shingle)
    return np.unique(np.fromiter([xxhash.xxh64_intdigest(joined[i:j], 42) for i, j in zip(first, last, strict=True)], np.uint64, len(first)))


def sketch(shingles: np.ndarray) -> bytes:
    """For each of _SKETCH bits, whether an odd number of the set's hashes fall there. A hash that only one of two sets has changes one bit, so two sets differ in as many hashes as their sketches in bits, or more."""
    return np.packbits(np.bincount(shingles.view(np.int64) & (_SKETCH - 1), minlength=_SKETCH) & 1 == 1).tobytes()


def fingerprint(text: bytes, shingle: int, bits: int) -> bytes:
    """The SimHash of a text, highest byte first: XXH64 of its shingles with seed 42 for the lowest 64 bits, 43 for the next, and so on. A bit is 1 if over half the shingles, repeats included, have it. No words: zero."""
    joined, first, last = _shingles(text, shingle)
    n = len(first)
    if not n:
        return bytes(bits // 8)
    out = []
    for seed in range(42, 42 + bits // 64):
        tally = np.zeros(64, np.int64)
        for k in range(0, n, _BLOCK):
            a, b = first[k : k + _BLOCK], last[k : k + _BLOCK]
            h = np.fromiter([xxhash.xxh64_intdigest(joined[i:j], seed) for i, j in zip(a, b, strict=True)], np.uint64, len(a)).view(np.uint8).reshape(-1, 8)
            for j in range(8):
                tally[8 * j : 8 * j + 8] += np.bincount(h[:, j], minlength=256) @ _BITS
        out.append(np.packbits(2 * tally > n, bitorder="little")[::-1].tobytes())
    return b"".join(reversed(out))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = 64) -> DataFrame:
    """(id, text_hash, fp binary) for every row; a null text is empty. text_hash: 64 bits of the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.binary())])
        for b in batches:
            yield arrow_rows(schema, id=b.column(0), text_hash=b.column(1), fp=[fingerprint(t.as_py(), shingle, bits) for t in b.column(2)])

    text = text_or_empty(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t")).mapInArrow(run, "id long, text_hash long, fp binary")


def meeting_keys(n_bytes: int, shared: int, width: int) -> list[tuple[int, ...]]:
    """Sets of `width` byte positions so that any two fingerprints with `shared` equal positional bytes agree on all of some set: positions are dealt into groups, few enough that one group gets `width` of any `shared`."""
    groups = (shared - 1) // (width - 1)
    return [c for g in range(groups) for c in combinations(range(g * n_bytes // groups, (g + 1) * n_bytes // groups), width)]


def _postings(n_bytes: int, shared: int, width: int):
    sets = meeting_keys(n_bytes, shared, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("posting", pa.int64()), ("fp", pa.binary()), ("rep", pa.int64())])
        for b in batches:
            if not b.num_rows:
                continue
            fp = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, n_bytes).astype(np.int64)
            for k, at in enumerate(sets):
                key = np.full(len(fp), k, np.int64)
                for p in at:
                    key = (key << 8) | fp[:, p]
                yield arrow_rows(schema, posting=key, fp=b.column(0), rep=b.column(1))

    return run


def _close(a: np.ndarray, b: np.ndarray, shared: int, radius: int) -> np.ndarray:
    """Count filter, then the exact distance: which rows of a and b have at least `shared` equal positional bytes and at most `radius` differing bits."""
    x = a ^ b
    out = np.count_nonzero(x == 0, axis=-1) >= shared
    out[out] = np.bitwise_count(x[out] if x.ndim > 1 else x).sum(-1, dtype=np.int64) <= radius
    return out


def _spanning(i: np.ndarray, j: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs (i, j) of n nodes make a minimum spanning forest: in each round, every tree takes its lightest pair to another one."""
    order = np.lexsort((j, i, weight))  # pairs by rank, so that no two weigh the same
    i, j = i[order], j[order]
    tree, kept, live = np.arange(n), np.zeros(len(i), bool), np.arange(len(i))
    while len(live):
        a, b = tree[i[live]], tree[j[live]]
        least = np.full(n, len(i))
        np.minimum.at(least, a, live)
        np.minimum.at(least, b, live)
        of = np.flatnonzero(least < len(i))
        kept[least[of]] = True
        to = np.arange(n)
        to[of] = tree[i[least[of]]] + tree[j[least[of]]] - of  # the tree at the pair's other end
        both = of[(to[to[of]] == of) & (of < to[of])]
        to[both] = both
        while (to[to] != to).any():
            to = to[to]
        tree = to[tree]
        live = live[tree[i[live]] != tree[j[live]]]
    return order[kept]


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The columns of whole posting lists, in parts to be joined: lists come one after the other, and a batch may end within one."""
    kept: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        fp = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(key), -1)
        columns = (key, fp, *(np.asarray(batch.column(k)) for k in range(2, batch.num_columns)))
        cut = int(np.searchsorted(key, key[-1]))  # the last posting list may go on in the next batch
        if cut:
            yield [*kept, tuple(c[:cut] for c in columns)]
            kept = []
        elif kept and kept[0][0][0] != key[0]:
            yield kept
            kept = []
        kept.append(tuple(c[cut:] for c in columns))
    if kept:
        yield kept


def _links(shared: int, radius: int, nearest: bool):
    """Edges (a, b) of posting lists; with `nearest`, a forest of least distances of each list, so fewer edges than the list has fingerprints, and (long), the keys of the lists that may have other edges."""

    def tree(fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a spanning forest of a long posting list: each fingerprint is held against those not reached yet."""
        left, a, b = np.arange(len(fp)), [], []
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                i = queue.pop()
                hit = _close(fp[left], fp[i], shared, radius)
                found, left = left[hit], left[~hit]
                a.append(np.full(len(found), rep[i]))
                b.append(rep[found])
                queue.extend(found.tolist())
        return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])

    def forest(fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A long posting list's links of least distance that join what can be joined: a minimum spanning forest, grown from one fingerprint to the next nearest."""
        last, left, a, b = 0, np.arange(1, len(fp)), [], []
        least, parent = np.full(len(left), 8 * fp.shape[1] + 1), np.zeros(len(left), np.int64)
        while len(left):
            x = fp[left] ^ fp[last]
            d = np.where(np.count_nonzero(x == 0, axis=-1) >= shared, np.bitwise_count(x).sum(-1, dtype=np.int64), 8 * fp.shape[1] + 1)
            nearer = d < least
            least[nearer], parent[nearer] = d[nearer], last
            k = int(least.argmin())
            last = int(left[k])
            if least[k] <= radius:
                a.append(rep[parent[k]])
                b.append(rep[last])
            left, least, parent = (np.delete(v, k) for v in (left, least, parent))
        return np.array(a, np.int64), np.array(b, np.int64)

    def links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        long = key[starts[sizes > _SHORT]]
        a, b = [], []
        for s, n in zip(starts[sizes > _SHORT].tolist(), sizes[sizes > _SHORT].tolist(), strict=True):
            x, y = (forest if nearest else tree)(fp[s : s + n], rep[s : s + n])
            a.append(x)
            b.append(y)
        short = np.repeat(sizes <= _SHORT, sizes)
        key, fp, rep = key[short], fp[short], rep[short]
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, _SHORT):
            i = np.flatnonzero(key[d:] == key[:-d]) if d < len(key) else np.zeros(0, np.int64)
            if not len(i):
                break
            i = i[_close(fp[i], fp[i + d], shared, radius)]
            x.append(i)
            y.append(i + d)
        x, y = np.concatenate(x), np.concatenate(y)
        if nearest and len(x):
            taken = _spanning(x, y, np.bitwise_count(fp[x] ^ fp[y]).sum(-1, dtype=np.int64), len(key))
            left = np.ones(len(x), bool)
            left[taken] = False
            long = np.concatenate([long, np.unique(key[x[left]])])
            x, y = x[taken], y[taken]
        a.append(rep[x])
        b.append(rep[y])
        return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b]), long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("long", pa.int64())])
        for rows in _lists(batches):
            a, b, long = links(*(np.concatenate(x) for x in zip(*rows, strict=True)))
            none = pa.nulls(len(a), pa.int64())
            yield arrow_rows(schema, a=a, b=b, long=none)
            if nearest and len(long):
                none = pa.nulls(len(long), pa.int64())
                yield arrow_rows(schema, a=none, b=none, long=long)

    return run


def _across(shared: int, radius: int, similarity: float, most: int):
    """Candidates (a, b) of posting lists between different components: of every fingerprint the `most` nearest; more says that a fingerprint has others. All fingerprints but the largest component's are held against those of the components after theirs. Pairs whose sketches differ in more bits than sets of that similarity can are none: sets of n and m hashes differ in (n + m)(1 - similarity)/(1 + similarity) at the most."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("more", pa.bool_())])

    def one(fp: np.ndarray, rep: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, which, count = np.unique(comp, return_inverse=True, return_counts=True)
        order = np.lexsort((rep, which, count[which]))
        fp, rep, which, n = fp[order], rep[order], which[order], n[order]
        bits = np.frombuffer(b"".join(bits[order]), np.uint64).reshape(len(n), -1)
        ends = np.append(np.flatnonzero(which[1:] != which[:-1]) + 1, len(which))
        a, b, more, held = [], [], False, 0
        for i in range(int(ends[-2]) if len(ends) > 1 else 0):
            later = int(ends[np.searchsorted(ends, i, "right")])
            hit = later + np.flatnonzero(_close(fp[later:], fp[i], shared, radius))
            hit = hit[np.bitwise_count(bits[hit] ^ bits[i]).sum(-1, dtype=np.int64) * (1 + similarity) <= (n[hit] + n[i]) * (1 - similarity) + 1e-6]
            if len(hit) > most:
                more = True
                hit = hit[np.argsort(np.bitwise_count(fp[hit] ^ fp[i]).sum(-1, dtype=np.int64), kind="stable")[:most]]
            if len(hit):
                a.append(np.full(len(hit), rep[i]))
                b.append(rep[hit])
                held += len(hit)
            if held > _BLOCK:
                yield arrow_rows(schema, a=np.concatenate(a), b=np.concatenate(b), more=np.zeros(held, bool))
                a, b, held = [], [], 0
        if held:
            yield arrow_rows(schema, a=np.concatenate(a), b=np.concatenate(b), more=np.zeros(held, bool))
        if more:
            yield arrow_rows(schema, a=[None], b=[None], more=[True])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _lists(batches):
            key, *columns = (np.concatenate(x) for x in zip(*rows, strict=True))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
            for s, e in zip(starts, [*starts[1:], len(key)], strict=True):
                yield from one(*(c[s:e] for c in columns))

    return run


def _ordered(edges: DataFrame) -> DataFrame:
    """The distinct edges between different nodes, the lesser node first."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _similar(edges: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The edges (a, b) whose texts' shingle sets have a Jaccard similarity of `similarity` or more. Only texts that some edge names are hashed, each once."""
    nodes = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("t")).join(nodes, "id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("s", pa.binary())])
        for b in batches:
            yield arrow_rows(schema, id=b.column(0), s=[shingle_set(t, shingle).tobytes() for t in b.column(1).to_pylist()])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield arrow_rows(schema, a=batch.column(0).filter(pa.array(ok, pa.bool_())), b=batch.column(1).filter(pa.array(ok, pa.bool_())))

    sets = materialise(texts.mapInArrow(hashed, "id long, s binary").distinct())
    pairs = edges.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    return pairs.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")


def _sketched(rest: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """rest with (n, sketch) beside each rep: how many shingles its text has, and their sketch. Each text is hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(1).to_pylist()]
            yield arrow_rows(schema, rep=b.column(0), n=[len(s) for s in sets], sketch=[sketch(s) for s in sets])

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), text_or_empty(text_col).cast("binary").alias("t")).join(rest.select("rep").distinct(), "rep")
    return rest.join(materialise(texts.mapInArrow(run, "rep long, n long, sketch binary").distinct()), "rep")


def _joined(first: DataFrame, index: DataFrame, rule: tuple[int, int, float], parts: int, verified, sketched) -> DataFrame:
    """Components over the candidates that `verified` passes. first: what _links gives of the index; rule: shared bytes, radius and similarity; sketched: sets beside an index's rows the sketches of their texts.

    A list's forest is only where the search begins, for a link may be missing from it: rounds follow over the lists that have more than their forest, of candidates between what are different components so far and were not looked at, until there are none. So every candidate is verified, lies within a component, or differs in its sketches by more than the similarity allows."""
    tried = materialise(_ordered(first.where("long is null")))
    linked = materialise(verified(tried))
    found = components(linked)
    long = materialise(first.where("long is not null").select(F.col("long").alias("posting")))
    most = _MORE
    rest = materialise(sketched(materialise(index.join(long, "posting", "left_semi")))) if long.limit(1).count() else None
    while rest is not None:
        named = rest.join(found, F.col("rep") == F.col("node"), "left").select("posting", "fp", "rep", F.coalesce("component", "rep").alias("comp"), "n", "sketch")
        given = materialise(named.repartition(parts, "posting").sortWithinPartitions("posting", "rep").mapInArrow(_across(*rule, most), "a long, b long, more boolean"))
        fresh = materialise(_ordered(given.where("a is not null")).join(tried, ["a", "b"], "left_anti"))
        if fresh.limit(1).count():
            linked = materialise(linked.union(verified(fresh)))
            found = components(linked)
            tried = tried.union(fresh)
        if not given.where("more").limit(1).count():
            return found
        most *= _MORE
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = 64, radius: int = 3, shared: int | None = None, width: int = 3, similarity: float | None = None) -> DataFrame:
    """(id, text_hash, fp, component) for every row: rows link when their fingerprints differ in at most `radius` bits, and, if `similarity` is given, their shingle sets have that Jaccard similarity or more. component is the least id that a row reaches by links.

    Equal fingerprints are one class before any pair is looked at, so copies cost nothing. Classes are indexed under `width` positional bytes; `shared` is how many equal positional bytes a linked pair is taken to have: bits/8 - radius at the least, for which the index misses none. Each posting list tallies shared bytes, drops pairs with fewer than are sure (`width`, or bits/8 - radius), and verifies the bits. A long list gives a spanning forest; if a similarity is to be verified, every list one of least distances, and then all its candidates that no verified links join.
    Null and empty texts have fingerprint zero and link like any other; rows that share an id keep one row each; rows without an id link only as copies of one that has one; an empty table gives an empty result.
    """
    sure = bits // 8 - radius
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, bits))
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    index = classes.where("rep is not null").mapInArrow(_postings(bits // 8, sure if shared is None else shared, width), "posting long, fp binary, rep long")
    rule, parts = (max(width, sure), radius), fan_out(classes)
    edges = index.repartition(parts, "posting").sortWithinPartitions("posting", "rep").mapInArrow(_links(*rule, similarity is not None), "a long, b long, long long")
    if similarity is None:
        found = components(edges.select("a", "b"))
    else:
        found = _joined(materialise(edges), index, (*rule, similarity), parts, lambda pairs: _similar(pairs, docs, id_col, text_col, shingle, similarity), lambda rest: _sketched(rest, docs, id_col, text_col, shingle))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return prints.join(named, "fp").select("id", "text_hash", "fp", "component")
