"""Suffix and common-prefix arrays of one shard by induced sorting, with tuples in disk-backed monotone priority queues.

A shard's text is many strings; each ends in a separator that is smaller than any character and differs from every other separator. Suffixes are induced from the sorted LMS suffixes, which are sorted by naming LMS substrings (themselves induced) and recursion on the names. Common prefixes, capped, are carried with the tuples as they are induced. A text has fewer than 2^31 characters; on disk a tuple is three 32-bit numbers.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Tuples that a queue hands out at once.
BLOCK = 1 << 16
#: Tuples of a slot with several keys, which is sorted in memory.
SORTED = 1 << 12
#: Tuples that a queue keeps in memory; beyond them, all slots' tuples go to their files.
MEMORY = 1 << 21
#: Common prefixes are carried up to this length.
CAP = 255


class TupleQueue:
    """A monotone priority queue on disk: tuples (key, position, common prefix with the tuple pushed to that key before). Equal keys come out in the order they went in.

    Keys are dealt into slots by ascending bounds. A slot with one key is a first-in-first-out file; one with more keys has a bounded number of tuples and is sorted when it is reached. When too many are in memory, each slot's go to a file of its own.
    """

    def __init__(self, folder: str, name: str, bounds: np.ndarray):
        self.bounds, self.total = bounds, 0
        self.path = os.path.join(folder, name)
        self.held: list[list[np.ndarray]] = [[] for _ in bounds]
        self.count = np.zeros(len(bounds), np.int64)
        self.spilled = np.zeros(len(bounds), bool)

    def push(self, rows: np.ndarray) -> None:
        """rows: columns key, position, prefix."""
        if not len(rows):
            return
        slot = self.bounds.searchsorted(rows[:, 0], "right") - 1
        order = slot.argsort(kind="stable")
        rows, slot = rows.take(order, 0), slot[order]
        cuts = [0, *((slot[1:] != slot[:-1]).nonzero()[0] + 1).tolist(), len(slot)]
        slots = slot[cuts[:-1]]
        for s, a, b in zip(slots.tolist(), cuts[:-1], cuts[1:], strict=True):
            self.held[s].append(rows[a:b].copy())  # not a view: it would keep all rows
        self.count[slots] += np.diff(cuts)
        self.total += len(rows)
        if self.total > MEMORY:
            for s in np.flatnonzero(self.count).tolist():
                with open(f"{self.path}.{s}", "ab") as f:
                    for x in self.held[s]:
                        f.write(x.astype(np.int32).tobytes())
                self.held[s], self.count[s], self.spilled[s] = [], 0, True
            self.total = 0

    def take(self, s: int) -> Iterator[np.ndarray]:
        """What slot s holds now, in the order it went in; the slot is empty then."""
        self.total -= int(self.count[s])
        if self.spilled[s]:
            path = f"{self.path}.{s}.out"
            os.rename(f"{self.path}.{s}", path)
            self.spilled[s] = False
            held, self.held[s], self.count[s] = self.held[s], [], 0
            with open(path, "rb") as f:
                while data := f.read(12 * BLOCK):
                    yield np.frombuffer(data, np.int32).reshape(-1, 3).astype(np.int64)
            os.remove(path)
        else:
            held, self.held[s], self.count[s] = self.held[s], [], 0
        if held:
            yield np.concatenate(held)


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first : last + 1] for each pair, by doubling."""
    width = last - first + 1
    level = np.frexp(width)[1] - 1
    out = np.empty(len(first), values.dtype)
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[first[at]], table[last[at] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


class _Between:
    """Least common prefix seen since a key was last pushed, over blocks of popped tuples."""

    def __init__(self) -> None:
        self.keys, self.low = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def block(self, prefix: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """prefix: of each popped tuple with the one popped before it; tuples `at` push `key`. Returns for each push the least prefix since that key's last push, -1 for its first."""
        order = np.argsort(key, kind="stable")
        k, a = key[order], at[order]
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        before = np.where(new, -1, np.concatenate([[-1], a[:-1]])) if len(k) else a
        low = _least(prefix, before + 1, a) if len(k) else np.zeros(0, np.int64)
        first = np.flatnonzero(new)
        where = np.searchsorted(self.keys, k[first])
        known = (where < len(self.keys)) & (self.keys[np.minimum(where, len(self.keys) - 1)] == k[first]) if len(self.keys) else np.zeros(len(first), bool)
        carried = np.zeros(len(first), np.int64)
        if len(self.keys):
            carried[known] = self.low[where[known]]
        low[first] = np.where(known, np.minimum(low[first], carried), -1)
        # What is carried on: of keys pushed here, the least after their last push; of the others, also this block's least.
        if len(prefix):
            tail = np.minimum.accumulate(np.append(prefix, np.iinfo(np.int64).max)[::-1])[::-1]
            self.low = np.minimum(self.low, tail[0])
            last = np.flatnonzero(np.concatenate([new[1:], [True]])) if len(k) else np.zeros(0, np.int64)
            self.low[where[known]] = tail[a[last[known]] + 1]
            if not known.all():
                keys = np.concatenate([self.keys, k[first[~known]]])
                lows = np.concatenate([self.low, tail[a[last[~known]] + 1]])
                o = np.argsort(keys, kind="stable")
                self.keys, self.low = keys[o], lows[o]
        out = np.empty(len(k), np.int64)
        out[order] = low
        return out


def _slots(text: np.ndarray, sign: int) -> np.ndarray:
    """Lower bounds of slots of keys (sign * character): one for each frequent character, and ranges of rare ones with at most about SORTED in all."""
    top = int(text.max()) + 1
    many = np.bincount(text, minlength=top)
    if sign < 0:
        many = many[::-1]
    total = np.cumsum(many)
    group = total // SORTED
    start = np.concatenate([[True], (group[1:] != group[:-1]) | (many[1:] >= SORTED) | (many[:-1] >= SORTED)])
    return np.flatnonzero(start) if sign > 0 else np.flatnonzero(start) - (top - 1)


def _run_places(text: np.ndarray) -> np.ndarray:
    """How many characters directly before each position equal its own."""
    at = np.arange(len(text), dtype=np.int32)
    return at - np.maximum.accumulate(np.where(np.concatenate([[True], text[1:] != text[:-1]]), at, 0))


def _marked(rows: np.ndarray, induced: int, left: np.ndarray | None = None) -> np.ndarray:
    """Tuples with whether they are induced and a step of 0; with `left`, each is followed by those of its run, steps away."""
    if left is None:
        out = np.zeros((len(rows), 5), np.int64)
        out[:, :3], out[:, 3] = rows, induced
        return out
    many = left[rows[:, 1]].astype(np.int64) + 1
    out = np.empty((int(many.sum()), 5), np.int64)
    out[:, :3], out[:, 3] = np.repeat(rows, many, 0), induced
    out[:, 4] = np.arange(len(out)) - np.repeat(np.cumsum(many) - many, many)
    out[:, 1] -= out[:, 4]
    return out


def _scan(text: np.ndarray, is_s: np.ndarray, first: Iterator[np.ndarray], sign: int, folder: str, name: str, emit: Callable[[np.ndarray], None], mode: str, seam: int = 0) -> None:
    """One induction scan. first: sorted seed tuples (key, position, prefix), keys ascending in `sign` order. sign 1: seeds are LMS suffixes, L suffixes are induced in ascending order; sign -1: seeds are L suffixes, S suffixes are induced in descending order. emit gets the induced and the seed tuples of each batch in order (a fourth column tells 1 for induced, a fifth is used here). mode: what the third column carries: "prefix", the common prefix with the tuple before (between the two kinds it is read off the text, up to `seam`); "class", a number that is equal for tuples induced alike; "order", nothing."""
    bounds = _slots(text, sign)
    queue, seeds = TupleQueue(folder, f"{name}.q", bounds), TupleQueue(folder, f"{name}.s", bounds)
    for rows in first:
        seeds.push(rows)
    between = _Between()
    # A tuple induces those of its whole run of equal characters, one after the other. In slots with several keys they are made at once, each with its step from the tuple; prefixes are carried step by step instead.
    left = None if mode == "prefix" else _run_places(text)

    state = {"at": 0, "kind": 0, "class": 0, "last": (None, None, None, None)}

    def process(rows: np.ndarray, mixed: bool) -> int:
        """Emit rows and push what they induce; mixed: of several keys, stop before the first row that must come after something pushed here. Returns how many rows were done."""
        pos = rows[:, 1]
        prev = pos - 1
        ok = (pos > 0)
        ok[ok] = (text[prev[ok]] > 0) & (is_s[prev[ok]] == (sign < 0))
        at = np.flatnonzero(ok)
        key = sign * text[prev[at]].astype(np.int64)
        if mixed and left is not None:
            on = key != rows[at, 0]
            at, key = at[on], key[on]
        n = len(rows)
        if mixed and len(at):
            # A row waits if an earlier one pushed a key below its own, or its own key and it is a seed or some steps into a run.
            wait = np.full(n, np.iinfo(np.int64).max)
            wait[at] = key
            wait = np.concatenate([[np.iinfo(np.int64).max], np.minimum.accumulate(wait)[:-1]])
            late = (rows[:, 0] > wait) | ((rows[:, 0] == wait) & ((rows[:, 3] == 0) | (rows[:, 4] > 0)))
            n = int(late.argmax()) if late.any() else n
            cut = np.searchsorted(at, n)
            at, key = at[:cut], key[:cut]
        rows = rows[:n]
        if not n:
            return 0
        if mode == "prefix":  # between the induced and the seeds of one character nothing was carried: compare the two
            before = np.concatenate([[state["at"]], rows[:-1, 1]])
            kinds = np.concatenate([[state["kind"]], rows[:-1, 3]])
            here = np.flatnonzero((kinds == 1) & (rows[:, 3] == 0))
            if len(here):
                rows[here, 2] = _prefixes(text, before[here], rows[here, 1], seam)
            state["at"], state["kind"] = int(rows[-1, 1]), int(rows[-1, 3])
            carried = np.minimum(between.block(rows[:, 2], at, key) + 1, CAP)
        elif mode == "class":
            new = np.empty(n, bool)
            new[0] = state["last"] != (rows[0, 0], rows[0, 2], rows[0, 3], rows[0, 4])
            new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 2] != rows[:-1, 2]) | (rows[1:, 3] != rows[:-1, 3]) | (rows[1:, 4] != rows[:-1, 4])
            state["last"] = (rows[-1, 0], rows[-1, 2], rows[-1, 3], rows[-1, 4])
            rows[:, 2] = state["class"] + np.cumsum(new)
            state["class"] = int(rows[-1, 2])
            carried = rows[at, 2]
        else:
            carried = np.zeros(len(at), np.int64)
        emit(rows)
        if len(at):
            queue.push(np.column_stack([key, prev[at], carried]))
        return n

    widths = np.append(bounds[1:], bounds[-1] + (1 << 40)) - bounds if len(bounds) else bounds
    top = int(text.max())
    for s in range(len(bounds)):
        single = widths[s] == 1 or (s == len(bounds) - 1 and bounds[s] == (top if sign > 0 else 0))
        if single:  # one key: induced tuples first, as long as there are any, then the seeds
            again = True
            while again:
                again = False
                for block in queue.take(s):
                    again = True
                    for k in range(0, len(block), BLOCK):
                        part = block[k : k + BLOCK]
                        process(_marked(part, 1), False)
            for block in seeds.take(s):
                for k in range(0, len(block), BLOCK):
                    part = block[k : k + BLOCK]
                    process(_marked(part, 0), False)
            continue
        rest = [_marked(x, 0) for x in seeds.take(s)]
        rest = np.concatenate(rest) if rest else np.zeros((0, 5), np.int64)
        size = 1024
        while True:
            new = [_marked(x, 1, left) for x in queue.take(s)]
            if new:
                rest = np.concatenate([rest, *new])
                rest = rest[np.argsort((2 * rest[:, 0] + 1 - rest[:, 3] << 31) + rest[:, 4], kind="stable")]
            if not len(rest):
                break
            done = process(rest[:size], True)
            size = min(BLOCK, max(512, 4 * done))
            rest = rest[done:]


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes: smaller than the next; separators (0) are S."""
    n = len(text)
    out = np.zeros(n, bool)
    out[text == 0] = True
    out[:-1] |= text[:-1] < text[1:]
    equal = np.flatnonzero((text[:-1] == text[1:]) & (text[:-1] > 0))
    if len(equal):  # runs of equal characters take the type of the run's last one
        last = np.flatnonzero(np.concatenate([equal[1:] != equal[:-1] + 1, [True]]))
        ends = equal[last] + 1
        out[equal] = out[ends[np.searchsorted(ends, equal, "right")]]
    return out


def _file(folder: str, name: str, dtype, n: int) -> np.ndarray:
    return np.memmap(os.path.join(folder, name), dtype, "w+", shape=(max(1, n),))[:n]


def _chunks(*columns: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(0, len(columns[0]), BLOCK):
        yield np.stack([np.asarray(c[k : k + BLOCK]).astype(np.int64) for c in columns], 1)


def _both_scans(text: np.ndarray, is_s: np.ndarray, seeds: Iterator[np.ndarray], folder: str, name: str, on_suffix: Callable[[np.ndarray], None], mode: str, seam: int = 0) -> None:
    """L scan, then S scan; on_suffix(rows) gets all suffixes in descending order: position, prefix with the suffix before (in descending order)."""
    spool = os.path.join(folder, f"{name}.l")
    count = 0

    with open(spool, "wb") as f:

        def emit_l(rows: np.ndarray) -> None:
            nonlocal count
            r = rows[(rows[:, 3] == 1) | (text[rows[:, 1]] == 0)]
            count += len(r)
            f.write(r[:, :3].astype(np.int32).tobytes())

        _scan(text, is_s, seeds, 1, folder, f"{name}1", emit_l, mode, seam)
    rows = np.memmap(spool, np.int32, "r", shape=(count, 3)) if count else np.zeros((0, 3), np.int32)

    def descending() -> Iterator[np.ndarray]:
        for hi in range(count, 0, -BLOCK):
            lo = max(0, hi - BLOCK)
            x = rows[lo:hi][::-1].astype(np.int64)
            if mode != "prefix":
                x[:, 0] = -x[:, 0]
                yield x
                continue
            # the prefix with the neighbour above: that neighbour's own, if it has the same key
            up = np.array(rows[lo + 1 : min(count, hi + 1)])
            y = np.zeros(hi - lo, np.int64)
            y[: len(up)] = np.where(up[:, 0] == np.array(rows[lo : lo + len(up), 0]), up[:, 2], 0)
            x[:, 2] = y[::-1]
            x[:, 0] = -x[:, 0]
            yield x

    _scan(text, is_s, descending(), -1, folder, f"{name}2", on_suffix, mode, seam)
    del rows
    os.remove(spool)


def sort_suffixes(text: np.ndarray, folder: str, depth: int = 0) -> np.ndarray:
    """Positions of the LMS suffixes of text in ascending order (separators, which sort by position, among them)."""
    name = f"d{depth}"
    is_s = _types(text)
    lms = np.flatnonzero(is_s & np.concatenate([[True], ~is_s[:-1] | (text[1:] == 0) | (text[:-1] == 0)]))
    lms = lms[(text[lms] == 0) | ((lms > 0) & ~is_s[np.maximum(lms - 1, 0)] & (text[np.maximum(lms - 1, 0)] > 0))]
    own = np.flatnonzero(text[lms] > 0)
    if not len(own):
        return lms
    # Name LMS substrings: induce them from LMS positions sorted by first character alone; those induced alike are equal.
    by = lms[np.argsort(text[lms], kind="stable")]
    key = text[by].astype(np.int64)
    names = np.full(len(text), -1, np.int64) if depth else _file(folder, f"{name}.names", np.int32, len(text))
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True

    def on(rows: np.ndarray) -> None:
        mine = is_lms[rows[:, 1]]
        names[rows[mine, 1]] = rows[mine, 2]

    _both_scans(text, is_s, _chunks(key, by, np.where(key > 0, 0, by + 1)), folder, name, on, "class")
    found = names[lms].astype(np.int64)
    del names
    # Descending numbers become ascending names; separators stay 0, each different by its place.
    reduced = np.where(text[lms] == 0, 0, found.max() - found + 1)
    if len(np.unique(reduced[own])) == len(own):
        order = np.lexsort((lms, reduced))
        return lms[order]
    used = np.unique(reduced)
    reduced = np.searchsorted(used, reduced) if used[0] == 0 else np.searchsorted(used, reduced) + 1
    # Every position of the reduced text is a suffix to sort: its own LMS suffixes come sorted from the recursion, the others are induced.
    return lms[_sort_all(reduced, folder, depth + 1)]


def _sort_all(text: np.ndarray, folder: str, depth: int) -> np.ndarray:
    """All positions of text in ascending order of their suffixes."""
    seeds = sort_suffixes(text, folder, depth)
    is_s = _types(text)
    out = np.empty(len(text), np.int64)
    at = len(text)

    def on(rows: np.ndarray) -> None:
        nonlocal at
        out[at - len(rows) : at] = rows[::-1, 1]
        at -= len(rows)

    key = text[seeds].astype(np.int64)
    _both_scans(text, is_s, _chunks(key, seeds, np.zeros(len(seeds), np.int64)), folder, f"e{depth}", on, "order")
    return out


def _prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of the suffixes at each a and b, up to `most`; separators match nothing."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    top = len(text) - 1
    for k in range(most):
        x, y = text[np.minimum(a[live] + k, top)], text[np.minimum(b[live] + k, top)]
        live = live[(x == y) & (x > 0)]
        if not len(live):
            break
        out[live] += 1
    return out


def suffixes_descending(text: np.ndarray, on: Callable[[np.ndarray, np.ndarray], None], most: int, folder: str | None = None) -> None:
    """Call on(positions, prefixes) with all suffixes that start at a character, in descending order, and each one's common prefix, up to `most` (at most CAP), with the one before it. text: characters from 1, a 0 after every string."""
    own = folder is None
    folder = folder or tempfile.mkdtemp(prefix="induced-")
    try:
        text = np.asarray(text)
        seeds = sort_suffixes(text, folder)
        is_s = _types(text)

        def first() -> Iterator[np.ndarray]:
            last = seeds[:1]
            for k in range(0, len(seeds), BLOCK):
                x = seeds[k : k + BLOCK]
                before = np.concatenate([last, x[:-1]])
                v = _prefixes(text, before, x, most)
                if k == 0:
                    v[:1] = 0
                yield np.stack([text[x].astype(np.int64), x, v], 1)
                last = x[-1:]

        def suffix(rows: np.ndarray) -> None:
            pos, v = rows[:, 1], np.minimum(rows[:, 2], most)
            kept = text[pos] > 0
            on(pos[kept], v[kept])

        _both_scans(text, is_s, first(), folder, "f", suffix, "prefix", most)
    finally:
        if own:
            shutil.rmtree(folder, ignore_errors=True)
