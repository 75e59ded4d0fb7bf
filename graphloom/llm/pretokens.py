"""Byte-level BPE over batches of texts: pre-tokens are found with array operations, and each distinct one is encoded once."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken

from graphloom.llm.common import sliced

_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
_APOSTROPHE = ord("'")
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A worker forgets its encoded pre-tokens beyond so many.
CACHE = 1_000_000
#: Code points that are handled at once, if no single text is longer.
CHUNK = 1 << 20


@lru_cache
def _classes() -> np.ndarray:
    """The class of each code point under the pre-tokeniser's pattern."""
    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, int(n).bit_length())
    return _power_table(size)


@lru_cache(maxsize=2)
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, x, np.uint64))]) for x in (_ODD, inverse))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache
def _mixed_bytes() -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(256, dtype=np.uint64) + _ODD)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """What range_hashes_at needs to hash any range of values."""
    up, _ = _powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        mixed = _mixed_bytes()[values] if values.dtype == np.uint8 else _mix(values.astype(np.uint64) + _ODD)
        mixed *= up[: len(values)]
        np.cumsum(mixed, out=out[1:])
    return out


def range_hashes_at(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _powers(len(total) - 1)
    with np.errstate(over="ignore"):
        return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def every_hash(total: np.ndarray, size: int) -> np.ndarray:
    """range_hashes_at for all ranges of one size."""
    n = max(0, len(total) - size)
    _, down = _powers(len(total) - 1)
    with np.errstate(over="ignore"):
        out = total[size : size + n] - total[:n]
        out *= down[:n]
        out += np.uint64(size)
        return _mix(out)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range [start, end) of values: equal ranges have equal hashes."""
    return range_hashes_at(prefix_sums(values), starts, ends)


def split_points(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts that lie one after the other in cp; bounds: where each text starts, and the end. Contractions are not looked for."""
    kind = _classes()[cp]
    edge = np.zeros(len(cp) + 1, bool)
    edge[bounds] = True
    runs = np.flatnonzero(edge[:-1] | np.concatenate([[True], kind[1:] != kind[:-1]]))
    ends = np.append(runs[1:], len(cp))
    # Of white space before other characters, the last one stands apart; a blank joins what follows.
    space = (kind[runs] == _SPACE) & ~edge[ends]
    last = ends[space] - 1
    blank = cp[last] == 32
    out = np.zeros(len(cp), bool)
    out[runs] = True
    out[last] = True
    out[last[blank] + 1] = False
    return np.flatnonzero(out)


class Encoder:
    """Token ids of many texts, equal to those of the tokenizer file's pattern and merges; special tokens' strings are ordinary text. ranks: a file of base64 tokens and ranks."""

    def __init__(self, ranks: str):
        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.at, self.used = np.zeros(1 << 16, np.uint16), np.zeros(1, np.int64), 0

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        encode = self.bpe._core_bpe.encode_single_piece
        new = [encode(p) for p in pieces]
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter((i for x in new for i in x), np.uint16, int(sizes.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        place = np.arange(len(self.at) - 1, len(self.at) - 1 + len(new))
        self.at = np.concatenate([self.at, self.used + np.cumsum(sizes)])
        self.used += len(flat)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, where, keys), np.insert(self.place, where, place)

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        odd = ["'" in t for t in texts]
        plain = [t for t, x in zip(texts, odd, strict=True) if not x]
        out = iter(self._plain(plain))
        return [np.asarray(self.bpe.encode_ordinary(t), np.uint16) if x else next(out) for t, x in zip(texts, odd, strict=True)]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        if not bounds[-1]:
            return [np.zeros(0, np.uint16) for _ in texts]
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = split_points(cp, bounds)
        ends = np.append(starts[1:], len(cp))
        keys, first, back = np.unique(range_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero((at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != keys)) if len(self.keys) else np.arange(len(keys))
        if len(new):
            self._learn(keys[new], [cp[a:b].tobytes().decode("utf-32-le").encode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        place = self.place[np.searchsorted(self.keys, keys)][back]
        sizes = self.at[place + 1] - self.at[place]
        ids = self.ids[sliced(self.at[place], sizes)]
        cuts = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= CHUNK:
                out += self._chunk(held)
                held, size = [], 0
        return out + self._chunk(held)


@lru_cache(maxsize=2)
def encoder(ranks: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(ranks)
