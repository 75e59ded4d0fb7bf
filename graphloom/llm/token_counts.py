"""Token counts under a unigram model, by dynamic programming over a trie of the distinct pre-tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_rows, sliced, text_or_empty
from graphloom.llm.pretokens import prefix_sums, range_hashes, range_hashes_at, split_points

#: Code points whose distinct pre-tokens share a trie, if no single text is longer.
CHUNK = 1 << 22
#: Pre-tokens of more bytes are scored one by one.
LONG = 64
#: Ranks are taken to follow Zipf's law from this one on.
_SHIFT = 10


class Unigram:
    """Pieces of a rank file with log-probabilities by Zipf's law over their ranks: p is in proportion to 1 / (rank + 10)."""

    def __init__(self, ranks: str):
        with open(ranks, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        total = np.log(sum(1 / (r + _SHIFT) for r in self.rank.values()))
        self.score = {p: -float(np.log(r + _SHIFT) + total) for p, r in self.rank.items()}
        pieces = list(self.score)
        size = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        keys = range_hashes(flat, np.cumsum(size) - size, np.cumsum(size))
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], np.array([self.score[p] for p in pieces])[order]
        self.sizes = sorted(set(size.tolist()))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def one(self, token: bytes) -> int:
        """Pieces of the best segmentation of one pre-token; of equal scores, the one whose last piece is shortest."""
        best, count = [0.0], [0]
        for j in range(1, len(token) + 1):
            top, n = -np.inf, 0
            for size in self.sizes:
                if size > j:
                    break
                s = self.score.get(token[j - size : j])
                if s is not None and best[j - size] + s > top:
                    top, n = best[j - size] + s, count[j - size] + 1
            best.append(top)
            count.append(n)
        return count[-1]

    def counts(self, flat: np.ndarray, sums: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Pieces of the best segmentation of each distinct pre-token, given as ranges of bytes.

        The pre-tokens are inserted in a trie, level by level: those with a common prefix share its node, and the forward score of a node is computed once. A pre-token's count is read at its last node.
        """
        out = np.zeros(len(starts), np.int64)
        words = np.flatnonzero(sizes <= LONG)
        for w in np.flatnonzero(sizes > LONG).tolist():
            out[w] = self.one(flat[starts[w] : starts[w] + sizes[w]].tobytes())
        node = np.zeros(len(starts), np.int64)  # of each word at the level reached
        levels = [node.copy()]
        best, count = [np.zeros(1)], [np.zeros(1, np.int64)]
        depth = 0
        while len(words):
            depth += 1
            key = node[words] * 256 + flat[starts[words] + depth - 1]
            _, first, own = np.unique(key, return_index=True, return_inverse=True)
            node[words] = own
            spoke = words[first]  # a word for each node
            at = starts[spoke]
            top, n = np.full(len(spoke), -np.inf), np.zeros(len(spoke), np.int64)
            for size in self.sizes:
                if size > depth:
                    break
                h = range_hashes_at(sums, at + depth - size, at + depth)
                live = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                k = np.minimum(np.searchsorted(self.keys, h[live]), len(self.keys) - 1)
                hit = self.keys[k] == h[live]
                live, k = live[hit], k[hit]
                before = levels[depth - size][spoke[live]]
                s = best[depth - size][before] + self.scores[k]
                better = s > top[live]
                live = live[better]
                top[live], n[live] = s[better], count[depth - size][before[better]] + 1
            best.append(top)
            count.append(n)
            levels.append(node.copy())
            ends = words[sizes[words] == depth]
            out[ends] = n[node[ends]]
            words = words[sizes[words] > depth]
        return out

    def text_counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and pieces of each text."""
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        if not bounds[-1]:
            return np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = split_points(cp, bounds)
        ends = np.append(starts[1:], len(cp))
        _, first, back = np.unique(range_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        # The distinct pre-tokens as UTF-8, one after the other.
        a, b = starts[first], ends[first]
        chars = cp[sliced(a, b - a)]
        width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(b - a)])
        total = np.concatenate([[0], np.cumsum(width)])
        flat = np.frombuffer(chars.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        pieces = self.counts(flat, prefix_sums(flat), total[at[:-1]], total[at[1:]] - total[at[:-1]])[back]
        cut = np.searchsorted(starts, bounds)
        sums = np.concatenate([[0], np.cumsum(pieces)])
        return np.diff(cut), sums[cut[1:]] - sums[cut[:-1]]


@lru_cache(maxsize=2)
def unigram(ranks: str) -> Unigram:
    """One model for each worker process and file."""
    return Unigram(ranks)


def token_counts(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_pretokens, n_tokens) for every row: pieces of the most probable segmentation of each pre-token of the whole text.

    A map over batches of texts without any exchange: each batch's distinct pre-tokens share a trie. Null and empty texts have none; rows that share an id keep a row each; an empty table gives no rows.
    """
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])
        model = unigram(ranks)
        for b in batches:
            texts, i = b.column(1).to_pylist(), 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                    size += len(texts[j])
                    j += 1
                pretokens, tokens = model.text_counts(texts[i:j])
                yield arrow_rows(schema, doc_id=b.column(0).slice(i, j - i), n_bytes=b.column(2).slice(i, j - i), n_pretokens=pretokens, n_tokens=tokens)
                i = j

    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n")).mapInArrow(run, "doc_id long, n_bytes long, n_pretokens long, n_tokens long")
