"""Log-bilinear language model over word classes, trained by noise-contrastive estimation, and the scores of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import arrow_rows, fan_out, materialise, text_or_empty, utf8
from graphloom.llm.pretokens import range_hashes

#: The model's outputs: the most frequent words, the end, and classes of the other words by how they end.
HEAD, AFFIXES = 127, 128
CLASSES = HEAD + 1 + AFFIXES
#: Classes before the predicted one, and the width of the vectors.
CONTEXT, WIDTH = 3, 32
#: Bytes of text that are one chunk, if no single text is longer.
CHUNK = 4_000_000
#: The end token's key.
END = np.uint64(0)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of the texts in data (text i: at[i] to at[i + 1]), and words for each text."""
    word = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1
    return starts, ends, np.diff(np.searchsorted(starts, at))


def _affix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of a word by its last three bytes."""
    return (range_hashes(data, np.maximum(starts, ends - 3), ends) % np.uint64(AFFIXES)).astype(np.uint8)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to chunks: each word as a number into the chunk's distinct words, with their keys, affix classes and training counts."""
    from pyspark import TaskContext

    schema = pa.schema([("chunk", pa.int64()), ("doc", pa.binary()), ("flags", pa.binary()), ("size", pa.binary()), ("token", pa.binary()), ("key", pa.binary()), ("affix", pa.binary()), ("count", pa.binary())])
    made = TaskContext.get().partitionId() << 32
    for b in batches:
        data, at = utf8(b.column(3))
        data = _LOWER[data]
        doc, flags = np.asarray(b.column(0)), np.asarray(b.column(1)) | np.asarray(b.column(2)) << 1
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
            part, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
            starts, ends, n = _words(part, own)
            size = n + 1
            keys = np.full(int(size.sum()), END, np.uint64)
            place = np.arange(len(starts)) + np.repeat(np.arange(j - i), n)
            keys[place] = range_hashes(part, starts, ends)
            word_of = np.full(len(keys), -1, np.int64)
            word_of[place] = np.arange(len(starts))
            key, first, token = np.unique(keys, return_index=True, return_inverse=True)
            word = word_of[first]
            affix = np.zeros(len(key), np.uint8)
            affix[word >= 0] = _affix(part, starts[word[word >= 0]], ends[word[word >= 0]])
            learn = np.repeat((flags[i:j] & 1) == 1, size)
            count = np.bincount(token[learn], minlength=len(key)).astype("<i8")
            yield arrow_rows(schema, chunk=[made], doc=[doc[i:j].astype("<i8").tobytes()], flags=[flags[i:j].astype(np.uint8).tobytes()], size=[size.astype("<i8").tobytes()], token=[token.astype("<u4").tobytes()], key=[key.tobytes()], affix=[affix.tobytes()], count=[count.tobytes()])
            made += 1
            i = j


def _by_shard(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the keys by shard, the shards that have any, and where each begins."""
    to = (key % np.uint64(shards)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    to = to[order]
    at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    return order, to[at], at


def _deal(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("key", pa.binary()), ("affix", pa.binary()), ("count", pa.binary())])
        for b in batches:
            for chunk, key, affix, count in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                key, affix, count = np.frombuffer(key, "<u8"), np.frombuffer(affix, np.uint8), np.frombuffer(count, "<i8")
                order, to, at = _by_shard(key, shards)
                cut = lambda x, order=order, at=at: [y.tobytes() for y in np.split(x[order], at[1:])]
                yield arrow_rows(schema, shard=to, chunk=[chunk] * len(to), key=cut(key), affix=cut(affix), count=cut(count))

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard of the vocabulary: sums over all chunks go back to every chunk that asked (kind 0), with sums by affix class (1) and the most frequent words (2)."""
    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("shard", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("body", pa.binary())])
    got = [x for b in batches for x in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)]
    for shard in sorted({x[0] for x in got}):
        mine = [x for x in got if x[0] == shard]
        keys = np.concatenate([np.frombuffer(x[2], "<u8") for x in mine])
        key, first, back = np.unique(keys, return_index=True, return_inverse=True)
        affix = np.concatenate([np.frombuffer(x[3], np.uint8) for x in mine])[first]
        each = np.concatenate([np.frombuffer(x[4], "<i8") for x in mine])
        count = np.zeros(len(key), np.int64)
        np.add.at(count, back, each)
        at = np.concatenate([[0], np.cumsum([len(x[2]) // 8 for x in mine])])
        whole = count[back].astype("<i8")
        for k, x in enumerate(mine):
            yield arrow_rows(schema, kind=[0], chunk=[x[1]], shard=[shard], a=[0], b=[0], body=[whole[at[k] : at[k + 1]].tobytes()])
        word = (key != END) & (count > 0)
        sums, distinct = np.bincount(affix[word], count[word], AFFIXES).astype(np.int64), np.bincount(affix[word], minlength=AFFIXES)
        yield arrow_rows(schema, kind=[1] * AFFIXES, chunk=np.arange(AFFIXES), shard=[shard] * AFFIXES, a=sums, b=distinct, body=[None] * AFFIXES)
        end = count[key == END]
        if len(end) and end[0]:
            yield arrow_rows(schema, kind=[3], chunk=[0], shard=[shard], a=[int(end[0])], b=[1], body=[None])
        top = np.flatnonzero(word)
        top = top[np.lexsort((key[top], -count[top]))][:HEAD]
        yield arrow_rows(schema, kind=[2] * len(top), chunk=key[top].view(np.int64), shard=affix[top].astype(np.int32), a=count[top], b=[0] * len(top), body=[None] * len(top))


@dataclass(frozen=True)
class Vocabulary:
    """head: keys of the most frequent words, sorted; tokens, distinct: of the training texts; tail, tail_distinct: by affix class, without the head; share: of each output class among the training tokens."""

    head: np.ndarray
    tokens: int
    distinct: int
    tail: np.ndarray
    tail_distinct: np.ndarray
    share: np.ndarray


def _vocabulary(reply: DataFrame) -> Vocabulary:
    rows = reply.where("kind in (1, 3)").groupBy("kind", "chunk").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    tail, distinct = np.zeros(AFFIXES, np.int64), np.zeros(AFFIXES, np.int64)
    end = 0
    for r in rows:
        if r["kind"] == 1:
            tail[r["chunk"]], distinct[r["chunk"]] = r["a"], r["b"]
        else:
            end = r["a"]
    n, v = int(tail.sum()) + end, int(distinct.sum()) + (end > 0)
    top = sorted(reply.where("kind = 2").orderBy(F.desc("a"), "chunk").limit(HEAD).collect(), key=lambda r: r["chunk"] % (1 << 64))
    share = np.zeros(CLASSES)
    for k, r in enumerate(top):
        share[k] = r["a"]
        tail[r["shard"]] -= r["a"]
        distinct[r["shard"]] -= 1
    share[HEAD], share[HEAD + 1 :] = end, tail
    return Vocabulary(np.array([r["chunk"] % (1 << 64) for r in top], np.uint64), n, v, tail, distinct, (share + 1) / (share + 1).sum())


def _code(shards: int, vocabulary: Vocabulary):
    """Chunks and their words' counts to output classes, and what needs no model: base scores and the words' shares of their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(k, pa.binary()) for k in ("doc", "flags", "size", "known", "base", "within", "classes")])
        voc = vocabulary
        for b in batches:
            for doc, flags, size, token, key, affix, bodies in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                key, affix, token, sizes = np.frombuffer(key, "<u8"), np.frombuffer(affix, np.uint8), np.frombuffer(token, "<u4"), np.frombuffer(size, "<i8")
                order, *_ = _by_shard(key, shards)
                count = np.empty(len(key), np.int64)
                count[order] = np.frombuffer(b"".join(x["body"] for x in sorted(bodies, key=lambda x: x["shard"])), "<i8")
                base = np.log10((count + 0.1) / (voc.tokens + 0.1 * (voc.distinct + 1)))
                within = np.log10((count + 0.1) / (voc.tail[affix] + 0.1 * (voc.tail_distinct[affix] + 1)))
                out = affix.astype(np.int64) + HEAD + 1
                if len(voc.head):
                    k = np.minimum(np.searchsorted(voc.head, key), len(voc.head) - 1)
                    top = voc.head[k] == key
                    out[top], within[top] = k[top], 0
                out[key == END], within[key == END] = HEAD, 0
                at = np.cumsum(sizes) - sizes
                add = lambda x, token=token, at=at: np.add.reduceat(x[token], at)
                yield arrow_rows(schema, doc=[doc], flags=[flags], size=[size], known=[add((count > 0).astype(np.int64)).tobytes()], base=[add(base).tobytes()], within=[add(within).tobytes()], classes=[out.astype(np.uint8)[token].tobytes()])

    return run


@dataclass
class LogBilinear:
    """q = sum of the vectors of the classes before, by place; the score of class w is q . r[w] + b[w]."""

    t: np.ndarray
    r: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(share: np.ndarray, seed: int = 7) -> LogBilinear:
        rng = np.random.default_rng(seed)
        small = lambda *n: rng.normal(0, 0.1, n).astype(np.float32)
        return LogBilinear(small(CONTEXT, CLASSES + 1, WIDTH), small(CLASSES, WIDTH), np.log(share).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.t.ravel(), self.r.ravel(), self.b])

    @staticmethod
    def of(flat: np.ndarray) -> LogBilinear:
        flat = flat.astype(np.float32)
        n, m = CONTEXT * (CLASSES + 1) * WIDTH, CLASSES * WIDTH
        return LogBilinear(flat[:n].reshape(CONTEXT, CLASSES + 1, WIDTH), flat[n : n + m].reshape(CLASSES, WIDTH), flat[n + m :])

    def log10(self, contexts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of the classes after their contexts."""
        out = np.empty(len(classes))
        for k in range(0, len(classes), 4096):
            c, w = contexts[k : k + 4096], classes[k : k + 4096]
            q = sum(self.t[i][c[:, i]] for i in range(CONTEXT))
            s = q @ self.r.T + self.b
            own = s[np.arange(len(w)), w]
            np.exp(np.minimum(s, 80, out=s), out=s)
            out[k : k + 4096] = (own - np.log(s.sum(1))) / np.log(10)
        return out


def _contexts(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CONTEXT classes before each token of its text; CLASSES before the text's start."""
    place = np.arange(len(classes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.full((len(classes), CONTEXT), CLASSES, np.int64)
    for i in range(CONTEXT):
        ok = np.flatnonzero(place > i)
        out[ok, i] = classes[ok - i - 1]
    return out


def _add_rows(n: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]), np.float32)
    order = np.argsort(at.astype(np.uint16), kind="stable")
    to = at[order]
    cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    out[to[cut]] = np.add.reduceat(rows[order], cut)
    return out


def train_nce(model: LogBilinear, share: np.ndarray, contexts: np.ndarray, classes: np.ndarray, state: list, rng: np.random.Generator, noise: int = 48, batch: int = 2048, rate: float = 0.1) -> None:
    """One pass of noise-contrastive estimation: each token is told from `noise` classes drawn from the training shares, drawn once for each batch. Steps are scaled by the gradients' running squares, kept in state."""
    log_kq = np.log(noise * share).astype(np.float32)
    cumulative = np.cumsum(share)
    sigma = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for k in range(0, len(classes), batch):
        c, w = contexts[k : k + batch], classes[k : k + batch]
        z = np.minimum(np.searchsorted(cumulative, rng.random(noise)), CLASSES - 1)
        q = sum(model.t[i][c[:, i]] for i in range(CONTEXT))
        rw, rz = model.r[w], model.r[z]
        gw = sigma(np.einsum("ij,ij->i", q, rw) + model.b[w] - log_kq[w]) - 1
        gz = sigma(q @ rz.T + (model.b[z] - log_kq[z]))
        gq = gw[:, None] * rw + gz @ rz
        gr = _add_rows(CLASSES, np.concatenate([w, z]), np.concatenate([gw[:, None] * q, gz.T @ q]))
        gb = np.bincount(w, gw, CLASSES) + np.bincount(z, gz.sum(0), CLASSES)
        gt = np.stack([_add_rows(CLASSES + 1, c[:, i], gq) for i in range(CONTEXT)])
        for p, g, s in zip((model.t, model.r, model.b), (gt, gr, gb), state, strict=True):
            s += g * g
            p -= rate * g / np.sqrt(s)


def _learn(flat: np.ndarray, share: np.ndarray, seed: int):
    """One task's pass over its training texts, from the shared start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n = LogBilinear.of(flat.copy()), 0
        state = [np.full_like(p, 1.0) for p in (model.t, model.r, model.b)]
        rng = np.random.default_rng(seed)
        for b in batches:
            for flags, size, classes in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                size, classes = np.frombuffer(size, "<i8"), np.frombuffer(classes, np.uint8).astype(np.int64)
                own = np.repeat((np.frombuffer(flags, np.uint8) & 1) == 1, size)
                contexts = _contexts(classes, size)[own]
                classes = classes[own]
                order = rng.permutation(len(classes))
                train_nce(model, share, contexts[order], classes[order], state, rng)
                n += len(classes)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([model.flat().astype("<f4").tobytes()], pa.binary())], names=["n", "p"])

    return run


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, np.zeros(0)
    for b in batches:
        for m, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            p = np.frombuffer(p, "<f4").astype(float)
            total, n = (total if n else np.zeros(len(p))) + m * p, n + m
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], names=["n", "p"])


def score_texts(docs: DataFrame, learn: str = "learn", held: str = "held_out", id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; learn and held name boolean columns: rows to learn from, and a mark that is passed on.

    Counts are over all training tokens: chunks send their distinct words' counts to vocabulary shards and get the sums back, so a frequent word is one entry a chunk. A word's probability is its class's, which the model gives normalised over all classes, times the word's share of the class (0.1 added, one slot for unknown words). The model passes `rounds` times over all training tokens: each task from the same start, the results averaged by tokens in two levels.
    Null and empty texts: the end alone. Null ids stay null. With no training rows, the model is the start's shares. An empty table gives no rows.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col(learn), F.lit(False)).cast("byte").alias("l"), F.coalesce(F.col(held), F.lit(False)).cast("byte").alias("h"), text_or_empty(text_col).cast("binary").alias("t"))
    chunks = materialise(base.mapInArrow(_chunks, "chunk long, doc binary, flags binary, size binary, token binary, key binary, affix binary, count binary"))
    n = fan_out(docs)
    dealt = chunks.select("chunk", "key", "affix", "count").mapInArrow(_deal(n), "shard int, chunk long, key binary, affix binary, count binary")
    reply = materialise(dealt.repartition(n, "shard").mapInArrow(_tally, "kind int, chunk long, shard int, a long, b long, body binary"))
    voc = _vocabulary(reply)
    bodies = reply.where("kind = 0").groupBy("chunk").agg(F.collect_list(F.struct("shard", "body")).alias("bodies"))
    joined = chunks.select("chunk", "doc", "flags", "size", "token", "key", "affix").join(bodies, "chunk").select("doc", "flags", "size", "token", "key", "affix", "bodies")
    coded = materialise(joined.mapInArrow(_code(n, voc), "doc binary, flags binary, size binary, known binary, base binary, within binary, classes binary"))
    flat = LogBilinear.start(voc.share).flat()
    for k in range(rounds if voc.tokens else 0):
        learned = coded.select("flags", "size", "classes").mapInArrow(_learn(flat, voc.share, k), "n long, p binary")
        groups = max(1, int(coded.rdd.getNumPartitions() ** 0.5))
        row = learned.repartition(groups).mapInArrow(_mean, "n long, p binary").repartition(1).mapInArrow(_mean, "n long, p binary").first()
        flat = np.frombuffer(row["p"], "<f4") if row else flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        model = LogBilinear.of(flat)
        for b in batches:
            for doc, flags, size, known, own, within, classes in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                size, classes = np.frombuffer(size, "<i8"), np.frombuffer(classes, np.uint8).astype(np.int64)
                p = model.log10(_contexts(classes, size), classes)
                doc = np.frombuffer(doc, "<i8")
                yield arrow_rows(schema, doc_id=pa.array(doc, mask=doc == -(1 << 63)), held_out=(np.frombuffer(flags, np.uint8) & 2) > 0, n_tokens=size, n_known=np.frombuffer(known, "<i8"), train_tokens=[voc.tokens] * len(doc), base_score=np.frombuffer(own, "<f8"), score=np.add.reduceat(p, np.cumsum(size) - size) + np.frombuffer(within, "<f8"))

    return coded.select("doc", "flags", "size", "known", "base", "within", "classes").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
