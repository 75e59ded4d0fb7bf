"""The corpus operators against brute-force versions, on small tables with nulls, empty and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import induced_sort
from graphloom.llm import queries as corpus
from graphloom.llm.components import components
from graphloom.llm.decontaminate import _template, _tokens, _windows, contaminated
from graphloom.llm.embed_dedup import Graph, audit_pairs, similar_vectors
from graphloom.llm.induced_sort import suffixes_descending
from graphloom.llm.line_dedup import drop_recurring_lines
from graphloom.llm.lm_score import score_texts
from graphloom.llm.packing import Mixture, pack
from graphloom.llm.sharding import shard_by_bytes
from graphloom.llm.simhash import _across, _links, fingerprint, meeting_keys, near_duplicates, shingle_set, sketch
from graphloom.llm.suffix_dedup import remove_repeats
from graphloom.llm.token_counts import Unigram, token_counts
from graphloom.llm.toxicity import _best_size, score_toxicity, train_toxicity

SF = "/root/testdata/sf0.001"
WORDS = ["alpha", "beta", "Gamma", "delta", "été", "straße", "x", "42", "kappa", "the", "of"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, long and repeated texts, repeated rows, extra columns with the operators' own names."""
    rng = np.random.default_rng(5)
    a, b = sentence(rng, 60), sentence(rng, 300)
    texts = [a, b, None, "", a, b[:900] + " tail " + b[900:], "the " * 400, " \n\t", "日本 🙂 " * 30, sentence(rng, 3000), a, "it's a 'tis"]
    rows = [(i, t, None if i == 3 else "src", i, "lang", "x") for i, t in enumerate(texts)]
    rows += [rows[1], (None, a, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, score string, component string")


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (7, 7), (5, 4), (4, 5)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert components(edges.limit(0)).count() == 0


def test_fingerprint_is_the_majority_of_shingle_hashes():
    text = "The quick  brown\tfox the quick brown fox É É"
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert int.from_bytes(fingerprint(text.encode(), 3, 64), "big") == want
    assert fingerprint(b" \n", 3, 64) == bytes(8)
    assert int.from_bytes(fingerprint(b"One two", 3, 64), "big") == xxhash.xxh64_intdigest(b"one two", 42)


@pytest.mark.parametrize(("n", "shared", "width"), [(8, 5, 3), (16, 3, 2)])
def test_any_shared_bytes_meet(n, shared, width):
    from itertools import combinations

    keys = [set(k) for k in meeting_keys(n, shared, width)]
    assert all(any(k <= set(c) for k in keys) for c in combinations(range(n), shared))


@pytest.mark.parametrize("source", ["odd", "table"])
def test_simhash_components(spark, odd, source):
    docs = odd if source == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    got = near_duplicates(docs, shingle=3).toPandas()
    fp = {r.doc_id: int.from_bytes(fingerprint((r.text or "").encode(), 3, 64), "big") for r in docs.collect() if r.doc_id is not None}
    comp = {i: i for i in fp}
    for _ in fp:
        new = {i: min([comp[i], *(comp[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3)]) for i in fp}
        if new == comp:
            break
        comp = new
    got = got[got.id.notna()]
    assert {int(i): c for i, c in zip(got.id, got.component, strict=True)} == comp
    assert near_duplicates(docs.limit(0), shingle=3).count() == 0


def test_similar_texts_share_a_component_and_others_do_not(spark, odd):
    """Groups of edited texts, from 2 to 120, beside texts that are alike but not similar enough, nulls, empty texts and repeated rows."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    texts: list = [None, "", "one two", "one two"]
    for n, edits in [(2, 1), (3, 2), (120, 1), (40, 6), (5, 40)]:
        base = rng.choice(words, 300)
        for _ in range(n):
            t = base.copy()
            t[rng.choice(300, edits, replace=False)] = rng.choice(words, edits)
            texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(len(texts) - 1, texts[-1]), (None, texts[5])], "doc_id long, text string")
    got = {r["id"]: r["component"] for r in near_duplicates(docs, shingle=5, bits=128, radius=32, shared=3, width=2, similarity=0.8).collect()}
    sets = [set(shingle_set((t or "").encode(), 5).tolist()) for t in texts]
    jaccard = lambda i, j: len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j]))
    linked = [(i, j) for i in range(2, len(texts)) for j in range(i) if jaccard(i, j) >= 0.8]
    assert sum(got[i] == got[j] for i, j in linked) >= 0.98 * len(linked)
    for i in range(2, len(texts)):
        if got[i] != i:
            assert any(got[j] == got[i] and jaccard(i, j) >= 0.8 for j in range(len(texts)) if j != i)
    assert got[0] == got[1] == 0 and got[2] == got[3] == 2


def test_posting_lists_give_no_squares_of_pairs():
    """A list of any length gives a forest of least distances, and a family that is alike but not similar enough no candidates."""
    rng = np.random.default_rng(8)
    for n in (3, 32, 90):
        fp = np.zeros((n, 24), np.uint8)
        fp[:, 23] = rng.permutation(256)[:n]
        rep = np.arange(n)
        batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array([x.tobytes() for x in fp]), pa.array(rep)], ["posting", "fp", "rep"])
        edges = [r for b in _links(2, 48, True)(iter([batch])) for r in b.to_pylist()]
        pairs = [(r["a"], r["b"]) for r in edges if r["long"] is None]
        assert len(pairs) == n - 1 and [r["long"] for r in edges if r["long"] is not None] == [0]
        root = list(range(n))
        total = 0
        for d, i, j in sorted(((int(fp[i, 23]) ^ int(fp[j, 23])).bit_count(), i, j) for i in range(n) for j in range(i)):
            if root[i] != root[j]:
                total, root = total + d, [root[i] if r == root[j] else r for r in root]
        assert sum((int(fp[i, 23]) ^ int(fp[j, 23])).bit_count() for i, j in pairs) == total
        base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[40:], rng.integers(0, 1 << 62, 40).astype(np.uint64)])) for _ in range(n)]
        sets[1] = np.unique(np.append(sets[0][5:], base[:5]))
        columns = [pa.array(rep), pa.array([len(x) for x in sets]), pa.array([sketch(x) for x in sets])]
        asked = pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "comp", "n", "sketch"])
        assert [(r["a"], r["b"]) for b in _across(2, 48, 0.8, 64)(iter([asked])) for r in b.to_pylist()] == [(0, 1)]


def test_every_candidate_of_a_long_list_is_verified(spark):
    """A family of one base, most pairs of which are near by their bits but not similar enough, and pairs that are, at no less distance: what is linked is what brute force over the candidates links."""
    rng = np.random.default_rng(3)
    base, texts = np.array([f"w{i}" for i in range(300)], object), []
    for k in range(540):
        at, t = 6 * rng.choice(50, 8, replace=False), base.copy()
        t[at[:5]] = [f"x{k}y{i}" for i in range(5)]
        texts.append(" ".join(t))
        if k < 60:  # two of the five edits alike, three others
            t[at[2:5]] = base[at[2:5]]
            t[at[5:]] = [f"z{k}y{i}" for i in range(3)]
            texts.append(" ".join(t))
    got = {r["id"]: r["component"] for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=5, bits=128, radius=32, shared=3, width=2, similarity=0.8).collect()}
    sets = [set(shingle_set(t.encode(), 5).tolist()) for t in texts]
    fp = [fingerprint(t.encode(), 5, 128) for t in texts]
    links = []
    for i in range(len(texts)):
        for j in range(i):
            same = [x == y for x, y in zip(fp[i], fp[j], strict=True)]
            near = sum((x ^ y).bit_count() for x, y in zip(fp[i], fp[j], strict=True)) <= 32
            if near and max(sum(same[:8]), sum(same[8:])) >= 2 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links.append((i, j))
    want = list(range(len(texts)))
    for _ in range(20):
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
    assert got == dict(enumerate(want)) and len(set(want)) > 300


def test_induced_sort_equals_sorting():
    rng = np.random.default_rng(1)
    for _ in range(60):
        text = np.append(rng.integers(0, 4, rng.integers(1, 60)), 0).astype(np.uint16)
        ends = np.flatnonzero(text == 0)
        keys = {i: (*text[i : ends[np.searchsorted(ends, i)]].tolist(), 0, i) for i in np.flatnonzero(text).tolist()}
        pos, pre = [], []
        suffixes_descending(text, lambda p, v, pos=pos, pre=pre: (pos.extend(p.tolist()), pre.extend(v.tolist())), 50)
        assert pos[::-1] == sorted(keys, key=lambda i: (*keys[i][:-1], ends[np.searchsorted(ends, i)]))
        for k in range(1, len(pos)):
            a, b = keys[pos[k - 1]][:-2], keys[pos[k]][:-2]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert pre[k] == n


@pytest.mark.parametrize("memory", [100, 1 << 21])
def test_a_run_of_equal_names_is_induced_at_once(monkeypatch, memory):
    """Repeated words give runs of equal names: a slot's queue is not asked once for each name of each run. With little memory its tuples go by the files."""
    rng = np.random.default_rng(4)
    text = np.concatenate([np.append(np.tile(rng.integers(1, 200, 6), 15), 0) for _ in range(200)]).astype(np.uint16)
    ends = np.flatnonzero(text == 0)
    end = {i: ends[np.searchsorted(ends, i)] for i in np.flatnonzero(text).tolist()}
    pushes, pos = [], []
    push = induced_sort.TupleQueue.push
    monkeypatch.setattr(induced_sort, "MEMORY", memory)
    monkeypatch.setattr(induced_sort.TupleQueue, "push", lambda self, rows: (pushes.append(len(rows)), push(self, rows)))
    suffixes_descending(text, lambda p, v: pos.extend(p.tolist()), 100)
    assert pos[::-1] == sorted(end, key=lambda i: (*text[i : end[i]].tolist(), 0, end[i]))
    assert len(pushes) < 1000


def brute_repeats(docs, tie):
    """Rows of one id and text are one document; tie: of different texts under one id, or none, which comes first."""
    rows = [(r.doc_id if r.doc_id is not None else 1 << 62, (r.text or "").encode(), r.doc_id) for r in docs]
    ids = Counter(i for i, *_ in rows)
    key = lambda i, b: (i, tie[b] if ids[i] > 1 or i == 1 << 62 else 0)
    rows = sorted([(key(i, b), b, own) for i, b, own in rows], key=lambda x: x[0])
    seen, out = {}, []
    for i, b, _ in rows:
        for k in range(len(b) - 99):
            seen.setdefault(b[k : k + 100], (i, k))
    for i, b, own in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if seen[b[k : k + 100]] < (i, k):
                gone[k : k + 100] = b"\1" * 100
        kept = bytes(x for x, z in zip(b, gone, strict=True) if not z)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((own, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("source", ["odd", "table", "shared ids"])
def test_repeats(spark, odd, source):
    docs = odd if source != "table" else spark.read.parquet(f"{SF}/documents.parquet")
    if source == "shared ids":  # different texts under one id and under none, some wholly their own
        rng = np.random.default_rng(8)
        common = sentence(rng, 70)
        own = [" ".join(f"{w}{k}{i}" for i, w in enumerate(rng.choice(WORDS, 80))) for k in range(8)]
        rows = [(None, own[0]), (None, own[1] + common), (None, common + own[2]), (7, own[3]), (7, own[4] + common), (7, own[3]), (7, ""), (None, None), (9, common), (None, own[0]), (3, own[5] + own[0]), (7, own[6]), (None, own[6] + own[7])]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {(r.text or "").encode(): r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("h")).collect()}
    got = sorted(map(tuple, remove_repeats(docs, with_kept=False).collect()), key=repr)
    assert got == brute_repeats(docs.collect(), tie)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_repeats_of_a_very_common_passage(spark):
    """A passage in every text, with different words around it: its runs are common, so they are anchors of last resort; results are those of brute force."""
    rng = np.random.default_rng(4)
    passage = sentence(rng, 60)
    rows = [(i, " ".join(f"{w}{rng.integers(1000)}" for w in rng.choice(WORDS, 30)) + passage + " ".join(f"{w}{rng.integers(1000)}" for w in rng.choice(WORDS, 30))) for i in range(150)]
    docs = spark.createDataFrame([*rows, (400, rows[3][1] + rows[5][1])], "doc_id long, text string")
    got = sorted(map(tuple, remove_repeats(docs, with_kept=False).collect()), key=repr)
    assert got == brute_repeats(docs.collect(), {}) and sum(r[2] > len(passage) - 4 for r in got) == 150


def test_shards(spark, odd):
    for docs in (odd, spark.read.parquet(f"{SF}/documents.parquet"), odd.limit(0)):
        got = shard_by_bytes(docs, shards=5).toPandas()
        assert len(got) == docs.count()
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert Counter((None if pd.isna(i) else int(i), n, c) for i, n, c in zip(got.doc_id, got["size"], got.text_crc32, strict=True)) == want
    sizes = shard_by_bytes(spark.read.parquet(f"{SF}/documents.parquet"), shards=4).groupBy("shard").agg(F.sum("size").alias("b")).toPandas().b
    assert sizes.max() < 1.3 * sizes.min()


def by_due_times(totals, weights, length):
    """Window and place of every id, by sorting all due times."""
    due = sorted((((k + 0.5) / w, q, k) for q, (t, w) in enumerate(zip(totals, weights, strict=True)) for k in range(t)), key=lambda x: x[:2])
    place = {}
    for i in range(0, len(due), length):
        window = sorted((q, k) for _, q, k in due[i : i + length])
        place |= {x: (i // length, j) for j, x in enumerate(window)}
    return place


@pytest.mark.parametrize("weights", [None, [1.0, 1.0, 1.0, 1.0, 3.0]])
def test_mixture_equals_sorting_due_times(weights):
    totals = np.array([7, 900, 1, 311, 2500])
    mix = Mixture(totals, np.array(weights or totals / totals.sum(), float), 64)
    want = by_due_times(totals.tolist(), mix.weights.tolist(), 64)
    got = {}
    rng = np.random.default_rng(1)
    for q, t in enumerate(totals.tolist()):
        cuts = np.unique([0, *rng.integers(0, t, 9), t])
        for row, lo, size, window, offset in mix.pieces(q, cuts[:-1], np.diff(cuts)):
            for r, a, m, w, o in zip(row, lo, size, window, offset, strict=True):
                got |= {(q, int(cuts[r] + a + i)): (int(w), int(o + i)) for i in range(m)}
    assert len(got) == len(want) and sum(got[x] != want[x] for x in want) == 0
    given = mix.allotted(np.arange(20))
    exact = given.sum(1)[:, None] * mix.weights / mix.weights.sum()
    assert weights or np.abs(given - exact).max() < 2


def test_a_rare_source_takes_little_memory():
    import tracemalloc

    peaks = []
    for total in (10**8, 10**10, 10**12):
        mix = Mixture(np.array([total, 5000, total // 3]), np.array([total, 5000, total // 3], float), 1024)
        tracemalloc.start()
        found = list(mix.pieces(1, np.array([1000]), np.array([3000])))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert sum(int(x[2].sum()) for x in found) == 3000
    assert max(peaks) < 1.5 * min(peaks) < 100e6


def test_each_source_is_a_queue_and_weights_hold(spark):
    rows = [(i, "one two three four five six seven " * 20, f"s{i % 300}") for i in range(600)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), length=1024).toPandas()
    full = got[got.sequence_id < got.sequence_id.max()]
    per = full.assign(source=full.doc_id % 300).groupby("sequence_id").source.nunique()
    assert (per == 300).all()
    rows = [(i, "one two three four five six seven " * 20, "ab"[i % 2] if i < 40 else None) for i in range(60)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), length=512, weights={"a": 3.0, "b": 1.0, None: 1.0}).toPandas()
    first = got[got.sequence_id < 5]
    assert abs(first[(first.doc_id < 40) & (first.doc_id % 2 == 0)].length.sum() - 0.6 * 5 * 512) < 3
    assert abs(first[(first.doc_id < 40) & (first.doc_id % 2 == 1)].length.sum() - 0.2 * 5 * 512) < 3


def test_packing_round_trip(spark, odd):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    got = pack(odd, length=64).toPandas()
    place = {}
    for r in got.itertuples():
        ids = np.frombuffer(r.ids, "<u4")
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(ids) == r.length
        for k, x in enumerate(ids):
            assert place.setdefault((r.sequence_id, r.offset + k), x) == x
    assert len(place) == got.length.sum() and {(s, o) for s, o in place} == {divmod(k, 64) for k in range(len(place))}
    want = Counter()
    for d in odd.collect():
        want.update([(d.doc_id, tuple([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0]))])
    parts = got.sort_values("start").groupby(["doc_id", "doc_tokens"], dropna=False)
    found = Counter()
    for (doc, n), g in parts:
        whole = np.zeros(n, np.uint32)
        for r in g.itertuples():
            whole[r.start : r.start + r.length] = np.frombuffer(r.ids, "<u4")
        found[(None if pd.isna(doc) else int(doc), tuple(whole.tolist()))] += int(g.length.sum() // n)
    assert found == want
    assert pack(odd.limit(0)).count() == 0


def test_token_counts(spark, odd):
    model = Unigram(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    import regex

    pattern = regex.compile(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    want = []
    for r in odd.collect():
        found = pattern.findall(r.text or "")
        want.append((r.doc_id, len((r.text or "").encode()), len(found), sum(model.one(t.encode()) for t in found)))
    assert sorted(map(tuple, token_counts(odd).collect()), key=repr) == sorted(want, key=repr)
    assert model.one(b"a") == 1 and token_counts(odd.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + rng.normal(size=16) * (0.05 if i % 3 else 0)).tolist(), i % 2) for i in range(120)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, rows[0][1], None), (203, [float("nan")] * 16, 0), (204, [None] * 16, 0), (205, rows[0][1], 0), (206, [1.0], 0), (207, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in similar_vectors(df).collect()}
    x = {r.vec_id: np.array(r.embedding, float) for r in df.collect() if r.embedding and len(r.embedding) == 16 and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding) and r.label is not None}
    label = {r.vec_id: r.label for r in df.collect()}
    near = {i: [j for j in x if j != i and label[i] == label[j] and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.98] for i in x}
    comp = {i: i for i in label}
    for _ in comp:
        comp = {i: min([comp[i], *(comp[j] for j in near.get(i, []))]) for i in comp}
    assert got == {i: (len(near.get(i, [])), comp[i], comp[i] == i) for i in label}
    assert similar_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("links", ["many", "few", "none"])
def test_embeddings_over_many_shards(spark, links):
    """Planted links between vectors of a label that fills many shards, against brute force over all pairs."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1400, 24))
    planted = {"many": 500, "few": 5, "none": 0}[links]
    for k in range(planted):
        x[1399 - k] = x[k % 200] + rng.normal(size=24) * 0.12
    label = np.where(np.arange(1400) % 7 == 0, 1, 0)
    rows = [(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, label, strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in similar_vectors(df, shard=64).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label) & ~np.eye(1400, dtype=bool)
    n = near.sum(1)
    recall = sum(got[i][0] for i in range(1400)) / max(1, n.sum())
    print(f"links {int(n.sum()) // 2}, recall {recall:.4f}")
    assert (n.sum() > 0) == (links != "none") and (recall >= 0.999 or not n.sum())
    comp = np.arange(1400)
    for _ in range(50):
        comp = np.minimum(comp, np.where(near, comp[None, :], 1400).min(1))
    assert all(got[i] == (n[i], comp[i]) for i in range(1400))


def test_the_audit_is_never_empty():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for same in (True, False):
        probe, pairs = audit_pairs(x[:200] if not same else x, x[100:] if not same else x, same, 0.999999999, 64, 32)
        assert len(pairs) >= 32 and all(i in probe for i, _ in pairs) and not (same and any(i == j for i, j in pairs))
    assert Graph.unpacked(Graph(x).packed(), x).within(x.astype(np.float32), 0.9999, 32)[0].tolist() == list(range(300))


def test_decontamination(spark):
    item = "A train leaves Oslo at 9 and the tired driver Hanna covers 120 km before the second stop in a quiet town near the border"
    other = item.replace("Hanna", "Pedro").replace("120 km", "85 miles").replace("at 9", "at 11")
    docs = [(1, f"Some words here. {item}. And more words follow it."), (2, f"intro text {other} closing"), (3, item.upper()), (4, "nothing of the kind is in this text at all, a quiet town near the border"), (5, None), (6, ""), (7, "zwischen " * 9 + item), (None, item)]
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (None, item)], "item_id long, text string")
    found = {r.doc_id: r.reparameterised for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert found == {1: False, 2: True, 3: False, 7: False}
    twice = "from 5 km to 5 km the road climbs and from there the old path runs along the river to the mill"
    bad = twice.replace("5 km to 5 km", "5 km to 7 km")
    got = contaminated(spark.createDataFrame([(1, twice), (2, bad), (3, twice.replace("5", "8"))], "doc_id long, text string"), spark.createDataFrame([(1, twice)], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {1, 3}
    assert contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items.limit(0)).count() == 0


def test_windows_of_tokens(spark):
    """Tokens and windows against plain Python, the last ones of each width and texts that are too short included."""
    texts = ["He ran 3.5 km, saw x.5 and .5 of 1,000.25 5 kg. ..5..6 1.2.3,4", "Met Bob Dole of Rome 5. 6", "one", "", "..."]
    want_tokens = [["he", "ran", "3.5", "km", "saw", "x", "5", "and", "5", "of", "1,000.25", "5", "kg", "5", "6", "1.2.3,4"], ["met", "~bob~dole", "of", "~rome", "5", "6"], ["one"], [], []]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: (r.t, r.m, r.h) for r in df.select("id", _tokens(F.col("text")).alias("t")).select("id", "t", _template(F.col("t")).alias("m"), _template(F.col("t"), F.xxhash64).alias("h")).collect()}
    assert [got[i][0] for i in range(len(texts))] == want_tokens
    assert got[0][1] == ["he", "ran", "#", "%", "saw", "x", "#", "and", "#", "of", "#", "#", "%", "#", "#", "#"] and got[1][1] == ["met", "~", "of", "~", "#", "#"]
    rows = Counter((r.id, r.place, r.width) for r in _windows(df, _tokens(F.col("text")), [2, 4]).collect())
    assert rows == Counter((i, p + 1, w) for i, t in enumerate(want_tokens) for w in (2, 4) for p in range(len(t) - w + 1))
    hashes = {(r.place, r.width): r.h for r in _windows(df.where("id = 0"), _tokens(F.col("text")), [2, 4]).collect()}
    h = got[0][2]
    plain = spark.createDataFrame([tuple(h[k : k + 4]) for k in range(len(h) - 3)], "a long, b long, c long, d long").select(F.xxhash64("a", "b").alias("two"), F.xxhash64("a", "b", "c", "d").alias("four")).collect()
    assert all(hashes[k + 1, 2] == r.two and hashes[k + 1, 4] == r.four for k, r in enumerate(plain))


def test_decontamination_wherever_the_edits_fall(spark):
    """An item of the shortest length with three words changed is found in any place and with any words changed; a shorter item beside it changes nothing."""
    words = "seven lazy foxes cross this frozen river while nobody watches from any dark window tonight".split()
    assert len(words) == 15
    spots = [(a, b, c) for a in range(15) for b in range(a) for c in range(b)]
    docs = [(k, " ".join([*["pad"] * (k % 5), *["changed" if i in at else w for i, w in enumerate(words)], "end"])) for k, at in enumerate(spots)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, "none of these words occur")], "item_id long, text string")
    assert {r.doc_id for r in contaminated(docs, items.where("item_id = 1")).collect()} == set(range(len(spots)))
    assert {r.doc_id for r in contaminated(docs, items).where("item_id = 1").collect()} == set(range(len(spots)))


def test_decontamination_numbers_and_names_are_one_slot(spark):
    item = "the old boat carries 2.5 tons of salt when captain Hanna Berg sails it to the port"
    docs = [(1, item.replace("2.5", "1,200").replace("Hanna Berg", "Pedro")), (2, item.replace("2.5", "7").replace("Hanna Berg", "Pedro Ruiz Soto")), (3, item.upper())]
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id: (r.item_tokens - r.matched, r.reparameterised) for r in found} == {1: (0, True), 2: (0, True), 3: (0, False)}


@pytest.mark.parametrize("n", [2, 3, 5, 9])
def test_passages_recur_from_two_texts_on(spark, n):
    rng = np.random.default_rng(n)
    passage, short = " ".join(f"p{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55)), "a short line that is in all of them"
    rows = [(i, "\n".join([sentence(rng, 60), passage, short, sentence(rng, 15)])) for i in range(n)]
    got = {r.doc_id: r for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1]
    for i in range(1, n):
        assert got[i].text == rows[i][1].replace(passage + "\n", "") and got[i].n_dropped == 1


def test_lines(spark):
    notice = "This notice number {} was issued by office {} for the reader of page {} and all the others who may come by later"
    rng = np.random.default_rng(2)
    rows = [(i, "\n".join([sentence(rng, 20), notice.format(i, chr(97 + i), i * 7), "", sentence(rng, 15)]), "x") for i in range(14)]
    rows += [(50, rows[0][1], "copy"), (51, None, None), (52, "", "e"), (None, notice.format(1, "q", 2), "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = {r.doc_id: r for r in drop_recurring_lines(df).collect()}
    assert got[0].text == rows[0][1] == got[50].text and got[0].n_dropped == 0
    for i in range(1, 14):
        assert got[i].text == "\n".join(x for k, x in enumerate(rows[i][1].split("\n")) if k != 1) and (got[i].n_lines, got[i].n_dropped) == (4, 1)
    assert got[51].text is None and got[52].text == "" and got[None].text == ""
    assert drop_recurring_lines(df.limit(0)).count() == 0


def test_variable_fields_anywhere_are_generalised(spark):
    """Words vary at places that are different from line to line, in all thirds of the line; prose with the same leading words stays."""
    rng = np.random.default_rng(12)
    base = "please note that the {} service of {} will be closed for {} repair on every day of the {} month".split()
    rows = []
    for i in range(24):
        word = iter([f"n{chr(97 + i)}", f"o{chr(97 + i)}x", f"q{chr(97 + i)}y", f"z{chr(97 + i)}"])
        notice = " ".join(next(word) if w == "{}" else w for w in base)
        prose = "please note that " + " ".join(rng.choice([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)], 16))
        rows.append((i, "\n".join([sentence(rng, 20), notice, prose])))
    got = {r.doc_id: r for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1]
    for i in range(1, 24):
        assert got[i].text == "\n".join(x for k, x in enumerate(rows[i][1].split("\n")) if k != 1), i


def test_language_model(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10000).alias("doc_id"), "text"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    got = score_texts(docs.select("doc_id", "text", (fold != 0).alias("learn"), (fold == 0).alias("held_out"))).toPandas()
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), None]
    rows = docs.collect()
    count = Counter(w for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 for w in tokens(r.text))
    n, v = sum(count.values()), len(count)
    want = sorted((len(t), sum(count[w] > 0 for w in t), round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for t in (tokens(r.text) for r in rows))
    assert sorted(zip(got.n_tokens, got.n_known, got.base_score.round(6), strict=True)) == want
    assert (got.train_tokens == n).all() and (got.score < 0).all()
    assert got.score.sum() > got.base_score.sum()


def test_feature_count_is_chosen_on_the_tried_rows():
    rng = np.random.default_rng(5)
    y = (np.arange(400) % 2).astype(float)
    tried = np.arange(400) % 4 < 2
    told = [[int(k)] if rng.random() < 0.9 else [] for k in y]  # features 0 and 1 tell the class, the other 198 are noise
    own = [t + sorted(rng.choice(np.arange(2, 200), 40, replace=False).tolist()) for t in told]
    row, feature = np.repeat(np.arange(400), [len(x) for x in own]), np.concatenate(own).astype(np.int64)
    ratio = np.concatenate([[-3.0, 3.0], rng.normal(0, 2, 198)])
    assert _best_size(row, feature, ratio, y, tried, (2, 200), 1e-3, 200) == 2
    assert _best_size(row, feature, ratio, y, np.zeros(400, bool), (2, 200), 1e-3, 200) == 200


def test_toxicity(spark):
    rng = np.random.default_rng(9)
    rows = [(i, sentence(rng, 40) + (" you utter moron " + sentence(rng, 9) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = train_toxicity(df.where("doc_id < 300").drop("toxic"), df.where("doc_id < 300").drop("text"))
    held = df.where("doc_id >= 300").unionByName(spark.createDataFrame([(900, None, 0), (901, "", 0), (None, "You MORON " * 500, 1)], df.schema))
    got = score_toxicity(held, model).collect()
    assert all((r.score >= 0.3) == bool(r.toxic) for r in got)
    one = train_toxicity(df, df.where("toxic = 0").drop("text"))
    assert score_toxicity(df.limit(3), one).where("score < 0.1").count() == 3
    assert score_toxicity(df.limit(0), model).count() == 0


def test_every_registered_query_has_its_columns(spark):
    want = {
        "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op2_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op5_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
        "op6_simhash": ["doc_id", "fingerprint", "component_id"],
        "op7_histogram_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op9_mixture_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op10_lm_scores": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    }
    for name, columns in want.items():
        assert corpus.queries()[name](spark, SF).columns[: len(columns)] == columns, name
