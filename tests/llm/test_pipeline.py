"""The pipeline's stages, each against a brute-force version, on tables with nulls, empty and repeated rows, shared ids, and columns with the operators' own names."""

import os
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm.queries import toxicity_model
from graphloom.llm.simhash import shingle_set
from graphloom.llm.toxicity import _present

STAGES = dict(corpus_pipeline.STAGES)
WORDS = [f"{a}{b}" for a in ["ka", "lo", "mi", "ne", "pu", "ra", "si", "to"] for b in ["den", "fer", "gal", "hin", "jor", "kel", "lum", "mas", "nod", "pil"]]
ITEMS = ["a slow train from Oslo brings 120 km of cable to the tired crew at the northern station before the first snow", "which of these seven birds sings only at night and builds a nest under old bridges near water", "short one"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines string, n_dropped int, component long, id long, fp string, key string, h int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


def table():
    rng = np.random.default_rng(21)
    texts = []
    for i in range(240):
        t = prose(rng, 40)
        texts.append(t + (" you filthy useless moron " + prose(rng, 8) if i % 5 == 0 else ""))
    texts += ["\n".join([prose(rng, 20), "read the terms of service before you go on", prose(rng, 15)]) for _ in range(14)]
    passage = prose(rng, 60)
    texts += [prose(rng, 30) + "\n" + passage for _ in range(3)]
    for edits in (1, 1, 2, 30):
        base = np.array(prose(rng, 120).split())
        texts.append(" ".join(base))
        base[rng.choice(120, edits, replace=False)] = [f"edit{k}" for k in range(edits)]
        texts.append(" ".join(base))
    texts += [texts[3], texts[3], None, "", " \n\t ", prose(rng, 6000), texts[7]]
    for item in ITEMS:
        texts += [f"{prose(rng, 20)} {item} {prose(rng, 20)}", item.replace("120 km", "85 miles").replace("Oslo", "Bergen")]
    rows = [(i, t, "en", f"s{i % 3}" if i % 17 else None, len(t or ""), "own", "n", 7, 5, 6, "f", "k", 1) for i, t in enumerate(texts)]
    rows += [rows[2], (None, texts[1], *rows[1][2:]), (None, prose(rng, 50), *rows[1][2:]), (4, prose(rng, 45), *rows[1][2:]), (None, f"{prose(rng, 9)} {ITEMS[1]}", *rows[1][2:])]
    return rows


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = table()
    put = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(os.path.join(folder, f"{name}.parquet"))
    put("documents", rows, COLUMNS)
    put("labels", [(i, 1, int(i % 5 == 0)) for i in range(200)] + [(None, 0, 1), (1000, 1, 1)], "doc_id long, quality int, toxic int")
    put("benchmark", [*enumerate(ITEMS), (9, None), (None, ITEMS[0]), (10, "")], "item_id long, text string")
    return folder


def run(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = STAGES[stage](spark, docs, sf)
    empty = STAGES[stage](spark, docs.limit(0), sf)
    assert empty.count() == 0
    if stage != "packing":
        assert out.dtypes == docs.dtypes == empty.dtypes
    return [tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]


def test_toxicity(spark, sf):
    rows, got = run(spark, sf, "toxicity")
    model = toxicity_model(spark, sf)

    def score(text):
        z = model.bias + sum(float(model.weight[feature].sum()) for _, _, feature in _present([text or ""], model.weight != 0))
        return 1 / (1 + np.exp(-z))

    assert Counter(got) == Counter(r for r in rows if score(r[1]) < 0.3)
    assert {r[0] for r in rows if r[1] and "moron" in r[1]}.isdisjoint({r[0] for r in got} - {None}) and len(got) > 200


def recurring_lines(rows):
    """Each text without the lines that recur: the rule of drop_recurring_lines, straight from its docstring."""
    texts = {r[1] or "": None for r in rows}
    least = {t: min((r[0] for r in rows if (r[1] or "") == t and r[0] is not None), default=1 << 62) for t in texts}
    lines = [(t, k, regex.sub("[0-9]+", "#", x).split(" ")) for t in texts for k, x in enumerate(t.split("\n")) if x.strip(" \t\r")]
    at = Counter((len(w), *w[:3], i, x) for *_, w in lines if len(w) >= 12 for i, x in enumerate(w))
    keys = defaultdict(set)
    for t, k, w in lines:
        if len(w) < 12 or len(w) >= 50:
            keys["whole", *w].add((t, k))
        if len(w) >= 12:
            form = [x if i < 3 or at[(len(w), *w[:3], i, x)] >= 10 else None for i, x in enumerate(w)]
            if sum(x is not None for x in form) >= len(w) / 2:
                keys["form", *form].add((t, k))
    gone = set()
    for key, places in keys.items():
        if len({t for t, _ in places}) >= (2 if key[0] == "whole" and len(key) > 50 else 10):
            first = min({t for t, _ in places}, key=least.get)
            gone |= {p for p in places if p[0] != first}
    return {t: "\n".join(x for k, x in enumerate(t.split("\n")) if (t, k) not in gone) for t in texts}


def test_line_dedup(spark, sf):
    rows, got = run(spark, sf, "line_dedup")
    left = recurring_lines(rows)
    want = [(r[0], None if r[1] is None else left[r[1]], *r[2:4], r[4] if r[1] is None else len(left[r[1]]), *r[5:]) for r in rows]
    assert Counter(got) == Counter(want)
    assert sum(a[1] != b[1] for a, b in zip(rows, want, strict=True)) == 13 + 2


def test_near_dedup(spark, sf):
    rows, got = run(spark, sf, "near_dedup")
    sets = [set(shingle_set((r[1] or "").encode(), 5).tolist()) for r in rows]
    comp = list(range(len(rows)))
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    linked = lambda i, j: sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if linked(i, j) and (None not in (rows[i][0], rows[j][0]) or (rows[i][1] or "") == (rows[j][1] or ""))]
    rank = {i: k for k, i in enumerate(order)}
    for _ in range(9):
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j], key=rank.get)
    stays = [r for i, r in enumerate(rows) if rows[comp[i]][0] is None or rows[comp[i]][0] == r[0]]
    assert Counter(got) == Counter(stays)
    assert 5 < len(rows) - len(got) < 20


def tokens(text):
    text = regex.sub(r"(?<=[\p{Ll},;] )(?=\p{Lu}\p{Ll})", "~", text or "")
    text = regex.sub(r" (?=~)(?<=~[\p{L}\p{M}]{1,40} )", "", text).lower()
    point = ".,'’  "
    return [t for t in regex.split(rf"[^\p{{L}}\p{{M}}\p{{N}}~{point}]+|(?<![0-9])[{point}]|[{point}](?![0-9])", text, flags=regex.V0) if t]


def template(words):
    from graphloom.llm.decontaminate import UNITS

    return ["~" if w[0] == "~" else "#" if w[0].isdigit() else "%" if i and words[i - 1][0].isdigit() and w in UNITS else w for i, w in enumerate(words)]


def holds(text, item):
    words = tokens(item)
    for it in (words, [x for w in words for x in w.split("~") if x]):
        if len(words) < 5:
            continue
        dt = tokens(text)
        im, dm = template(it), template(dt)
        for shift in range(-len(it), len(dt)):
            agree = [(a, dt[i + shift]) for i, a in enumerate(it) if 0 <= i + shift < len(dt) and im[i] == dm[i + shift]]
            if len(agree) >= min(13, -(-len(it) * 4 // 5)):
                slots = {(a, b) for a, b in agree if template([a])[0] in "#~" or a != b}
                if len({a for a, _ in slots}) == len(slots):
                    return True
    return False


def test_decontaminate(spark, sf):
    rows, got = run(spark, sf, "decontaminate")
    want = [r for r in rows if not any(holds(r[1], item) for item in ITEMS)]
    assert Counter(got) == Counter(want) and len(rows) - len(got) == 5


def test_packing(spark, sf):
    rows, got = run(spark, sf, "packing")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    size = [len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows]
    assert sorted((r[5], r[6] + k) for r in got for k in range(r[2])) == [divmod(k, 1024) for k in range(sum(size))]
    held = Counter()
    for r in got:
        held[r[0], r[4]] += r[2]
    want = Counter()
    for r, n in zip(rows, size, strict=True):
        want[r[0], n] += n
    assert held == want
    # Every full sequence has each source's share of all ids, within two.
    source, share = {r[0]: r[3] for r in rows if r[0] is not None and r[0] != 4}, Counter()
    for r, n in zip(rows, size, strict=True):
        share[r[3]] += n
    for k in range(sum(size) // 1024):
        per = Counter()
        for r in got:
            if r[5] == k:
                per[source.get(r[0], "?")] += r[2]
        assert all(per[s] <= 1024 * share[s] / sum(size) + 2 and per[s] + per["?"] >= 1024 * share[s] / sum(size) - 2 for s in share)


def test_all_stages_run_on_what_the_stage_before_kept(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    rows = table()
    assert not ids & {r[0] for r in rows if r[0] is not None and r[1] and ("moron" in r[1] or holds(r[1], ITEMS[0]))} and len(ids) > 200
