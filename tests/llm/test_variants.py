"""Spelling variants against plain counting and neighbourhoods by deletions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from wardwise.llm import variant_trie as V

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                count[run] += 1
    count = {w: n for w, n in count.items() if n >= 2}
    gaps = defaultdict(set)
    for w in count:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for w in count:
        for i in range(len(w)):
            near[w] |= gaps[w[:i], w[i + 1 :]] - {w}  # replaced
            if (short := w[:i] + w[i + 1 :]) in count:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-count[o], o))
            if count[best] >= 10 * count[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n, len(near[w]), count[form[w]] if w in form else 0) for w, n in count.items())


def found(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def corpus():
    rng = random.Random(3)
    letters = "eeeaintorÀßÿ×÷zzq"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(40)] + ["ab" * 60, "x" * 300, "éa" * 80]
    rows = []
    for doc in range(300):
        text = []
        for _ in range(30):
            w = base[min(int(rng.expovariate(0.25)), len(base) - 1)]
            for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :]])
            text.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((None if doc % 50 == 7 else doc, rng.choice([" ", "-", "1", "界", " ", "Ÿ"]).join(text)))
    return [*rows, (400, None), (401, ""), (402, " 12 界 "), *rows[:40]]


def test_equals_plain(spark, docs):
    rows = corpus()
    want = plain(rows)
    assert found(V.variants(docs(rows))) == want
    assert sum(bool(f) for _, f, *_ in want) > 50 and any(r not in (f, w) for w, f, r, *_ in want)


@pytest.mark.parametrize("shard, queries", [(20, 50), (4, 9)])
def test_small_shards_find_the_same(spark, docs, monkeypatch, shard, queries):
    rows = corpus()[:120]
    monkeypatch.setattr(V, "SHARD", shard)
    monkeypatch.setattr(V, "QUERIES", queries)
    assert found(V.variants(docs(rows))) == plain(rows)


def test_blocks_of_states_and_leaves(monkeypatch):
    words = [w for w, *_ in plain(corpus())]
    column = pa.array(words)
    groups = V.np.arange(256) % V.GROUPS
    trie = V.Trie(column, groups)
    table = pa.table({"word": column, "n": pa.array(range(len(words)))})

    def pairs():
        return sorted((int(a), int(b)) for q, r in V.near_pairs(table, trie, V.Words(column), table, groups) for a, b in zip(q, r))

    want = pairs()
    assert len(set(want)) == len(want) and len({frozenset(p) for p in want}) == len(want) > 100
    monkeypatch.setattr(V, "CHUNK", 7)
    assert pairs() == want


def test_short_words(spark, docs):
    rows = [(i, "a b ab abc a ab b abd abcd") for i in range(40)]
    got = found(V.variants(docs(rows), least=1, times=1))
    count = {w: n for w, *_, n, _, _ in got}
    for w, form, _, _, n_near, _ in got:
        near = {o for o in count if o != w and (V.one_edit(w, o) if len(w) <= len(o) else V.one_edit(o, w))}
        assert n_near == len(near) and (not form or form in near)


def test_empty(spark, docs):
    assert V.variants(docs([])).collect() == []
    assert V.variants(docs([(1, None), (2, "short one")])).collect() == []


def test_registered_query_on_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = V.op13_query(spark, sf)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert found(out) == plain(rows)
