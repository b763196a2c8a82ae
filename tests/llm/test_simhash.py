"""SimHash near duplicates against plain fingerprints and all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wardwise.llm import simhash_dedup as S

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    x = np.array(prints, np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 3) + i + 1:
            parent[root(int(j))] = root(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(x))]


def test_hashes_are_xxh64():
    rng = random.Random(5)
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(0, 140), 1000, 4095, 4096, 4097, 9000]]
    ends = np.cumsum([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    got = S.xxh64(data, ends - [len(w) for w in words], ends)
    assert [int(h) for h in got] == [xxhash.xxh64_intdigest(w, 42) for w in words]


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéK界") for _ in range(rng.randint(1, 9)))
    base = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 40, 300]))) for _ in range(60)]
    out = [None, "", " \t\n", "one", "ONE", "one two", "one\x0btwo", "x" * 5000 + " y z", *base]
    for b in base[:40]:
        w = b.split(" ")
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = word()
            out.append("  ".join(v).upper() if rng.random() < 0.3 else " ".join(v))
    return out + out[:30]


def test_equals_all_pairs(spark, docs):
    rows = [(None if i % 17 == 3 else i, t) for i, t in enumerate(texts())]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in S.near_duplicates(docs(rows)).collect())
    prints = [plain_print(t) for _, t in rows]
    comp = plain_components([i for i, _ in rows], prints)
    assert got == sorted((-1 if i is None else i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, comp))


def cloud(rng, n, spread):
    """Fingerprints around some centres, in chains and clusters."""
    out = set()
    while len(out) < n:
        c = rng.getrandbits(64)
        for _ in range(spread):
            c2 = c
            for _ in range(rng.randint(0, 4)):
                c2 ^= 1 << rng.randrange(64)
            out.add(c2)
            if rng.random() < 0.3:
                c = c2
    return sorted(out)


@pytest.mark.parametrize("mid, small", [(1024, 32), (64, 8), (6, 2)])
def test_links_of_clusters(spark, monkeypatch, mid, small):
    monkeypatch.setattr(S, "MID", mid)
    monkeypatch.setattr(S, "SMALL", small)
    rng = random.Random(mid)
    near = cloud(rng, 500, 120) + [rng.getrandbits(64) for _ in range(300)] + [(7 << 40) | rng.getrandbits(9) for _ in range(400)]
    near = sorted(set(near))
    signed = [p - (1 << 64) if p >> 63 else p for p in near]
    prints = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = S.components(S.links(prints)).collect()
    label = {r.doc_id: r.component_id for r in found}
    got = [label.get(p, p) for p in signed]
    want = plain_components(signed, near)
    assert got == want
    pairs = S.links(prints).count()
    assert pairs < 70 * len(near)  # trees, not all pairs


def test_exploded_rows_are_not_broadcast(spark):
    rows = S.signatures(spark.range(1000).select(F.xxhash64("id").alias("fp")))
    for met in (S.shared(rows), S.shared(S.halves(S.shared(rows)))):
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_roots_by_flips_equal_roots_by_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 1 << 18, 900).astype(np.uint64) << np.uint64(5))
    want = S.roots_of(fp, 2)
    monkeypatch.setattr(S, "MID", 10)
    assert (S.roots_of(fp, 2) == want).all()


def test_empty_tables_and_ranges(spark, docs):
    assert S.near_duplicates(docs([])).collect() == []
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([(1,)], "fp long"), 4)


def test_registered_query_on_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_print(r.text) for r in rows]
    want = zip([r.doc_id for r in rows], [f"{p:016x}" for p in prints], plain_components([r.doc_id for r in rows], prints))
    out = S.op12_query(spark, sf)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert out.where(F.col("doc_id") != F.col("component_id")).count() > 0
