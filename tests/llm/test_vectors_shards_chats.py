"""Search, shards, chats and the pipeline on small tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardwise.llm import chat_format, ring_shards, score_aware_search


def test_search_finds_nearly_all_and_scores_exactly(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 17)).astype(np.float32)
    rows = [(i, [float(v) for v in row], "x") for i, row in enumerate(x)]
    rows += [(2000, None, "x"), (2001, [0.0] * 17, "x"), (2002, [float("nan")] + [1.0] * 16, "x"), (2003, [None] + [1.0] * 16, "x"), (2004, [1.0], "x"), (2005, [float("inf")] * 17, "x"), (2006, [float(v) for v in x[0]], "x")]
    v = score_aware_search.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"))
    out = score_aware_search.search(v, v.where("vec_id % 20 = 0"), 20).collect()
    full = np.vstack((x, x[:1])).astype(np.float64)
    ids = np.append(np.arange(1200), 2006)
    got: dict = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1200, 20))
    hits = 0
    for q, rows_ in got.items():
        rows_.sort()
        score = full @ full[q]
        keep = ids != q
        best = set(ids[keep][np.lexsort((ids[keep], -score[keep]))[:20]])
        assert [r for r, *_ in rows_] == list(range(1, 21))
        assert all(abs(s - score[np.flatnonzero(ids == i)[0]]) < 1e-12 and i != q for _, i, s in rows_)
        assert [(-s, i) for _, i, s in rows_] == sorted((-s, i) for _, i, s in rows_)
        hits += len(best & {i for _, i, _ in rows_})
    assert hits >= 0.9 * 20 * len(got)
    few = v.where("vec_id < 5")
    assert Counter(r.query_id for r in score_aware_search.search(few, few, 20).collect()) == {i: 4 for i in range(5)}
    assert score_aware_search.search(v.limit(0), v.limit(0)).collect() == []


def test_search_keeps_the_smallest_of_equal_vectors(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2500, 17))
    x[rng.permutation(2500)[:1000]] = x[0]  # 1,000 copies and more than are reranked
    x[1] = 1.01 * x[0]
    v = score_aware_search.usable(spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>"))
    got: dict = {}
    for r in score_aware_search.search(v, v.where("vec_id in (0, 1)"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in (0, 1):
        score = (x * x[q]).sum(1)
        assert got[q] == [i for i in np.lexsort((np.arange(2500), -score)) if i != q][:20]


def test_anisotropic_codes_have_less_parallel_error():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 8))
    own = score_aware_search.fitted(x)
    plain = score_aware_search.Codebooks(own.centres.copy(), 1.0)

    def parallel(books, codes):
        back = books.centres[np.arange(4), codes].reshape(len(x), -1)
        return ((((x - back) * x).sum(1) / np.linalg.norm(x, axis=1)) ** 2).mean()

    assert own.eta >= 1
    own.eta = 8.0
    assert parallel(own, own.encode(x)) < parallel(plain, plain.encode(x))


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_shards_obey_their_law(docs, n):
    r = random.Random(n)
    rows = [(i, r.choice([None, "", "é" * r.randint(1, 5), "same"])) for i in range(n)]
    rows += [(3, "same")] * (n // 5)
    out = ring_shards.ring_shards(docs(rows), 8, 16).collect()
    assert Counter((x.doc_id, x["size"], x.text_crc32) for x in out) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    per = Counter(x.shard for x in out)
    counts = [per.get(s, 0) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(x.slot for x in out if x.shard == s) == list(range(counts[s]))
    if n == 500:  # overflow goes clockwise: only rows of shards that are full have moved
        home = Counter(x.home for x in out)
        assert all(home[x.home] > per[x.home] for x in out if x.shard != x.home) and sum(x.shard == x.home for x in out) > n / 2


def test_fill_goes_clockwise():
    assert ring_shards.fill([5, 0, 1], [0, 1, 2], [2, 2, 2]) == [[(0, 2, 0), (2, 2, 1), (4, 1, 2)], [], [(0, 1, 2)]]


def test_chats_are_read_back(spark):
    r = random.Random(9)
    pieces = ["<s>", "</s>", "[:]", "[+]", "[INST]", "[/INST]", "\\", "<", "[", "a", "é", "\n", "<\\/s>", "[\\\\:]", "</", "s>", ":]", "🙂"]
    rows = []
    for c in range(80):
        for t in range(r.randint(1, 7)):
            rows.append((c, t, r.choice(["user", "assistant", "system", "<s>", None]), r.choice([None, "", "".join(r.choice(pieces) for _ in range(r.randint(0, 9)))]), "x"))
    rows += [(None, 0, "user", "lost", "x"), (200, None, "user", "b", "x"), (200, 0, "user", "c", "x"), (200, 0, "user", "c", "x"), (201, 0, "assistant", "long " * 40_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    chats = chat_format.format_chat(df).select("conv_id", "formatted", "segments", chat_format.read_chat(F.col("formatted")).alias("back"))
    want: dict = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for x in chats.collect():
        turns = [(role, text) for *_, role, text in sorted(want[x.conv_id], key=lambda k: k[:2])]
        back = [(b.role, b.text) for b in x.back]
        assert sorted(back) == sorted(turns) and (x.conv_id in (200,) or len({k[1] for k in want[x.conv_id]}) < len(turns) or back == turns)
        assert "".join(s.text for s in x.segments) == x.formatted
        assert x.formatted.count("</s>") == sum(i == 0 or role != back[i - 1][0] for i, (role, _) in enumerate(back))
        assert sum(s.loss for s in x.segments) == sum(role == "assistant" for role, _ in back)
    assert chat_format.format_chat(df.limit(0)).collect() == []
    plan = chat_format.format_chat(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_near_dedup_keeps_documents_without_id(spark, docs):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(40))
    table = docs([(1, text), (2, text), (3, "other words are here"), (None, text), (None, text), (None, None)])
    out = corpus_pipeline.near_dedup(spark, table, "")
    assert out.columns == table.columns
    assert Counter((x.doc_id, x.text) for x in out.collect()) == {(1, text): 1, (3, "other words are here"): 1, (None, text): 2, (None, None): 1}


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    words = ["hello", "green", "table", "walks", "under", "river", "stone", "cloud", "paper", "light"]
    rows = [(i, " ".join(r.choice(words) + str(r.randrange(9)) for _ in range(40))) for i in range(200)]
    labels = [(i, 0, int(i % 4 == 0)) for i in range(200)]
    rows = [(i, t + (" moron" if i % 4 == 0 else "")) for i, t in rows]
    item = "what is the boiling point of seventeen green parrots on a distant wall"
    rows += [(300, rows[1][1]), (301, rows[2][1] + " end"), (302, f"so {item} it is"), (303, "write to joe@site.org please"), (304, None)]
    d = str(tmp_path)
    docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, d).write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        kept.append({x.doc_id for x in now.select("doc_id").collect()})
    clean = {i for i in range(200) if i % 4} | {300, 301, 302, 303, 304}
    assert kept == [clean, clean - {300, 301}, clean - {300, 301, 302}, clean - {300, 301, 302}, clean - {300, 301, 302}]
    assert spark.read.parquet(f"{d}/pii").where("doc_id = 303").first().text == "write to [EMAIL] please"
    out = sorted((x.doc_id, x.ids_sha256) for x in corpus_pipeline.run(spark, d).collect())
    assert out == sorted((x.doc_id, x.ids_sha256) for x in now.collect())
    assert hashlib.sha256(b"").hexdigest() == dict(out)[304]


def test_tied_turns_are_in_order_of_their_texts(spark):
    rows = [(1, 0, "user", t) for t in ("[;", "[:]", "[", "</s>", "<")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = chat_format.format_chat(df).select(chat_format.read_chat(F.col("formatted")).alias("t")).first().t
    assert [x.text for x in got] == sorted(t for *_, t in rows)
