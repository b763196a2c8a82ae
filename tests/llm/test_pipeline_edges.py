"""Every stage of the pipeline on empty tables, very long texts, repeated rows and columns whose names it uses itself."""

import random

import pytest

import corpus_pipeline

CLASHING = ["kept", "component_id", "score", "predicted", "spans", "shingles", "tokens", "n_shingles", "ids", "part", "id", "rest", "class_id", "same", "toxic"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def tables(spark, folder, rows, labels, items):
    full = [(i, t, "en", "src", None if t is None else len(t), *(f"{c} of {i}" for c in CLASHING)) for i, t in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("labelled, measured", [(False, False), (True, True)])
def test_empty_corpus(spark, tmp_path, labelled, measured):
    d = str(tmp_path)
    docs = tables(spark, d, [], [(1, 0, 1), (2, 0, 0)] if labelled else [], [(1, "some words of an item that nobody has")] if measured else [])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        assert out.collect() == []
        assert k == 4 or out.columns == docs.columns
    assert corpus_pipeline.run(spark, d).collect() == []


def test_long_texts_repeated_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(4)
    words = ["hello", "green", "table", "walks", "under", "river", "stone", "cloud", "paper", "light"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(n))
    item = "what is the boiling point of seventeen green parrots on a distant wall"
    long = text(40_000)
    rows = [(i, text(3000 if i % 10 == 5 else 30) + (" moron" if i % 4 == 0 else "")) for i in range(120)]  # labelled ones are long too
    rows += [(500, long), (501, f"{long} and {item}"), (502, "x" * 300_000), (503, rows[1][1]), (504, ""), (505, None), (506, "  \t"), (None, text(20)), (507, text(25) + " joe@site.org"), (507, None)]
    rows += rows[120:125] + [(1, rows[1][1])]
    labels = [(i, 0, int(i % 4 == 0)) for i in range(120)] + [(None, 0, 1), (7, None, None)]
    d = str(tmp_path)
    now = tables(spark, d, rows, labels, [(1, item), (2, None), (3, ""), (None, item)])
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, d)
        assert k == 4 or out.columns == now.columns
        out.write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        seen.append(sorted((-1 if r.doc_id is None else r.doc_id) for r in now.select("doc_id").collect()))
        if k < 4:
            assert all(r[c] == f"{c} of {r.doc_id}" for r in now.limit(30).collect() for c in CLASHING)
    clean = sorted((-1 if i is None else i) for i, t in rows if i is None or i >= 120 or i % 4)
    assert seen[0] == clean
    gone = {501, 503}  # 501 is the long text with an item, 503 a copy
    assert seen[1] == [i for i in clean if i not in gone]
    assert seen[2] == seen[3] == seen[4] == seen[1]
    assert corpus_pipeline.run(spark, d).count() == len(seen[4])
