"""Tables that change together, in buckets; digests."""

import os

import pytest
from pyspark.sql import functions as F

from wardwise.operators.store import Store, digest
from wardwise.streaming.maintenance import keep_in_store


def rows(spark, n, v=0):
    return spark.range(n).select("id", (F.col("id") + v).alias("v"), F.when(F.col("id") % 3 > 0, F.lit("a")).alias("s"))


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def written_bytes(path, before=()):
    files = {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path / "data") for f in names if f.endswith(".parquet")}
    return files, sum(s for f, s in files.items() if f not in before)


def test_a_run_changes_all_its_tables_or_none(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", target=10)
    with store.run("first", "2024-01-01", "v1") as run:
        run.replace("a", rows(spark, 30), ["id"])
        run.upsert("b", rows(spark, 5), ["id"])
        run.replace("c", rows(spark, 0), ["id"])
        assert run.read("a").count() == 30 and store.read("a") is None  # seen by the run alone
    before = {t: content(store.read(t)) for t in "abc"}
    assert before["c"] == [] and len(before["b"]) == 5
    with pytest.raises(Exception, match="broken"), store.run("second", "2024-01-02", "v2") as run:
        run.upsert("a", rows(spark, 3, 100), ["id"])
        run.replace("b", rows(spark, 1), ["id"])
        run.replace("c", rows(spark, 9).where(F.raise_error(F.lit("broken")).isNull()), ["id"])
    assert {t: content(store.read(t)) for t in "abc"} == before and store.version() == 1
    with store.run("third", "2024-01-03", "v3", name="third") as run:
        run.upsert("a", rows(spark, 3, 100), ["id"])
    assert content(store.read("a"))[:4] == [(0, 100, None), (1, 101, "a"), (10, 10, "a"), (11, 11, "a")] and store.read("a").count() == 30
    got = {r.source: (r.status, r.vintage, r.rows, r.error is not None) for r in store.ledger().collect()}
    assert got["first"] == ("success", "v1", 35, False) and got["second"] == ("failed", "v2", None, True) and got["third"][:2] == ("success", "v3")
    with pytest.raises(ValueError, match="already"), store.run("third", "2024-01-03", name="third"):
        pass
    with pytest.raises(ValueError, match="keys of a"), store.run("fourth", "2024-01-04") as run:
        run.upsert("a", rows(spark, 1), ["v"])


def test_of_two_writers_one_wins(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    with pytest.raises(RuntimeError, match="another run"), store.run("slow", "1", name="slow") as slow:
        slow.replace("a", rows(spark, 2), ["id"])
        with store.run("fast", "2") as fast:
            fast.replace("a", rows(spark, 3), ["id"])
    assert store.read("a").count() == 3
    assert {r.source: r.status for r in store.ledger().collect()} == {"slow": "failed", "fast": "success"}


def test_a_small_batch_writes_no_more_into_a_larger_table(spark, tmp_path):
    sizes = []
    for n in (2_000, 32_000):
        path = tmp_path / str(n)
        store = Store(spark, f"file://{path}", target=200)
        with store.run("load", "1") as run:
            run.replace("a", rows(spark, n), ["id"])
        files, _ = written_bytes(path)
        with store.run("batch", "2") as run:
            run.upsert("a", rows(spark, n).where("id < 10").withColumn("v", F.lit(-1).cast("long")), ["id"])
        sizes.append(written_bytes(path, files)[1])
        assert store.read("a").agg(F.sum("v")).first()[0] == sum(range(10, n)) - 10
    assert sizes[1] < 1.5 * sizes[0]


def test_tables_are_laid_out_anew_as_they_grow(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", target=50)
    for k in range(6):
        with store.run("grow", str(k)) as run:
            run.upsert("a", spark.range(k * 150, (k + 1) * 150).withColumn("v", F.col("id")), ["id"])
    entry = store.manifest()["tables"]["a"]
    assert entry["n"] >= 16 and content(store.read("a")) == sorted([(i, i) for i in range(900)], key=repr)


def test_batches_of_a_stream_are_runs(spark, tmp_path):
    source = tmp_path / "in"
    store = Store(spark, f"file://{tmp_path}/store", target=10)
    for k in range(2):
        spark.createDataFrame([(i, 10 * k + i, k) for i in range(k, k + 3)], "id long, v long, at int").write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id long, v long, at int").parquet(str(source))
        keep_in_store(stream, store, "a", ["id"], "at", "feed", f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted((r.id, r.v) for r in store.read("a").collect()) == [(0, 0), (1, 11), (2, 12), (3, 13)]
    assert [r.status for r in store.ledger().collect()] == ["success", "success"]


def test_digests(spark):
    def of(df):
        return {r.column: tuple(r) for r in digest(df).collect()}

    a = rows(spark, 50).withColumn("m", F.create_map(F.lit("k"), "v")).withColumn("x", F.array("id"))
    assert of(a) == of(a.orderBy(F.desc("id")).repartition(3)) and set(of(a)) == {"id", "v", "s", "m", "x", "*"}
    changed = of(a.withColumn("s", F.when(F.col("id") == 7, F.lit("b")).otherwise(F.col("s"))))
    assert {c for c in changed if changed[c] != of(a)[c]} == {"s", "*"}
    two = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    swapped = of(spark.createDataFrame([(1, 4), (3, 2)], "a int, b int"))
    assert {c for c in swapped if swapped[c] != of(two)[c]} == {"*"}
    assert of(spark.createDataFrame([(None, 0)], "a int, b int")) != of(spark.createDataFrame([(0, None)], "a int, b int"))
    assert of(two.union(two)) != of(two) and of(two.limit(0)) == {}


def test_a_replacement_makes_its_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)
    kept = F.udf(lambda x: made.add(1) is None, "boolean")
    store = Store(spark, f"file://{tmp_path}/once")
    with store.run("x", "2026-01-01") as run:
        run.replace("t", spark.range(40).where(kept("id")), ["id"])
    assert store.read("t").count() == 40 and made.value == 40
    assert digest(spark.range(0)).count() == 0
