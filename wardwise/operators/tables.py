"""Table maintenance as functions of old and new rows: upserts, deletions of what is gone, replacement, ledger."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows win by key; null keys are equal to each other. Of new rows with one key the largest by its other columns counts."""
    i = incoming.select(*keys).distinct()
    others = [c for c, t in incoming.dtypes if c not in keys and "map<" not in t]
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in others] or [F.lit(1)])
    once = incoming.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return once.unionByName(current.join(i, _same(current, i, keys), "left_anti"))


def sync(current: DataFrame, incoming: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """Upsert, and rows of this source that are no longer there go; other sources stay."""
    return upsert(current.where(F.col("source") != source), incoming, keys)


def sync_periods(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for each (source, period) in the batch only."""
    scope = incoming.select("source", "period").distinct()
    return upsert(current.join(scope, ["source", "period"], "left_anti").select(*current.columns), incoming, keys)


def replace_source(current: DataFrame, incoming: DataFrame, source: str) -> DataFrame:
    return current.where(F.col("source") != source).unionByName(incoming)


def stale(current: DataFrame, incoming: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """Keys of this source that the batch lacks."""
    c, i = current.where(F.col("source") == source).select(*keys), incoming.select(*keys)
    return c.join(i, _same(c, i, keys), "left_anti")


def union_arrays(current: DataFrame, incoming: DataFrame, key: str, column: str) -> DataFrame:
    """Values of an array column add up, each once, in order."""
    c, i = current.select(key, F.col(column).alias("_c")), incoming.select(key, F.col(column).alias("_i"))
    both = F.array_sort(F.array_distinct(F.concat(F.coalesce("_c", F.array().cast("array<string>")), F.coalesce("_i", F.array().cast("array<string>")))))
    return c.join(i, key, "full").select(key, both.alias(column))


def blocked(stale_keys: DataFrame, references: dict[str, DataFrame], key: str) -> DataFrame:
    """How many rows of each table still point to keys that are to go."""
    parts = [t.select(F.col(c).alias(key)).join(stale_keys, key, "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for (name, c), t in ((n.split("."), t) for n, t in references.items())]
    return reduce(DataFrame.unionByName, parts)


def without_references(rows: DataFrame, gone: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows with null where a nullable column points to a key that is to go. columns: column of the rows to key of ``gone``."""
    out = rows
    for column, key in columns.items():
        lost = gone.select(F.col(key).alias(column)).distinct().withColumn("_lost", F.lit(True))
        out = out.join(lost, column, "left").withColumn(column, F.when(F.col("_lost").isNull(), F.col(column))).drop("_lost")
    return out.select(*rows.columns)


def backfill_problems(current: DataFrame, names: DataFrame, key: str, column: str, valid: Column) -> DataFrame:
    """Why new values cannot be filled in, all or none: keys that are unknown, there twice, or whose value is not valid: key, problem."""
    n = names.withColumn("_valid", F.coalesce(valid, F.lit(False))).groupBy(key).agg(F.count("*").alias("_n"), F.min("_valid").alias("_valid"))
    j = n.join(current.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    problem = F.when(F.col("_known").isNull(), "unknown").when(F.col("_n") > 1, "repeated").when(~F.col("_valid"), "invalid")
    return j.withColumn("problem", problem).where("problem is not null").select(key, "problem")


def backfill_checked(current: DataFrame, names: DataFrame, key: str, column: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """As ``backfill``, but an error that names the problems, and nothing filled in, if there is any."""
    found = [f"{r.n} {r.problem}" for r in backfill_problems(current, names, key, column, valid).groupBy("problem").agg(F.count("*").alias("n")).orderBy("problem").collect()]  # three rows at most
    if found:
        raise ValueError(f"{column} cannot be filled in: " + ", ".join(found))
    return backfill(current, names, key, column)


def backfill(current: DataFrame, names: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """The table with new values where they differ, and a report."""
    n = names.select(key, F.col(column).alias("_new"))
    j = current.join(n, key, "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(column))
    report = j.agg(F.count("_new").alias("considered"), F.count_if(changed).alias("updated"), (F.count("_new") - F.count_if(changed)).alias("already"))
    return j.withColumn(column, F.when(changed, F.col("_new")).otherwise(F.col(column))).select(*current.columns), report


def latest(runs: DataFrame, key: str, order: str, where: Column | None = None) -> DataFrame:
    """The newest row of each key."""
    rows = runs if where is None else runs.where(where)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(order, *[c for c in sorted(rows.columns) if c not in (key, order) and not dict(rows.dtypes)[c].startswith("map")])).alias("m")).select(key, "m.*")


def hashed_pick(rows: DataFrame, key: str, id_column: str) -> DataFrame:
    """One row of each key, the one whose id has the least md5."""
    w = Window.partitionBy(key).orderBy(F.md5(F.col(id_column).cast("string")), id_column)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


class Versions:
    """A table as numbered directories. A version counts from when its marker is there: a file that is renamed into
    place after all data is written, and only if no other writer took the number. A failed write changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def current(self) -> int | None:
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return None
        names = [f.getPath().getName() for f in fs.listStatus(path(self.path))]
        return max((int(n.split("-")[1]) for n in names if n.startswith("current-")), default=None)

    def read(self) -> DataFrame:
        n = self.current()
        return self.spark.read.parquet(f"{self.path}/{self.spark.read.text(f'{self.path}/current-{n}').first()[0]}")

    def write(self, df: DataFrame) -> int:
        """Write the next version, then point to it."""
        fs, path = self._fs()
        n = (self.current() or 0) + 1
        name = f"v{n}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        out = fs.create(path(f"{self.path}/_marker-{name}"), False)
        out.write(bytearray(name.encode()))
        out.close()
        if fs.exists(path(f"{self.path}/current-{n}")) or not fs.rename(path(f"{self.path}/_marker-{name}"), path(f"{self.path}/current-{n}")):
            raise RuntimeError(f"version {n} of {self.path} was written by another one")
        return n


def run_ledgered(spark: SparkSession, ledger: str, source: str, started_at: str, step) -> int:
    """Run ``step()`` (it returns a number of rows) and append what became of it to the ledger."""
    schema = "source string, started_at string, status string, rows long, error string"
    try:
        rows = step()
        spark.createDataFrame([(source, started_at, "success", rows, None)], schema).write.mode("append").parquet(ledger)
        return rows
    except Exception as e:
        spark.createDataFrame([(source, started_at, "failed", None, str(e)[:500])], schema).write.mode("append").parquet(ledger)
        raise
