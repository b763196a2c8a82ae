"""Rules on rows and on whole tables, as data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise.functions.text import has_japanese


def split_rejects(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the names of those they break; a null rule is broken."""
    names = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("reasons", names)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def not_empty(*columns: str) -> dict[str, Column]:
    return {f"{c} is empty": F.trim(F.col(c)) != "" for c in columns}


def report(checks: list[tuple[str, DataFrame, Column, float | None, float | None]]) -> DataFrame:
    """A row for each check (label, table, aggregate, least, most): label, value, passed."""
    parts = []
    for label, df, value, least, most in checks:
        v = F.coalesce(F.col("value"), F.lit(0.0))
        ok = (F.lit(True) if least is None else v >= least) & (F.lit(True) if most is None else v <= most)
        parts.append(df.agg(value.cast("double").alias("value")).select(F.lit(label).alias("label"), v.alias("value"), ok.alias("passed")))
    return reduce(DataFrame.unionByName, parts)


def coverage(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Codes that are missing, unknown or there more than once."""
    n = found.groupBy(key).agg(F.count("*").alias("n"))
    j = n.join(expected.select(key).withColumn("_e", F.lit(True)), key, "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return j.withColumn("problem", problem).where("problem is not null").select(key, "problem")


def name_audit(rows: DataFrame, local: str, english: str, by: str) -> DataFrame:
    """Blank, unchanged and Japanese English names by group."""
    e = F.col(english)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(e.isNull() | (F.trim(e) == "")).alias("blank"), F.count_if(e == F.col(local)).alias("unchanged"), F.count_if(has_japanese(e)).alias("japanese"))


def share(df: DataFrame, bad: Column) -> DataFrame:
    """Share of bad rows; an empty table has none."""
    return df.agg(F.count_if(bad).alias("bad"), F.count("*").alias("n")).select("bad", "n", F.when(F.col("n") > 0, F.col("bad") / F.col("n")).otherwise(0.0).alias("share"))


def forbidden_sources(tables: dict[str, DataFrame], forbidden: Sequence[str]) -> DataFrame:
    """Rows of each table that come from a source that must not be there: table, source, n."""
    every = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table"), "source") for name, df in tables.items()])
    return every.where(F.col("source").isin(*forbidden)).groupBy("table", "source").agg(F.count("*").alias("n"))


def taken_over(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows of a source an upsert takes over from another one: old_source, new_source, n."""
    c, i = current.select(*keys, F.col("source").alias("old_source")), incoming.select(*keys, F.col("source").alias("new_source")).distinct()
    return c.join(i, list(keys)).where(~F.col("old_source").eqNullSafe(F.col("new_source"))).groupBy("old_source", "new_source").agg(F.count("*").alias("n"))


def prerequisites(checks: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """A row for each (step, what is lacking, the rows that lack it): step, lacking, n, ready."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), F.lit(lacking).alias("lacking"), "n", (F.col("n") == 0).alias("ready")) for step, lacking, df in checks]
    return reduce(DataFrame.unionByName, parts)


def require(checks: list[tuple[str, str, DataFrame]], step: str) -> None:
    """An error that names everything that a step lacks."""
    mine = [c for c in checks if c[0] == step]
    lacks = [f"{r.lacking}: {r.n} rows" for r in prerequisites(mine).where("not ready").collect()] if mine else []
    if lacks:
        raise ValueError(f"{step} cannot run yet, " + "; ".join(lacks))
