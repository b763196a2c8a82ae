"""Searches for places: many queries at once over many names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardwise import config
from wardwise.functions.text import best_similarity, matches, trigrams
from wardwise.sources.shared import materialized


def place_search(queries: DataFrame, places: DataFrame, limit: int = config.PLACES) -> DataFrame:
    """Places (place_id, kind, name, aliases) that hold each query (query_id, query), the most similar first.

    A query meets places by a shared piece: its first three characters, or all of it if it has fewer, so no
    pair is looked at that cannot match. Empty queries find nothing.
    """
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))

    def pieces(text, size: int):
        t = F.lower(text)
        return F.when(F.length(t) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - size + 1)), lambda i: F.substring(t, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    found = []
    for size in (1, 2, 3):
        by_piece = places.withColumn("piece", F.explode(F.array_distinct(F.flatten(F.transform(every, lambda x: pieces(x, size))))))  # noqa: B023
        asked = queries.where(F.length("query") >= 3 if size == 3 else F.length("query") == size)
        found.append(asked.withColumn("piece", F.substring(F.lower("query"), 1, size)).join(by_piece, "piece").drop("piece"))
    hits = reduce(DataFrame.unionByName, found).where(matches(F.col("query"), [F.col("name")], [F.col("aliases")]))
    scored = hits.withColumn("similarity", best_similarity(F.col("query"), [F.col("name")], [F.col("aliases")]))
    first = F.when(F.col("kind") == "station", 0).otherwise(1)
    w = Window.partitionBy("query_id").orderBy(first, F.desc("similarity"), "name", "place_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _ranked_grams(names: DataFrame, counts: DataFrame, side: str) -> DataFrame:
    """id, n and grams (trigrams of a name, the rarest of both tables first)."""
    g = names.select(F.col("id").alias(side), F.explode(trigrams(F.col("name"))).alias("gram"))
    return g.join(counts, "gram").groupBy(side).agg(F.array_sort(F.collect_list(F.struct("k", "gram"))).alias("g")).select(side, F.size("g").alias(f"n_{side}"), F.transform("g", lambda x: x["gram"]).alias(f"grams_{side}"))


def _keys(df: DataFrame, side: str, sizes: DataFrame, least: float, which: Callable[[Column], Column] | None = None) -> DataFrame:
    """What names are met by: id and key, a pair of their first trigrams for each size that a similar enough name has; with
    bits of all their trigrams and how many may be in one of the two names only.

    Names of m and n trigrams that are ``least`` similar share k = least / (1 + least) * (m + n) of them or more. So one of two rarest
    shared ones is among the first m - k + 1 of a name, and both are among the first m - k + 2.
    """
    n, other = F.col(f"n_{side}"), F.col("other")
    fits = lambda m: (m >= n * least - 1e-9) & (n >= m * least - 1e-9) & (which(m) if which else F.lit(True))
    bits = lambda of: F.expr(f"aggregate(h, 0L, (x, g) -> x | if((g & 64) = {of}, shiftleft(1L, cast(g & 63 as int)), 0L))")
    each = df.select(side, n, F.transform(f"grams_{side}", lambda g: F.xxhash64(g)).alias("h")).withColumn(f"low_{side}", bits(0)).withColumn(f"high_{side}", bits(64))
    each = each.crossJoin(F.broadcast(sizes)).withColumn("other", F.explode(F.filter("sizes", fits)))
    shared = F.greatest(F.lit(1), F.ceil((n + other) * (least / (1 + least)) - 1e-9))
    both = (n, other) if side == "a_id" else (other, n)
    most = F.least(n, n - shared + 2).cast("int")
    one = F.transform(F.slice("h", F.lit(1), most), lambda x: F.xxhash64(*both, x))
    two = F.flatten(F.transform(F.sequence(F.lit(1), most), lambda i: F.transform(F.slice("h", F.lit(1), i - 1), lambda x: F.xxhash64(*both, x, F.get("h", i - 1)))))
    alone = [(n + other - 2 * shared).alias("alone")] if side == "a_id" else []
    return each.select(side, f"low_{side}", f"high_{side}", *alone, F.explode(F.when(shared >= 2, two).otherwise(one)).alias("key"))


def _met(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs with a key in common, without those whose bits say that too many trigrams differ."""
    differ = F.bit_count(F.col("low_a_id").bitwiseXOR(F.col("low_b_id"))) + F.bit_count(F.col("high_a_id").bitwiseXOR(F.col("high_b_id")))
    return x.join(y.hint("shuffle_merge"), "key").where(differ <= F.col("alone")).select("a_id", "b_id")


def _sizes(df: DataFrame, side: str) -> DataFrame:
    """One row: all numbers of trigrams that names have; as many as the longest name has trigrams at most."""
    return df.agg(F.collect_set(f"n_{side}").alias("sizes"))


def _gram_tables(a: DataFrame, b: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    if not 0 < least <= 1:
        raise ValueError("the least similarity is over 0 and at most 1")
    every = a.select("id", "name") if a is b else a.select("id", "name").unionByName(b.select("id", "name"))
    counts = every.select(F.explode(trigrams(F.col("name"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("k"))
    x = materialized(_ranked_grams(a, counts, "a_id"), "grams")
    return x, x.toDF("b_id", "n_b_id", "grams_b_id") if a is b else materialized(_ranked_grams(b, counts, "b_id"), "grams")


def name_candidates(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Pairs of names (id, name) that may be ``least`` similar: a_id, b_id and their trigrams, each pair once.

    Two names that are similar enough share two of their first trigrams, as many as could be missing and two more
    (or one, where they need to share no more); these are the rarest, so few names are listed under each pair of them.
    """
    x, y = _gram_tables(a, b, least)
    pairs = _met(_keys(x, "a_id", _sizes(y, "b_id"), least), _keys(y, "b_id", _sizes(x, "a_id"), least)).distinct()
    return pairs.join(x, "a_id").join(y, "b_id")


def _scored(candidates: DataFrame, least: float) -> DataFrame:
    shared = F.size(F.array_intersect("grams_a_id", "grams_b_id"))
    scored = candidates.withColumn("similarity", shared / (F.col("n_a_id") + F.col("n_b_id") - shared))
    return scored.where(F.col("similarity") >= least).select("a_id", "b_id", "similarity")


def similar_names(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Pairs of names (id, name) whose trigrams are similar enough: a_id, b_id, similarity."""
    return _scored(name_candidates(a, b, least), least)


def similar_pairs(names: DataFrame, least: float) -> DataFrame:
    """As ``similar_names`` of a table with itself, each pair once, a_id < b_id."""
    x, y = _gram_tables(names, names, least)
    sizes = _sizes(x, "a_id")
    shorter = _keys(x, "a_id", sizes, least, lambda m: m >= F.col("n_a_id"))
    longer = _keys(y, "b_id", sizes, least, lambda m: m <= F.col("n_b_id"))
    met = _met(shorter, longer).where("a_id <> b_id").select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()
    return _scored(met.join(x, "a_id").join(y, "b_id"), least)
