"""Names that are alike, against all pairs."""

import random

import pytest

from wardwise.operators import search


def grams(name):
    return {f"  {w} "[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in name.lower()).split() for i in range(len(w) + 1)}


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_names_equal_all_pairs(spark, least):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeo") for _ in range(rng.randint(1, 8))) for _ in range(25)]
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(160)] + ["", None, "--", "a", "A!"]
    a, b = list(enumerate(names[:90] + names[-5:])), list(enumerate(names[60:]))
    df = [spark.createDataFrame(x, "id long, name string") for x in (a, b)]
    got = {(r.a_id, r.b_id): r.similarity for r in search.similar_names(*df, least).collect()}
    want = {}
    for i, x in a:
        for j, y in b:
            p, q = grams(x or ""), grams(y or "")
            if p and q and len(p & q) / len(p | q) >= least:
                want[i, j] = len(p & q) / len(p | q)
    assert got == pytest.approx(want) and want


def test_few_pairs_are_looked_at(spark):
    """Names that all share their commonest word meet by their rare ones."""
    rng = random.Random(6)
    rare = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(200)]
    names = spark.createDataFrame([(i, f"north station {w}") for i, w in enumerate(rare)], "id long, name string")
    met = search.name_candidates(names, names, 0.8).where("a_id < b_id").count()
    assert met < 200 * 199 / 2 / 20
    with pytest.raises(ValueError):
        search.similar_names(names, names, 0.0)


def test_names_of_few_words_and_a_number_meet_by_two_trigrams(spark):
    names = [(i, f"{w} ring Brand#{b} {i} LARGE") for i, (w, b) in enumerate((w, b) for w in ("large", "small") for b in (1, 12) for _ in range(150))]
    df = spark.createDataFrame(names, "id long, name string")
    g = {i: grams(n) for i, n in names}
    want = {(i, j): len(g[i] & g[j]) / len(g[i] | g[j]) for i in g for j in g if i < j and len(g[i] & g[j]) / len(g[i] | g[j]) >= 0.75}
    assert {(r.a_id, r.b_id): r.similarity for r in search.similar_pairs(df, 0.75).collect()} == pytest.approx(want) and want
    assert search.name_candidates(df, df, 0.75).where("a_id < b_id").count() < 4 * len(want)


def test_station_names_are_met_from_three_tenths_on(spark, tmp_path):
    """Names that share between 0.3 and a half of their trigrams are pairs, too."""
    from wardwise.plans import queries

    spark.createDataFrame([(1, "Supplier KENYA", 0)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(7, "KENYA")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    found = [tuple(r) for r in queries.similar_station_names(spark, str(tmp_path)).collect()]
    p, q = grams("Supplier KENYA"), grams("Supplier KENYA 000000007")
    assert found == [(1, 7, pytest.approx(len(p & q) / len(p | q), abs=1e-6))]
    spark.createDataFrame([(1, "Supplier#000000007", 0)], "s_suppkey long, s_name string, s_nationkey int").write.mode("overwrite").parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(7, "UNITED KINGDOM OF NAMES")], "n_nationkey int, n_name string").write.mode("overwrite").parquet(f"{tmp_path}/nation.parquet")
    p, q = grams("Supplier#000000007"), grams("Supplier UNITED KINGDOM OF NAMES 000000007")
    found = [tuple(r) for r in queries.similar_station_names(spark, str(tmp_path)).collect()]
    assert 0.3 <= len(p & q) / len(p | q) < 0.5 and found == [(1, 7, pytest.approx(len(p & q) / len(p | q), abs=1e-6))]
