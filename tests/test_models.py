"""Golden numbers of the rent, scoring and text models."""

import pytest
from pyspark.sql import functions as F

from wardwise.functions import numbers, text, times
from wardwise.operators import metrics, rent, scoring


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_rent_of_a_layout(spark):
    area = spark.createDataFrame([(3600.0, 7000.0, 1.0, False, 2, "2024")], "rent_per_sqm double, fee double, multiplier double, fallback boolean, base_confidence int, period string")
    row = rent.estimates(area, 2025).where("layout = '1LDK'").first()
    assert (row.low_yen, row.median_yen, row.high_yen, row.confidence) == (110680, 143800, 185200, 2)
    old = rent.estimates(area.withColumn("fallback", F.lit(True)), 2028).where("layout = '1R'").first()
    assert old.confidence == 0


@pytest.mark.parametrize("near, ward, n, expected", [(100.0, 100.0, 3, 1.0), (1000.0, 100.0, 5, 1.15), (1.0, 100.0, 5, 0.85), (200.0, 100.0, 2, 1.0), (None, 100.0, 9, 1.0), (0.0, 100.0, 9, 1.0)])
def test_multiplier(spark, near, ward, n, expected):
    assert one(spark, rent.multiplier(F.lit(near).cast("double"), F.lit(ward), F.lit(n)))[0] == pytest.approx(expected)


def test_rent_choice_prefers_a_recent_source(spark):
    rows = [(1, "reins", "2024Q1", 1.0, 0.0), (1, "reins", "2024Q3", 2.0, 0.0), (1, "estat", "2023", 3.0, 0.0), (2, "reins", "2020Q1", 4.0, 0.0), (2, "estat", "2018", 5.0, 0.0), (3, "reins", "2019Q1", 6.0, 0.0)]
    got = {r.ward: (r.rent_per_sqm, r.base_confidence) for r in rent.rent_choice(spark.createDataFrame(rows, "ward int, source string, period string, rent_per_sqm double, fee double"), 2026).collect()}
    assert got == {1: (2.0, 2), 2: (5.0, 0)}


def test_scores_at_their_bounds(spark):
    a = scoring.affordability
    assert one(spark, a(F.lit(80.0), F.lit(100.0)), a(F.lit(90.0), F.lit(100.0)), a(F.lit(100.0), F.lit(100.0))) == (100.0, 50.0, 0.0)
    c = scoring.commute_score
    assert one(spark, c(F.lit(15.0), F.lit(45.0)), c(F.lit(30.0), F.lit(45.0)), c(F.lit(45.0), F.lit(45.0))) == (100.0, 50.0, 0.0)


def test_exclusion_has_one_reason(spark):
    rows = [(None, 1.0), (50.0, 999.0), (20.0, 300.0), (20.0, 200.0)]
    df = spark.createDataFrame(rows, "c double, r double").select(scoring.exclusion(F.col("c"), F.lit(45.0), F.col("r"), F.lit(200.0)))
    assert [r[0] for r in df.collect()] == ["disconnected", "commute", "rent", None]


def test_roundings_differ(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,)], "x double")
    got = [tuple(r) for r in df.select(numbers.half_up(F.col("x")), numbers.half_even(F.col("x"))).collect()]
    assert got == [(1, 0.0), (2, 2.0), (3, 2.0), (0, -0.0)]


@pytest.mark.parametrize("hours, expected", [("24/7", True), ("Mo-Su 10:00-23:00", True), ("Mo-Su 10:00-22:59", False), ("18:00-29:00", True), ("Mo-Fr 10:00-23:30; Sa off", False), ("Mo-Sa 17:00-26:00", True), ("office 10:00-23:00", True), (None, None)])
def test_late_night(spark, hours, expected):
    assert one(spark, times.late_night(F.lit(hours).cast("string")))[0] is expected


def test_times(spark):
    m = times.gtfs_minutes
    assert one(spark, m(F.lit("25:30:00")), m(F.lit("07:29:30")), m(F.lit("7:61:00"))) == (1530.0, 449.5, None)
    p = times.period
    assert one(spark, p(F.lit(450.0)), p(F.lit(599.9)), p(F.lit(600.0)), p(F.lit(1440.0 + 450))) == ("peak", "peak", "offpeak", "peak")


def test_text(spark):
    s = text.similarity
    same, none, half = one(spark, s(F.lit("Tokyo"), F.lit("tokyo")), s(F.lit(None).cast("string"), F.lit("x")), s(F.lit("word"), F.lit("two words")))
    assert same == 1.0 and none == 0.0 and half == pytest.approx(4 / 11)
    assert one(spark, text.slug(F.lit(" Ｓhin-Koiwa  (Ward) ")), text.station_key(F.lit("Shibuya Station")), text.without_chome(F.lit("神南二丁目")), text.number(F.lit("1,234.5")), text.number(F.lit("x"))) == ("shin-koiwa-ward", "shibuya", "神南", 1234.5, None)


def test_min_max_of_a_constant_column_is_the_middle(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    assert [tuple(r) for r in metrics.min_max(df, ["a", "b"]).select("norm_a", "norm_b").collect()] == [(0.0, 50.0), (100.0, 50.0), (None, 50.0)]


def test_requests_are_judged(spark):
    schema = "request_id int, destination_id long, destination_lat double, destination_lon double, arrival_time string, budget double, layout string, max_commute int, preferences map<string,string>"
    rows = [(1, 5, None, None, "08:30", 1.0, "1K", 30, {"health": "low"}), (2, 5, 1.0, 2.0, "08:30", 1.0, "1K", 30, {"health": "low"}), (3, 5, None, None, "8:30", 1.0, "1K", 30, {"health": "low"}), (4, 5, None, None, "08:30", 1.0, "1K", 30, {}), (5, 5, None, None, "08:30", 1.0, "9K", 30, {"health": "low"})]
    assert [r.reason for r in scoring.valid_requests(spark.createDataFrame(rows, schema)).orderBy("request_id").collect()] == [None, "destination", "arrival_time", "preferences", "layout"]
