"""Delimited and JSON statistics: rents, postal names, catalogues, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwise import config
from wardwise.functions.text import first_of, half_width, number, title, ward_key


def delimited(spark: SparkSession, path: str, encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """A CSV with quotes and line breaks inside them, cells trimmed, blank lines left out; all columns are text."""
    if encoding.upper() not in ("UTF-8", "UTF-16", "US-ASCII", "ISO-8859-1"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = spark.read.csv(path, header=header, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, encoding=encoding, inferSchema=False)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def as_tags(df: DataFrame) -> DataFrame:
    """All columns as one map, for headers that differ from release to release."""
    return df.select(F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns]), lambda e: e["v"].isNotNull())).alias("tags"))


def _matched(rows: DataFrame, wards: DataFrame) -> DataFrame:
    """Ward by five-digit code, else by name; wards: ward_code, name."""
    w = wards.select("ward_code", ward_key(F.col("name")).alias("_key"))
    by_code = F.broadcast(w.select(F.col("ward_code").alias("_code"), F.col("ward_code").alias("_w1")))
    by_name = F.broadcast(w.select("_key", F.col("ward_code").alias("_w2")))
    r = rows.withColumn("_code", F.substring(F.col("code"), 1, 5)).withColumn("_key", ward_key(F.col("area")))
    return r.join(by_code, "_code", "left").join(by_name, "_key", "left").withColumn("ward_code", F.coalesce("_w1", "_w2")).drop("_code", "_key", "_w1", "_w2")


def yearly_rents(tags: DataFrame, wards: DataFrame, period: str, per_tsubo: bool = False) -> DataFrame:
    """Ward rents of one survey with the reasons why a row cannot be used (null where it can)."""
    t = F.col("tags")
    rent = number(first_of(t, ["家賃(1㎡当たり)", "家賃（1㎡当たり）", "家賃(1平方m当たり)", "家賃(1畳当たり)", "rent_per_sqm_yen"]))
    rows = tags.select(first_of(t, ["地域コード", "code", "ward_code"]).alias("code"), first_of(t, ["地域", "area", "ward"]).alias("area"), (F.floor(rent / F.lit(config.TSUBO_SQM) + 0.5).cast("double") if per_tsubo else rent).alias("rent_per_sqm_yen"), _number_or(first_of(t, ["共益費・サービス費", "共益費", "management_fee_yen"]), 0.0).alias("management_fee_yen"), F.floor(number(first_of(t, ["標本数", "sample_count"])) + 0.5).cast("int").alias("sample_count"))
    return _judged(_matched(rows, wards).withColumn("period", F.lit(period)).withColumn("source", F.lit("estat")))


def quarterly_rents(tags: DataFrame, wards: DataFrame) -> DataFrame:
    """Ward rents by quarter; the period is given whole or as year and quarter."""
    t = F.col("tags")
    whole = first_of(t, ["period"])
    period = F.coalesce(whole, F.concat(first_of(t, ["year"]), F.lit("Q"), first_of(t, ["quarter"])))
    rows = tags.select(first_of(t, ["地域コード", "code", "ward_code"]).alias("code"), first_of(t, ["地域", "area", "ward"]).alias("area"), number(first_of(t, ["rent_per_sqm_yen"])).alias("rent_per_sqm_yen"), _number_or(first_of(t, ["management_fee_yen"]), 0.0).alias("management_fee_yen"), number(first_of(t, ["sample_count"])).cast("int").alias("sample_count"), period.alias("period"))
    judged = _judged(_matched(rows, wards).withColumn("source", F.lit("reins")))
    return judged.withColumn("reason", F.when(~F.coalesce(F.col("period").rlike("^\\d{4}Q[1-4]$"), F.lit(False)), "period").otherwise(F.col("reason")))


def _number_or(cell: Column, empty: float) -> Column:
    """A numeric cell, or what an empty one stands for; what is no number stays null, so that the row is rejected."""
    return F.when(F.coalesce(F.trim(cell), F.lit("")) == "", F.lit(empty)).otherwise(number(cell))


def _judged(rows: DataFrame) -> DataFrame:
    def out(c: str, bounds) -> Column:
        return ~F.coalesce(F.col(c).between(*bounds), F.lit(False))

    reason = F.when(F.col("ward_code").isNull(), "ward").when(out("rent_per_sqm_yen", config.RENT_RANGE), "rent").when(out("management_fee_yen", config.FEE_RANGE), "fee")
    return rows.withColumn("reason", reason)


def statistics_cube(spark: SparkSession, path: str) -> DataFrame:
    """VALUE cells of a statistical response, one or many: area, tab, unit, value. Read as text first, as its shape varies."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "GET_STATS_DATA struct<STATISTICAL_DATA: struct<DATA_INF: struct<VALUE: string>, TABLE_INF: struct<`@id`: string>>>").alias("j"))
    data = F.col("j.GET_STATS_DATA.STATISTICAL_DATA")
    text = data["DATA_INF"]["VALUE"]
    cell = "struct<`@area`: string, `@tab`: string, `@unit`: string, `$`: string>"
    many = F.when(F.substring(F.trim(text), 1, 1) == "[", F.from_json(text, f"array<{cell}>")).otherwise(F.array(F.from_json(text, cell)))
    return raw.select(data["TABLE_INF"]["@id"].alias("table_id"), F.explode(many).alias("c")).select("table_id", F.col("c.`@area`").alias("area"), F.col("c.`@tab`").alias("tab"), F.col("c.`@unit`").alias("unit"), number(F.col("c.`$`")).alias("value"))


def cube_problems(cells: DataFrame, table_id: str, expected: DataFrame) -> DataFrame:
    """Areas that a cube cannot be taken for: of another table, unknown, missing, repeated or without a value: area, problem. expected: area."""
    n = cells.groupBy("area").agg(F.count("*").alias("n"), F.count_if(F.col("table_id").eqNullSafe(table_id)).alias("own"), F.count("value").alias("values"))
    j = n.join(expected.select("area").distinct().withColumn("_e", F.lit(True)), "area", "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("own") < F.col("n"), "table").when(F.col("_e").isNull(), "unknown").when(F.col("n") > 1, "repeated").when(F.col("values") == 0, "value")
    return j.withColumn("problem", problem).where("problem is not null").select("area", "problem")


def rent_and_fee(rents: DataFrame, fees: DataFrame) -> DataFrame:
    """Two cubes as one row an area; a fee that is not there is 0."""
    return rents.select("area", F.col("value").alias("rent_per_sqm_yen")).join(fees.select("area", F.col("value").alias("management_fee_yen")), "area", "left").fillna(0.0, ["management_fee_yen"])


def postal_names(spark: SparkSession, path: str, prefecture: str = "東京都", encoding: str = "Shift_JIS") -> DataFrame:
    """Town names with their romanisation, of one prefecture's wards, without the row for towns not listed."""
    df = delimited(spark, path, encoding, header=False)
    names = ["postal", "pref", "city", "town", "pref_roman", "city_roman", "town_roman"]
    df = df.select(*[F.col(c).alias(n) for c, n in zip(df.columns, names)])
    town = F.regexp_replace("town", "（[^）]*）?", "")
    roman = title(F.trim(F.regexp_replace(F.regexp_replace("town_roman", "\\([^)]*\\)?", ""), "\\s+", " ")))
    ward = F.regexp_extract("city", "([^　 ]+区)$", 1)
    return df.where((F.col("pref") == prefecture) & (ward != "") & ~F.coalesce(F.col("town").contains("以下に掲載がない場合"), F.lit(False))).select("postal", ward.alias("ward_ja"), half_width(town).alias("town_ja"), roman.alias("town_en"))


def resolved_names(towns: DataFrame, index: DataFrame, overrides: DataFrame) -> DataFrame:
    """English town names: an override, else the only name that the index has; problem says why there is none.

    towns, index, overrides: ward_ja, town_ja (index, overrides: town_en).
    """
    keys = ["ward_ja", "town_ja"]
    i = index.groupBy(*keys).agg(F.collect_set("town_en").alias("names"))
    j = towns.join(overrides.select(*keys, F.col("town_en").alias("own")), keys, "left").join(i, keys, "left")
    name = F.coalesce("own", F.when(F.size("names") == 1, F.col("names")[0]))
    problem = F.when(name.isNull() & F.col("names").isNull(), "missing").when(name.isNull(), "ambiguous").when(~name.rlike("^[A-Za-z0-9][A-Za-z0-9 '\\-]*$"), "invalid")
    unused = overrides.join(towns, keys, "left_anti").select(*keys, F.lit(None).cast("string").alias("town_en"), F.lit("unused").alias("problem"))
    return j.select(*keys, name.alias("town_en"), problem.alias("problem")).unionByName(unused)


def preferred_names(names: DataFrame, sources: list[str]) -> DataFrame:
    """Of each key the name of the first source that has exactly one: key, source, name."""
    order = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    one = names.groupBy("key", "source").agg(F.collect_set("name").alias("n")).where(F.size("n") == 1).withColumn("o", order).where("o > 0")
    return one.groupBy("key").agg(F.min_by(F.col("n")[0], "o").alias("name"), F.min_by("source", "o").alias("source"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Datasets of a manifest with what is wrong with an entry (null if nothing): id, file, sha256."""
    schema = "version int, datasets array<struct<id: string, file: string, url: string, sha256: string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST").select("version", F.explode("datasets").alias("d")).select("version", "d.*")
    n = rows.groupBy("id").agg(F.count("*").alias("n"))
    empty = F.lit(False)
    for c in ("id", "file", "url", "sha256"):
        empty = empty | (F.coalesce(F.trim(F.col(c)), F.lit("")) == "")
    return rows.join(n, "id", "left").withColumn("problem", F.when(F.col("version") != 1, "version").when(empty, "empty").when(F.col("n") > 1, "repeated")).drop("n")


def checksums(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Whether each file of the manifest is there with its digest: status ok, wrong or missing."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("found"))
    j = manifest.select("id", "file", "sha256").join(files, "file", "left")
    return j.select("id", "file", F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.lower("sha256"), "ok").otherwise("wrong").alias("status"))
