"""Hard filters, scores, reasons and ranked shortlists for batches of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardwise import config
from wardwise.functions.numbers import half_up, one_decimal


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests with a ``reason`` where they break a rule: one form of destination, one to five rated axes, sensible limits."""
    rated = F.map_filter("preferences", lambda k, v: k.isin(*config.AXES) & v.isin(*config.IMPORTANCE))
    by_id, by_point = F.col("destination_id").isNotNull(), F.col("destination_lat").isNotNull() & F.col("destination_lon").isNotNull()
    reason = (
        F.when(by_id == by_point, "destination")
        .when(~F.size(rated).between(1, 5) | (F.size(rated) != F.size("preferences")), "preferences")
        .when(~F.coalesce(F.col("budget") > 0, F.lit(False)), "budget")
        .when(~F.coalesce(F.col("max_commute") > 0, F.lit(False)), "max_commute")
        .when(~F.coalesce(F.col("arrival_time").rlike("^([01]\\d|2[0-3]):[0-5]\\d$"), F.lit(False)), "arrival_time")
        .when(~F.coalesce(F.col("layout").isin(*config.LAYOUTS), F.lit(False)), "layout")
    )
    return requests.withColumn("reason", reason)


def exclusion(commute: Column, max_commute: Column, rent: Column, budget: Column) -> Column:
    """Why a candidate is out, the first reason only; null if it is in."""
    return F.when(commute.isNull(), "disconnected").when(commute > max_commute, "commute").when(rent > budget, "rent")


def affordability(rent: Column, budget: Column) -> Column:
    full = budget * config.FULL_AFFORDABILITY_RATIO
    return F.when(rent <= full, F.lit(100.0)).when(rent >= budget, F.lit(0.0)).otherwise(F.lit(100.0) * (budget - rent) / (budget - full))


def commute_score(minutes: Column, most: Column) -> Column:
    full = config.FULL_COMMUTE_MIN
    return F.when(minutes <= full, F.lit(100.0)).when(minutes >= most, F.lit(0.0)).otherwise(F.lit(100.0) * (most - minutes) / (most - full))


def diagnostics(candidates: DataFrame) -> DataFrame:
    """Counts by reason for each request; candidates: request_id, reason."""
    counts = [F.count_if(F.col("reason") == r).alias(f"excluded_{r}") for r in ("disconnected", "commute", "rent")]
    return candidates.groupBy("request_id").agg(F.count("*").alias("considered"), *counts, F.count_if(F.col("reason").isNull()).alias("feasible"))


def suggestions(candidates: DataFrame) -> DataFrame:
    """For requests without a feasible candidate: the main reason and the value to try. candidates: request_id, reason, commute, rent."""
    quartile = lambda c, r: F.expr(f"percentile({c}, 0.25) FILTER (WHERE reason = '{r}')")
    d = diagnostics(candidates).join(candidates.groupBy("request_id").agg(quartile("commute", "commute").alias("q_commute"), quartile("rent", "rent").alias("q_rent")), "request_id").where("feasible = 0")
    n = {r: F.col(f"excluded_{r}") for r in ("disconnected", "commute", "rent")}
    main = F.when((n["disconnected"] >= n["commute"]) & (n["disconnected"] >= n["rent"]), "disconnected").when(n["commute"] >= n["rent"], "commute").otherwise("rent")
    value = F.when(main == "commute", half_up(F.col("q_commute"))).when(main == "rent", half_up(F.col("q_rent") / 1000) * 1000)
    return d.select("request_id", main.alias("main_reason"), value.cast("long").alias("try_value"))


def factors(feasible: DataFrame, axes: DataFrame, preferences: DataFrame) -> DataFrame:
    """A row for each factor of a feasible candidate: key, component, weight, points and direction.

    feasible: request_id, locality, rent, commute, budget, max_commute; axes: locality, axis, score;
    preferences: request_id, axis, importance. Axes that are not rated have no factor.
    """
    value = F.element_at(F.create_map(*[F.lit(x) for kv in config.IMPORTANCE.items() for x in kv]), F.col("importance"))
    shares = preferences.withColumn("v", value).withColumn("share", F.col("v") / F.sum("v").over(Window.partitionBy("request_id"))).select("request_id", "axis", "share")
    life = feasible.select("request_id", "locality").join(shares, "request_id").join(axes, ["locality", "axis"]).select("request_id", "locality", F.col("axis").alias("key"), F.col("score").alias("component"), (F.lit(config.WEIGHTS["lifestyle"]) * F.col("share")).alias("weight"))
    own = feasible.select("request_id", "locality", F.explode(F.array(
        F.struct(F.lit("affordability").alias("key"), affordability(F.col("rent"), F.col("budget")).alias("component"), F.lit(config.WEIGHTS["affordability"]).alias("weight")),
        F.struct(F.lit("commute").alias("key"), commute_score(F.col("commute"), F.col("max_commute")).alias("component"), F.lit(config.WEIGHTS["commute"]).alias("weight")),
    )).alias("f")).select("request_id", "locality", "f.*")
    every = own.unionByName(life)
    direction = F.when(F.col("component") > config.POSITIVE, "positive").when(F.col("component") < config.NEGATIVE, "negative").otherwise("neutral")
    return every.withColumn("points", one_decimal(F.col("component") * F.col("weight"))).withColumn("direction", direction)


def shortlist(feasible: DataFrame, all_factors: DataFrame, limit: int = config.RESULTS) -> DataFrame:
    """The best candidates of each request: by score, then shorter commute, lower rent, id."""
    scores = all_factors.groupBy("request_id", "locality").agg(F.least(F.lit(100.0), one_decimal(F.round(F.sum("points"), 6))).alias("overall"))
    w = Window.partitionBy("request_id").orderBy(F.desc("overall"), "commute", "rent", "locality")
    return feasible.join(scores, ["request_id", "locality"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def reasons(all_factors: DataFrame, most: int = 3) -> DataFrame:
    """The first reasons for and against: by weight, then by distance from the threshold, then key."""
    gap = F.when(F.col("direction") == "positive", F.col("component")).otherwise(-F.col("component"))
    w = Window.partitionBy("request_id", "locality", "direction").orderBy(F.desc(F.round("weight", 9)), F.desc(gap), "key")
    return all_factors.where("direction <> 'neutral'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def extremes(all_factors: DataFrame) -> DataFrame:
    """Strongest and weakest factor and a description by the two strongest."""
    order = F.struct(F.col("component"), F.col("key"))
    g = all_factors.groupBy("request_id", "locality").agg(F.max_by("key", order).alias("strongest"), F.min_by("key", order).alias("weakest"), F.slice(F.sort_array(F.collect_list(F.struct("component", "key")), False), 1, 2).alias("top"))
    return g.select("request_id", "locality", "strongest", "weakest", F.array_join(F.transform("top", lambda x: x["key"]), " and ").alias("descriptor"))


def standouts(values: DataFrame, spread: float) -> DataFrame:
    """Metrics in which one member of a set is alone at the top, and far from the last: set_id, member, metric, value."""
    w = Window.partitionBy("set_id", "metric")
    v = values.withColumn("hi", F.max("value").over(w)).withColumn("lo", F.min("value").over(w))
    v = v.withColumn("winners", F.count_if(F.col("value") == F.col("hi")).over(w))
    return v.where((F.col("value") == F.col("hi")) & (F.col("winners") == 1) & (F.col("hi") - F.col("lo") >= spread)).select("set_id", "metric", "member", "value")


def concentration(ranked: DataFrame, top: int = 8) -> DataFrame:
    """How a shortlist's first places are spread over wards: request_id, ward, rank."""
    n = ranked.where(F.col("rank") <= top).groupBy("request_id", "ward").agg(F.count("*").alias("n"))
    all_n = F.sum("n").over(Window.partitionBy("request_id"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("n"), "ward"))
    kind = F.when(F.col("n") * 4 >= F.col("total") * 3, "three quarters").when(F.col("n") * 2 > F.col("total"), "majority").otherwise("spread")
    return n.withColumn("total", all_n).withColumn("place", place).where("place = 1").select("request_id", "ward", "n", "total", kind.alias("kind"))
