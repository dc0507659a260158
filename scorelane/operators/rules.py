"""Solvers of routing and tool scenarios with missing facts."""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INSUFFICIENT, NO_ROUTE, NO_TOOL = "insufficient_information", "no_route", "no_eligible_tool"


def solve_routing(queries: DataFrame, domains: DataFrame, rules: DataFrame, features: list[str]) -> DataFrame:
    """(scenario_id, outcome): the destination all completions of the missing features agree on.

    queries has scenario_id and a column a feature (null: missing); domains has (feature, value);
    rules has a column a feature and destination. Unlisted completions go to no_route. Domains whose
    product passes 256 completions raise ValueError; so rules, one a completion at most, stay small
    enough to broadcast.
    """
    sizes = {r["feature"]: r["n"] for r in domains.groupBy("feature").agg(F.countDistinct("value").alias("n")).collect()}  # one row a feature
    if prod(sizes.get(f, 0) for f in features) > 256:
        raise ValueError("more than 256 completions")
    out = queries
    for f in features:
        values = domains.filter(F.col("feature") == f).agg(F.array_sort(F.collect_set("value")).alias(f"d_{f}"))
        out = out.crossJoin(F.broadcast(values)).withColumn(f, F.explode(F.when(F.col(f).isNull(), F.col(f"d_{f}")).otherwise(F.array(F.col(f))))).drop(f"d_{f}")
    met = out.join(F.broadcast(rules), features, "left").select("scenario_id", F.coalesce("destination", F.lit(NO_ROUTE)).alias("to"))
    got = met.groupBy("scenario_id").agg(F.min("to").alias("a"), F.max("to").alias("b"))
    return got.select("scenario_id", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(INSUFFICIENT).alias("outcome"))


def solve_tools(scenarios: DataFrame, ties: str = "raise") -> DataFrame:
    """(scenario_id, outcome): the cheapest tool that fits, if all completions of unknown permissions agree.

    scenarios has required array<string>, input string, permissions array<string>, granted
    array<boolean> (null: unknown) and tools array<struct<id, capabilities, inputs, needs, cost>>.
    A tie of the cheapest raises, or gives the outcome "tie" if ``ties`` is "mark"; no tool that fits
    gives no_eligible_tool.
    """
    unknown = F.transform(F.filter(F.arrays_zip(F.col("permissions").alias("p"), F.col("granted").alias("g")), lambda z: z["g"].isNull()), lambda z: z["p"])
    known = F.transform(F.filter(F.arrays_zip(F.col("permissions").alias("p"), F.col("granted").alias("g")), lambda z: z["g"]), lambda z: z["p"])
    bits = F.sequence(F.lit(0), F.pow(F.lit(2), F.size("unknown")).cast("int") - 1)
    open_ = scenarios.withColumn("unknown", unknown).withColumn("known", known)
    sets = F.transform(bits, lambda b: F.concat(F.col("known"), F.filter(F.col("unknown"), lambda _, i: F.getbit(b.cast("long"), i) == 1)))
    cases = open_.withColumn("have", F.explode(sets))
    fits = F.filter("tools", lambda t: (F.size(F.array_except(F.col("required"), t["capabilities"])) == 0) & F.array_contains(t["inputs"], F.col("input")) & (F.size(F.array_except(t["needs"], F.col("have"))) == 0))
    cases = cases.withColumn("fits", fits).withColumn("least", F.array_min(F.transform("fits", lambda t: t["cost"])))
    best = F.filter("fits", lambda t: t["cost"] == F.col("least"))
    outcome = F.when(F.size("fits") == 0, NO_TOOL).when(F.size(best) > 1, "tie").otherwise(F.get(best, F.lit(0))["id"])
    got = cases.select("scenario_id", outcome.alias("o")).groupBy("scenario_id").agg(F.min("o").alias("a"), F.max("o").alias("b"), F.max(F.col("o") == "tie").alias("t"))
    tie = F.lit("tie") if ties == "mark" else F.raise_error(F.concat(F.lit("the cheapest tools tie in scenario "), F.col("scenario_id").cast("string"))).cast("string")
    return got.select("scenario_id", F.when(F.col("t"), tie).when(F.col("a") == F.col("b"), F.col("a")).otherwise(INSUFFICIENT).alias("outcome"))
