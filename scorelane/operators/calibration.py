"""Temperature calibration by a grid search over weighted log losses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, HIGH, POINTS = 0.05, 10.0, 81


def grid() -> list[float]:
    """81 logarithmic steps from 0.05 to 10 with exact ends, and 1, in order."""
    step = (math.log(HIGH) - math.log(LOW)) / (POINTS - 1)
    inner = [math.exp(math.log(LOW) + i * step) for i in range(1, POINTS - 1)]
    return sorted({LOW, *inner, HIGH, 1.0})


def loss_at(logits: Column, gold: Column, temperature: Column) -> Column:
    """Negative log probability of the gold option at a temperature; the maximum goes first."""
    most = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp((x - most) / temperature))
    return F.log(total) - (F.get(logits, gold) - most) / temperature


def equal_weights(rows: DataFrame, by: str) -> DataFrame:
    """Rows with weight 1 / (rows of their group), counted by an aggregation and a join."""
    n = rows.groupBy(F.col(by).alias("_by")).agg((1.0 / F.count("*")).alias("weight"))
    return rows.join(n, F.col(by) == F.col("_by")).drop("_by")


def losses(rows: DataFrame, temperatures: list[float] | None = None) -> DataFrame:
    """(temperature, nll): weighted mean loss of rows (logits, gold_index, weight) at each grid point.

    The grid unrolls inside the row, an array of a fixed number of losses, and sums combine before
    the shuffle; no row is sent per grid point.
    """
    points = temperatures or grid()
    at = F.explode(F.arrays_zip(F.array(*map(F.lit, points)).alias("t"), F.array(*[F.col(f"s{i}") for i in range(len(points))]).alias("s")))
    values = rows.select("weight", F.transform(F.array(*map(F.lit, points)), lambda t: loss_at(F.col("logits"), F.col("gold_index"), t)).alias("l"))
    sums = values.agg(F.sum("weight").alias("w"), *[F.sum(F.col("weight") * F.get("l", F.lit(i))).alias(f"s{i}") for i in range(len(points))])
    return sums.select("w", at.alias("z")).select(F.col("z.t").alias("temperature"), (F.col("z.s") / F.col("w")).alias("nll"))


def fit(rows: DataFrame, temperatures: list[float] | None = None) -> DataFrame:
    """One row: the temperature nearest to 1 (in logarithm, then smaller) among the best within rounding."""
    table = losses(rows, temperatures)
    everything = Window.partitionBy()
    table = table.withColumn("least", F.min("nll").over(everything)).withColumn("raw", F.min(F.when(F.col("temperature") == 1.0, F.col("nll"))).over(everything))
    slack = F.greatest(F.lit(1e-15), 8 * F.lit(2.0**-52) * F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.abs("least"), F.lit(1.0)))))))
    good = table.filter((F.col("nll") <= F.col("least") + slack) & (F.col("nll") <= F.col("raw")))
    best = good.agg(F.min(F.struct(F.abs(F.log("temperature")).alias("d"), F.col("temperature").alias("t"), F.col("nll").alias("l"), F.col("raw").alias("r"))).alias("b"))
    return best.select(F.col("b.t").alias("temperature"), F.col("b.r").alias("raw_nll"), F.col("b.l").alias("fitted_nll"), F.col("b.t").isin(LOW, HIGH).alias("boundary_hit"))
