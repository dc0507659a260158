"""Bootstrap intervals, exact gates and sequence checks."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelane.operators import records


def bank(spark: SparkSession, seed: int, sizes: list[tuple[str, int]], draws: int) -> DataFrame:
    """(task, draw, pos, idx) of resampled group numbers from one Mersenne Twister in task order.

    draws * groups numbers are made on the driver, because only that generator gives these draws;
    for banks that needn't match one, ``hashed_bank`` draws on the executors.
    """
    rng = random.Random(seed)
    rows = [(task, d, p, rng.randrange(n)) for task, n in sizes for d in range(draws) for p in range(n)]
    return spark.createDataFrame(rows, "task string, draw int, pos int, idx int")


def hashed_bank(groups: DataFrame, by: str, draws: int) -> DataFrame:
    """(by, draw, idx): as many hash-drawn group numbers a draw as the task has groups; groups has (by, n)."""
    size = 1 << 16  # positions that one array holds at most
    drawn = groups.select(by, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    drawn = drawn.select(by, "n", "draw", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size))).alias("part"))
    drawn = drawn.select(by, "n", "draw", F.explode(F.sequence(F.col("part") * size, F.least(F.col("n") - 1, F.col("part") * size + (size - 1)))).alias("pos"))
    head = F.substring(F.sha2(F.concat_ws(":", F.col(by), "draw", "pos"), 256), 1, 15)
    return drawn.select(by, "draw", (F.conv(head, 16, 10).cast("long") % F.col("n")).alias("idx"))


def intervals(deltas: DataFrame, drawn: DataFrame, by: str) -> DataFrame:
    """Observed mean of delta and the 2.5 and 97.5 % points (type 7) of the drawn means; deltas has (by, idx, delta)."""
    means = drawn.join(deltas, [by, "idx"]).groupBy(by, "draw").agg(F.avg("delta").alias("m"))
    points = means.groupBy(by).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    seen = deltas.groupBy(by).agg(F.avg("delta").alias("mean"), F.count("*").alias("groups"))
    return seen.join(points, by).select(by, "groups", "mean", F.get("p", F.lit(0)).alias("low"), F.get("p", F.lit(1)).alias("high"))


def ratio_intervals(groups: DataFrame, drawn: DataFrame, by: str) -> DataFrame:
    """Ratio of sums over all groups (idx, hits, total) and its interval over draws, each a ratio of sums as well."""
    point = groups.groupBy(by).agg(F.count("*").alias("groups"), F.try_divide(F.sum("hits"), F.sum("total")).alias("ratio"))
    each = drawn.join(groups.select(by, "idx", "hits", "total"), [by, "idx"]).groupBy(by, "draw").agg(F.try_divide(F.sum("hits"), F.sum("total")).alias("r"))
    ends = each.groupBy(by).agg(F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("e"))
    return point.join(ends, by).select(by, "groups", "ratio", F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """``rows`` with idx, their place from 0 within ``by``, in ranges (see records.running)."""
    return records.running(rows, [by], [F.col(order)], {"idx": F.lit(1).cast("long")}).withColumn("idx", F.col("idx") - 1)


def gate(num: Column, den: Column, limit_num: int, limit_den: int) -> Column:
    """num / den >= limit, at equality too, by whole numbers (den and limit_den above zero)."""
    wide = lambda c: c.cast("decimal(19,0)")
    return wide(num) * F.lit(limit_den).cast("decimal(19,0)") >= wide(den) * F.lit(limit_num).cast("decimal(19,0)")


def flip_gate(base: Column, now: Column) -> Column:
    """Flips fell by a quarter at least; from none, none may appear."""
    return F.when(base == 0, now == 0).otherwise(4 * (base - now) >= base)


def sequence_faults(events: DataFrame, by: str, order: str, time: str, kind: str, expected: list[str]) -> DataFrame:
    """Per group the rows whose time isn't after the one before, and whose kind isn't the expected one."""
    run = Window.partitionBy(by).orderBy(order)
    place = F.row_number().over(run)
    kinds = F.array(*map(F.lit, expected))
    marked = events.withColumn("_late", F.coalesce(F.col(time) <= F.lag(time).over(run), F.lit(False)).cast("int")).withColumn("_kind", (F.col(kind) != F.element_at(kinds, ((place - 1) % len(expected) + 1).cast("int"))).cast("int"))
    return marked.groupBy(by).agg(F.count("*").alias("n"), F.sum("_late").alias("late"), F.sum("_kind").alias("unexpected"))


def within_caps(steps: DataFrame, by: str, order: str, amount: str, cap: int) -> DataFrame:
    """Steps whose running total passes the cap; totals run in ranges, whatever one group holds."""
    return records.running(steps, [by], [F.col(order)], {"total": F.col(amount).cast("long")}).filter(F.col("total") > cap)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ledger_faults(done: DataFrame, plan: DataFrame, order: str, spec: str, category: str, caps: dict[str, int], total: int) -> DataFrame:
    """(order, fault) of a ledger of steps: what isn't the plan's step of its place, and what passes a cap.

    Steps are joined with the plan by place; counts a category and over all run in ranges, so the
    ledger may be of any length. Places the ledger hasn't reached are no fault.
    """
    at = done.select(order, spec, category).join(plan.select(F.col(order).alias("_o"), F.col(spec).alias("_spec")), F.col(order) == F.col("_o"), "left")
    wrong = at.select(order, F.when(F.col("_o").isNull(), "not planned").when(~F.col(spec).eqNullSafe(F.col("_spec")), "not the planned spec").alias("fault"))
    limits = F.create_map(*[x for c, n in caps.items() for x in (F.lit(c), F.lit(n))])
    own = records.running(done.select(order, category), [category], [F.col(order)], {"n": F.lit(1).cast("long")}).select(order, F.when(F.col("n") > F.coalesce(F.element_at(limits, F.col(category)), F.lit(0)), "category cap").alias("fault"))
    every = records.running(done.select(order), [], [F.col(order)], {"n": F.lit(1).cast("long")}).select(order, F.when(F.col("n") > total, "total cap").alias("fault"))
    return wrong.unionByName(own).unionByName(every).filter("fault IS NOT NULL")


def event_faults(events: DataFrame, by: str, order: str, time: str, kind: str, expected: list[str], calls: str) -> DataFrame:
    """(by, order, fault) of runs: kinds that aren't the expected one of their place, times that don't grow, and call lists that lose or repeat a call."""
    run = Window.partitionBy(by).orderBy(order)
    kinds, place = F.array(*map(F.lit, expected)), F.row_number().over(run)
    marked = events.withColumns({"_p": place, "_t": F.lag(time).over(run), "_c": F.lag(calls).over(run)})
    checks = [
        (~F.coalesce(F.get(kinds, F.col("_p") - 1), F.lit("")).eqNullSafe(F.col(kind)), "kind"), (F.col(time) <= F.col("_t"), "time"),
        (F.size(F.array_except(F.coalesce("_c", F.array().cast("array<string>")), calls)) > 0, "calls lost"), (F.size(F.array_distinct(calls)) < F.size(calls), "repeated call"),
    ]
    return marked.select(by, order, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))).alias("fault"))
