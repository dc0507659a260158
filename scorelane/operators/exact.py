"""Exact fractions of whole numbers: means of means, bootstraps of them, and gates on them.

A fraction is a pair of columns of decimal digits: whole numbers of any length, in lowest terms where
this module makes them. Spark adds the numerators of each denominator; the sums of a group, one a
denominator that occurs in it, meet in one row, where Python adds them. Nothing is rounded.
"""

from __future__ import annotations

import hashlib
import json
import random
import sys
from collections import defaultdict
from fractions import Fraction
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType

WIDE = "decimal(38,0)"
#: Digits of the pieces in which Spark adds long numerators; sums of 10^20 rows fit 38 digits.
PIECE = 18
MEAN = StructType().add("num", StringType()).add("den", StringType()).add("n", LongType())
GATE = StructType().add("delta", DoubleType()).add("passes", BooleanType())
#: Euclid's steps that two numbers of 19 digits need at most.
STEPS = 92


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of whole numbers above zero."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda z, _: F.when(z["b"] == 0, z).otherwise(F.struct(z["b"].alias("a"), (z["a"] % F.nullif(z["b"], F.lit(0))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda z: z["a"])


def lcm_all(values: Column) -> Column:
    """Least common multiple of an array of whole numbers above zero."""
    return F.aggregate(values, F.lit(1).cast("long"), lambda a, v: F.call_function("div", a, gcd(a, v)) * v.cast("long"))


def _added(parts: list[Fraction]) -> Fraction:
    """Sum of at least one fraction, in pairs, so that few additions are of long numbers."""
    while len(parts) > 1:
        parts = [a + b for a, b in zip_longest(parts[::2], parts[1::2], fillvalue=Fraction())]
    return parts[0]


@F.arrow_udf(MEAN)
def _mean_of(groups: pa.Array) -> pa.Array:
    """Mean of fractions given as sums: each (den, at, num, n) stands for n of them, which add up to num * 10^at / den."""
    sys.set_int_max_str_digits(0)
    out = []
    for parts in groups.to_pylist():
        sums: dict[str, int] = defaultdict(int)
        for p in parts:
            if p["num"] is not None:
                sums[p["den"]] += int(p["num"]) * 10 ** p["at"]
        n = sum(p["n"] for p in parts)
        mean = _added([Fraction(num, int(den)) for den, num in sums.items()]) / n if sums else None
        out.append({"num": None, "den": None, "n": n} if mean is None else {"num": str(mean.numerator), "den": str(mean.denominator), "n": n})
    return pa.array(out, pa.struct([("num", pa.string()), ("den", pa.string()), ("n", pa.int64())]))


@F.arrow_udf(DoubleType())
def ratio(num: pa.Array, den: pa.Array) -> pa.Array:
    """num / den as the nearest double, however long they are; null if one is."""
    sys.set_int_max_str_digits(0)
    return pa.array([None if a is None or b is None else int(a) / int(b) for a, b in zip(num.to_pylist(), den.to_pylist(), strict=True)], pa.float64())


def _mean(sums: DataFrame, by: list[str]) -> DataFrame:
    """(by..., num, den, n): mean of the fractions of each group, from their sums (by..., den, at, num, n)."""
    parts = F.collect_list(F.struct(F.col("den").cast("string").alias("den"), F.col("at").cast("int").alias("at"), F.col("num").cast("string").alias("num"), "n"))
    return sums.groupBy(*by).agg(parts.alias("_p")).select(*by, _mean_of("_p").alias("_m")).select(*by, "_m.*")


def group_fractions(rows: DataFrame, by: list[str], group: str = "source_group_id", record: str = "record_id") -> DataFrame:
    """(by..., group, num, den): exact accuracy of a group, orders weighing alike in a record, records alike in a group."""
    each = rows.groupBy(*by, group, record).agg(F.sum("correct").alias("c"), F.count("*").alias("den"))
    sums = each.groupBy(*by, group, "den").agg(F.sum("c").cast(WIDE).alias("num"), F.count("*").alias("n")).withColumn("at", F.lit(0))
    return _mean(sums, [*by, group]).drop("n")


def mean_of_groups(groups: DataFrame, by: list[str]) -> DataFrame:
    """(by..., num, den, n): exact mean of the groups' fractions."""
    num = F.col("num").cast("string")
    digits = F.ltrim(num, F.lit("-"))
    ends = F.sequence(F.length(digits), F.lit(1), F.lit(-PIECE))
    piece = lambda end: F.substring(digits, F.greatest(end - PIECE + 1, F.lit(1)), F.least(end, F.lit(PIECE))).cast(WIDE)
    signed = F.transform(ends, lambda end: F.when(num.startswith("-"), -piece(end)).otherwise(piece(end)))
    pieces = groups.select(*by, "den", F.posexplode(F.coalesce(signed, F.array(F.lit(None).cast(WIDE)))).alias("_i", "_piece"))
    sums = pieces.groupBy(*by, "den", "_i").agg(F.sum("_piece").alias("num"), F.count_if(F.col("_i") == 0).alias("n"))
    return _mean(sums.withColumn("at", F.col("_i") * PIECE), by)


@F.arrow_udf(GATE)
def _gate(num: pa.Array, den: pa.Array, base_num: pa.Array, base_den: pa.Array, min_num: pa.Array, min_den: pa.Array) -> pa.Array:
    """The value less its base as the nearest double, and whether the exact difference is at least the minimum; null if a number is."""
    sys.set_int_max_str_digits(0)
    out = []
    for texts in zip(*[c.to_pylist() for c in (num, den, base_num, base_den, min_num, min_den)], strict=True):
        a, b, c, d, e, f = (None if t is None else int(t) for t in texts)
        delta = None if None in (a, b, c, d) else Fraction(a, b) - Fraction(c, d)
        passes = None if delta is None or None in (e, f) else delta >= Fraction(e, f)
        out.append({"delta": None if delta is None else delta.numerator / delta.denominator, "passes": passes})
    return pa.array(out, pa.struct([("delta", pa.float64()), ("passes", pa.bool_())]))


def gates(values: DataFrame, specs: DataFrame, lows: DataFrame | None = None) -> DataFrame:
    """Each gate of ``specs`` (gate, task, final, base, min_num, min_den, strict) with its exact delta and verdict.

    values has (task, state, num, den), whole numbers of any length; lows (gate, low) are lower interval
    ends, which a strict gate needs above zero. A gate without values, or a strict one without its interval, fails.
    """
    side = lambda name: values.select("task", F.col("state").alias(name), F.col("num").alias(f"{name}_num"), F.col("den").alias(f"{name}_den"))
    got = specs.join(side("final"), ["task", "final"], "left").join(side("base"), ["task", "base"], "left")
    got = got.join(lows, "gate", "left") if lows is not None else got.withColumn("low", F.lit(None).cast("double"))
    numbers = [F.col(c).cast("string") for c in ("final_num", "final_den", "base_num", "base_den", "min_num", "min_den")]
    got = got.select("gate", "low", "strict", _gate(*numbers).alias("_g"))
    passes = F.col("_g.passes") & (~F.col("strict") | (F.col("low") > 0))
    return got.select("gate", F.col("_g.delta").alias("delta"), "low", F.coalesce(passes, F.lit(False)).alias("passes"))


def anchor_gates(values: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each anchor (gate, task, state, at_num, at_den, min_num, min_den): the value less the fixed fraction, and whether that is enough.

    Whole numbers of any length; a null task is a task of its own, and an anchor without a value fails.
    """
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"v.{c}")) for c in ("task", "state")]
    got = anchors.alias("a").join(values.select("task", "state", "num", "den").alias("v"), same, "left")
    numbers = [F.col(c).cast("string") for c in ("num", "den", "at_num", "at_den", "min_num", "min_den")]
    got = got.select("gate", _gate(*numbers).alias("_g"))
    return got.select("gate", F.col("_g.delta").alias("delta"), F.coalesce("_g.passes", F.lit(False)).alias("passes"))


def mean_ratio_intervals(groups: DataFrame, drawn: DataFrame, by: str) -> DataFrame:
    """Difference of two states: the point over all rows, the interval over means of group ratios.

    groups has (by, idx, hits, total, base_hits, base_total). The point is the difference of raw
    accuracies, each draw the mean of the drawn groups' differences of ratios.
    """
    ratio = F.col("hits") / F.col("total") - F.col("base_hits") / F.col("base_total")
    means = drawn.join(groups.select(by, "idx", ratio.alias("d")), [by, "idx"]).groupBy(by, "draw").agg(F.avg("d").alias("m"))
    ends = means.groupBy(by).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    point = groups.groupBy(by).agg((F.try_divide(F.sum("hits"), F.sum("total")) - F.try_divide(F.sum("base_hits"), F.sum("base_total"))).alias("difference"), F.count("*").alias("groups"))
    return point.join(ends, by).select(by, "groups", "difference", F.get("p", F.lit(0)).alias("low"), F.get("p", F.lit(1)).alias("high"))


def macro_intervals(deltas: DataFrame, drawn: DataFrame, by: str) -> DataFrame:
    """One row: mean over tasks of their mean delta, and the interval in which draw i of every task is averaged."""
    means = drawn.join(deltas, [by, "idx"]).groupBy(by, "draw").agg(F.avg("delta").alias("m"))
    macro = means.groupBy("draw").agg(F.avg("m").alias("m")).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    seen = deltas.groupBy(by).agg(F.avg("delta").alias("d")).agg(F.count("*").alias("tasks"), F.avg("d").alias("mean"))
    return seen.crossJoin(macro).select("tasks", "mean", F.get("p", F.lit(0)).alias("low"), F.get("p", F.lit(1)).alias("high"))  # one row each


def drawn_bank(seed: int, sizes: list[tuple[str, int]], draws: int) -> dict[str, list[list[int]]]:
    """Resampled places of each task from one Mersenne Twister, used up in task order."""
    rng = random.Random(seed)
    return {task: [[rng.randrange(n) for _ in range(n)] for _ in range(draws)] for task, n in sizes}


def bank_digest(bank: dict[str, list[list[int]]]) -> str:
    """SHA-256 of the bank as compact JSON, tasks in their order."""
    h = hashlib.sha256()
    for piece in json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).iterencode(bank):
        h.update(piece.encode())
    return h.hexdigest()
