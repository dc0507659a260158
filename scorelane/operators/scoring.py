"""Scores of options, the tie and confidence policy, orders of options and their comparison."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scored(rows: DataFrame, temperature: float = 1.0, min_confidence: float | None = None) -> DataFrame:
    """Rows (ids array<string>, logits array<double>, ...) with the decision added.

    Adds log_probs, probs, top_option_id (smallest id among ties of the scaled maximum),
    confidence, tied, reason (tie before low_confidence), abstained. All per row; no shuffle.
    """
    out = rows.withColumn("scaled", F.transform("logits", lambda x: x / temperature))
    out = out.withColumn("_most", F.array_max("scaled"))
    # the smallest first, so that the order of options changes no bit of the sum
    shares = F.array_sort(F.transform("scaled", lambda x: F.exp(x - F.col("_most"))))
    out = out.withColumn("_z", F.log(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)))
    out = out.withColumn("log_probs", F.transform("scaled", lambda x: x - F.col("_most") - F.col("_z")))
    out = out.withColumn("probs", F.transform("log_probs", lambda x: F.exp(x)))
    best = F.filter("ids", lambda _, i: F.get(F.col("scaled"), i) == F.col("_most"))
    out = out.withColumn("top_option_id", F.array_min(best)).withColumn("tied", F.size(best) > 1).withColumn("confidence", F.array_max("probs"))
    low = F.lit(False) if min_confidence is None else F.col("confidence") < min_confidence
    out = out.withColumn("reason", F.when(F.col("tied"), "tie").when(low, "low_confidence"))
    return out.withColumn("abstained", F.col("reason").isNotNull()).drop("_most", "_z")


def judged(rows: DataFrame) -> DataFrame:
    """Scored rows with an answer_id: correct, gold_log_prob and the Brier sum added."""
    at = F.array_position("ids", F.col("answer_id")).cast("int") - 1
    brier = F.aggregate(F.transform("probs", lambda p, i: F.pow(p - (i == at).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("correct", (F.col("top_option_id") == F.col("answer_id")).cast("int")).withColumn("gold_log_prob", F.get("log_probs", at)).withColumn("brier", brier)


def winner(ids: Column, logits: Column) -> Column:
    """Smallest id among those of the largest raw logit."""
    return F.array_min(F.transform(F.filter(F.arrays_zip(ids.alias("i"), logits.alias("l")), lambda z: z["l"] == F.array_max(logits)), lambda z: z["i"]))


def align(ids: Column, logits: Column) -> Column:
    """Logits of a map in the order of the ids; null where one is missing."""
    return F.transform(ids, lambda i: F.element_at(logits, i))


def reversed_pair(options: Column) -> Column:
    return F.array(options, F.reverse(options))


def rotation(options: Column, by: Column | int) -> Column:
    by = F.lit(by) if isinstance(by, int) else by
    n = F.size(options)
    return F.concat(F.slice(options, by + 1, n), F.slice(options, F.lit(1), by))


def rotations(options: Column) -> Column:
    """All cyclic orders, the given one first."""
    return F.transform(F.sequence(F.lit(0), F.size(options) - 1), lambda k: rotation(options, k))


def permutations(options: Column, n: int) -> Column:
    """All orders of n options, by lexicographic index."""
    from itertools import permutations as orders

    return F.array(*[F.array(*[F.get(options, F.lit(i)) for i in order]) for order in orders(range(n))])


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two distributions over the same ids in the same order, at most ln 2.

    A component with mean m and half difference d contributes half of m((1+r)ln(1+r) + (1-r)ln(1-r))
    with r = d / m; near zero the even series of that function is used.
    """

    def term(z: Column) -> Column:
        m = (z["p"] + z["q"]) / 2
        r = F.abs(z["p"] - z["q"]) / F.nullif(2 * m, F.lit(0.0))
        series = sum(F.pow(r, F.lit(2.0 * k)) / (k * (2 * k - 1)) for k in range(1, 9)) / 2
        exact = ((1 + r) * F.log1p(r) + F.when(r < 1, (1 - r) * F.log1p(-r)).otherwise(0.0)) / 2
        return F.coalesce(m * F.when(r < 0.01, series).otherwise(exact), F.lit(0.0))

    total = F.aggregate(F.transform(F.arrays_zip(p.alias("p"), q.alias("q")), term), F.lit(0.0), lambda a, x: a + x)
    return F.least(total, F.lit(math.log(2)))


def parity(single: DataFrame, batch: DataFrame, key: str, most_logit: float = 0.125, most_prob: float = 0.02) -> DataFrame:
    """Largest differences of logits and probabilities of two runs over the same rows, and why one fails."""
    one = scored(single).select(F.col(key), F.col("logits").alias("l1"), F.col("probs").alias("p1"), F.col("top_option_id").alias("t1"))
    two = scored(batch).select(F.col(key), F.col("logits").alias("l2"), F.col("probs").alias("p2"), F.col("top_option_id").alias("t2"))
    gap = lambda a, b: F.array_max(F.transform(F.arrays_zip(a, b), lambda z: F.abs(z[a] - z[b])))
    both = one.join(two, key).select(key, gap("l1", "l2").alias("logit_gap"), gap("p1", "p2").alias("prob_gap"), (F.col("t1") == F.col("t2")).alias("same_top"))
    why = F.array_compact(F.array(F.when(F.col("logit_gap") > most_logit, F.lit("logit")), F.when(F.col("prob_gap") > most_prob, F.lit("probability"))))
    return both.withColumn("reasons", F.array_join(why, ","))


def both_directions(options: Column) -> Column:
    """All cyclic orders and those of the reversed list, each once, in order of first appearance."""
    return F.array_distinct(F.concat(rotations(options), rotations(F.reverse(options))))


def presentation_id(namespace: str, record: Column, order: Column) -> Column:
    """Digest of a namespace, a record and the order of its option ids."""
    return F.sha2(F.concat(F.lit(namespace), F.lit("|"), record, F.lit("|"), F.array_join(order, ",")), 256)


def calibration_status(profile: Column) -> Column:
    """Whether a calibration profile was named."""
    return F.when(profile.isNull(), "uncalibrated").otherwise("profile_id_supplied")


def orders(options: Column, only_given: Column | None = None) -> Column:
    """Orders in which options are shown: all of two or three, the rotations of four, eight or sixteen.

    Other numbers of options raise; rows for which ``only_given`` is true keep the given order.
    """
    n = F.size(options)
    wrong = F.raise_error(F.concat(F.lit("no orders for "), n.cast("string"), F.lit(" options"))).cast("array<array<string>>")
    out = F.when(n == 2, permutations(options, 2)).when(n == 3, permutations(options, 3)).when(n.isin(4, 8, 16), rotations(options)).otherwise(wrong)
    return out if only_given is None else F.when(only_given, F.array(options)).otherwise(out)


def presentation_digest(**fields: Column) -> Column:
    """Digest of the named fields of a presentation as canonical JSON, their names in order."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def joined_digest(*parts: Column) -> Column:
    """Digest of parts joined by a zero character; arrays give their items as parts."""
    return F.sha2(F.concat_ws("\0", *parts), 256)
