"""Metrics of judged rows, per group of columns ``by`` (none: over all rows).

Every metric is one aggregation, or two where classes, bins or confidences come first; sums are
combined before the shuffle, so a group that holds most rows costs one row a task. Running sums
are taken in ranges, never over all confidences in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelane.functions.text import confidence_bin, wilson
from scorelane.operators import records
from scorelane.operators.workspace import Workspace


def basic(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, accuracy (abstained rows count), nll (unclipped), brier, coverage and accepted_risk (null if none)."""
    kept = (~F.col("abstained")).cast("int")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("correct").alias("accuracy"),
        F.avg(-F.col("gold_log_prob")).alias("nll"),
        F.avg("brier").alias("brier"),
        F.avg(kept).alias("coverage"),
        F.try_divide(F.sum(kept * (1 - F.col("correct"))).cast("double"), F.sum(kept)).alias("accepted_risk"),
    )


def macro_f1(rows: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted mean of the F1 of all labels that are gold or predicted in the group."""
    roles = F.explode(F.array(F.struct(F.col("answer_id").alias("label"), F.lit(1).alias("gold")), F.struct(F.col("top_option_id").alias("label"), F.lit(0).alias("gold"))))
    sides = rows.select(*by, "correct", roles.alias("r")).groupBy(*by, F.col("r.label").alias("label"))
    counts = sides.agg(F.sum(F.col("r.gold") * F.col("correct")).alias("tp"), F.count("*").alias("both"))
    return counts.groupBy(*by).agg(F.avg(2.0 * F.col("tp") / F.col("both")).alias("macro_f1"))


def bins(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean confidence and accuracy of each of ten confidence bins that has rows."""
    return rows.groupBy(*by, confidence_bin(F.col("confidence")).alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("correct").alias("accuracy"))


def ece(rows: DataFrame, by: list[str]) -> DataFrame:
    """Expected calibration error over ten bins."""
    gap = F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))
    return bins(rows, by).groupBy(*by).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def risk_curve(rows: DataFrame, by: list[str], digits: int | None = None) -> DataFrame:
    """Coverage and risk after each distinct confidence, the highest first.

    Confidences are counted before the running sums, so the window sees distinct values. ``digits``
    rounds them first, for comparing with engines whose exponentials differ in the last bit; without
    it they are told apart as they are. The curve starts at (0, null), a row that isn't given here.
    """
    conf = F.col("confidence") if digits is None else F.round("confidence", digits)
    steps = rows.groupBy(*by, conf.alias("confidence")).agg(F.count("*").alias("k"), F.sum(1 - F.col("correct")).alias("wrong"))
    steps = records.running(steps, by, [F.col("confidence").desc()], {"seen": F.col("k"), "lost": F.col("wrong")})
    total = steps.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max("seen").alias("total"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)) if by else F.lit(True)  # one row without groups
    at = steps.join(total, same)
    return at.select(*by, "confidence", (F.col("seen") / F.col("total")).alias("coverage"), (F.col("lost") / F.col("seen")).alias("risk"), (F.col("k") / F.col("total")).alias("step"))


def aurc(rows: DataFrame, by: list[str], digits: int | None = None) -> DataFrame:
    """Area under the risk-coverage curve by right end points."""
    return risk_curve(rows, by, digits).groupBy(*by).agg(F.sum(F.col("step") * F.col("risk")).alias("aurc"))


def report(rows: DataFrame, by: list[str], digits: int | None = None) -> DataFrame:
    """All of the above, a row a group. The rows are written first, so they are scored once."""
    rows = Workspace(rows.sparkSession, "report").save(rows.select(*by, "correct", "gold_log_prob", "brier", "abstained", "confidence", "answer_id", "top_option_id"), "judged")
    parts = [basic(rows, by), macro_f1(rows, by), ece(rows, by), aurc(rows, by, digits)]
    if not by:
        return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    return reduce(lambda a, b: a.join(b, by), parts)


def macro_report(per_dataset: DataFrame) -> DataFrame:
    """Unweighted means of the datasets' metrics."""
    return per_dataset.agg(*[F.avg(c).alias(f"macro_dataset_{c}") for c in ("accuracy", "macro_f1", "nll", "brier", "ece")])


def confusion(rows: DataFrame, by: list[str], labels: list[str]) -> DataFrame:
    """Counts of gold against predicted, a row for each of the given labels in each group, zeros included.

    Gold labels that aren't given get a row where they occur.
    """
    gold, every = F.col("answer_id").alias("gold"), F.explode(F.array(*map(F.lit, labels))).alias("gold")
    there = rows.groupBy(*by, gold).agg(*[F.count_if(F.col("top_option_id") == x).alias(f"pred_{x}") for x in labels])
    groups = rows.select(*by).distinct().select(*by, every) if by else rows.sparkSession.range(1).select(every)
    blank = groups.select(*by, "gold", *[F.lit(0).cast("long").alias(f"pred_{x}") for x in labels])
    return there.unionByName(blank).groupBy(*by, "gold").agg(*[F.sum(f"pred_{x}").alias(f"pred_{x}") for x in labels])


def positions(rows: DataFrame) -> DataFrame:
    """How often the gold and the predicted option stand at each position."""
    where = F.explode(F.array(*[F.struct(F.lit(role).alias("role"), (F.array_position("ids", F.col(c)) - 1).cast("int").alias("position")) for role, c in (("gold", "answer_id"), ("predicted", "top_option_id"))]))
    return rows.select(where.alias("w")).groupBy("w.role", "w.position").agg(F.count("*").alias("n"))


def by_record(rows: DataFrame, by: list[str]) -> DataFrame:
    """Over the orders of each record: share right, all right, whether the winner changes, ties."""
    return rows.groupBy(*by, "record_id").agg(
        F.avg("correct").alias("share"), F.min("correct").alias("all_correct"), (F.min("top_option_id") != F.max("top_option_id")).cast("int").alias("flipped"), F.sum(F.col("tied").cast("int")).alias("ties"), F.count("*").alias("orders")
    )


def order_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Records, those right in all orders, flips, ties and the record-equal accuracy."""
    return by_record(rows, by).groupBy(*by).agg(F.count("*").alias("records"), F.sum("all_correct").alias("all_correct"), F.sum("flipped").alias("flips"), F.sum("ties").alias("ties"), F.avg("share").alias("record_accuracy"))


def group_accuracy(rows: DataFrame, by: list[str], group: str = "source_group_id") -> DataFrame:
    """Accuracy that gives every group the same weight, every record in it, and every order of a record."""
    records = by_record(rows, [*by, group])
    return records.groupBy(*by, group).agg(F.avg("share").alias("accuracy"), F.count("*").alias("records"))


def paired(left: DataFrame, right: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Counts of rows that both, only one or neither side gets right."""
    a, b = F.col("l"), F.col("r")
    both = left.select(key, *by, F.col("correct").alias("l")).join(right.select(key, F.col("correct").alias("r")), key)
    count = lambda c, name: F.sum(c.cast("int")).alias(name)
    return both.groupBy(*by).agg(count((a == 1) & (b == 1), "both"), count((a == 1) & (b == 0), "left_only"), count((a == 0) & (b == 1), "right_only"), count((a == 0) & (b == 0), "neither"))


def with_wilson(counts: DataFrame, hits: str, n: str) -> DataFrame:
    low, high = wilson(F.col(hits), F.col(n))
    return counts.withColumn("low", low).withColumn("high", high)


def exposure(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Row counts per value of each column, one pass by grouping sets."""
    sets = [[F.col(c)] for c in columns]
    out = rows.groupingSets(sets, *columns).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"_{c}") for c in columns])
    name = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in columns])
    value: Column = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns])
    return out.select(name.alias("column"), value.alias("value"), "n")


def strata(orders: DataFrame, columns: list[str]) -> DataFrame:
    """Per value of each column, in one pass: records, those right in the given order and in all, and flips."""
    first = F.max(F.when(F.col("order_index") == 0, F.col("correct"))).alias("original")
    rows = orders.groupBy("record_id", *columns).agg(first, F.min("correct").alias("every"), (F.min("top_option_id") != F.max("top_option_id")).cast("int").alias("flipped"))
    return rows.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count("*").alias("n"), F.sum("original").alias("original"), F.sum("every").alias("every"), F.sum("flipped").alias("flips"))


def unique_maxima(rows: DataFrame, by: list[str]) -> DataFrame:
    """Share of rows with a single best option, and the accuracy among these (null if none)."""
    return rows.groupBy(*by).agg(F.avg((~F.col("tied")).cast("int")).alias("coverage"), F.avg(F.when(~F.col("tied"), F.col("correct"))).alias("accuracy"))


def known_sum(x: Column) -> Column:
    """A sum that is unknown (null) once any term is."""
    return F.when(F.count(x) == F.count("*"), F.sum(x))


def pairs_of_models(rows: DataFrame, models: list[str], by: list[str]) -> DataFrame:
    """Every two models (left before right) over the records both have: rows, equal winners, both right.

    Rows hold model, record_id, top_option_id and correct. A record meets itself once a pair of models,
    so the join grows with the number of models and never with that of records squared.
    """
    left = rows.select("record_id", *by, F.col("model").alias("left_model"), F.col("top_option_id").alias("_l"), F.col("correct").alias("_lc"))
    right = rows.select("record_id", F.col("model").alias("right_model"), F.col("top_option_id").alias("_r"), F.col("correct").alias("_rc"))
    both = left.filter(F.col("left_model").isin(models)).join(right.filter(F.col("right_model").isin(models)), "record_id").filter("left_model < right_model")
    return both.groupBy("left_model", "right_model", *by).agg(F.count("*").alias("n"), F.sum((F.col("_l") == F.col("_r")).cast("int")).alias("agree"), F.sum(F.col("_lc") * F.col("_rc")).alias("both_correct"))


def winner_table(orders: DataFrame, n: int) -> DataFrame:
    """One row a record that has all n orders: the winner under each."""
    got = orders.groupBy("record_id").agg(F.countDistinct("order_index").alias("_n"), *[F.max(F.when(F.col("order_index") == k, F.col("top_option_id"))).alias(f"order_{k}") for k in range(n)])
    return got.filter(F.col("_n") == n).drop("_n")


def by_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., order_index, n, accuracy, ties) of each order in which options were shown."""
    return rows.groupBy(*by, "order_index").agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.count_if("tied").alias("ties"))


def repeats(rows: DataFrame, by: list[str], record: str) -> DataFrame:
    """(by..., records, rows, most, repeated): how often records are shown: in all, at most, and how many more than once."""
    per = rows.groupBy(*by, record).agg(F.count("*").alias("k"))
    return per.groupBy(*by).agg(F.count("*").alias("records"), F.sum("k").alias("rows"), F.max("k").alias("most"), F.count_if(F.col("k") > 1).alias("repeated"))


def shown_at(rows: DataFrame, by: list[str], ids: str, answer: str) -> DataFrame:
    """(by..., options, position, n): rows by their number of options and the place of the answer, from 0."""
    return rows.groupBy(*by, F.size(ids).alias("options"), (F.array_position(ids, F.col(answer)) - 1).cast("int").alias("position")).agg(F.count("*").alias("n"))
