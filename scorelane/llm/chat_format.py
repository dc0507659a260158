"""Chat formatting with perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and the others as named users; the mask marks the spans to learn from: the assistant's
words with their end mark. Roles in ``context_roles`` are context in every rendering and no
participant. DataFrame functions only.

A dialogue is rendered whole, however long. Where a turn begins is found before turns are gathered:
a running total of the lengths that turns have when all speak as users, corrected by what each own
turn before is longer or shorter as the assistant's. So a perspective's spans take one pass.

Defined cases: repeated rows are rendered once; turns sort by (turn, role, text), nulls first; a
null or empty role speaks as the user "unknown" and is no participant; a null text is empty; rows
with a null conversation are one conversation; a conversation without participants gives no row;
an empty table gives no rows; further columns don't take part, whatever their names. Marks inside
words are broken up ("<|" becomes "< |"), line ends and marks in names become "_".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT_ROLES = ("system",)
START, END = "<|im_start|>", "<|im_end|>\n"
OWN = START + "assistant\n"


def rotate(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """Rows (conv_id, perspective, n_turns, text, mask): mask holds (first, end) offsets in characters.

    Turns are dealt out by conversation once; repeats, running totals, spans and the dialogue all use
    that order. A conversation's turns end in one row, as its text does.
    """
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = messages.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.nullif(F.col(role_col), F.lit("")).alias("role"),
        F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        F.coalesce(F.col(text_col), F.lit("")).alias("said"),
    )
    said = said.repartition(parts, "conv_id").distinct()
    context = F.coalesce(F.col("role").isin(*context_roles), F.lit(False))
    name = F.regexp_replace(F.coalesce("role", F.lit("unknown")), r"[\r\n]|<\|", "_")
    head = F.concat(F.lit(START), F.when(context, F.lit("system")).otherwise(F.concat(F.lit("user name="), name)), F.lit("\n"))
    said = said.withColumn("head", head).withColumn("body", F.concat("text", F.lit(END))).withColumn("speaks", ~context & F.col("role").isNotNull())

    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("said")]
    run = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.length("head") + F.length("body")
    placed = said.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).withColumn("stop", F.sum(whole.cast("long")).over(run))
    own = Window.partitionBy("conv_id", "role").orderBy("nth")
    placed = placed.withColumn("before", F.row_number().over(own).cast("long"))
    end = F.col("stop") + F.col("before") * (F.lit(len(OWN)) - F.length("head"))
    span = F.struct((end - F.length("body")).alias("first"), end.alias("end"))

    spoken = placed.filter("speaks").groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(span)).alias("mask"))
    turns = F.array_sort(F.collect_list(F.struct("nth", "role", "head", "body")))
    dialogues = placed.groupBy(F.col("conv_id").alias("_conv")).agg(turns.alias("turns"))
    both = spoken.join(dialogues, F.col("conv_id").eqNullSafe(F.col("_conv")))

    def shown(m: Column) -> Column:
        return F.concat(F.when(F.coalesce(m["role"] == F.col("role"), F.lit(False)), F.lit(OWN)).otherwise(m["head"]), m["body"])

    return both.select("conv_id", F.col("role").alias("perspective"), F.size("turns").alias("n_turns"), F.array_join(F.transform("turns", shown), "").alias("text"), "mask")
