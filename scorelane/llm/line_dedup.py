"""Removal of repeated lines by overlapping windows of three lines.

A text is cut at line feeds. Every run of ``window`` consecutive lines is hashed to 128 bits; a
text of fewer lines is one shorter window. A window seen more than once in the whole input keeps
its first occurrence (by id, then text key, then position; null ids first) and the lines that any
later occurrence covers are removed. The first occurrence of a line is never covered, because a
window around it would have to be an earlier occurrence itself, so no wording is lost.

Defined cases: a null text has no lines and stays null; an empty text is one blank line; windows
of blank lines only are never repeats; rows that agree in id and text count as one document and
get the same result; further columns pass through, and the columns added here replace columns of
the same name. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.operators.workspace import spread_again

def _windows(lines: Column, window: int) -> Column:
    """Array of structs, one a window, of the hashes of its lines; a short text has one window."""
    hashed = F.transform(lines, lambda s: F.struct(F.xxhash64(s).alias("x"), F.xxhash64(F.lit(1), s).alias("y"), (F.trim(s) != "").alias("full")))
    return F.slice(F.arrays_zip(*[F.slice(hashed, k + 1, 1 << 30).alias(f"l{k}") for k in range(window)]), 1, F.greatest(F.size(lines) - (window - 1), F.lit(1)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """``docs`` with ``text_col`` cleaned and n_lines, n_removed and removed_spans added.

    removed_spans holds the merged covered runs as (first, last) line numbers from 0. Window
    counts are combined before the shuffle, so a window that fills a third of the corpus costs
    one row a task; the repeated windows are shuffled anew for the join with their occurrences, so
    that Spark may split the partition that a frequent one fills.
    """
    key = F.xxhash64(F.col(text_col))
    lines = F.split(F.col(text_col), "\n", -1)
    windows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), key.alias("key"), F.posexplode(_windows(lines, window)).alias("pos", "w"))
    windows = windows.filter(reduce(or_, (F.coalesce(F.col(f"w.l{k}.full"), F.lit(False)) for k in range(window))))
    hashed = [F.xxhash64(F.lit(h), *[F.col(f"w.l{k}.{h}") for k in range(window)]).alias(h) for h in ("x", "y")]
    occurrences = windows.select("id", "key", "pos", *hashed)
    place = F.struct("id", "key", "pos")
    repeated = occurrences.groupBy("x", "y").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    later = occurrences.join(spread_again(repeated, ["x", "y"]), ["x", "y"]).filter(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy(F.col("id").alias("_w_id"), F.col("key").alias("_w_key")).agg(F.collect_set("pos").alias("_w_starts"))

    # the lines cross the join as an array, so that expressions after it index them in place
    added = ("n_lines", "n_removed", "removed_spans")
    names = [c for c in docs.columns if c not in added]
    kept = docs.select(*[(lines if c == text_col else F.col(c)).alias(f"c{i}") for i, c in enumerate(names)], F.col(id_col).alias("_id"), key.alias("_key"))
    joined = kept.join(covered, F.col("_id").eqNullSafe(F.col("_w_id")) & (F.col("_key") == F.col("_w_key")), "left")
    own = F.col(f"c{names.index(text_col)}")
    last = F.size(own) - 1
    gone = F.coalesce(F.array_distinct(F.flatten(F.transform("_w_starts", lambda p: F.sequence(p, F.least(p + (window - 1), last))))), F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), last), gone)
    text = F.array_join(F.when(F.col("_w_starts").isNull(), own).otherwise(F.transform(left, lambda i: F.get(own, i))), "\n")
    firsts = F.array_sort(F.array_except(gone, F.transform(gone, lambda p: p + 1)))
    lasts = F.array_sort(F.array_except(gone, F.transform(gone, lambda p: p - 1)))
    spans = F.transform(F.arrays_zip(firsts.alias("first"), lasts.alias("last")), lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))
    return joined.select(
        *[(text if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)],
        F.when(own.isNull(), 0).otherwise(F.size(own)).alias("n_lines"),
        F.size(gone).alias("n_removed"),
        spans.alias("removed_spans"),
    )
