"""Mixing sources to target weights by entropy balancing.

Among all rates of documents whose tokens meet the target of every source, entropy balancing takes
the ones nearest (in relative entropy) to one copy of each document, none above ``most`` copies:
rate = min(most, exp(lambda * size)), with one lambda a source that solves the convex dual. Newton
steps on the logarithm of the source's tokens, kept inside a bracket, run as aggregations over the
counts of (source, size). Rates are then rounded: a document gets the whole copies of its rate and
one more if its hash falls below the fraction. What rounding misses of a target is repaired in
rounds: documents no larger than the gap, in hash order, gain or lose one copy as long as they fit.
DataFrame functions only; the tables of one row a source stay distributed and written.

Defined cases: a null text has size zero; null is a source of its own, last in order; sources
without words have target zero and take nothing; documents without words take nothing; repeated
rows (of one id and text) are numbered and their rates are rounded as one running quantity, so that
any number of them meets its share; columns pass through whatever their names; texts of any length
are counted whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelane.llm.common import WORD
from scorelane.operators.workspace import Workspace

MOST = 3
WEIGHTS = (1, 2, 3)
#: Newton steps at most; whether all sources are close is looked up after every third.
STEPS = 30
CLOSE = 1e-9
#: Rounds that repair rounding, and hash places in each.
REPAIRS, PLACES = 3, 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(sid, source, source_size, target) of the sources of rows (source, size).

    Weights repeat over the sources in code point order, null last. A target stops at ``most``
    times its source's size; the level at which the others share the rest is the largest of the
    levels that result if the sources of the smallest ratios are stopped. The windows run over one
    row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("top", (most * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("top") / F.col("weight"), "sid")
    stopped = F.coalesce(F.sum("top").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sharing = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    level = per.withColumn("level", (total - stopped) / sharing).withColumn("level", F.max("level").over(Window.partitionBy()))
    return level.select("sid", "source", "source_size", F.least(F.col("weight") * F.col("level"), F.col("top")).alias("target"))


def _rate(size: Column, most: int) -> Column:
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.exp(F.least(F.col("lam") * size / F.col("scale"), F.lit(50.0))), F.lit(float(most))))


def _newton(state: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """One step of every source: tokens and slope at lambda, then a step inside the bracket."""
    at = counts.join(state, "sid")
    mass = F.col("n") * F.col("size") * _rate(F.col("size"), most)
    free = F.col("lam") * F.col("size") / F.col("scale") < F.log(F.lit(float(most)))
    sums = at.groupBy("sid").agg(F.sum(mass).alias("f"), F.sum(F.when(free, mass * F.col("size") / F.col("scale")).otherwise(0.0)).alias("d"))
    now = state.drop("gap").join(sums, "sid")
    lam, low, high = F.col("lam"), F.col("low"), F.col("high")
    over = F.col("f") > F.col("target")
    now = now.withColumn("high", F.when(over, lam).otherwise(high)).withColumn("low", F.when(over, low).otherwise(lam))
    step = lam - F.log(F.col("f") / F.col("target")) * F.col("f") / F.nullif(F.col("d"), F.lit(0.0))
    inside = (step > F.coalesce(low, step - 1)) & (step < F.coalesce(high, step + 1)) & (F.abs(step - lam) < 8 * (1 + F.abs(lam)))
    other = F.coalesce((low + high) / 2, F.when(over, lam - 2 * (1 + F.abs(lam))).otherwise(lam + 2 * (1 + F.abs(lam))))
    gap = F.abs(F.col("f") / F.col("target") - 1)
    moved = F.when(F.col("full") | (gap < CLOSE), lam).when(F.coalesce(inside, F.lit(False)), step).otherwise(other)
    return now.select("sid", "target", "full", "scale", moved.alias("lam"), "low", "high", F.when(F.col("full"), 0.0).otherwise(gap).alias("gap"))


def solve(counts: DataFrame, goals: DataFrame, work: Workspace, most: int = MOST) -> DataFrame:
    """(sid, full, scale, lam) of every source with words; counts holds (sid, size, n)."""
    mean = counts.groupBy("sid").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    none = F.lit(None).cast("double")
    state = goals.join(mean, "sid").select("sid", "target", (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("full"), "scale", F.lit(0.0).alias("lam"), none.alias("low"), none.alias("high"), F.lit(1.0).alias("gap"))
    for step in range(1, STEPS + 1):
        state = work.save(_newton(state, counts, most), "lambda")
        if step % 3 == 0 and (state.agg(F.max("gap")).first()[0] or 0.0) < CLOSE:
            break
    return state.select("sid", "full", "scale", "lam")


def _place(salt: int) -> Column:
    own = F.when(F.col("nth") == 0, F.col("u")).otherwise(F.xxhash64("u", "nth"))
    return F.pmod(F.xxhash64(F.lit(salt), own), F.lit(PLACES)).cast("int")


def _repaired(copies: Column, k: int, most: int) -> Column:
    """Copies after round k: documents up to the round's last place and no larger than its gap."""
    gap, last = F.col(f"gap{k}"), F.col(f"last{k}")
    chosen = (F.col("size") > 0) & (F.col("size") <= F.abs(gap)) & (_place(k + 1) <= last)
    step = F.when(F.coalesce(chosen, F.lit(False)), F.signum(gap).cast("long")).otherwise(0)
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(most).cast("long"), copies + step))


def _copies(rows: DataFrame, plan: DataFrame, rounds: int, most: int) -> DataFrame:
    """``rows`` (source, size, u, nth) with the columns of their source, rate and copies after the rounds.

    Row n of equal ones gets what the running total of their rates, less the fraction of their hash,
    passes in whole numbers between n and n + 1; a single row gets the whole copies of its rate and
    one more if its fraction is above the hash's.
    """
    at = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    at = at.withColumn("rate", F.when(F.col("size") > 0, F.coalesce(_rate(F.col("size"), most), F.lit(0.0))).otherwise(0.0))
    part = F.pmod(F.col("u"), F.lit(1 << 30)) / float(1 << 30)
    passed = lambda n: F.ceil(n * F.col("rate") - part)
    copies = (passed(F.col("nth") + 1) - passed(F.col("nth"))).cast("long")
    for k in range(rounds):
        at = at.withColumn("copies", copies)
        copies = _repaired(F.col("copies"), k, most)
    return at.withColumn("copies", copies).drop("full", "scale", "lam", *[f"{c}{k}" for k in range(rounds) for c in ("gap", "last")])


def words(text: Column) -> Column:
    """Number of words of a text, zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.lit("mix"), F.col(id_col), F.xxhash64(F.col(text_col))).alias("u")]


def _repeats(rows: DataFrame, work: Workspace) -> DataFrame | None:
    """The hashes u that several rows bear; None if there are none."""
    again = work.save(rows.groupBy("u").agg(F.count("*").alias("_n")).filter("_n > 1").select("u"), "repeated")
    return None if again.isEmpty() else again


def _numbered(rows: DataFrame, again: DataFrame | None, work: Workspace) -> DataFrame:
    """``rows`` with nth, which numbers rows of one hash u from 0; which of equal rows gets which number doesn't matter.

    Only repeated rows are moved. They are numbered within the parts they were read in, after those
    of the parts before, so one row repeated a billion times isn't gathered in one task.
    """
    if again is None:
        return rows.withColumn("nth", F.lit(0).cast("long"))
    alone = rows.join(again, "u", "left_anti").withColumn("nth", F.lit(0).cast("long"))
    many = work.save(rows.join(again, "u", "left_semi").withColumn("_part", F.spark_partition_id()), "parts")
    before = Window.partitionBy("_u").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = many.groupBy(F.col("u").alias("_u"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = many.withColumn("_row", F.row_number().over(Window.partitionBy("u", "_part").orderBy("size")))
    placed = inside.join(starts, (F.col("u") == F.col("_u")) & (F.col("_part") == F.col("_p"))).withColumn("nth", (F.col("_start") + F.col("_row") - 1).cast("long"))
    return alone.unionByName(placed.drop("_u", "_p", "_part", "_row", "_start"))


def plan(rows: DataFrame, work: Workspace, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a source: its target, dual variable, and the gap and last place of each repair."""
    goals = work.save(targets(rows, weights, most), "targets")
    named = goals.select("sid", F.col("source").alias("_s"))
    counts = rows.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")).join(named, F.col("source").eqNullSafe(F.col("_s")))
    counts = work.save(counts.select("sid", "size", "n"), "counts")
    rates = solve(counts, goals, work, most)
    state = work.save(goals.withColumnRenamed("source", "_s").join(rates, "sid", "left"), "rates")
    known = work.save(_copies(rows, state, 0, most).select("sid", "target", "size", "u", "nth", "copies"), "rounded")
    for k in range(REPAIRS):
        gaps = work.save(known.groupBy("sid").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias(f"gap{k}")), "gaps")
        own = gaps.select(F.col("sid").alias("_sid"), F.col(f"gap{k}").alias("gap"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & (((F.col("gap") > 0) & (F.col("copies") < most)) | ((F.col("gap") < 0) & (F.col("copies") > 0)))
        placed = known.join(own, F.col("sid") == F.col("_sid")).filter(fits).groupBy("sid", _place(k + 1).alias("place")).agg(F.sum("size").alias("t"), F.max(F.abs("gap")).alias("room"))
        running = F.sum("t").over(Window.partitionBy("sid").orderBy("place"))
        last = placed.withColumn("c", running).filter("c <= room").groupBy("sid").agg(F.max("place").alias(f"last{k}"))
        step = work.save(gaps.join(last, "sid", "left"), "repair")
        state = state.join(step, "sid", "left")
        if k + 1 < REPAIRS:
            moved = known.join(step.withColumnRenamed("sid", "_sid"), F.col("sid") == F.col("_sid"), "left").withColumn("copies", _repaired(F.col("copies"), k, most))
            known = work.save(moved.select("sid", "target", "size", "u", "nth", "copies"), "rounded")
    return work.save(state, "plan")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Rows (id, size, source_size, target, rate, copies, taken) of all documents.

    Texts are read once, to count their words. Everything after works on rows of a few numbers;
    sources are joined as a table of one row each, whose size Spark checks before it broadcasts.
    """
    work = Workspace(docs.sparkSession, "mix")
    rows = work.save(docs.select(F.col(id_col).alias("id"), *_sized(docs, id_col, text_col, source_col)), "sizes")
    rows = _numbered(rows, _repeats(rows, work), work)
    done = _copies(rows, plan(rows.drop("id"), work, weights, most), REPAIRS, most)
    return done.select(F.col("id").alias(id_col), "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the mix takes it; texts aren't shuffled
    as long as the tables of sources and of repeated rows are small enough to broadcast."""
    work = Workspace(docs.sparkSession, "mix")
    rows = work.save(docs.select(*_sized(docs, id_col, text_col, source_col)), "sizes")
    again = _repeats(rows, work)
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), *_sized(docs, id_col, text_col, source_col))
    done = _copies(_numbered(whole, again, work), plan(_numbered(rows, again, work), work, weights, most), REPAIRS, most)
    return done.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
