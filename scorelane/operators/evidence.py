"""Joins of panels, prompts, outputs and gold answers that say what doesn't fit, and checks of rows and bundles.

Every check returns all its findings as rows; ``demand`` raises on the first in order. Sides of a
join are reduced to one row a key before they meet, so a repeated key costs one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelane.functions.text import finite
from scorelane.operators import records as R
from scorelane.operators import scoring

IDENTITY = ["presentation_id", "record_id", "dataset_id", "source_group_id", "request_hash", "order_index", "order_ids"]


def demand(faults: DataFrame, what: str) -> None:
    """Raise ValueError with the first finding in order, if there is one."""
    first = faults.orderBy(*faults.columns).limit(1).collect()
    if first:
        raise ValueError(f"{what}: " + ", ".join(f"{c}={first[0][c]}" for c in faults.columns))


def _once(rows: DataFrame, key: list[str], cols: list[str], mark: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias(f"{mark}n"), *[F.first(c).alias(f"{mark}{c}") for c in cols])


def join_faults(left: DataFrame, right: DataFrame, key: list[str], same: list[str] = ()) -> DataFrame:
    """(key..., fault): keys missing on the right, unexpected there, repeated on a side, or with other values in ``same``."""
    both = _once(left, key, list(same), "_l").join(_once(right, key, list(same), "_r"), key, "full")
    tests = [
        (F.col("_rn").isNull(), "missing"), (F.col("_ln").isNull(), "unexpected"), (F.col("_ln") > 1, "repeated_left"), (F.col("_rn") > 1, "repeated_right"),
        *[(F.col("_ln").isNotNull() & F.col("_rn").isNotNull() & ~F.col(f"_l{c}").eqNullSafe(F.col(f"_r{c}")), f"differs: {c}") for c in same],
    ]
    return both.select(*key, F.explode(F.array_compact(F.array(*[F.when(t, F.lit(m)) for t, m in tests]))).alias("fault"))


def matched(left: DataFrame, right: DataFrame, key: list[str], same: list[str] = ()) -> DataFrame:
    """Rows of both sides with equal keys and equal ``same`` columns; the latter stay once."""
    return left.join(right, [*key, *same])


def zip_faults(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], same: list[str]) -> DataFrame:
    """(position, fault): rows of two ordered lists that differ at their place, or lack a partner."""
    a = R.numbered(left.select(*dict.fromkeys([*left_order, *same])), left_order, "position").select("position", *same)
    b = R.numbered(right.select(*dict.fromkeys([*right_order, *same])), right_order, "position").select("position", *same)
    return join_faults(a, b, ["position"], same)


def reused(old: DataFrame, panel: DataFrame, key: list[str], scored: list[str]) -> DataFrame:
    """Old outputs under the identity of the panel rows of the same meaning, with the old id as source_id.

    ``key`` may hold arrays (record, request hash, order of ids); old outputs outside the panel go.
    """
    own = old.select(*key, *scored, F.col("presentation_id").alias("source_id"))
    return panel.join(own, key)


def reuse_faults(old: DataFrame, panel: DataFrame, key: list[str], record: str, original: Column, dropped_dataset: str) -> DataFrame:
    """(record, fault) of a reuse that isn't exact.

    Every panel row must be among the old outputs; old rows that aren't in the panel must belong to
    ``dropped_dataset`` and be orders other than the original, and every such record must lack all of them.
    """
    absent = panel.join(old.select(*key), key, "left_anti").select(F.col(record).alias("record"), F.lit("not scored before").alias("fault"))
    rest = old.join(panel.select(*key), key, "left_anti")
    foreign = rest.filter((F.col("dataset_id") != dropped_dataset) | original).select(F.col(record).alias("record"), F.lit("not a dropped order").alias("fault"))
    kept = old.filter(F.col("dataset_id") == dropped_dataset).join(panel.select(*key, F.lit(1).alias("_in")), key, "left")
    partly = kept.filter(~original).groupBy(record).agg(F.count("_in").alias("_in")).filter("_in > 0").select(F.col(record).alias("record"), F.lit("an order was kept").alias("fault"))
    return absent.unionByName(foreign).unionByName(partly)


def looked_up(wanted: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """``wanted`` with the columns of the one candidate of its key; keys with none or several are left out (see join_faults)."""
    unique = candidates.join(candidates.groupBy(key).count().filter("count = 1").select(key), key, "left_semi")
    return wanted.join(unique, key)


def referenced(panel: DataFrame, records: DataFrame, key: str, position: str) -> DataFrame:
    """Records that a panel refers to, with the place at which each is first seen there."""
    return records.join(panel.groupBy(key).agg(F.min(position).alias("first_seen")), key)


def membership_faults(panel: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """(key, fault): records the panel never shows, panel rows without a record."""
    shown = panel.select(key).distinct()
    unused = records.join(shown, key, "left_anti").select(key, F.lit("not shown").alias("fault"))
    return unused.unionByName(shown.join(records.select(key), key, "left_anti").select(key, F.lit("no record").alias("fault")))


def regrouped(panel: DataFrame, records: DataFrame, aliased: list[str], namespace: str) -> DataFrame:
    """(record columns, fault): records under the group that the panel gives them.

    Datasets named in ``aliased`` must use a group "namespace:dataset:..."; all others the record's
    own. A record whose panel rows disagree, or break this, has a fault; the others null.
    """
    seen = panel.groupBy("record_id").agg(F.min("source_group_id").alias("_group"), F.max("source_group_id").alias("_other"))
    at = records.join(seen, "record_id")
    alias = F.col("dataset_id").isin(aliased)
    fits = F.when(alias, F.col("_group").startswith(F.concat(F.lit(f"{namespace}:"), F.col("dataset_id"), F.lit(":")))).otherwise(F.col("_group") == F.col("source_group_id"))
    fault = F.when(F.col("_group") != F.col("_other"), "several groups").when(~fits, F.when(alias, "no alias").otherwise("other group"))
    return at.withColumn("fault", fault).withColumn("source_group_id", F.col("_group")).drop("_group", "_other")


def prior_groups(panels: DataFrame) -> DataFrame:
    """(group_id, panels) of groups that more than one earlier panel (panel, group_id) holds; none if they are disjoint."""
    return panels.groupBy("group_id").agg(F.countDistinct("panel").alias("panels")).filter("panels > 1")


def panel_winners(panel: DataFrame, compiled: DataFrame, outputs: DataFrame) -> DataFrame:
    """(record_id, order_index, winner) of presentations, compiled prompts and outputs that fit together."""
    got = matched(panel, compiled, ["presentation_id"], ["request_hash", "order_ids"])
    got = matched(got, outputs.select("presentation_id", "input_tokens", "prompt_sha256", "candidate_logits"), ["presentation_id"], ["input_tokens", "prompt_sha256"])
    return got.select("record_id", "order_index", scoring.winner(F.col("order_ids"), F.col("candidate_logits")).alias("winner"))


def panel_faults(panel: DataFrame, compiled: DataFrame, outputs: DataFrame, orders: int) -> DataFrame:
    """(presentation_id, fault) of the three-way match, and of orders that are missing, repeated or no rotation."""
    one = join_faults(panel, compiled, ["presentation_id"], ["request_hash", "order_ids"]).withColumn("fault", F.concat(F.lit("prompt "), "fault"))
    two = join_faults(compiled, outputs, ["presentation_id"], ["input_tokens", "prompt_sha256"]).withColumn("fault", F.concat(F.lit("output "), "fault"))
    per = Window.partitionBy("record_id")
    start = F.first_value(F.when(F.col("order_index") == 0, F.col("order_ids")), ignoreNulls=True).over(per)
    sides = panel.withColumns({"_n": F.count("*").over(per), "_k": F.size(F.collect_set("order_index").over(per)), "_start": start})
    turned = scoring.rotation(F.col("_start"), F.col("order_index"))
    checks = [((F.col("_n") != orders) | (F.col("_k") != orders), "orders incomplete"), (F.col("_start").isNull() | (F.col("order_ids") != turned), "not the rotation")]
    three = sides.select("presentation_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for c, m in checks]))).alias("fault"))
    return one.unionByName(two).unionByName(three)


def output_faults(outputs: DataFrame, panel: DataFrame, most_tokens: int = 2048) -> DataFrame:
    """(presentation_id, fault) of output rows: identity, dimensions, finite logits, winner, prompt, tokens.

    panel has the columns of IDENTITY and prompt_sha256 of the rendered request.
    """
    identity = [c for c in IDENTITY if c != "presentation_id"]
    found = join_faults(panel, outputs, ["presentation_id"], identity)
    expected = panel.select("presentation_id", F.col("order_ids").alias("_ids"), F.col("prompt_sha256").alias("_prompt"))
    at = outputs.join(expected, "presentation_id")
    logits = F.col("candidate_logits")
    checks = [
        (F.size(logits) != F.size("_ids"), "logits don't match options"),
        (F.exists(logits, lambda x: ~finite(x)), "logit isn't finite"),
        (F.col("winner_option_id") != scoring.winner(F.col("_ids"), logits), "winner"),
        (F.col("prompt_sha256") != F.col("_prompt"), "prompt"),
        (~F.col("input_tokens").between(1, most_tokens), "tokens"),
    ]
    more = at.select("presentation_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for c, m in checks]))).alias("fault"))
    return found.unionByName(more)


def reload_parity(first: DataFrame, again: DataFrame, key: str, stored: DataFrame | None = None, most_logit: float = 0.125) -> DataFrame:
    """One row: rows compared, largest difference of logits, equal winners, and whether that passes.

    With ``stored`` (rows, logit_gap, same_winners) the recomputed summary must also equal it.
    """
    a = first.select(key, F.col("order_ids").alias("_ids"), F.col("candidate_logits").alias("_a"))
    both = a.join(again.select(key, F.col("candidate_logits").alias("_b")), key)
    gap = F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)))
    same = scoring.winner(F.col("_ids"), F.col("_a")) == scoring.winner(F.col("_ids"), F.col("_b"))
    got = both.agg(F.count("*").alias("rows"), F.max(gap).alias("logit_gap"), F.count_if(same).alias("same_winners"))
    passes = (F.col("logit_gap") <= most_logit) & (F.col("same_winners") == F.col("rows"))
    if stored is not None:
        told = stored.select(*[F.col(c).alias(f"_{c}") for c in ("rows", "logit_gap", "same_winners")])
        got = got.crossJoin(told)  # one row each
        passes = passes & reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("rows", "logit_gap", "same_winners")))
    return got.select("rows", "logit_gap", "same_winners", F.coalesce(passes, F.lit(False)).alias("passes"))


def allowed(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows of listed datasets only, before anything else looks at them; the filter reaches the files."""
    return rows.filter(F.col(column).isin(values))


def kind_of(dataset: Column, prefixes: dict[str, str], suffixes: dict[str, str]) -> Column:
    """The kind that the first fitting prefix, else the first fitting suffix, of a dataset's name gives; null without one."""
    out = F.lit(None).cast("string")
    for test, kind in reversed([*[(dataset.startswith(p), k) for p, k in prefixes.items()], *[(dataset.endswith(x), k) for x, k in suffixes.items()]]):
        out = F.when(test, kind).otherwise(out)
    return out


def count_faults(rows: DataFrame, by: list[str], expected: DataFrame) -> DataFrame:
    """(by..., n, expected) where counts differ from those declared; groups that one side lacks count as zero there."""
    got = rows.groupBy(*by).agg(F.count("*").alias("n"))
    both = got.join(expected.select(*by, "expected"), by, "full").fillna(0, ["n", "expected"])
    return both.filter("n <> expected")


def partition_faults(whole: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, fault): keys of the whole that no part or several parts hold, and keys of a part that the whole lacks."""
    every = reduce(DataFrame.unionByName, [p.select(key, F.lit(name).alias("part")) for name, p in parts.items()])
    held = every.groupBy(key).agg(F.count("*").alias("_n"))
    both = whole.groupBy(key).agg(F.count("*").alias("_w")).join(held, key, "full")
    fault = F.when(F.col("_w").isNull(), "not in the whole").when(F.col("_n").isNull(), "in no part").when(F.col("_n") != F.col("_w"), "in several parts")
    return both.select(key, fault.alias("fault")).filter("fault IS NOT NULL")


def selection_faults(selection: DataFrame, expected: DataFrame) -> DataFrame:
    """(selection, fault) of a recipe's selections (selection, source, split, row_id, item_id, group_id).

    Counts must be those declared, ids must not repeat within a selection, the digest of the sorted
    item ids must be the declared one, and the groups of one source must lie in one split.
    """
    ids = F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), "\n"), 256)
    got = selection.groupBy("selection").agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(f"d_{c}") for c in ("row_id", "item_id", "group_id")], ids.alias("digest"))
    both = got.join(expected.select("selection", F.col("n").alias("_n"), F.col("digest").alias("_digest")), "selection", "full")
    checks = [(F.col("n").isNull() | F.col("_n").isNull() | (F.col("n") != F.col("_n")), "count"), *[(F.col(f"d_{c}") < F.col("n"), f"repeated {c}") for c in ("row_id", "item_id", "group_id")], (F.col("digest") != F.col("_digest"), "digest")]
    one = both.select("selection", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))).alias("fault"))
    crossing = selection.groupBy("source", "group_id").agg(F.countDistinct("split").alias("k")).filter("k > 1").select("source", "group_id")
    two = selection.join(crossing, ["source", "group_id"], "left_semi").select("selection", F.lit("group crosses splits").alias("fault")).distinct()
    return one.unionByName(two)


def semantic_key(request: Column, normalized) -> Column:  # type: ignore[no-untyped-def]
    """Digest of a request's normalised words, its options in any order; ``normalized`` is a column function."""
    options = F.array_sort(F.transform(request["options"], lambda o: F.array(o["id"], o["label"], F.coalesce(o["description"], F.lit("")))))
    return normalized(F.to_json(F.struct(request["context"].alias("context"), request["question"].alias("question"), options.alias("options"))))


def candidate_summary(rows: DataFrame, held_out: DataFrame, labels: list[str]) -> DataFrame:
    """One row: groups that hold every label, rows of each label in them, and selected rows whose pair is held out.

    rows has source_group_id, answer_id, pair_key; held_out has pair_key.
    """
    full = rows.groupBy("source_group_id").agg(F.collect_set("answer_id").alias("_s")).filter(F.size(F.array_except(F.array(*map(F.lit, labels)), F.col("_s"))) == 0)
    eligible = rows.join(full.select("source_group_id"), "source_group_id", "left_semi")
    known = eligible.join(held_out.select("pair_key").distinct().withColumn("_held", F.lit(1)), "pair_key", "left")
    return known.agg(F.countDistinct("source_group_id").alias("groups"), *[F.count_if(F.col("answer_id") == x).alias(f"n_{x}") for x in labels], F.count("_held").alias("held_out_pairs"))


def identical_or_faulty(rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that agree in full become one; keys whose rows differ are returned apart as faults."""
    once = rows.dropDuplicates()
    several = once.groupBy(*key).count().filter("count > 1").select(*key)
    return once.join(several, key, "left_anti"), several
