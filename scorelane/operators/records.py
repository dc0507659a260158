"""Audits, deduplication, source groups, selection and allocation of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelane.operators.components import connected_components
from scorelane.operators.workspace import Workspace


def crossing(rows: DataFrame, key: list[str], side: str = "split") -> DataFrame:
    """Keys found on more than one side, with the number of sides and rows."""
    got = rows.groupBy(*key).agg(F.countDistinct(side).alias("sides"), F.count("*").alias("n"))
    return got.filter("sides > 1")


def orphans(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return rows.join(dimension.select(key), key, "left_anti")


def bijection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys missing on the right, extra on the right, repeated on either side, and matched."""
    a = left.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("l"))
    b = right.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("r"))
    both = a.join(b, "k", "full")
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    return both.agg(count(F.col("r").isNull(), "missing"), count(F.col("l").isNull(), "extra"), count((F.col("l") > 1) | (F.col("r") > 1), "repeated"), count((F.col("l") == 1) & (F.col("r") == 1), "matched"))


def audit(records: DataFrame, datasets: DataFrame, held_out: list[str], partitioned: list[str]) -> DataFrame:
    """Violations (code, key): sources, groups and requests over splits, held-out families, ids, datasets.

    records has record_id, dataset_id, source_group_id, request_hash; datasets has dataset_id,
    source_id, task_family, split. All violations are returned, not the first.
    """
    at = records.join(datasets, "dataset_id")
    found = [
        crossing(datasets, ["source_id"]).filter(~F.col("source_id").isin(*partitioned, "")).select(F.lit("source_crosses_splits").alias("code"), F.col("source_id").alias("key")),
        datasets.filter(F.col("task_family").isin(*held_out, "") & (F.col("split") != "test")).select(F.lit("held_out_family").alias("code"), F.col("dataset_id").alias("key")),
        crossing(at, ["source_id", "source_group_id"]).select(F.lit("group_crosses_splits").alias("code"), F.concat_ws("/", "source_id", "source_group_id").alias("key")),
        crossing(at, ["request_hash"]).select(F.lit("request_crosses_splits").alias("code"), F.col("request_hash").alias("key")),
        records.groupBy("record_id").count().filter("count > 1").select(F.lit("repeated_record").alias("code"), F.col("record_id").alias("key")),
        orphans(records, datasets, "dataset_id").select(F.lit("unknown_dataset").alias("code"), F.col("record_id").alias("key")),
    ]
    return reduce(DataFrame.unionByName, found)


def dedup(rows: DataFrame, key: list[str], order: list[str], label: str, policy: str = "exclude") -> DataFrame:
    """One row a key, the smallest by ``order``; keys with several labels go ("exclude") or stay marked ("mark")."""
    row = F.struct(*[F.col(c) for c in [*order, *[c for c in rows.columns if c not in order]]])
    got = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.min(row).alias("row"), F.min(label).alias("_a"), F.max(label).alias("_b"))
    got = got.withColumn("conflict", ~F.col("_a").eqNullSafe(F.col("_b")))
    if policy == "exclude":
        return got.filter(~F.col("conflict")).select("row.*")
    return got.select("row.*", "conflict")


def source_groups(rows: DataFrame, id_col: str, anchors: list[tuple[str, Column]]) -> DataFrame:
    """(id, component): rows that share any anchor (kind, value), directly or by others; null values share nothing.

    Rows link to the smallest row of each anchor, a star, so a frequent anchor gives one link a row.
    """
    work = Workspace(rows.sparkSession, "groups")
    pairs = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in anchors])).alias("a")).filter(F.col("a.value").isNotNull())
    least = pairs.groupBy("a").agg(F.min("id").alias("root"))
    links = pairs.join(least, "a").select("id", "root")
    parts = connected_components(links, "id", "root", work)
    return rows.select(F.col(id_col).alias("id")).join(parts, F.col("id") == F.col("node"), "left").select(F.col("id").alias(id_col), F.coalesce("component", "id").alias("component"))


def first_per(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)


def allocate(rows: DataFrame, stratum: str, order: list[Column], quotas: list[tuple[str, int]]) -> DataFrame:
    """The head of each stratum's order, cut into the named parts by quota."""
    total = sum(n for _, n in quotas)
    out, part, before = first_per(rows, [stratum], order, total), F.lit(None).cast("string"), 0
    for name, n in quotas:
        part = F.when((F.col("place") > before) & (F.col("place") <= before + n), name).otherwise(part)
        before += n
    return out.withColumn("part", part)


def greedy(rows: DataFrame, strata: str, block: str, order: list[str], quota: int) -> list[tuple]:
    """Walk strata by name and candidates by order, skipping blocks used before, until each quota is met.

    The choice depends on all earlier ones, so it runs on the driver; only each stratum's best
    candidate of a block can be chosen, and of those at most quota * strata are ever needed.
    """
    names = [r[0] for r in rows.select(strata).distinct().orderBy(strata).collect()]
    best = first_per(rows.select(strata, block, *order), [strata, block], [F.col(c) for c in order])
    near = first_per(best.drop("place"), [strata], [F.col(c) for c in order], quota * max(1, len(names)))
    used, out = set(), []
    by_name: dict = {}
    for r in near.orderBy(strata, *order).collect():
        by_name.setdefault(r[strata], []).append(r)
    for name in names:
        taken = 0
        for r in by_name.get(name, []):
            if taken < quota and r[block] not in used:
                used.add(r[block])
                taken += 1
                out.append(tuple(r[c] for c in (strata, block, *order)))
    return out


def conflicting(rows: DataFrame, key: list[str], label: str) -> DataFrame:
    """(key..., labels): keys whose rows bear several labels."""
    return rows.groupBy(*key).agg(F.countDistinct(label).alias("labels")).filter("labels > 1")


def lowest_rank(rows: DataFrame, key: list[str], order: list[Column], label: str | None = None) -> DataFrame:
    """One row a key, the first by ``order``; with ``label``, a key of several labels raises ValueError."""
    if label is not None and not conflicting(rows, key, label).isEmpty():
        raise ValueError("repeated rows have conflicting answers")
    return first_per(rows, key, order).drop("place")


def not_one_to_one(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Values (side, value, others) that meet more than one value of the other column."""
    pairs = rows.select(left, right).distinct()
    found = [pairs.groupBy(F.col(a).cast("string").alias("value")).agg(F.count(b).alias("others")).filter("others > 1").select(F.lit(a).alias("side"), "value", "others") for a, b in ((left, right), (right, left))]
    return found[0].unionByName(found[1])


def separation(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """For each key, the number of its values that both sides hold; zero where they are apart."""
    found = [left.select(F.col(k).alias("v")).intersect(right.select(F.col(k).alias("v"))).agg(F.count("*").alias("shared")).select(F.lit(k).alias("key"), "shared") for k in keys]
    return reduce(DataFrame.unionByName, found)


def excluded(rows: DataFrame, *blocked: tuple[DataFrame, str]) -> DataFrame:
    """Rows that none of the (frame, column) lists names; null values are never named."""
    for frame, column in blocked:
        rows = rows.join(frame.select(column).distinct(), column, "left_anti")
    return rows


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in order, without gathering them: ranges are sorted and counted apart.

    Only one count a range meets in one task. The ranges are written, so a repeated task sees the same.
    """
    placed = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    placed = Workspace(rows.sparkSession, "numbered").save(placed, "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg(F.count("*").alias("_n")).select(F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = placed.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return inside.join(starts, F.col("_range") == F.col("_at")).withColumn(name, F.col("_start") + F.col("_place") - 1).drop("_range", "_at", "_start", "_place")


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running sums within each group, in order, the row itself included; no group is gathered.

    Rows are dealt out by ranges of (by, order), summed apart, and the sums of a group's ranges before
    are added; only one row a range and group meets in a window. The ranges are written, so a
    repeated task sees the same.
    """
    placed = rows.withColumns({f"_v_{n}": c for n, c in sums.items()}).repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id())
    placed = Workspace(rows.sparkSession, "running").save(placed, "ranges")
    per = placed.groupBy(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_range").alias("_at")).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    before = Window.partitionBy(*[f"_b_{c}" for c in by]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({f"_s_{n}": F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)) for n in sums})
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by), F.col("_range") == F.col("_at"))
    at = placed.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in sums}).join(per, same)
    return at.withColumns({n: F.col(n) + F.col(f"_s_{n}") for n in sums}).select(*rows.columns, *sums)


def balanced(rows: DataFrame, group: str, label: str, labels: list[str], group_rank: Column, order: list[Column], quota: int | None = None) -> DataFrame:
    """Groups that hold every label, dealt to the labels in turn by rank; of each, the first row of its label.

    With ``quota``, only so many groups a label are taken, those of the smallest ranks.
    """
    full = rows.filter(F.col(label).isin(labels)).groupBy(group).agg(F.countDistinct(label).alias("k")).filter(F.col("k") == len(labels))
    dealt = numbered(full.select(F.col(group).alias("_g"), group_rank.alias("_rank")), ["_rank", "_g"], "_i")
    dealt = dealt if quota is None else dealt.filter(F.col("_i") < quota * len(labels))
    dealt = dealt.select("_g", F.element_at(F.array(*map(F.lit, labels)), (F.col("_i") % len(labels) + 1).cast("int")).alias("_label"))
    return first_per(rows.join(dealt, (F.col(group) == F.col("_g")) & (F.col(label) == F.col("_label"))), [group], order).drop("place", "_g", "_label")


def representatives(rows: DataFrame, group: str, group_rank: Column, n: int, order: list[Column]) -> DataFrame:
    """Of the n groups of the smallest rank, the first row by ``order``."""
    top = rows.select(group, group_rank.alias("_rank")).distinct().orderBy("_rank", group).limit(n).select(group)
    return first_per(rows.join(top, group, "left_semi"), [group], order).drop("place")


def group_digests(rows: DataFrame, id_col: str, anchors: list[tuple[str, Column]]) -> DataFrame:
    """(id, group_id): as ``source_groups``, a group named by the SHA-256 of its distinct anchors in order.

    A group's anchors meet in one row, because its name is the digest of them all.
    """
    from scorelane.functions.text import canonical

    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in anchors])
    pairs = rows.select(F.col(id_col).alias("_id"), F.explode(kinds).alias("a")).filter("a.value IS NOT NULL").select("_id", F.array("a.kind", "a.value").alias("a")).distinct()
    parts = Workspace(rows.sparkSession, "named").save(source_groups(rows, id_col, anchors), "parts")
    own = pairs.join(parts, F.col("_id") == F.col(id_col)).groupBy("component").agg(F.array_sort(F.collect_set("a")).alias("every"))
    named = own.select(F.col("component").alias("_c"), F.sha2(canonical(F.to_json("every")), 256).alias("group_id"))
    return parts.join(named, F.col("component") == F.col("_c"), "left").select(id_col, "group_id")


def source_items(rows: DataFrame, key: list[str], anchors: list[tuple[str, str]], order: list[str], label: str, policy: str = "raise") -> tuple[DataFrame, DataFrame]:
    """Items of a source and one row of counts.

    Rows of one normalised key are one item: the smallest by ``order``. Anchors (kind, column) of all
    its rows, labelled or not, tie it to a group. Keys with several labels raise ("raise") or go
    ("exclude"). Counts: raw, unlabelled and conflicting rows, and pairs of each kind, and groups.
    """
    from scorelane.functions.text import canonical

    work = Workspace(rows.sparkSession, "items")
    rows = work.save(rows.withColumn("_key", canonical(F.to_json(F.array(*key)))), "rows")
    whole = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *[c for c in rows.columns if c != "_key"]])])
    per = rows.groupBy("_key").agg(F.min(F.when(F.col(label).isNotNull(), whole)).alias("row"), F.countDistinct(label).alias("labels"), F.count(label).alias("labelled"))
    per = work.save(per, "keys")
    if policy == "raise" and not per.filter("labels > 1").isEmpty():
        raise ValueError("repeated rows have conflicting labels")
    filled = [(kind, F.nullif(F.col(c), F.lit(""))) for kind, c in anchors]
    named = work.save(group_digests(rows.select("_key", *dict.fromkeys(c for _, c in anchors)).distinct(), "_key", filled).distinct(), "groups")
    items = per.filter("labels = 1").join(named, "_key").select(F.sha2("_key", 256).alias("item_id"), "group_id", "row.*")
    raw = rows.agg(F.count("*").alias("raw_rows"), F.count_if(F.col(label).isNull()).alias("unlabelled_rows"))
    counts = per.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("labels") > 1).alias("conflicting_pairs"), F.coalesce(F.sum(F.when(F.col("labels") > 1, F.col("labelled"))), F.lit(0)).alias("conflicting_rows"),
        F.count_if(F.col("labels") == 1).alias("consistent_pairs"), F.count_if(F.col("labels") == 0).alias("unlabelled_pairs"),
    )
    return items, raw.crossJoin(counts).crossJoin(named.agg(F.countDistinct("group_id").alias("groups")))  # one row each


def complete_groups(rows: DataFrame, group: str, label: str, labels: list[str], exact: bool = False) -> DataFrame:
    """(group) of the groups that hold every label; ``exact``: these labels and no other."""
    sets = rows.groupBy(group).agg(F.collect_set(label).alias("_s"))
    wanted = F.array(*map(F.lit, labels))
    full = F.size(F.array_except(wanted, "_s")) == 0
    return sets.filter(full & (F.size("_s") == len(set(labels))) if exact else full).select(group)


def label_order(label: Column) -> Column:
    """What labels sort by: whole numbers first, by value, then the others as text."""
    number = label.try_cast("long")
    return F.struct(number.isNull().alias("text"), number.alias("number"), label.alias("label"))
