"""Generated scenarios, training schedules and digests of panels."""

from __future__ import annotations

from functools import reduce
from itertools import permutations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.operators import records
from scorelane.operators.workspace import Workspace


def draw(salt: str, row: Column, field: str, n: int) -> Column:
    """A number from 0 to n - 1 that a digest of (salt, field, row) gives."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(salt), F.lit(field), row), 256), 1, 8), 16, 10).cast("long") % n


def comparisons(spark: SparkSession, n: int, salt: str, families: int = 4) -> DataFrame:
    """n generated questions that ask for the larger or smaller of three amounts, with the answer.

    Rows follow from their number alone, so partitions make them side by side; amounts are made
    distinct by their place.
    """
    row = F.col("id")
    rows = spark.range(n).select("id", draw(salt, row, "family", families).alias("family"), (draw(salt, row, "ask", 2) == 0).alias("largest"), *[(draw(salt, row, f"amount{i}", 100) * 3 + i).alias(f"v{i}") for i in range(3)])
    return rows.select("id", "family", "largest", "v0", "v1", "v2", answer_of([F.col(f"v{i}") for i in range(3)], F.col("largest")).alias("answer"))


def answer_of(values: list[Column], largest: Column) -> Column:
    best = F.when(largest, F.greatest(*values)).otherwise(F.least(*values))
    return F.coalesce(*[F.when(v == best, F.lit(f"o{i}")) for i, v in enumerate(values)])


def interleave(streams: list[DataFrame], order: list[str], cycles: list[bool], width: int = 4) -> DataFrame:
    """One schedule of several streams: step i takes row i of each; streams that cycle start again.

    Streams have the columns record_id and ``order``; steps are as many as the longest stream that
    doesn't cycle has rows. Adds update (steps go ``width`` to one) and slot.
    """
    numbered = [s.select("record_id", F.col("i").cast("long"), F.lit(k).alias("stream")) for k, s in enumerate(records.numbered(s, order, "i") for s in streams)]
    sizes = [n.count() for n in numbered]
    steps = streams[0].sparkSession.range(max([n for n, cycle in zip(sizes, cycles, strict=True) if not cycle], default=0)).select(F.col("id").alias("step"))
    parts = []
    for own, size, cycle in zip(numbered, sizes, cycles, strict=True):
        if size:
            at = steps.withColumn("_i", F.col("step") % size if cycle else F.col("step"))
            parts.append(own.join(at, F.col("i") == F.col("_i")).select("record_id", "step", "stream"))
    out = reduce(DataFrame.unionByName, parts) if parts else steps.limit(0).select(F.lit(None).cast("string").alias("record_id"), "step", F.lit(0).alias("stream"))
    place = F.col("step") * len(streams) + F.col("stream")
    return out.withColumn("update", F.floor(place / width)).withColumn("slot", (place % width).cast("int"))


def panel_digest(rows: DataFrame, by: str, group: str, item: str) -> DataFrame:
    """A digest a panel that fixes its groups and their items: of the group digests in order, each of its items in order."""
    groups = rows.groupBy(by, group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(item)), "\n"), 256).alias("d"))
    return groups.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(group, "d"))), lambda s: s["d"]), "\n"), 256).alias("digest"))


def truth_table_form(sizes: list[int], outcomes: dict[tuple[int, ...], str]) -> str:
    """A text that rule tables share if renaming features, their values and their outcomes makes them equal.

    All orders of the features and of each feature's values are tried (four of each at most); an
    outcome is named by its first appearance, the missing one by a dash; the smallest text is taken.
    """
    best = None
    for order in permutations(range(len(sizes))):
        turned = [sizes[f] for f in order]
        for names in product(*[permutations(range(n)) for n in turned]):
            seen: dict[str, int] = {}
            cells = []
            for cell in product(*map(range, turned)):
                key = [0] * len(sizes)
                for place, f in enumerate(order):
                    key[f] = names[place][cell[place]]
                to = outcomes.get(tuple(key))
                cells.append("-" if to is None else str(seen.setdefault(to, len(seen))))
            text = ",".join(map(str, turned)) + ":" + ".".join(cells)
            best = text if best is None or text < best else best
    return best or ""


def epoch_examples(rows: DataFrame, seed: int, epoch: int) -> DataFrame:
    """(place, record_id, option_ids, gold_index): records and then each one's options shuffled by one Mersenne Twister.

    rows has place, record_id, option_ids and answer_id; the twister starts at seed + epoch and is
    used up in order, so an epoch is one task: its ids must fit a worker, texts stay behind.
    """
    import random

    import pandas as pd

    def shuffle(part: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(seed + epoch)
        order = list(part.sort_values("place").itertuples(index=False))
        rng.shuffle(order)
        out = []
        for r in order:
            ids = list(r.option_ids)
            rng.shuffle(ids)
            out.append((len(out), r.record_id, ids, ids.index(r.answer_id)))
        return pd.DataFrame(out, columns=["place", "record_id", "option_ids", "gold_index"])

    own = rows.select("place", "record_id", "option_ids", "answer_id", F.lit(epoch).alias("epoch"))
    return own.groupBy("epoch").applyInPandas(shuffle, "place long, record_id string, option_ids array<string>, gold_index int")


def syllable_name(number: Column, syllables: list[str], places: int = 4) -> Column:
    """A number as ``places`` syllables, the last one changing fastest; numbers past the last name start again."""
    n, table = len(syllables), F.array(*map(F.lit, syllables))
    digit = lambda k: F.element_at(table, (F.floor(number / n**k) % n + 1).cast("int"))
    return F.concat(*[digit(k) for k in reversed(range(places))])


def _byte(*parts: Column | str) -> Column:
    """A number from 0 to 255 that a digest of the parts gives."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256), 1, 2), 16, 10).cast("int")


def _upto(n: Column | int) -> Column:
    """0 to n - 1, empty for none."""
    return F.filter(F.sequence(F.lit(0), F.lit(n) if isinstance(n, int) else n), lambda i: i < n)


def _named(mark: str, i: Column) -> Column:
    return F.concat(F.lit(mark), i.cast("string"))


def routing_scenario(key: Column, features: Column | int, destinations: Column | int) -> Column:
    """A routing scenario of binary features that the digests of a key give: a destination or none for each cell, and a query."""
    k, n = (F.lit(x) if isinstance(x, int) else x for x in (features, destinations))
    value = lambda i, bit: F.concat(F.when(bit == 0, "a").otherwise("b"), i.cast("string"))
    named = F.transform(_upto(k), lambda i: F.struct(_named("f", i).alias("name"), F.array(_named("a", i), _named("b", i)).alias("values")))
    cells = F.transform(_upto(F.pow(F.lit(2), k).cast("int")), lambda c: F.struct(c.alias("c"), (_byte(key, c) % (n + 1)).alias("h")))
    bit = lambda c, i: F.floor(c / F.pow(F.lit(2), k - 1 - i)).cast("long") % 2
    rules = F.transform(F.filter(cells, lambda z: z["h"] < n), lambda z: F.struct(F.transform(_upto(k), lambda i: value(i, bit(z["c"], i))).alias("values"), _named("d", z["h"]).alias("destination_id")))
    asked = F.transform(_upto(k), lambda i: F.when(_byte(key, "q", i) % 3 == 0, _named("a", i)).when(_byte(key, "q", i) % 3 == 1, _named("b", i)))
    return F.struct(named.alias("features"), F.transform(_upto(n), lambda i: _named("d", i)).alias("destination_ids"), rules.alias("rules"), asked.alias("query"))


def tool_scenario(key: Column, tools: Column | int) -> Column:
    """A tool scenario of three capabilities, two inputs and two permissions that the digests of a key give; costs differ."""
    some = lambda mark, size, bits: F.transform(F.filter(_upto(size), lambda i: F.getbit(bits.cast("long"), i) == 1), lambda i: _named(mark, i))
    tool = lambda j: F.struct(
        _named("t", j).alias("id"), some("c", 3, 1 + _byte(key, j, "c") % 7).alias("capabilities"), some("i", 2, 1 + _byte(key, j, "i") % 3).alias("input_types"),
        some("p", 2, _byte(key, j, "p") % 4).alias("required_permissions"), ((_byte(key, j, "x") % 50) * 6 + j).cast("long").alias("cost"),
    )
    every = lambda mark, size: F.transform(_upto(size), lambda i: _named(mark, i))
    granted = F.transform(_upto(2), lambda i: F.when(_byte(key, "g", i) % 3 == 0, F.lit(True)).when(_byte(key, "g", i) % 3 == 1, F.lit(False)))
    return F.struct(
        every("c", 3).alias("capabilities"), every("i", 2).alias("input_types"), every("p", 2).alias("permissions"), F.transform(_upto(tools), tool).alias("tools"),
        F.array(_named("c", _byte(key, "r") % 3)).alias("required_capabilities"), _named("i", _byte(key, "n") % 2).alias("input_type"), granted.alias("permission_values"),
    )


def distinct_choice(candidates: DataFrame, work: Workspace, rounds: int = 1000) -> DataFrame:
    """Rows (item, attempt, key) in which each item, in order, has its first attempt whose key no earlier item has.

    Found without walking the items: all propose their first attempt left, each key keeps its
    smallest item, the others strike the key off; once nobody is refused, the choice is that of the
    walk, since a key never goes back to a later item. Items that run out of attempts are missing.
    """
    left = work.save(candidates.groupBy("item", "key").agg(F.min("attempt").alias("attempt")), "candidates")
    for _ in range(rounds):
        asked = left.groupBy("item").agg(F.min(F.struct("attempt", "key")).alias("a")).select("item", "a.*")
        held = asked.groupBy("key").agg(F.min("item").alias("holder"))
        refused = work.save(asked.join(held, "key").filter("item <> holder").select("item", "key"), "refused")
        if refused.isEmpty():
            return asked
        left = work.save(left.join(refused, ["item", "key"], "left_anti"), "candidates")
    raise RuntimeError(f"the choice did not settle in {rounds} rounds")


def _distinct(rows: DataFrame, counts: dict[str, int], kind: Column, structure: Column, attempts: int) -> DataFrame:
    """Rows (item, split, scenario, ...) of items whose attempts fit: the kind that is an item's turn, and a structure of its split not used before."""
    from scorelane.functions.text import split_slot

    work = Workspace(rows.sparkSession, "generated")
    rows = rows.withColumn("case_kind", kind).filter(F.col("case_kind") == F.col("wanted")).withColumn("structure", structure)
    rows = work.save(rows.filter(split_slot(F.col("structure")) == F.col("split")), "fitting")
    chosen = distinct_choice(rows.select("item", "attempt", F.col("structure").alias("key")), work)
    short = sum(counts.values()) - chosen.count()
    if short:
        raise ValueError(f"{short} items found no structure of their own in {attempts} attempts")
    return rows.join(chosen.select("item", "attempt"), ["item", "attempt"]).drop("wanted")


def _attempts(spark: SparkSession, counts: dict[str, int], kinds: list[str], attempts: int) -> DataFrame:
    """(item, split, wanted, attempt): items number the splits' rows in order, kinds take turns within a split."""
    start, split, first = 0, F.lit(None).cast("string"), F.lit(0)
    for name, n in counts.items():
        inside = (F.col("item") >= start) & (F.col("item") < start + n)
        split, first = F.when(inside, name).otherwise(split), F.when(inside, start).otherwise(first)
        start += n
    turn = F.element_at(F.array(*map(F.lit, kinds)), ((F.col("item") - first) % len(kinds) + 1).cast("int"))
    rows = spark.range(start).withColumnRenamed("id", "item").select("item", split.alias("split"), turn.alias("wanted"))
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))


#: Kinds of cases in the order in which generated items take them.
ROUTING_KINDS = ["complete_route", "complete_no_route", "missing_route_agree", "missing_no_route_agree", "missing_route_conflict", "missing_route_vs_none", "multiple_missing"]
TOOL_KINDS = ["complete_tool", "complete_no_eligible", "missing_tool_agree", "missing_none_agree", "missing_tool_conflict", "missing_tool_vs_none", "multiple_missing"]


def distinct_routing(spark: SparkSession, seed: int, counts: dict[str, int], attempts: int = 1024) -> DataFrame:
    """(item, attempt, split, scenario, case_kind, structure): generated routing scenarios, kinds in turn, no structure twice, each in its structure's split."""
    from scorelane.operators import scenarios as S

    key = F.concat_ws(":", F.lit(str(seed)), "split", "item", "attempt")
    rows = _attempts(spark, counts, ROUTING_KINDS, attempts).withColumn("scenario", routing_scenario(key, 3, 2 * (1 + F.col("item") % 3)))
    return _distinct(rows, counts, S.routing_case(F.col("scenario")), S.routing_structure(F.col("scenario")), attempts)


def distinct_tools(spark: SparkSession, seed: int, counts: dict[str, int], attempts: int = 1024) -> DataFrame:
    """As ``distinct_routing`` for tool scenarios of two, four and six tools."""
    from scorelane.operators import scenarios as S

    key = F.concat_ws(":", F.lit(str(seed)), "split", "item", "attempt")
    rows = _attempts(spark, counts, TOOL_KINDS, attempts).withColumn("scenario", tool_scenario(key, 2 * (1 + F.col("item") % 3)))
    return _distinct(rows, counts, S.tool_case(F.col("scenario")), S.tool_structure(F.col("scenario")), attempts)
