"""Routing and tool scenarios as columns: outcomes, case kinds, identities, structure and audits.

A routing scenario is a struct of features array<struct<name, values>>, destination_ids, rules
array<struct<values, destination_id>> and query (null: missing). A tool scenario is a struct of
capabilities, input_types, permissions, tools array<struct<id, capabilities, input_types,
required_permissions, cost>>, required_capabilities, input_type and permission_values (null:
unknown). Every function works on one row, so nothing is shuffled but by the audits' counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.operators.rules import INSUFFICIENT, NO_ROUTE, NO_TOOL

ROUTING = "struct<features array<struct<name string, values array<string>>>, destination_ids array<string>, rules array<struct<values array<string>, destination_id string>>, query array<string>>"
TOOLS = (
    "struct<capabilities array<string>, input_types array<string>, permissions array<string>, tools array<struct<id string, capabilities array<string>, input_types array<string>, "
    "required_permissions array<string>, cost bigint>>, required_capabilities array<string>, input_type string, permission_values array<boolean>>"
)
TIE = "tie"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once a row, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _product(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(1), lambda a, n: a * n)


def routing_outcomes(s: Column) -> Column:
    """Distinct outcomes, sorted, of all completions of a routing query.

    Rule keys are distinct and lie in the domains, so each rule that agrees with the known values
    is one completion; if there are fewer than completions, some go to no_route.
    """
    fits = F.filter(s["rules"], lambda r: F.forall(F.zip_with(r["values"], s["query"], lambda v, q: q.isNull() | (v == q)), lambda ok: ok))
    completions = _product(F.zip_with(s["features"], s["query"], lambda f, q: F.when(q.isNull(), F.size(f["values"])).otherwise(1)))
    every = lambda met: F.when(F.size(met) < completions, F.array_append(met, F.lit(NO_ROUTE))).otherwise(met)
    return F.array_sort(F.array_distinct(let(F.transform(fits, lambda r: r["destination_id"]), every)))


def settled(outcomes: Column) -> Column:
    """The outcome that all completions share; a tie of the cheapest anywhere is "tie"."""
    return let(outcomes, lambda o: F.when(F.array_contains(o, TIE), TIE).when(F.size(o) == 1, F.get(o, F.lit(0))).otherwise(INSUFFICIENT))


def routing_case(s: Column) -> Column:
    """Kind of a routing case; null where one missing value leads to more than two outcomes."""
    missing = F.size(F.filter(s["query"], lambda q: q.isNull()))

    def kind(found: Column) -> Column:
        none, alone = F.array_contains(found, NO_ROUTE), F.size(found) == 1
        one = F.when(alone, F.when(none, "missing_no_route_agree").otherwise("missing_route_agree")).when(F.size(found) == 2, F.when(none, "missing_route_vs_none").otherwise("missing_route_conflict"))
        return F.when(missing == 0, F.when(none, "complete_no_route").otherwise("complete_route")).when(missing == 1, one).otherwise("multiple_missing")

    return let(routing_outcomes(s), kind)


def tool_outcomes(s: Column) -> Column:
    """Distinct outcomes, sorted, of all completions of unknown permissions (three permissions at most)."""
    state = F.arrays_zip(s["permissions"].alias("p"), s["permission_values"].alias("g"))
    open_ = F.transform(F.filter(state, lambda z: z["g"].isNull()), lambda z: z["p"])
    known = F.transform(F.filter(state, lambda z: z["g"]), lambda z: z["p"])

    def outcome(have: Column) -> Column:
        fits = F.filter(s["tools"], lambda t: (F.size(F.array_except(s["required_capabilities"], t["capabilities"])) == 0) & F.array_contains(t["input_types"], s["input_type"]) & (F.size(F.array_except(t["required_permissions"], have)) == 0))
        best = lambda p: F.when(F.size(p) == 0, NO_TOOL).when(F.get(p, F.lit(0))["cost"] == F.get(p, F.lit(1))["cost"], TIE).otherwise(F.get(p, F.lit(0))["id"])
        return let(F.array_sort(F.transform(fits, lambda t: F.struct(t["cost"].alias("cost"), t["id"].alias("id")))), best)

    def completed(z: Column) -> Column:
        bits = F.sequence(F.lit(0), F.pow(F.lit(2), F.size(z["open"])).cast("int") - 1)
        return F.transform(bits, lambda b: F.concat(z["known"], F.filter(z["open"], lambda _, i: F.getbit(b.cast("long"), i) == 1)))

    granted = let(F.struct(open_.alias("open"), known.alias("known")), completed)
    return F.array_sort(F.array_distinct(F.transform(granted, outcome)))


def tool_case(s: Column) -> Column:
    """Kind of a tool case; null where the cheapest tools tie."""
    missing = F.size(F.filter(s["permission_values"], lambda g: g.isNull()))

    def kind(found: Column) -> Column:
        none, alone = F.array_contains(found, NO_TOOL), F.size(found) == 1
        one = F.when(alone, F.when(none, "missing_none_agree").otherwise("missing_tool_agree")).otherwise(F.when(none, "missing_tool_vs_none").otherwise("missing_tool_conflict"))
        told = F.when(missing == 0, F.when(none, "complete_no_eligible").otherwise("complete_tool")).when(missing == 1, one).otherwise("multiple_missing")
        return F.when(~F.array_contains(found, TIE), told)

    return let(tool_outcomes(s), kind)


def answer_class(answer: Column) -> Column:
    return F.when(answer.isin(NO_TOOL, INSUFFICIENT), answer).otherwise("tool")


def routing_answers(s: Column) -> Column:
    return F.concat(s["destination_ids"], F.array(F.lit(NO_ROUTE), F.lit(INSUFFICIENT)))


def tool_answers(s: Column) -> Column:
    return F.concat(F.transform(s["tools"], lambda t: t["id"]), F.array(F.lit(NO_TOOL), F.lit(INSUFFICIENT)))


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    one = F.to_json(F.array(text))
    return F.substr(one, F.lit(2), F.length(one) - 2)


def _json_list(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def _named_pairs(names: Column, values: Column) -> Column:
    """Sorted [name, value] pairs as JSON; null values stay."""
    pairs = F.array_sort(F.zip_with(names, values, lambda n, v: F.struct(n.alias("n"), v.alias("v"))))
    shown = lambda v: F.coalesce(quoted(v), F.lit("null"))
    return _json_list(F.transform(pairs, lambda p: F.concat(F.lit("["), quoted(p["n"]), F.lit(","), F.when(p["v"].isNull(), "null").otherwise(shown(p["v"])), F.lit("]"))))


def routing_identity(s: Column, with_query: bool) -> Column:
    """SHA-256 of a rule set, or of a whole scenario, whatever the order of features, values, destinations and rules."""
    names = F.transform(s["features"], lambda f: f["name"])
    rules = F.array_sort(F.transform(s["rules"], lambda r: F.concat(F.lit('{"destination":'), quoted(r["destination_id"]), F.lit(',"when":'), _named_pairs(names, r["values"]), F.lit("}"))))
    features = F.to_json(F.array_sort(F.transform(s["features"], lambda f: F.struct(f["name"].alias("name"), F.array_sort(f["values"]).alias("values")))))
    query = F.concat(F.lit(',"query":'), _named_pairs(names, s["query"])) if with_query else F.lit("")
    return F.sha2(F.concat(F.lit('{"destinations":'), F.to_json(F.array_sort(s["destination_ids"])), F.lit(',"features":'), features, query, F.lit(',"rules":'), _json_list(rules), F.lit("}")), 256)


def tool_identity(s: Column, with_query: bool) -> Column:
    """SHA-256 of a catalog, or of a whole scenario, whatever the order of its lists."""
    ordered = lambda a: F.to_json(F.array_sort(a))
    tools = F.array_sort(F.transform(s["tools"], lambda t: F.to_json(F.struct(F.array_sort(t["capabilities"]).alias("capabilities"), t["cost"].alias("cost"), t["id"].alias("id"), F.array_sort(t["input_types"]).alias("input_types"), F.array_sort(t["required_permissions"]).alias("required_permissions")))))
    state = F.array_sort(F.zip_with(s["permissions"], s["permission_values"], lambda p, g: F.concat(F.lit("["), quoted(p), F.lit(","), F.coalesce(g.cast("string"), F.lit("null")), F.lit("]"))))
    query = F.concat(F.lit(',"query":{"input_type":'), quoted(s["input_type"]), F.lit(',"permission_values":'), _json_list(state), F.lit(',"required_capabilities":'), ordered(s["required_capabilities"]), F.lit("}")) if with_query else F.lit("")
    return F.sha2(F.concat(F.lit('{"capabilities":'), ordered(s["capabilities"]), F.lit(',"input_types":'), ordered(s["input_types"]), F.lit(',"permissions":'), ordered(s["permissions"]), query, F.lit(',"tools":'), _json_list(tools), F.lit("}")), 256)


def _cells(features: int) -> list[list[int]]:
    """For every order of binary features and every swap of their values, the old cell of each new cell."""
    out = []
    for order in permutations(range(features)):
        for swap in range(1 << features):
            cell = lambda new, order=order, swap=swap: sum(((new ^ swap) >> (features - 1 - i) & 1) << (features - 1 - f) for i, f in enumerate(order))
            out.append([cell(new) for new in range(1 << features)])
    return out


def _literal(rows: list[list[int]]) -> Column:
    return F.array(*[F.array(*map(F.lit, r)) for r in rows])


def routing_structure(s: Column) -> Column:
    """SHA-256 that routing tables share if renaming features, values and destinations makes them equal.

    One to four features of two values; others give null. A table is read in every order of its
    features and with every swap of values; destinations are numbered by first appearance, cells
    without a rule are zero, and the smallest list of numbers stands for all.
    """
    n = F.size(s["features"])
    binary = F.forall(s["features"], lambda f: F.size(f["values"]) == 2) & n.between(1, 4)
    cell = lambda r: F.aggregate(F.zip_with(r["values"], s["features"], lambda v, f: (F.array_position(f["values"], v) - 1).cast("int")), F.lit(0), lambda a, b: a * 2 + b)
    placed = F.map_from_entries(F.transform(s["rules"], lambda r: F.struct(cell(r).alias("k"), r["destination_id"].alias("v"))))
    table = let(placed, lambda m: F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), n).cast("int") - 1), lambda c: F.element_at(m, c)))
    maps = reduce(lambda other, k: F.when(n == k, _literal(_cells(k))).otherwise(other), (1, 2, 3), _literal(_cells(4)))

    def numbered(read: Column) -> Column:
        return let(F.array_distinct(F.array_compact(read)), lambda seen: F.transform(read, lambda d: F.coalesce(F.array_position(seen, d).cast("int"), F.lit(0))))

    least = F.to_json(let(table, lambda t: F.array_min(F.transform(maps, lambda order: let(F.transform(order, lambda i: F.get(t, i)), numbered)))))
    text = F.concat(F.lit('{"destination_count":'), F.size(s["destination_ids"]).cast("string"), F.lit(',"feature_count":'), n.cast("string"), F.lit(',"table":'), least, F.lit("}"))
    return F.when(binary, F.sha2(text, 256))


def mask(values: Column, domain: Column) -> Column:
    """Bits of the places at which the values stand in their domain."""
    return F.aggregate(values, F.lit(0), lambda a, v: a.bitwiseOR(F.pow(F.lit(2), F.array_position(domain, v) - 1).cast("int")))


def turned_mask(bits: Column, order: Column) -> Column:
    """A mask whose bit i moves to place order[i]."""
    return F.aggregate(order, F.struct(F.lit(0).alias("i"), F.lit(0).alias("m")), lambda a, to: F.struct((a["i"] + 1).alias("i"), (a["m"] + F.getbit(bits.cast("long"), a["i"]).cast("int") * F.pow(F.lit(2), to).cast("int")).alias("m")), lambda a: a["m"])


def _turns(size: int) -> list[list[int]]:
    """For every order of ``size`` places, what becomes of each mask."""
    return [[sum(1 << order[i] for i in range(size) if m >> i & 1) for m in range(1 << size)] for order in permutations(range(size))]


def tool_structure(s: Column) -> Column:
    """SHA-256 that catalogs share if renaming capabilities, inputs, permissions and tools and re-pricing in the same order makes them equal."""
    costs = F.array_sort(F.array_distinct(F.transform(s["tools"], lambda t: t["cost"])))
    rows = let(costs, lambda known: F.transform(s["tools"], lambda t: F.array(mask(t["capabilities"], s["capabilities"]), mask(t["input_types"], s["input_types"]), mask(t["required_permissions"], s["permissions"]), (F.array_position(known, t["cost"]) - 1).cast("int"))))
    pick = lambda n, sizes: reduce(lambda other, k: F.when(n == k, _literal(_turns(k))).otherwise(other), sizes[:-1], _literal(_turns(sizes[-1])))
    sizes = [F.size(s[c]) for c in ("capabilities", "input_types", "permissions")]
    caps, inputs, perms = pick(sizes[0], [1, 2, 3, 4]), pick(sizes[1], [1, 2, 3]), pick(sizes[2], [0, 1, 2, 3])
    at = lambda r, k: F.get(r, F.lit(k))
    read = lambda all_, c, i, p: F.array_sort(F.transform(all_, lambda r: F.array(F.get(c, at(r, 0)), F.get(i, at(r, 1)), F.get(p, at(r, 2)), at(r, 3))))
    least = let(rows, lambda all_: F.array_min(F.transform(caps, lambda c: F.array_min(F.transform(inputs, lambda i: F.array_min(F.transform(perms, lambda p: read(all_, c, i, p))))))))
    count = lambda name, n: F.concat(F.lit(f'"{name}":'), n.cast("string"), F.lit(","))
    text = F.concat(F.lit("{"), count("capability_count", sizes[0]), count("input_type_count", sizes[1]), count("permission_count", sizes[2]), count("tool_count", F.size(s["tools"])), F.lit('"tools":'), F.to_json(least), F.lit("}"))
    return F.sha2(text, 256)


def _violations(rows: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    """(code, key) of the rows at which a check is true or can't be told."""
    codes = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(code)) for bad, code in checks]))
    return rows.select(F.explode(codes).alias("code"), F.col("record_id").alias("key"))


def _many(rows: DataFrame, digest: str, side: str, code: str) -> DataFrame:
    """(code, digest) of digests that bear more than one value of ``side``."""
    return rows.groupBy(digest).agg(F.min(side).alias("a"), F.max(side).alias("b")).filter("a <> b").select(F.lit(code).alias("code"), F.col(digest).alias("key"))


def _repeated(rows: DataFrame, digest: str, code: str) -> DataFrame:
    return rows.groupBy(digest).count().filter("count > 1").select(F.lit(code).alias("code"), F.col(digest).alias("key"))


def audit_routing(rows: DataFrame, vocabularies: DataFrame, split_of: Column | None = None) -> DataFrame:
    """Violations (code, key) of routing rows, all of them.

    rows has record_id, split, case_kind, answer_id, source_group_id, option_ids (those of the
    request), parsed (scenario, option_ids and template_id of the prompt's text, null if it can't be
    read), template_id, expected_template (of the split) and scenario; vocabularies has (split,
    terms, features array<struct<name, values>>, destinations), one row a split.
    """
    from scorelane.functions.text import split_slot

    s = F.col("scenario")
    by_name = lambda a: F.array_sort(F.transform(a, lambda f: F.struct(f["name"].alias("name"), F.array_sort(f["values"]).alias("values"))))
    own = vocabularies.select(F.col("split").alias("_split"), by_name(F.col("features")).alias("_features"), F.col("destinations").alias("_destinations"))
    at = rows.join(own, F.col("split") == F.col("_split"), "left")
    at = at.withColumns({"_structure": routing_structure(s), "_rules": routing_identity(s, False), "_scenario": routing_identity(s, True)})
    n = F.size(s["destination_ids"])
    checks = [
        (by_name(s["features"]) != F.col("_features"), "feature_domains"),
        (~n.isin(2, 4, 6) | (F.size(F.array_distinct(s["destination_ids"])) < n) | (F.size(F.array_except(s["destination_ids"], F.col("_destinations"))) > 0), "destination_menu"),
        (F.col("parsed").isNull() | ~F.col("parsed.scenario").eqNullSafe(s), "prompt_facts"),
        (F.col("parsed.option_ids") != F.col("option_ids"), "option_order"),
        ((F.col("template_id") != F.col("expected_template")) | (F.col("parsed.template_id") != F.col("template_id")), "template"),
        (F.col("answer_id") != settled(routing_outcomes(s)), "answer"),
        (F.col("case_kind") != routing_case(s), "case_kind"),
        (F.col("source_group_id") != F.concat(F.lit("routing-group-"), F.col("_structure")), "group"),
        (F.col("split") != (split_slot(F.col("_structure")) if split_of is None else split_of), "structure_split"),
    ]
    placed = at.withColumn("_place", F.concat_ws("/", "split", "source_group_id"))
    found = [
        _violations(at, checks), _repeated(at, "_scenario", "repeated_scenario"), _many(placed, "_rules", "_place", "rules_cross"), _many(placed, "_structure", "_place", "structure_crosses"),
        shared_terms(vocabularies),
    ]
    return reduce(DataFrame.unionByName, found)


def shared_terms(vocabularies: DataFrame) -> DataFrame:
    """Terms that the vocabularies of several splits hold."""
    terms = vocabularies.select("split", F.explode("terms").alias("term")).distinct()
    return terms.groupBy("term").count().filter("count > 1").select(F.lit("vocabulary").alias("code"), F.col("term").alias("key"))


def audit_tools(rows: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """As ``audit_routing`` for tool rows; catalogs and structures may not repeat at all.

    vocabularies has (split, terms, capabilities, input_types, permissions, tool_ids).
    """
    from scorelane.functions.text import split_slot

    s = F.col("scenario")
    lists = ("capabilities", "input_types", "permissions", "tool_ids")
    own = vocabularies.select(F.col("split").alias("_split"), *[F.array_sort(c).alias(f"_{c}") for c in lists])
    at = rows.join(own, F.col("split") == F.col("_split"), "left")
    at = at.withColumns({"_structure": tool_structure(s), "_catalog": tool_identity(s, False), "_scenario": tool_identity(s, True)})
    ids = F.transform(s["tools"], lambda t: t["id"])
    checks = [
        (reduce(lambda a, b: a | b, (F.array_sort(s[c]) != F.col(f"_{c}") for c in lists[:3])), "domains"),
        (~F.size(ids).isin(2, 4, 6) | (F.size(F.array_except(ids, F.col("_tool_ids"))) > 0), "tool_menu"),
        (F.col("parsed").isNull() | ~F.col("parsed.scenario").eqNullSafe(s), "prompt_facts"),
        (F.col("parsed.option_ids") != F.col("option_ids"), "option_order"),
        ((F.col("template_id") != F.col("expected_template")) | (F.col("parsed.template_id") != F.col("template_id")), "template"),
        (F.col("answer_id") != settled(tool_outcomes(s)), "answer"),
        (F.col("case_kind") != tool_case(s), "case_kind"),
        (F.col("source_group_id") != F.concat(F.lit("tool-group-"), F.col("_structure")), "group"),
        (F.col("split") != split_slot(F.col("_structure")), "structure_split"),
    ]
    found = [_violations(at, checks), _repeated(at, "_scenario", "repeated_scenario"), _repeated(at, "_catalog", "repeated_catalog"), _repeated(at, "_structure", "repeated_structure"), shared_terms(vocabularies)]
    return reduce(DataFrame.unionByName, found)


def menu_table(rows: DataFrame, answers: Column, answer: Column) -> DataFrame:
    """(split, menu_size, tool, no tool, insufficient) counts of answer classes by the size of the menu."""
    kinds = rows.select("split", F.size(answers).alias("menu_size"), answer_class(answer).alias("kind"))
    return kinds.groupBy("split", "menu_size").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("tool", NO_TOOL, INSUFFICIENT)])


def domains(features: int) -> list[tuple[int, ...]]:
    """Completions of binary features, the last one changing fastest."""
    return list(product((0, 1), repeat=features))
