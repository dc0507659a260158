"""Requests made from scenarios, their prompts, and scenarios read back from prompts.

Templates are given by the caller: (id, words before the facts, question). A prompt is read only if
it is exactly the text that its facts, template and options give, so keys that repeat, are missing
or were added, white space, and changed words all make it unreadable (null).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelane.functions import text as T
from scorelane.operators import scenarios as S
from scorelane.operators.rules import INSUFFICIENT, NO_ROUTE, NO_TOOL

Template = tuple[str, str, str]
#: Labels of answers, and the line that ends a prompt.
NO_ROUTE_LABEL = "No route applies"
NO_TOOL_LABEL = "No eligible tool"
INSUFFICIENT_LABEL = "Insufficient information"
ROUTE_TO, USE_TOOL = "Route to ", "Use tool "
ANSWER = "\nAnswer:\n"


def label(answer: Column, head: str) -> Column:
    """The wording of an answer: fixed for the special ones, else ``head`` and the id as a JSON string."""
    special = {NO_ROUTE: NO_ROUTE_LABEL, NO_TOOL: NO_TOOL_LABEL, INSUFFICIENT: INSUFFICIENT_LABEL}
    return reduce(lambda other, k: F.when(answer == k, special[k]).otherwise(other), special, F.concat(F.lit(head), S.quoted(answer)))


def _request(facts: Column, order: Column, head: str, template: Column) -> Column:
    options = F.transform(order, lambda o: F.struct(o.alias("id"), label(o, head).alias("label"), F.lit(None).cast("string").alias("description")))
    return F.struct(F.concat(template["prefix"], F.to_json(facts, {"ignoreNullFields": "false"})).alias("context"), template["question"].alias("question"), options.alias("options"))


def templates(rows: list[Template]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(p).alias("prefix"), F.lit(q).alias("question")) for i, p, q in rows])


def template(rows: list[Template], name: Column) -> Column:
    return F.get(F.filter(templates(rows), lambda t: t["id"] == name), F.lit(0))


def routing_request(scenario: Column, order: Column, rows: list[Template], name: Column) -> Column:
    """struct<context, question, options>; ``order`` holds every answer id once."""
    return _request(scenario, order, ROUTE_TO, template(rows, name))


def tool_request(scenario: Column, order: Column, rows: list[Template], name: Column) -> Column:
    return _request(scenario, order, USE_TOOL, template(rows, name))


def prompt(request: Column) -> Column:
    return T.prompt(request["context"], request["question"], request["options"])


def _blank(c: Column) -> Column:
    return c.isNull() | (T.squeeze(c) == "")


def _unique(a: Column) -> Column:
    return ~F.exists(a, _blank) & (F.size(F.array_distinct(a)) == F.size(a))


def _all(checks: list[Column]) -> Column:
    return F.coalesce(reduce(and_, checks), F.lit(False))


def routing_valid(s: Column) -> Column:
    """Whether the struct is a routing scenario: numbers of features, values and destinations, known and distinct names."""
    n = F.size(s["features"])
    legal = lambda v, f: F.array_contains(f["values"], v)
    keys = F.transform(s["rules"], lambda r: r["values"])
    return _all(
        [
            n.between(1, 4), _unique(F.transform(s["features"], lambda f: f["name"])), F.forall(s["features"], lambda f: F.size(f["values"]).between(1, 4) & _unique(f["values"])),
            F.size(s["destination_ids"]).between(2, 6), _unique(s["destination_ids"]), ~F.arrays_overlap(s["destination_ids"], F.array(F.lit(NO_ROUTE), F.lit(INSUFFICIENT))),
            F.forall(s["rules"], lambda r: (F.size(r["values"]) == n) & F.array_contains(s["destination_ids"], r["destination_id"]) & F.forall(F.zip_with(r["values"], s["features"], legal), lambda ok: F.coalesce(ok, F.lit(False)))),
            F.size(F.array_distinct(keys)) == F.size(keys),
            F.size(s["query"]) == n, F.forall(F.zip_with(s["query"], s["features"], lambda v, f: v.isNull() | legal(v, f)), lambda ok: ok),
        ]
    )


def tool_valid(s: Column) -> Column:
    """Whether the struct is a tool scenario: sizes, names of at most 256 characters, domains, whole costs up to a million."""
    domains = [("capabilities", 1, 4), ("input_types", 1, 3), ("permissions", 0, 3)]
    named = lambda a, least, most: F.size(a).between(least, most) & _unique(a) & ~F.exists(a, lambda x: F.length(x) > 256)
    inside = lambda a, whole: F.size(F.array_except(a, whole)) == 0
    ids = F.transform(s["tools"], lambda t: t["id"])
    tool = lambda t: reduce(and_, [named(t[c], a, z) & inside(t[c], s[d]) for (d, a, z), c in zip(domains, ("capabilities", "input_types", "required_permissions"), strict=True)]) & t["cost"].between(0, 1_000_000)
    return _all(
        [
            *[named(s[c], a, z) for c, a, z in domains], F.size(s["tools"]).between(2, 6), named(ids, 2, 6), ~F.arrays_overlap(ids, F.array(F.lit(NO_TOOL), F.lit(INSUFFICIENT))), F.forall(s["tools"], tool),
            named(s["required_capabilities"], 1, 4), inside(s["required_capabilities"], s["capabilities"]), F.array_contains(s["input_types"], s["input_type"]),
            F.size(s["permission_values"]) == F.size(s["permissions"]),
        ]
    )


def _read(text: Column, rows: list[Template], schema: str, head: str, answers: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    body = F.substr(text, F.lit(1), F.length(text) - len(ANSWER))
    outer = F.from_json(body, "struct<context string, question string, options array<struct<symbol string, label string, description string>>>")

    def with_template(o: Column) -> Column:
        fits = F.filter(templates(rows), lambda t: o["context"].startswith(t["prefix"]))
        return F.when(F.size(fits) == 1, S.let(F.get(fits, F.lit(0)), lambda own: with_facts(o, own)))

    def with_facts(o: Column, own: Column) -> Column:
        facts = F.from_json(F.substr(o["context"], F.length(own["prefix"]) + 1), schema)
        return S.let(facts, lambda f: F.when(valid(f), S.let(answers(f), lambda ids: with_options(o, own, f, ids))))

    def with_options(o: Column, own: Column, facts: Column, ids: Column) -> Column:
        found = S.let(F.transform(ids, lambda i: label(i, head)), lambda labels: F.transform(o["options"], lambda x: F.get(ids, (F.array_position(labels, x["label"]) - 1).cast("int"))))
        return S.let(found, lambda order: F.when(exact(own, facts, ids, order), F.struct(facts.alias("scenario"), order.alias("option_ids"), own["id"].alias("template_id"))))

    def exact(own: Column, facts: Column, ids: Column, order: Column) -> Column:
        every = (F.size(order) == F.size(ids)) & (F.size(F.array_distinct(F.array_compact(order))) == F.size(ids))
        # known facts and options that give the same text again leave nothing unread
        return F.coalesce(every & (prompt(_request(facts, order, head, own)) == text), F.lit(False))

    return F.when(text.endswith(ANSWER), S.let(outer, with_template))


def read_routing(text: Column, rows: list[Template]) -> Column:
    """struct<scenario, option_ids, template_id> of a routing prompt, null if it isn't one."""
    return _read(text, rows, S.ROUTING, ROUTE_TO, S.routing_answers, routing_valid)


def read_tools(text: Column, rows: list[Template]) -> Column:
    """struct<scenario, option_ids, template_id> of a tool prompt, null if it isn't one."""
    return _read(text, rows, S.TOOLS, USE_TOOL, S.tool_answers, tool_valid)


def verified(parsed: Column, scenario: Column, option_ids: Column) -> Column:
    """Whether a prompt reads back as this scenario with these options in order."""
    return F.coalesce(parsed["scenario"].eqNullSafe(scenario) & (parsed["option_ids"] == option_ids), F.lit(False))


def compiled(text: Column, options: Column, encode: Callable[[str], list[int]], budget: int = 2048) -> Column:
    """struct<input_tokens, candidate_ids, fault> of prompts with a number of options under the tokenizer ``encode``.

    Each option's symbol must add exactly one token to the prompt's, and the options' tokens must
    differ; the prompt may hold ``budget`` tokens. What fails is named and the tokens are still given.
    """
    @F.pandas_udf("input_tokens int, candidate_ids array<int>, fault string")
    def run(texts: pd.Series, counts: pd.Series) -> pd.DataFrame:
        out = []
        for t, n in zip(texts, counts, strict=True):
            ids = encode(t)
            longer = [encode(t + s) for s in T.SYMBOLS[:n]]
            single = all(x[:-1] == ids for x in longer)
            last = [x[-1] for x in longer] if single else []
            fault = None if single else "a symbol isn't one token"
            fault = fault or (None if len(set(last)) == len(last) else "symbols share a token") or (None if len(ids) <= budget else "token budget")
            out.append((len(ids), last, fault))
        return pd.DataFrame(out, columns=["input_tokens", "candidate_ids", "fault"])

    return run(text, options)
