"""Registered queries over routing and tool scenarios and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.functions.text import split_slot
from scorelane.operators import generate
from scorelane.operators import prompts as P
from scorelane.operators import scenarios as S
from scorelane.plans import derive
from scorelane.registry import query

#: Templates of the derived prompts.
ROUTING_TEMPLATES = [("routing-a", "Use the routing table. null is a missing value.\n\nTable:\n", "Which destination applies?"), ("routing-b", "Read the whole table first; null is unknown.\n\nTable:\n", "What follows from the table?")]
TOOL_TEMPLATES = [("tool-a", "Pick the cheapest tool that fits. null is unknown.\n\nTools:\n", "Which tool applies?"), ("tool-b", "Tools, costs and permissions follow; null is unknown.\n\nTools:\n", "What follows from the tools?")]

BYTE = "('0x' || substr(sha256({}), 1, 2))::INT"


def routing_sql() -> str:
    return f"""q AS (SELECT p_partkey AS id, (1 + p_partkey % 3)::INT AS k, (2 * (1 + (p_partkey // 3) % 3))::INT AS n FROM part),
cells AS (SELECT id, k, n, c, {BYTE.format("id || ':' || c")} % (n + 1) AS h FROM q, range(8) r(c) WHERE c < (1 << k)),
asked AS (SELECT id, k, i, CASE {BYTE.format("id || ':q:' || i")} % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS v FROM q, range(3) r(i) WHERE i < k),
met AS (SELECT c.id, CASE WHEN h < n THEN 'd' || h ELSE 'no_route' END AS o FROM cells c WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.id = c.id AND a.v <> ((c.c >> (c.k - 1 - a.i)) & 1))),
solved AS (SELECT id, count(DISTINCT o) AS kinds, CASE WHEN min(o) = max(o) THEN min(o) ELSE 'insufficient_information' END AS outcome, bool_or(o = 'no_route') AS none FROM met GROUP BY 1),
missing AS (SELECT id, count(*) FILTER (v IS NULL) AS missing FROM asked GROUP BY 1),
cases AS (SELECT id, outcome, CASE WHEN missing = 0 THEN CASE WHEN none THEN 'complete_no_route' ELSE 'complete_route' END WHEN missing > 1 THEN 'multiple_missing'
  WHEN kinds = 1 THEN CASE WHEN none THEN 'missing_no_route_agree' ELSE 'missing_route_agree' END WHEN none THEN 'missing_route_vs_none' ELSE 'missing_route_conflict' END AS case_kind FROM solved JOIN missing USING (id)),
feats AS (SELECT id, '[' || string_agg('{{"name":"f' || i || '","values":["a' || i || '","b' || i || '"]}}', ',' ORDER BY i) || ']' AS fs, '[' || string_agg('["f' || i || '",' || CASE v WHEN 0 THEN '"a' || i || '"' WHEN 1 THEN '"b' || i || '"' ELSE 'null' END || ']', ',' ORDER BY i) || ']' AS qs FROM asked GROUP BY 1),
whens AS (SELECT c.id, h, c.c, '[' || string_agg('["f' || i || '","' || CASE (c.c >> (c.k - 1 - i)) & 1 WHEN 0 THEN 'a' ELSE 'b' END || i || '"]', ',' ORDER BY i) || ']' AS w FROM cells c, range(3) r(i) WHERE i < c.k AND h < n GROUP BY ALL),
ruled AS (SELECT id, string_agg('{{"destination":"d' || h || '","when":' || w || '}}', ',' ORDER BY '{{"destination":"d' || h || '","when":' || w || '}}') AS rs FROM whens GROUP BY 1),
dests AS (SELECT id, '[' || string_agg('"d' || d || '"', ',' ORDER BY d) || ']' AS ds FROM q, range(6) r(d) WHERE d < n GROUP BY 1),
named AS (SELECT id, sha256('{{"destinations":' || ds || ',"features":' || fs || ',"rules":[' || coalesce(rs, '') || ']}}') AS rules_hash,
  sha256('{{"destinations":' || ds || ',"features":' || fs || ',"query":' || qs || ',"rules":[' || coalesce(rs, '') || ']}}') AS scenario_hash FROM feats JOIN dests USING (id) LEFT JOIN ruled USING (id)),
tables AS (SELECT id, any_value(k) AS k, any_value(n) AS n, list(CASE WHEN h < n THEN 'd' || h END ORDER BY c) AS t FROM cells GROUP BY 1),
maps(k, m) AS (VALUES {", ".join(f"({k}, {m})" for k in (1, 2, 3) for m in S._cells(k))}),
turned AS (SELECT id, tables.k, n, list_transform(m, lambda x: t[x + 1]) AS r FROM tables JOIN maps ON tables.k = maps.k),
firsts AS (SELECT *, list_sort(list_distinct(list_transform(list_filter(r, lambda x: x IS NOT NULL), lambda x: list_position(r, x)))) AS f FROM turned),
coded AS (SELECT id, k, n, min(list_transform(r, lambda x: CASE WHEN x IS NULL THEN 0 ELSE list_position(f, list_position(r, x)) END)) AS least FROM firsts GROUP BY ALL),
structures AS (SELECT id, sha256('{{"destination_count":' || n || ',"feature_count":' || k || ',"table":[' || array_to_string(least, ',') || ']}}') AS structure FROM coded)"""


def tools_sql() -> str:
    turns = lambda size: ", ".join(f"({i}, {m})" for i, m in enumerate(S._turns(size)))
    some = lambda mark, size, bits: "'[' || array_to_string([" + f"x FOR x IN [{', '.join(f'{chr(39)}{chr(34)}{mark}{i}{chr(34)}{chr(39)}' for i in range(size))}] IF ({bits} >> (substr(x, 3, 1))::INT) & 1 = 1" + "], ',') || ']'"
    return f"""q AS (SELECT p_partkey AS id, (2 * (1 + p_partkey % 3))::INT AS n, {BYTE.format("p_partkey || ':r'")} % 3 AS need, {BYTE.format("p_partkey || ':n'")} % 2 AS input FROM part),
tools AS (SELECT id, n, need, input, j, 1 + {BYTE.format("id || ':' || j || ':c'")} % 7 AS caps, 1 + {BYTE.format("id || ':' || j || ':i'")} % 3 AS ins, {BYTE.format("id || ':' || j || ':p'")} % 4 AS perms, {BYTE.format("id || ':' || j || ':x'")} % 50 * 6 + j AS cost FROM q, range(6) r(j) WHERE j < n),
state AS (SELECT id, i, CASE {BYTE.format("id || ':g:' || i")} % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS g FROM q, range(2) r(i)),
open AS (SELECT id, g FROM q, range(4) r(g) WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.id = q.id AND s.g <> ((r.g >> s.i) & 1))),
met AS (SELECT o.id, o.g, coalesce('t' || min_by(j, cost), 'no_eligible_tool') AS o FROM open o LEFT JOIN tools t ON o.id = t.id AND (caps >> need) & 1 = 1 AND (ins >> input) & 1 = 1 AND (perms & ~o.g) = 0 GROUP BY ALL),
solved AS (SELECT id, CASE WHEN min(o) = max(o) THEN min(o) ELSE 'insufficient_information' END AS outcome, bool_or(o = 'no_eligible_tool') AS none, min(o) = max(o) AS alone FROM met GROUP BY 1),
cases AS (SELECT id, outcome, CASE WHEN missing = 0 THEN CASE WHEN none THEN 'complete_no_eligible' ELSE 'complete_tool' END WHEN missing > 1 THEN 'multiple_missing'
  WHEN alone THEN CASE WHEN none THEN 'missing_none_agree' ELSE 'missing_tool_agree' END WHEN none THEN 'missing_tool_vs_none' ELSE 'missing_tool_conflict' END AS case_kind
  FROM solved JOIN (SELECT id, count(*) FILTER (g IS NULL) AS missing FROM state GROUP BY 1) USING (id)),
shown AS (SELECT id, '{{"capabilities":' || {some("c", 3, "caps")} || ',"cost":' || cost || ',"id":"t' || j || '","input_types":' || {some("i", 2, "ins")} || ',"required_permissions":' || {some("p", 2, "perms")} || '}}' AS x FROM tools),
listed AS (SELECT id, string_agg(x, ',' ORDER BY x) AS ts FROM shown GROUP BY 1),
granted AS (SELECT id, string_agg('["p' || i || '",' || CASE g WHEN 1 THEN 'true' WHEN 0 THEN 'false' ELSE 'null' END || ']', ',' ORDER BY i) AS gs FROM state GROUP BY 1),
named AS (SELECT id, sha256('{{"capabilities":["c0","c1","c2"],"input_types":["i0","i1"],"permissions":["p0","p1"],"tools":[' || ts || ']}}') AS catalog_hash,
  sha256('{{"capabilities":["c0","c1","c2"],"input_types":["i0","i1"],"permissions":["p0","p1"],"query":{{"input_type":"i' || input || '","permission_values":[' || gs || '],"required_capabilities":["c' || need || '"]}},"tools":[' || ts || ']}}') AS scenario_hash FROM q JOIN listed USING (id) JOIN granted USING (id)),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY cost) - 1 AS rk FROM tools),
turned AS (SELECT id, n, a.i AS a, b.i AS b, c.i AS c, list_sort(list([a.m[caps + 1], b.m[ins + 1], c.m[perms + 1], rk])) AS rows FROM ranked, (VALUES {turns(3)}) a(i, m), (VALUES {turns(2)}) b(i, m), (VALUES {turns(2)}) c(i, m) GROUP BY ALL),
structures AS (SELECT id, sha256('{{"capability_count":3,"input_type_count":2,"permission_count":2,"tool_count":' || n || ',"tools":[' || array_to_string(list_transform(min(rows), lambda r: '[' || array_to_string(r, ',') || ']'), ',') || ']}}') AS structure FROM turned GROUP BY id, n)"""


def _routing(spark, sf) -> DataFrame:
    return derive.routing_scenarios(spark, sf)


@query("r03_routing_cases", f"WITH {routing_sql()} SELECT id AS scenario_id, outcome, case_kind FROM cases")
def _(spark, sf):
    s = F.col("scenario")
    return _routing(spark, sf).select("scenario_id", S.settled(S.routing_outcomes(s)).alias("outcome"), S.routing_case(s).alias("case_kind"))


@query("r04_tool_cases", f"WITH {tools_sql()} SELECT id AS scenario_id, outcome, case_kind FROM cases")
def _(spark, sf):
    s = F.col("scenario")
    return derive.tool_scenarios(spark, sf).select("scenario_id", S.settled(S.tool_outcomes(s)).alias("outcome"), S.tool_case(s).alias("case_kind"))


@query("r05_routing_structure", f"WITH {routing_sql()} SELECT id AS scenario_id, structure FROM structures")
def _(spark, sf):
    return _routing(spark, sf).select("scenario_id", S.routing_structure(F.col("scenario")).alias("structure"))


@query("r06_tool_structure", f"WITH {tools_sql()} SELECT id AS scenario_id, structure FROM structures")
def _(spark, sf):
    return derive.tool_scenarios(spark, sf).select("scenario_id", S.tool_structure(F.col("scenario")).alias("structure"))


@query("r07_routing_identity", f"WITH {routing_sql()} SELECT id AS scenario_id, rules_hash, scenario_hash FROM named")
def _(spark, sf):
    s = F.col("scenario")
    return _routing(spark, sf).select("scenario_id", S.routing_identity(s, False).alias("rules_hash"), S.routing_identity(s, True).alias("scenario_hash"))


@query("r07_tool_identity", f"WITH {tools_sql()} SELECT id AS scenario_id, catalog_hash, scenario_hash FROM named")
def _(spark, sf):
    s = F.col("scenario")
    return derive.tool_scenarios(spark, sf).select("scenario_id", S.tool_identity(s, False).alias("catalog_hash"), S.tool_identity(s, True).alias("scenario_hash"))


def _template(name: str) -> Column:
    return F.concat(F.lit(f"{name}-"), F.when(F.col("scenario_id") % 2 == 0, "a").otherwise("b"))


def _order(answers: Column) -> Column:
    """The answers, those of every third scenario turned round."""
    return F.when(F.col("scenario_id") % 3 == 0, F.reverse(answers)).otherwise(answers)


ROUTING_IDS = "CASE WHEN id % 3 = 0 THEN list_reverse(ids) ELSE ids END"


@query("f17_labels", f"WITH q AS (SELECT p_partkey AS id, 2 * (1 + (p_partkey // 3) % 3) AS n FROM part), a AS (SELECT id, list_concat(list_transform(range(n), lambda i: 'd' || i), ['no_route', 'insufficient_information']) AS ids FROM q) SELECT id AS scenario_id, array_to_string(list_transform({ROUTING_IDS}, lambda i: CASE i WHEN 'no_route' THEN 'No route applies' WHEN 'insufficient_information' THEN 'Insufficient information' ELSE 'Route to \"' || i || '\"' END), '|') AS labels FROM a")
def _(spark, sf):
    order = _order(S.routing_answers(F.col("scenario")))
    return _routing(spark, sf).select("scenario_id", F.array_join(F.transform(order, lambda i: P.label(i, P.ROUTE_TO)), "|").alias("labels"))


def routing_rows(spark, sf, changed: bool = True) -> DataFrame:
    """Scenarios with their prompts; those whose number 7 divides have a word changed."""
    rows = _routing(spark, sf).withColumn("template_id", _template("routing")).withColumn("option_ids", _order(S.routing_answers(F.col("scenario"))))
    text = P.prompt(P.routing_request(F.col("scenario"), F.col("option_ids"), ROUTING_TEMPLATES, F.col("template_id")))
    if changed:
        text = F.when(F.col("scenario_id") % 7 == 0, F.replace(text, F.lit('\\"d0\\"'), F.lit('\\"d9\\"'))).otherwise(text)
    return rows.withColumn("parsed", P.read_routing(text, ROUTING_TEMPLATES))


def tool_rows(spark, sf, changed: bool = True) -> DataFrame:
    rows = derive.tool_scenarios(spark, sf).withColumn("template_id", _template("tool")).withColumn("option_ids", _order(S.tool_answers(F.col("scenario"))))
    text = P.prompt(P.tool_request(F.col("scenario"), F.col("option_ids"), TOOL_TEMPLATES, F.col("template_id")))
    if changed:
        text = F.when(F.col("scenario_id") % 7 == 0, F.replace(text, F.lit("cost"), F.lit("price"))).otherwise(text)
    return rows.withColumn("parsed", P.read_tools(text, TOOL_TEMPLATES))


@query("f18_read_prompts", f"WITH q AS (SELECT p_partkey AS id, 2 * (1 + (p_partkey // 3) % 3) AS n FROM part), a AS (SELECT id, list_concat(list_transform(range(n), lambda i: CASE WHEN id % 7 = 0 AND i = 0 THEN 'd9' ELSE 'd' || i END), ['no_route', 'insufficient_information']) AS ids FROM q) SELECT 'routing' AS kind, id AS scenario_id, 'routing-' || CASE id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS template_id, array_to_string({ROUTING_IDS}, ',') AS option_ids FROM a UNION ALL SELECT 'tool', p_partkey, CASE WHEN p_partkey % 7 > 0 THEN 'tool-' || CASE p_partkey % 2 WHEN 0 THEN 'a' ELSE 'b' END END, CASE WHEN p_partkey % 7 > 0 THEN array_to_string(CASE WHEN p_partkey % 3 = 0 THEN list_reverse(t) ELSE t END, ',') END FROM (SELECT p_partkey, list_concat(list_transform(range(2 * (1 + p_partkey % 3)), lambda i: 't' || i), ['no_eligible_tool', 'insufficient_information']) AS t FROM part)")
def _(spark, sf):
    # a destination renamed throughout is another scenario that reads well; a changed key can't be read
    parts = [r.select(F.lit(kind).alias("kind"), "scenario_id", F.col("parsed.template_id").alias("template_id"), F.array_join("parsed.option_ids", ",").alias("option_ids")) for kind, r in (("routing", routing_rows(spark, sf)), ("tool", tool_rows(spark, sf)))]
    return parts[0].unionByName(parts[1])


@query("f19_round_trip", "SELECT 'routing' AS kind, count(*) FILTER (p_partkey % 7 > 0) AS verified, count(*) FILTER (p_partkey % 7 = 0) AS refused FROM part UNION ALL SELECT 'tool', count(*) FILTER (p_partkey % 7 > 0), count(*) FILTER (p_partkey % 7 = 0) FROM part")
def _(spark, sf):
    parts = []
    for kind, rows in (("routing", routing_rows(spark, sf)), ("tool", tool_rows(spark, sf))):
        ok = P.verified(F.col("parsed"), F.col("scenario"), F.col("option_ids"))
        parts.append(rows.select(F.lit(kind).alias("kind"), ok.alias("ok")).groupBy("kind").agg(F.count_if("ok").alias("verified"), F.count_if(~F.col("ok")).alias("refused")))
    return parts[0].unionByName(parts[1])


@query("f20_masks", f"WITH q AS (SELECT p_partkey AS id, range(3) AS b FROM part), m AS (SELECT id, list_sum([(1 << i) FOR i IN b IF {BYTE.format('id || chr(58) || i')} % 2 = 0])::INT AS mask FROM q) SELECT id, coalesce(mask, 0) AS mask, coalesce(((mask & 1) << 2) | ((mask >> 1) & 1) | (((mask >> 2) & 1) << 1), 0) AS turned FROM m")
def _(spark, sf):
    key, domain = F.col("p_partkey"), F.array(*map(F.lit, "xyz"))
    chosen = F.filter(domain, lambda _, i: generate._byte(key, i) % 2 == 0)
    rows = derive.table(spark, sf, "part").select(key.alias("id"), S.mask(chosen, domain).alias("mask"))
    return rows.withColumn("turned", S.turned_mask(F.col("mask"), F.array(F.lit(2), F.lit(0), F.lit(1))))


def _planted(rows: DataFrame, prefix: str, structure: Column, answer: Column, case: Column) -> DataFrame:
    """Rows of an audit: group and split follow the structure; some answers, kinds and groups are wrong."""
    k = F.col("scenario_id")
    rows = rows.withColumn("_s", structure)
    return rows.select(
        F.concat(F.lit("row-"), k.cast("string")).alias("record_id"), split_slot(F.col("_s")).alias("split"), F.when(k % 13 == 0, "other").otherwise(case).alias("case_kind"),
        F.when(k % 11 == 0, "nowhere").otherwise(answer).alias("answer_id"), F.concat(F.lit(prefix), F.when(k % 17 == 0, F.reverse("_s")).otherwise(F.col("_s"))).alias("source_group_id"),
        "option_ids", "parsed", "template_id", F.col("template_id").alias("expected_template"), "scenario",
    )


SLOT = "(['train', 'train', 'train', 'train', 'development', 'calibration', 'test', 'test'])[(('0x' || right(structure, 1))::INT % 8) + 1]"
PLANTED = "SELECT 'answer' AS code, 'row-' || p_partkey AS key FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT 'case_kind', 'row-' || p_partkey FROM part WHERE p_partkey % 13 = 0 UNION ALL SELECT 'group', 'row-' || p_partkey FROM part WHERE p_partkey % 17 = 0 UNION ALL SELECT 'vocabulary', 'shared'"


@query("i08_routing_audit", f"""WITH {routing_sql()}, placed AS (SELECT id, structure, rules_hash, scenario_hash, {SLOT} || '/routing-group-' || CASE WHEN id % 17 = 0 THEN reverse(structure) ELSE structure END AS place, {SLOT} AS split, k FROM structures JOIN named USING (id) JOIN (SELECT id, k FROM q) USING (id))
{PLANTED} UNION ALL SELECT 'feature_domains', 'row-' || id FROM placed WHERE k < 3
UNION ALL SELECT 'repeated_scenario', scenario_hash FROM placed GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'rules_cross', rules_hash FROM placed GROUP BY 2 HAVING count(DISTINCT place) > 1
UNION ALL SELECT 'structure_crosses', structure FROM placed GROUP BY 2 HAVING count(DISTINCT place) > 1""")
def _(spark, sf):
    s = F.col("scenario")
    rows = _planted(routing_rows(spark, sf, False), "routing-group-", S.routing_structure(s), S.settled(S.routing_outcomes(s)), S.routing_case(s))
    words = [(split, [split, "shared"] if split != "train" else [split, "other"]) for split in ("train", "development", "calibration", "test")]
    bank = spark.createDataFrame(words, "split string, terms array<string>")
    feats = F.array(*[F.struct(F.lit(f"f{i}").alias("name"), F.array(F.lit(f"b{i}"), F.lit(f"a{i}")).alias("values")) for i in range(3)])
    bank = bank.withColumn("features", feats).withColumn("destinations", F.array(*[F.lit(f"d{i}") for i in range(6)]))
    return S.audit_routing(rows, bank)


@query("i09_tool_audit", f"""WITH {tools_sql()}
{PLANTED} UNION ALL SELECT 'repeated_scenario', scenario_hash FROM named GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'repeated_catalog', catalog_hash FROM named GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'repeated_structure', structure FROM structures GROUP BY 2 HAVING count(*) > 1""")
def _(spark, sf):
    s = F.col("scenario")
    rows = _planted(tool_rows(spark, sf, False), "tool-group-", S.tool_structure(s), S.settled(S.tool_outcomes(s)), S.tool_case(s))
    words = [(split, [split, "shared"] if split != "train" else [split, "other"]) for split in ("train", "development", "calibration", "test")]
    bank = spark.createDataFrame(words, "split string, terms array<string>")
    lists = {"capabilities": ("c", 3), "input_types": ("i", 2), "permissions": ("p", 2), "tool_ids": ("t", 6)}
    bank = bank.withColumns({c: F.array(*[F.lit(f"{m}{i}") for i in range(n)]) for c, (m, n) in lists.items()})
    return S.audit_tools(rows, bank)


@query("i09_menu_table", f"WITH {tools_sql()}, rows AS (SELECT {SLOT} AS split, (n + 2)::INT AS menu_size, outcome FROM structures JOIN cases USING (id) JOIN q USING (id)) SELECT split, menu_size, count(*) FILTER (outcome NOT IN ('no_eligible_tool', 'insufficient_information')) AS tool, count(*) FILTER (outcome = 'no_eligible_tool') AS no_eligible_tool, count(*) FILTER (outcome = 'insufficient_information') AS insufficient_information FROM rows GROUP BY ALL")
def _(spark, sf):
    s = F.col("scenario")
    rows = derive.tool_scenarios(spark, sf).withColumn("split", split_slot(S.tool_structure(s)))
    return S.menu_table(rows, S.tool_answers(s), S.settled(S.tool_outcomes(s)))


@query("r10_generated_routing")
def _(spark, sf):
    out = generate.distinct_routing(spark, 20, {"train": 14, "development": 7, "calibration": 7, "test": 7})
    return out.select("split", "item", "attempt", "case_kind", "structure")


@query("r10_generated_tools")
def _(spark, sf):
    out = generate.distinct_tools(spark, 20, {"train": 14, "development": 7, "calibration": 7, "test": 7})
    return out.select("split", "item", "attempt", "case_kind", "structure")
