"""Registered queries over panels, outputs, gates and bundles and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelane.functions import text as T
from scorelane.operators import evidence as E
from scorelane.operators import exact, generate, metrics, records, scoring, stats
from scorelane.plans import derive
from scorelane.queries import DELTAS, RANK, RECORDS, SPLITS, rounded, scored_sql, state, turned
from scorelane.registry import query

PANEL = f"""{RECORDS}, panel AS (SELECT 'panel:' || record_id || ':' || k AS presentation_id, k, o, r.* FROM records r, (VALUES (0, 'high,low,mid'), (1, 'low,mid,high'), (2, 'mid,high,low')) t(k, o))"""
#: What an output row that is missing its first order lacks.
FIRST = "k = 0 AND doc_id % 7 > 0"


@query("j04_output_join", f"WITH {PANEL} SELECT presentation_id, fault FROM panel, (VALUES ('missing', 7), ('repeated_right', 29), ('differs: dataset_id', 11)) f(fault, m) WHERE k = 0 AND doc_id % m = 0 AND (m = 7 OR doc_id % 7 > 0)")
def _(spark, sf):
    return E.join_faults(derive.panel(spark, sf), derive.scored_panel(spark, sf, True), ["presentation_id"], ["dataset_id"])


@query("j05_gold_join", f"WITH {PANEL}, {scored_sql(orders=True)} SELECT presentation_id, p.answer_id, (s.top = p.answer_id) AS correct FROM panel p JOIN s ON s.record_id = p.record_id AND s.order_index = p.k")
def _(spark, sf):
    gold = derive.records(spark, sf).select("record_id", "dataset_id", "source_group_id", "answer_id")
    rows = E.matched(derive.scored_panel(spark, sf), gold, ["record_id"], ["dataset_id", "source_group_id"])
    return rows.select("presentation_id", "answer_id", (F.col("winner_option_id") == F.col("answer_id")).alias("correct"))


@query("j06_zip", "WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, lang FROM documents), b AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, lang FROM documents WHERE doc_id <> 5) SELECT position, CASE WHEN b.position IS NULL THEN 'missing' ELSE 'differs: lang' END AS fault FROM a LEFT JOIN b USING (position) WHERE b.position IS NULL OR a.lang IS DISTINCT FROM b.lang")
def _(spark, sf):
    docs = derive.table(spark, sf, "documents").select("doc_id", "lang")
    return E.zip_faults(docs, docs.filter("doc_id <> 5"), ["doc_id"], ["doc_id"], ["lang"])


KEY = ["record_id", "request_hash", "order_ids"]


@query("j07_reused_outputs", f"WITH {PANEL}, {scored_sql(orders=True)} SELECT presentation_id, 'old-' || presentation_id AS source_id, top AS winner_option_id FROM panel p JOIN s ON s.record_id = p.record_id AND s.order_index = p.k WHERE k = 0")
def _(spark, sf):
    old = derive.scored_panel(spark, sf).withColumn("presentation_id", F.concat(F.lit("old-"), "presentation_id"))
    now = derive.panel(spark, sf).filter("order_index = 0").select("presentation_id", *KEY)
    return E.reused(old, now, KEY, ["winner_option_id"]).select("presentation_id", "source_id", "winner_option_id")


@query("j08_paired_sets", f"WITH {RECORDS} SELECT record_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'unexpected' END AS fault FROM records WHERE (doc_id % 5 = 0) <> (doc_id % 6 = 0)")
def _(spark, sf):
    return E.join_faults(state(spark, sf).filter("doc_id % 6 > 0"), state(spark, sf, "control").filter("doc_id % 5 > 0"), ["record_id"])


@query("j16_lookup", f"WITH {RECORDS} SELECT DISTINCT source_group_id, length(source_group_id)::INT AS size FROM records WHERE NOT ends_with(source_group_id, '1')")
def _(spark, sf):
    opaque = lambda c: F.sha2(F.concat(F.lit("opaque:"), c), 256).alias("opaque_id")
    one = derive.table(spark, sf, "documents").select(opaque("source"), "source", F.length("source").alias("size")).distinct()
    candidates = one.unionByName(one.filter("endswith(source, '1')")).drop("source")  # some ids name two candidates
    wanted = derive.records(spark, sf).select("source_group_id", opaque("source_group_id")).distinct()
    return E.looked_up(wanted, candidates, "opaque_id").select("source_group_id", "size")


@query("j19_referenced", f"WITH {RECORDS} SELECT record_id, min(doc_id * 3 + k) AS first_seen FROM records, range(3) r(k) WHERE doc_id % 4 > 0 GROUP BY 1")
def _(spark, sf):
    shown = derive.panel(spark, sf).filter("doc_id % 4 > 0").select("record_id", (F.col("doc_id") * 3 + F.col("order_index")).alias("position"))
    return E.referenced(shown, derive.records(spark, sf).select("record_id"), "record_id", "position")


@query("j19_membership", f"WITH {RECORDS} SELECT record_id, 'not shown' AS fault FROM records WHERE doc_id % 4 = 0 AND doc_id % 3 > 0 UNION ALL SELECT record_id, 'no record' FROM records WHERE doc_id % 4 > 0 AND doc_id % 3 = 0")
def _(spark, sf):
    rows = derive.records(spark, sf)
    return E.membership_faults(derive.panel(spark, sf).filter("doc_id % 4 > 0"), rows.filter("doc_id % 3 > 0"), "record_id")


@query("j20_regrouped", f"WITH {RECORDS} SELECT record_id, CASE WHEN dataset_id <> 'quality-de' OR doc_id % 9 = 0 THEN source_group_id ELSE 'alias:' || dataset_id || ':' || source_group_id END AS source_group_id, CASE WHEN dataset_id = 'quality-de' AND doc_id % 9 = 0 THEN 'no alias' END AS fault FROM records")
def _(spark, sf):
    alias = F.concat_ws(":", F.lit("alias"), "dataset_id", "source_group_id")
    shown = derive.panel(spark, sf).withColumn("source_group_id", F.when((F.col("dataset_id") == "quality-de") & (F.col("doc_id") % 9 > 0), alias).otherwise(F.col("source_group_id")))
    return E.regrouped(shown, derive.records(spark, sf), ["quality-de"], "alias").select("record_id", "source_group_id", "fault")


@query("j21_reuse_faults", f"WITH {RECORDS} SELECT record_id AS record, CASE WHEN doc_id % 8 = 0 THEN 'not scored before' ELSE 'not a dropped order' END AS fault FROM records, range(3) r(k) WHERE (doc_id % 8 = 0 AND (k = 0 OR dataset_id <> 'quality-fr')) OR (doc_id % 8 > 0 AND dataset_id = 'quality-de' AND doc_id % 10 = 1 AND k > 0)")
def _(spark, sf):
    every = derive.scored_panel(spark, sf).withColumn("n", F.regexp_extract("record_id", r"\d+", 0).cast("long"))
    # of one dataset only the first order stays in the panel; some rows weren't scored, some panel rows were lost
    now = every.filter("dataset_id <> 'quality-fr' OR order_index = 0").filter("NOT (dataset_id = 'quality-de' AND n % 10 = 1 AND n % 8 > 0 AND order_index > 0)")
    return E.reuse_faults(every.filter("n % 8 > 0"), now, KEY, "record_id", F.col("order_index") == 0, "quality-fr")


@query("j22_prior_groups", "SELECT source AS group_id, count(DISTINCT lang) AS panels FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def _(spark, sf):
    return E.prior_groups(derive.table(spark, sf, "documents").select(F.col("lang").alias("panel"), F.col("source").alias("group_id")).distinct())


@query("j23_lineage", f"WITH {RECORDS} SELECT record_id, CASE WHEN doc_id % 9 = 4 THEN 'missing' ELSE 'differs: lang' END AS fault FROM records WHERE doc_id % 9 = 4 OR (doc_id % 10 = 3 AND doc_id % 9 <> 4) UNION ALL SELECT 'doc-' || doc_id, 'unexpected' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 9 <> 4")
def _(spark, sf):
    rows = derive.records(spark, sf).select("record_id", F.substring("dataset_id", 9, 100).alias("lang"))
    docs = derive.table(spark, sf, "documents").filter("doc_id % 9 <> 4")
    return E.join_faults(rows, docs.select(F.concat(F.lit("doc-"), "doc_id").alias("record_id"), F.when(F.col("doc_id") % 10 == 3, "xx").otherwise(F.col("lang")).alias("lang")), ["record_id"], ["lang"])


@query("j24_compiled", f"WITH {PANEL} SELECT presentation_id, 'differs: input_tokens' AS fault FROM panel WHERE k = 1 AND doc_id % 6 = 0")
def _(spark, sf):
    every = derive.scored_panel(spark, sf)
    other = every.withColumn("input_tokens", F.when((F.col("order_index") == 1) & (F.regexp_extract("record_id", r"\d+", 0).cast("long") % 6 == 0), 1).otherwise(F.col("input_tokens")))
    return E.join_faults(every, other, ["presentation_id"], ["request_hash", "order_ids", "input_tokens"])


@query("j26_panel_winners", f"WITH {RECORDS}, {scored_sql(orders=True)} SELECT record_id, order_index::INT AS order_index, top AS winner FROM s")
def _(spark, sf):
    every = derive.scored_panel(spark, sf)
    return E.panel_winners(derive.panel(spark, sf).select(*E.IDENTITY), every.select("presentation_id", "request_hash", "order_ids", "input_tokens", "prompt_sha256"), every)


@query("j26_panel_faults", f"WITH {PANEL} SELECT presentation_id, 'orders incomplete' AS fault FROM panel WHERE doc_id % 5 = 0 AND k < 2 UNION ALL SELECT presentation_id, 'output missing' FROM panel WHERE doc_id % 4 = 0 AND k = 1 UNION ALL SELECT presentation_id, 'prompt unexpected' FROM panel WHERE doc_id % 5 = 0 AND k = 2")
def _(spark, sf):
    every = derive.scored_panel(spark, sf).withColumn("n", F.regexp_extract("record_id", r"\d+", 0).cast("long"))
    compiled = every.select("presentation_id", "request_hash", "order_ids", "input_tokens", "prompt_sha256")
    return E.panel_faults(every.filter("NOT (n % 5 = 0 AND order_index = 2)"), compiled, every.filter("NOT (n % 4 = 0 AND order_index = 1)"), 3)


@query("t14_output_faults", f"WITH {PANEL}, f(fault, m) AS (VALUES ('missing', 7), ('differs: dataset_id', 11), ('repeated_right', 29)), g(fault, m) AS (VALUES ('winner', 13), ('tokens', 17), ('prompt', 19), ('logits don''t match options', 23)), copies AS (SELECT *, unnest(range(CASE WHEN doc_id % 29 = 0 THEN 2 ELSE 1 END)) AS c FROM panel WHERE {FIRST}), {scored_sql(orders=True)}, cut AS (SELECT record_id, min(id) FILTER (logit = m2) AS w FROM (SELECT record_id, id, logit, max(logit) OVER (PARTITION BY record_id) AS m2 FROM s_l WHERE order_index = 0 AND id <> 'mid') GROUP BY 1) SELECT presentation_id, fault FROM panel, f WHERE k = 0 AND doc_id % m = 0 AND (m = 7 OR doc_id % 7 > 0) UNION ALL SELECT presentation_id, fault FROM copies, g WHERE doc_id % m = 0 UNION ALL SELECT presentation_id, 'winner' FROM copies c JOIN s ON s.record_id = c.record_id AND s.order_index = 0 JOIN cut ON cut.record_id = c.record_id WHERE doc_id % 23 = 0 AND doc_id % 13 > 0 AND top <> w")
def _(spark, sf):
    return E.output_faults(derive.scored_panel(spark, sf, True), derive.panel(spark, sf))


@query("t16_reload_parity", f"WITH {RECORDS}, {scored_sql(orders=True)} SELECT count(*) AS rows, 0.0625::DOUBLE AS logit_gap, count(*) AS same_winners, true AS passes FROM s WHERE order_index = 0")
def _(spark, sf):
    one = derive.scored_panel(spark, sf).filter("order_index = 0")
    again = one.withColumn("candidate_logits", F.transform("candidate_logits", lambda x: x + 0.0625))
    stored = one.agg(F.count("*").alias("rows"), F.lit(0.0625).alias("logit_gap"), F.count("*").alias("same_winners"))
    return E.reload_parity(one, again, "presentation_id", stored)


@query("a19_by_option_count", f"WITH {RECORDS}, {scored_sql(orders=True)} SELECT dataset_id, CASE WHEN order_index < 3 THEN 3 END::INT AS options, count(*) AS n, sum(correct)::BIGINT AS correct FROM s GROUP BY ALL")
def _(spark, sf):
    return turned(spark, sf).groupBy("dataset_id", F.size("ids").alias("options")).agg(F.count("*").alias("n"), F.sum("correct").alias("correct"))


@query("c04_status", f"WITH {RECORDS} SELECT record_id, CASE WHEN doc_id % 2 = 0 THEN 'profile_id_supplied' ELSE 'uncalibrated' END AS calibration_status FROM records")
def _(spark, sf):
    return derive.records(spark, sf).select("record_id", scoring.calibration_status(F.when(F.col("doc_id") % 2 == 0, "p")).alias("calibration_status"))


@query("o05_orders", "WITH q AS (SELECT p_partkey AS id, ([2, 3, 4, 8, 16])[p_partkey % 5 + 1] AS n, p_partkey % 3 = 0 AS calibration FROM part) SELECT id, n::INT AS n, CASE WHEN calibration THEN 1 WHEN n = 2 THEN 2 WHEN n = 3 THEN 6 ELSE n END::INT AS orders, CASE WHEN calibration THEN 'o0' WHEN n = 2 THEN 'o1' WHEN n = 3 THEN 'o2' ELSE 'o' || (n - 1) END AS last_first FROM q")
def _(spark, sf):
    n = F.element_at(F.array(*map(F.lit, (2, 3, 4, 8, 16))), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = derive.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), n.alias("n"), (F.col("p_partkey") % 3 == 0).alias("calibration"))
    options = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.concat(F.lit("o"), i.cast("string")))
    rows = rows.withColumn("all", scoring.orders(options, F.col("calibration")))
    return rows.select("id", "n", F.size("all").alias("orders"), F.get(F.element_at("all", -1), F.lit(0)).alias("last_first"))


@query("l03_lexicographic", f"WITH {RECORDS}, g AS (SELECT source_group_id FROM records GROUP BY 1 ORDER BY sha256('groups:9:' || source_group_id) LIMIT 6) SELECT source_group_id, min(record_id) AS record_id FROM records SEMI JOIN g USING (source_group_id) GROUP BY 1")
def _(spark, sf):
    return records.representatives(derive.records(spark, sf), "source_group_id", T.rank("groups", 9, F.col("source_group_id")), 6, [F.col("record_id")]).select("source_group_id", "record_id")


@query("d03_full_rows", "WITH d AS (SELECT DISTINCT text, lang, source FROM documents) SELECT sha256(text) AS key, lang, source FROM d WHERE text IN (SELECT text FROM d GROUP BY 1 HAVING count(*) = 1)")
def _(spark, sf):
    docs = derive.table(spark, sf, "documents").select(F.sha2("text", 256).alias("key"), "lang", "source").filter("key IS NOT NULL")
    return E.identical_or_faulty(docs, ["key"])[0]


@query("p03_allowed", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def _(spark, sf):
    return E.allowed(derive.table(spark, sf, "documents").select("doc_id", "lang"), "lang", ["de", "fr"])


@query("p06_dispatch", "SELECT doc_id, CASE WHEN starts_with(lang, 'd') THEN 'german' WHEN ends_with(source, '1') THEN 'first' END AS kind FROM documents")
def _(spark, sf):
    docs = derive.table(spark, sf, "documents")
    return docs.withColumn("name", F.concat_ws("/", "lang", "source")).select("doc_id", E.kind_of(F.col("name"), {"d": "german"}, {"1": "first"}).alias("kind"))


@query("p07_counts", "WITH e(lang, expected) AS (VALUES ('de', 10), ('xx', 3)) SELECT lang, coalesce(n, 0)::BIGINT AS n, coalesce(expected, 0)::BIGINT AS expected FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) FULL JOIN e USING (lang) WHERE coalesce(n, 0) <> coalesce(expected, 0)")
def _(spark, sf):
    return E.count_faults(derive.table(spark, sf, "documents"), ["lang"], spark.createDataFrame([("de", 10), ("xx", 3)], "lang string, expected long"))


@query("i06_one_split", f"WITH {SPLITS} SELECT lang, count(DISTINCT split) AS splits FROM docs GROUP BY 1 HAVING count(DISTINCT split) > 1")
def _(spark, sf):
    return derive.splits(spark, sf).groupBy("lang").agg(F.countDistinct("split").alias("splits")).filter("splits > 1")


@query("i07_scenario_partition", f"WITH {SPLITS} SELECT request_hash, count(*) AS n, count(DISTINCT split) AS splits FROM docs GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    return derive.splits(spark, sf).groupBy("request_hash").agg(F.count("*").alias("n"), F.countDistinct("split").alias("splits")).filter("n > 1")


@query("i11_leaked_requests", f"WITH {SPLITS}, k AS (SELECT d.doc_id, split, md5(lower(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' '))) AS k FROM docs d JOIN documents USING (doc_id)) SELECT doc_id FROM k WHERE split = 'train' AND k IN (SELECT k FROM k WHERE split = 'test')")
def _(spark, sf):
    # the SQL folds A to Z only; no text of the given tables differs in other letters' case alone
    text = derive.table(spark, sf, "documents").select(F.col("doc_id").alias("_d"), T.nfkc_casefolded("text").alias("key"))
    docs = derive.splits(spark, sf).join(text, F.col("doc_id") == F.col("_d"))
    return docs.filter("split = 'train'").join(docs.filter("split = 'test'").select("key").distinct(), "key", "left_semi").select("doc_id")


@query("i13_selections", "WITH s AS (SELECT lang AS selection, count(*) AS n, count(DISTINCT sha256(text)) AS u FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT selection, 'count' AS fault FROM s WHERE selection = 'de' UNION ALL SELECT selection, 'repeated item_id' FROM s WHERE u < n UNION ALL SELECT selection, 'repeated group_id' FROM s WHERE n > 20 UNION ALL SELECT selection, 'digest' FROM s")
def _(spark, sf):
    docs = derive.table(spark, sf, "documents").filter("text IS NOT NULL")
    rows = docs.select(F.col("lang").alias("selection"), F.lit("corpus").alias("source"), F.lit("train").alias("split"), F.col("doc_id").alias("row_id"), F.sha2("text", 256).alias("item_id"), F.col("source").alias("group_id"))
    told = rows.groupBy("selection").agg(F.count("*").alias("n")).select("selection", F.when(F.col("selection") == "de", 0).otherwise(F.col("n")).alias("n"), F.lit("none").alias("digest"))
    return E.selection_faults(rows, told)


@query("i15_candidates", f"WITH {RECORDS}, f AS (SELECT source_group_id FROM records GROUP BY 1 HAVING count(DISTINCT answer_id) = 2), e AS (SELECT * FROM records SEMI JOIN f USING (source_group_id)) SELECT count(DISTINCT source_group_id) AS groups, count(*) FILTER (answer_id = 'high') AS n_high, count(*) FILTER (answer_id = 'low') AS n_low, count(*) FILTER (doc_id % 5 = 0) AS held_out_pairs FROM e")
def _(spark, sf):
    rows = derive.records(spark, sf).withColumn("pair_key", F.sha2("record_id", 256))
    return E.candidate_summary(rows, rows.filter("doc_id % 5 = 0").select("pair_key"), ["high", "low"])


@query("i17_partition", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'in no part' ELSE 'in several parts' END AS fault FROM documents WHERE doc_id % 10 = 0 OR (doc_id % 10 = 3 AND doc_id % 6 = 1) UNION ALL SELECT -1, 'not in the whole'")
def _(spark, sf):
    docs = derive.table(spark, sf, "documents").select("doc_id")
    extra = spark.createDataFrame([(-1,)], docs.schema)
    parts = {"low": docs.filter("doc_id % 10 BETWEEN 1 AND 4"), "high": docs.filter("doc_id % 10 > 4"), "more": docs.filter("doc_id % 10 = 3 AND doc_id % 6 = 1").union(extra)}
    return E.partition_faults(docs, parts, "doc_id")


EXACT = f"""WITH {RECORDS}, {", ".join(scored_sql(f"s_{x}", x, True) for x in ("base", "control", "treatment"))}, every AS ({" UNION ALL ".join(f"SELECT '{x}' AS state, * FROM s_{x}" for x in ("base", "control", "treatment"))}),
r AS (SELECT state, dataset_id AS task, source_group_id, record_id, avg(correct) AS a FROM every GROUP BY ALL), g AS (SELECT state, task, source_group_id, avg(a) AS a FROM r GROUP BY ALL), v AS (SELECT state, task, avg(a) AS a FROM g GROUP BY ALL)"""


def _values(spark, sf):
    parts = [turned(spark, sf, x).select(F.lit(x).alias("state"), F.col("dataset_id").alias("task"), "source_group_id", "record_id", "correct") for x in ("base", "control", "treatment")]
    return exact.mean_of_groups(exact.group_fractions(parts[0].union(parts[1]).union(parts[2]), ["state", "task"]), ["state", "task"])


@query("a11_exact_accuracy", f"{EXACT} SELECT state, task, round(a, 9) AS accuracy FROM v")
def _(spark, sf):
    return _values(spark, sf).select("state", "task", F.round(exact.ratio("num", "den"), 9).alias("accuracy"))


@query("t10_gate_set", f"{EXACT}, d AS (SELECT f.task, f.a - b.a AS delta FROM v f JOIN v b ON f.task = b.task AND f.state = 'treatment' AND b.state = 'base') SELECT 'gain ' || task AS gate, round(delta, 9) AS delta, delta >= -0.05::DOUBLE AS passes FROM d UNION ALL SELECT 'strict ' || task, round(delta, 9), delta >= -0.05::DOUBLE AND task = 'quality-de' FROM d")
def _(spark, sf):
    values = _values(spark, sf)
    tasks = values.filter("task IS NOT NULL").select("task").distinct()
    one = lambda head, strict: tasks.select(F.concat(F.lit(head), "task").alias("gate"), "task", F.lit("treatment").alias("final"), F.lit("base").alias("base"), F.lit(-1).alias("min_num"), F.lit(20).alias("min_den"), F.lit(strict).alias("strict"))
    lows = tasks.select(F.concat(F.lit("strict "), "task").alias("gate"), F.when(F.col("task") == "quality-de", 0.01).otherwise(0.0).alias("low"))
    return rounded(exact.gates(values, one("gain ", False).union(one("strict ", True)), lows).drop("low"), "delta")


@query("t11_anchors", f"{EXACT} SELECT 'anchor ' || task AS gate, round(a - 1e0 / 3, 9) AS delta, 3 * a >= 1 - 3 * 0.05::DOUBLE AS passes FROM v WHERE state = 'treatment'")
def _(spark, sf):
    values = _values(spark, sf)
    anchors = values.select("task").distinct().select(F.concat(F.lit("anchor "), "task").alias("gate"), "task", F.lit("treatment").alias("state"), F.lit(1).alias("at_num"), F.lit(3).alias("at_den"), F.lit(-1).alias("min_num"), F.lit(20).alias("min_den"))
    return rounded(exact.anchor_gates(values, anchors), "delta")


DRAWN = """drawn AS (SELECT d AS draw, ('0x' || substr(sha256('{task}:' || d || ':' || p), 1, 15))::BIGINT % n AS idx FROM n, range(2000) r(d), (SELECT unnest(range(n)) AS p FROM n))"""


@query("t05_mean_ratio", f"""WITH {RECORDS}, {scored_sql()}, {scored_sql("c", "treatment")}, g AS (SELECT row_number() OVER (ORDER BY source_group_id) - 1 AS idx, * FROM (SELECT s.source_group_id, sum(c.correct) AS hits, sum(s.correct) AS base_hits, count(*) AS total FROM s JOIN c USING (record_id) GROUP BY 1)), n AS (SELECT count(*) AS n FROM g), {DRAWN.format(task="quality")},
means AS (SELECT draw, avg(hits::DOUBLE / total - base_hits::DOUBLE / total) AS m FROM drawn JOIN g USING (idx) GROUP BY 1)
SELECT 'quality' AS task, (SELECT n FROM n) AS groups, round((SELECT sum(hits)::DOUBLE / sum(total) - sum(base_hits)::DOUBLE / sum(total) FROM g), 9) AS difference, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM means""")
def _(spark, sf):
    one = lambda salt, name: state(spark, sf, salt).select("record_id", "source_group_id", F.col("correct").alias(name))
    both = E.matched(one("treatment", "h"), one("base", "b"), ["record_id"], ["source_group_id"])
    sums = both.groupBy("source_group_id").agg(F.sum("h").alias("hits"), F.sum("b").alias("base_hits"), F.count("*").alias("total")).withColumn("base_total", F.col("total"))
    groups = stats.numbered(sums.withColumn("task", F.lit("quality")), "task", "source_group_id")
    drawn = stats.hashed_bank(groups.groupBy("task").agg(F.count("*").alias("n")), "task", 2000)
    return rounded(exact.mean_ratio_intervals(groups, drawn, "task"), "difference", "low", "high")


@query("t06_macro", f"""WITH {RECORDS}, {scored_sql()}, {scored_sql("c", "treatment")}, g AS (SELECT s.dataset_id AS task, row_number() OVER (PARTITION BY s.dataset_id ORDER BY s.source_group_id) - 1 AS idx, avg(c.correct) - avg(s.correct) AS delta FROM s JOIN c USING (record_id) GROUP BY s.dataset_id, s.source_group_id), n AS (SELECT task, count(*) AS n FROM g GROUP BY 1),
drawn AS (SELECT task, d AS draw, ('0x' || substr(sha256(task || ':' || d || ':' || p), 1, 15))::BIGINT % n AS idx FROM (SELECT task, n, unnest(range(n)) AS p FROM n), range(2000) r(d)),
m AS (SELECT draw, avg(m) AS m FROM (SELECT task, draw, avg(delta) AS m FROM drawn JOIN g USING (task, idx) GROUP BY ALL) GROUP BY 1)
SELECT (SELECT count(*) FROM n) AS tasks, round((SELECT avg(d) FROM (SELECT avg(delta) AS d FROM g GROUP BY task)), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m""")
def _(spark, sf):
    one = lambda salt, name: state(spark, sf, salt).groupBy(F.col("dataset_id").alias("task"), "source_group_id").agg(F.avg("correct").alias(name))
    both = one("treatment", "a").join(one("base", "b"), ["task", "source_group_id"])
    deltas = stats.numbered(both.select("task", "source_group_id", (F.col("a") - F.col("b")).alias("delta")), "task", "source_group_id")
    drawn = stats.hashed_bank(deltas.groupBy("task").agg(F.count("*").alias("n")), "task", 2000)
    return rounded(exact.macro_intervals(deltas, drawn, "task"), "mean", "low", "high")


@query("r11_epoch_shuffle")
def _(spark, sf):
    rows = derive.records(spark, sf).select(F.col("doc_id").alias("place"), "record_id", F.array(*map(F.lit, derive.IDS)).alias("option_ids"), "answer_id")
    return generate.epoch_examples(rows, 7, 2).withColumn("option_ids", F.array_join("option_ids", ","))


@query("f21_names", "SELECT p_partkey, (['ka', 'lo', 'mi'])[(p_partkey // 27) % 3 + 1] || (['ka', 'lo', 'mi'])[(p_partkey // 9) % 3 + 1] || (['ka', 'lo', 'mi'])[(p_partkey // 3) % 3 + 1] || (['ka', 'lo', 'mi'])[p_partkey % 3 + 1] AS name FROM part")
def _(spark, sf):
    return derive.table(spark, sf, "part").select("p_partkey", generate.syllable_name(F.col("p_partkey"), ["ka", "lo", "mi"]).alias("name"))


@query("t07_bank_digest")
def _(spark, sf):
    sizes = [(r["lang"], r["n"]) for r in derive.table(spark, sf, "documents").groupBy("lang").agg(F.countDistinct("source").alias("n")).orderBy("lang").collect()]
    return spark.createDataFrame([(exact.bank_digest(exact.drawn_bank(20, sizes, 200)),)], "digest string")


@query("a17_by_order", f"WITH {RECORDS}, {scored_sql(orders=True)} SELECT dataset_id, order_index::INT AS order_index, count(*) AS n, round(avg(correct), 9) AS accuracy, count(*) FILTER (tied) AS ties FROM s GROUP BY ALL")
def _(spark, sf):
    return rounded(metrics.by_order(turned(spark, sf), ["dataset_id"]), "accuracy")


@query("a16_repeats", f"WITH {RECORDS}, k AS (SELECT dataset_id, source_group_id, count(*) AS k FROM records GROUP BY ALL) SELECT dataset_id, count(*) AS records, sum(k)::BIGINT AS rows, max(k) AS most, count(*) FILTER (k > 1) AS repeated FROM k GROUP BY 1")
def _(spark, sf):
    return metrics.repeats(derive.records(spark, sf), ["dataset_id"], "source_group_id")


@query("a16_positions", f"WITH {PANEL} SELECT dataset_id, 3 AS options, (list_position(string_split(o, ','), answer_id) - 1)::INT AS position, count(*) AS n FROM panel GROUP BY ALL")
def _(spark, sf):
    return metrics.shown_at(derive.panel(spark, sf), ["dataset_id"], "order_ids", "answer_id")


@query("o09_id_forms", f"WITH {PANEL} SELECT presentation_id, sha256('{{\"namespace\":\"panel\",\"order_ids\":[\"' || replace(o, ',', '\",\"') || '\"],\"record_id\":\"' || record_id || '\"}}') AS digest, sha256('panel' || chr(0) || record_id || chr(0) || replace(o, ',', chr(0))) AS joined FROM panel")
def _(spark, sf):
    rows = derive.panel(spark, sf)
    return rows.select("presentation_id", scoring.presentation_digest(namespace=F.lit("panel"), record_id=F.col("record_id"), order_ids=F.col("order_ids")).alias("digest"), scoring.joined_digest(F.lit("panel"), F.col("record_id"), F.col("order_ids")).alias("joined"))


@query("f07_opaque_ids", "SELECT doc_id, 'doc-' || sha256('[\"doc\",\"' || doc_id || '\",\"' || source || '\"]') AS opaque_id FROM documents")
def _(spark, sf):
    return derive.table(spark, sf, "documents").select("doc_id", T.opaque_id("doc", F.col("doc_id"), F.col("source")).alias("opaque_id"))


@query("d04_conflicts", "SELECT sha256(text) AS key, count(DISTINCT source) AS labels FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1")
def _(spark, sf):
    return records.conflicting(derive.table(spark, sf, "documents").select(F.sha2("text", 256).alias("key"), "source").filter("key IS NOT NULL"), ["key"], "source")


@query("l08_quota", f"WITH {RECORDS}, g AS (SELECT source_group_id, row_number() OVER (ORDER BY sha256('deal:5:' || source_group_id), source_group_id) - 1 AS i FROM records GROUP BY 1 HAVING count(DISTINCT answer_id) = 2), d AS (SELECT source_group_id, CASE i % 2 WHEN 0 THEN 'high' ELSE 'low' END AS answer_id FROM g WHERE i < 6) SELECT source_group_id, answer_id, min_by(record_id, ({RANK}, record_id)) AS record_id FROM records JOIN d USING (source_group_id, answer_id) GROUP BY ALL")
def _(spark, sf):
    rows = derive.records(spark, sf).withColumn("rank", T.rank("select", 7, F.col("doc_id")))
    got = records.balanced(rows, "source_group_id", "answer_id", ["high", "low"], T.rank("deal", 5, F.col("source_group_id")), [F.col("rank"), F.col("record_id")], 3)
    return got.select("source_group_id", "answer_id", "record_id")


@query("t12_ledger", "WITH d AS (SELECT o_orderkey AS step, o_orderstatus AS category, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) SELECT step, 'not the planned spec' AS fault FROM d WHERE step % 11 = 0 AND step % 13 > 0 UNION ALL SELECT step, 'not planned' FROM d WHERE step % 13 = 0 UNION ALL SELECT step, 'category cap' FROM d WHERE k > CASE category WHEN 'O' THEN 100 WHEN 'F' THEN 5000 ELSE 0 END UNION ALL SELECT step, 'total cap' FROM d WHERE n > 14000")
def _(spark, sf):
    orders = derive.table(spark, sf, "orders").select(F.col("o_orderkey").alias("step"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("spec"), F.col("o_orderstatus").alias("category"))
    plan = orders.filter("step % 13 > 0").withColumn("spec", F.when(F.col("step") % 11 == 0, "other").otherwise(F.col("spec")))
    return stats.ledger_faults(orders, plan, "step", "spec", "category", {"O": 100, "F": 5000}, 14000)


@query("t13_event_faults", "WITH e AS (SELECT conv_id, turn, role, row_number() OVER w AS p, lag(turn) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, 'kind' AS fault FROM e WHERE coalesce((['system', 'user', 'assistant', 'user'])[p], '') <> role UNION ALL SELECT conv_id, turn, 'time' FROM e WHERE turn // 2 <= t // 2 UNION ALL SELECT conv_id, turn, 'calls lost' FROM e WHERE turn % 3 = 0 AND t IS NOT NULL")
def _(spark, sf):
    rows = derive.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.floor(F.col("turn") / 2).alias("ts"))
    calls = F.when(F.col("turn") % 3 == 0, F.array(F.lit("b"))).when(F.col("turn") % 3 == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return stats.event_faults(rows.withColumn("calls", calls), "conv_id", "turn", "ts", "role", ["system", "user", "assistant", "user"], "calls")


@query("u04_complete_groups", f"WITH {RECORDS}, g AS (SELECT source_group_id, dataset_id, list_sort(list(DISTINCT answer_id)) AS s FROM records WHERE doc_id % 3 > 0 GROUP BY ALL), n AS (SELECT source_group_id || dataset_id AS g, s FROM g) SELECT g, s = ['high', 'low'] AS exact FROM n WHERE list_has_all(s, ['high']) ")
def _(spark, sf):
    rows = derive.records(spark, sf).filter("doc_id % 3 > 0").withColumn("g", F.concat("source_group_id", "dataset_id"))
    some = records.complete_groups(rows, "g", "answer_id", ["high"])
    both = records.complete_groups(rows, "g", "answer_id", ["high", "low"], exact=True).withColumn("_e", F.lit(True))
    return some.join(both, "g", "left").select("g", F.coalesce("_e", F.lit(False)).alias("exact"))


@query("l04_label_order", "WITH x AS (SELECT DISTINCT CASE WHEN p_size % 7 = 0 THEN 'x' || p_size ELSE p_size::VARCHAR END AS label FROM part) SELECT label, row_number() OVER (ORDER BY try_cast(label AS BIGINT) IS NULL, try_cast(label AS BIGINT), label) - 1 AS place FROM x")
def _(spark, sf):
    size = F.col("p_size").cast("string")
    labels = derive.table(spark, sf, "part").select(F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("x"), size)).otherwise(size).alias("label")).distinct()
    ranked = labels.withColumn("_o", records.label_order(F.col("label")))
    return records.numbered(ranked, ["_o"], "place").select("label", F.col("place").cast("long").alias("place"))
