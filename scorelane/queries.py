"""Registered queries of the evaluation engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.functions import text as T
from scorelane.operators import calibration, generate, metrics, records, rules, scoring, stats
from scorelane.plans import derive
from scorelane.registry import QUERIES, SQL, query
from scorelane.streaming import events as streams

NAMES = ("accuracy", "macro_f1", "nll", "brier", "ece", "coverage", "accepted_risk", "aurc")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in names})


def state(spark: SparkSession, sf_dir: str, salt: str = "base") -> DataFrame:
    """Judged records of a state; abstained on a tie or below a confidence of one half."""
    return scoring.judged(scoring.scored(derive.outputs(derive.records(spark, sf_dir), salt), min_confidence=0.5))


def turned(spark: SparkSession, sf_dir: str, salt: str = "base") -> DataFrame:
    return scoring.judged(scoring.scored(derive.presentations(derive.records(spark, sf_dir), salt)))


RECORDS = """records AS (
  SELECT 'doc-' || doc_id AS record_id, 'quality-' || lang AS dataset_id, source AS source_group_id, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS answer_id, doc_id
  FROM labels JOIN documents USING (doc_id))"""


def scored_sql(name: str = "s", salt: str = "base", orders: bool = False) -> str:
    """Common table expressions that end in judged rows ``name``."""
    key = "record_id || ':' || order_index" if orders else "record_id"
    turns = "(VALUES (0), (1), (2)) t(order_index)" if orders else "(VALUES (0)) t(order_index)"
    return f"""{name}_l AS (
  SELECT r.*, order_index, id, ((('0x' || substr(sha256({key} || ':' || id || ':{salt}'), 1, 4))::INT % 13) - 6)::DOUBLE AS logit, (pos - order_index + 3) % 3 AS position
  FROM records r, (VALUES ('high', 0), ('low', 1), ('mid', 2)) o(id, pos), {turns}),
{name}_m AS (SELECT *, max(logit) OVER w AS m, sum(exp(logit)) OVER w AS z FROM {name}_l WINDOW w AS (PARTITION BY record_id, order_index)),
{name}_p AS (SELECT *, logit - ln(z) AS lp, exp(logit) / z AS p FROM {name}_m),
{name}_t AS (
  SELECT record_id, order_index, any_value(dataset_id) AS dataset_id, any_value(source_group_id) AS source_group_id, any_value(answer_id) AS answer_id,
    min(id) FILTER (logit = m) AS top, count(*) FILTER (logit = m) > 1 AS tied, max(p) AS confidence, max(lp) FILTER (id = answer_id) AS gold, sum((p - (id = answer_id)::INT) ** 2) AS brier,
    list(p ORDER BY id) AS ps, max(position) FILTER (id = answer_id) AS gold_position
  FROM {name}_p GROUP BY record_id, order_index),
{name} AS (SELECT *, (top = answer_id)::INT AS correct, (tied OR confidence < 0.5) AS abstained FROM {name}_t)"""


def report_sql(by: str) -> str:
    g, p, on = (f"{by},", f"PARTITION BY {by}", f"USING ({by})") if by else ("", "", "ON true")
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH {RECORDS}, {scored_sql()},
basic AS (SELECT {g} count(*) AS n, avg(correct) AS accuracy, avg(-gold) AS nll, avg(brier) AS brier, avg((NOT abstained)::INT) AS coverage,
  avg(1 - correct) FILTER (NOT abstained) AS accepted_risk FROM s {group}),
sides AS (SELECT {g} answer_id AS label, correct AS tp FROM s UNION ALL SELECT {g} top, 0 FROM s),
f AS (SELECT {g} avg(f1) AS macro_f1 FROM (SELECT {g} label, 2 * sum(tp)::DOUBLE / count(*) AS f1 FROM sides GROUP BY {g} label) {group}),
b AS (SELECT {g} least(len(list_filter([0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE], lambda e: confidence >= e)), 9) AS bin, count(*) AS k, avg(confidence) AS c, avg(correct) AS a FROM s GROUP BY ALL),
e AS (SELECT {g} sum(k * abs(c - a)) / sum(k) AS ece FROM b {group}),
steps AS (SELECT {g} round(confidence, 12) AS conf, count(*) AS k, sum(1 - correct) AS wrong FROM s GROUP BY ALL),
curve AS (SELECT {g} k::DOUBLE / sum(k) OVER ({p}) AS step, sum(wrong) OVER ({p} ORDER BY conf DESC)::DOUBLE / sum(k) OVER ({p} ORDER BY conf DESC) AS risk FROM steps),
u AS (SELECT {g} sum(step * risk) AS aurc FROM curve {group}),
report AS (SELECT * FROM basic JOIN f {on} JOIN e {on} JOIN u {on})"""


ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in NAMES)


@query("eval_report_per_dataset", f"{report_sql('dataset_id')} SELECT dataset_id, n, {ROUNDED} FROM report")
def _(spark, sf):
    return rounded(metrics.report(state(spark, sf), ["dataset_id"], digits=12), *NAMES)


@query("eval_report_pooled", f"{report_sql('')} SELECT n, {ROUNDED} FROM report")
def _(spark, sf):
    return rounded(metrics.report(state(spark, sf), [], digits=12), *NAMES)


@query("a09_macro_over_datasets", f"{report_sql('dataset_id')} SELECT " + ", ".join(f"round(avg({c}), 9) AS macro_dataset_{c}" for c in NAMES[:5]) + " FROM report")
def _(spark, sf):
    out = metrics.macro_report(metrics.report(state(spark, sf), ["dataset_id"], digits=12))
    return rounded(out, *out.columns)


@query("a05_ece_bins", f"{report_sql('dataset_id')} SELECT dataset_id, bin::INT AS bin, k AS n, round(c, 9) AS mean_confidence, round(a, 9) AS accuracy FROM b")
def _(spark, sf):
    return rounded(metrics.bins(state(spark, sf), ["dataset_id"]), "mean_confidence", "accuracy")


@query("a07_risk_coverage", f"WITH {RECORDS}, {scored_sql()}, k AS (SELECT round(confidence, 9) AS confidence, count(*) AS k, sum(1 - correct) AS wrong FROM s GROUP BY ALL) SELECT confidence, round(sum(k) OVER w / sum(k) OVER (), 9) AS coverage, round(sum(wrong) OVER w / sum(k) OVER w, 9) AS risk FROM k WINDOW w AS (ORDER BY confidence DESC)")
def _(spark, sf):
    return rounded(metrics.risk_curve(state(spark, sf), [], digits=9).drop("step"), "coverage", "risk")


@query("a13_confusion", f"WITH {RECORDS}, {scored_sql()} SELECT g.dataset_id, g.gold, " + ", ".join(f"count(*) FILTER (top = '{i}') AS pred_{i}" for i in derive.IDS) + " FROM (SELECT DISTINCT dataset_id, gold FROM records, (VALUES ('high'), ('low'), ('mid')) v(gold)) g LEFT JOIN s ON s.dataset_id = g.dataset_id AND s.answer_id = g.gold GROUP BY ALL")
def _(spark, sf):
    return metrics.confusion(state(spark, sf), ["dataset_id"], list(derive.IDS))


@query("a17_positions", f"WITH {RECORDS}, {scored_sql(orders=True)}, w AS (SELECT 'gold' AS role, gold_position AS position FROM s UNION ALL SELECT 'predicted', l.position FROM s JOIN s_l l ON l.record_id = s.record_id AND l.order_index = s.order_index AND l.id = s.top) SELECT role, position::INT AS position, count(*) AS n FROM w GROUP BY ALL")
def _(spark, sf):
    return metrics.positions(turned(spark, sf))


BY_RECORD = "r AS (SELECT dataset_id, source_group_id, record_id, avg(correct) AS share, min(correct) AS every, (min(top) <> max(top))::INT AS flipped, sum(tied::INT) AS ties FROM s GROUP BY ALL)"


@query("a12_order_summary", f"WITH {RECORDS}, {scored_sql(orders=True)}, {BY_RECORD} SELECT dataset_id, count(*) AS records, sum(every)::BIGINT AS all_correct, sum(flipped)::BIGINT AS flips, sum(ties)::BIGINT AS ties, round(avg(share), 9) AS record_accuracy FROM r GROUP BY 1")
def _(spark, sf):
    return rounded(metrics.order_summary(turned(spark, sf), ["dataset_id"]), "record_accuracy")


@query("a11_group_accuracy", f"WITH {RECORDS}, {scored_sql(orders=True)}, {BY_RECORD} SELECT source_group_id, round(avg(share), 9) AS accuracy, count(*) AS records FROM r GROUP BY 1")
def _(spark, sf):
    return rounded(metrics.group_accuracy(turned(spark, sf), []), "accuracy")


@query("a15_paired", f"WITH {RECORDS}, {scored_sql()}, {scored_sql('c', 'control')} SELECT s.dataset_id, count(*) FILTER (s.correct = 1 AND c.correct = 1) AS both, count(*) FILTER (s.correct = 1 AND c.correct = 0) AS left_only, count(*) FILTER (s.correct = 0 AND c.correct = 1) AS right_only, count(*) FILTER (s.correct = 0 AND c.correct = 0) AS neither FROM s JOIN c USING (record_id) GROUP BY 1")
def _(spark, sf):
    return metrics.paired(state(spark, sf), state(spark, sf, "control"), "record_id", ["dataset_id"])


WILSON = "(p + {z2} / (2 * n)) / (1 + {z2} / n) {sign} {z} / (1 + {z2} / n) * sqrt(p * (1 - p) / n + {z2} / (4 * n * n))"
_W = {sign: WILSON.format(z=f"{T.Z95}::DOUBLE", z2=f"({T.Z95}::DOUBLE * {T.Z95}::DOUBLE)", sign=sign) for sign in "+-"}


@query("a21_wilson", f"WITH {RECORDS}, {scored_sql()}, c AS (SELECT dataset_id, sum(correct)::BIGINT AS hits, count(*) AS k FROM s GROUP BY 1), d AS (SELECT *, hits::DOUBLE / k AS p, k::DOUBLE AS n FROM c) SELECT dataset_id, hits, k AS n, round(greatest(0, {_W['-']}), 9) AS low, round(least(1, {_W['+']}), 9) AS high FROM d")
def _(spark, sf):
    counts = state(spark, sf).groupBy("dataset_id").agg(F.sum("correct").alias("hits"), F.count("*").alias("n"))
    return rounded(metrics.with_wilson(counts, "hits", "n"), "low", "high")


@query("a16_exposure", f"WITH {RECORDS} SELECT 'dataset_id' AS \"column\", dataset_id AS value, count(*) AS n FROM records GROUP BY 2 UNION ALL SELECT 'answer_id', answer_id, count(*) FROM records GROUP BY 2 UNION ALL SELECT 'source_group_id', source_group_id, count(*) FROM records GROUP BY 2")
def _(spark, sf):
    return metrics.exposure(derive.records(spark, sf), ["dataset_id", "answer_id", "source_group_id"])


@query("c02_decisions", f"WITH {RECORDS}, {scored_sql()} SELECT record_id, top AS top_option_id, CASE WHEN tied THEN 'tie' WHEN confidence < 0.5 THEN 'low_confidence' END AS reason, abstained, round(confidence, 9) AS confidence FROM s")
def _(spark, sf):
    return rounded(state(spark, sf).select("record_id", "top_option_id", "reason", "abstained", "confidence"), "confidence")


@query("c05_winners", f"WITH {RECORDS}, {scored_sql()} SELECT record_id, top AS winner FROM s")
def _(spark, sf):
    return derive.outputs(derive.records(spark, sf), "base").select("record_id", scoring.winner(F.col("ids"), F.col("logits")).alias("winner"))


@query("c06_parity", f"WITH {RECORDS}, {scored_sql()}, {scored_sql('c', 'control')}, l AS (SELECT s_p.record_id, max(abs(s_p.logit - c_p.logit)) AS lg, max(abs(s_p.p - c_p.p)) AS pg FROM s_p JOIN c_p USING (record_id, id) GROUP BY 1) SELECT record_id, lg AS logit_gap, round(pg, 9) AS prob_gap, s.top = c.top AS same_top, concat_ws(',', CASE WHEN lg > 0.125 THEN 'logit' END, CASE WHEN pg > 0.02 THEN 'probability' END) AS reasons FROM l JOIN s USING (record_id) JOIN c USING (record_id)")
def _(spark, sf):
    rows = derive.records(spark, sf).select("record_id")
    return rounded(scoring.parity(derive.outputs(rows, "base"), derive.outputs(rows, "control"), "record_id"), "prob_gap")


def _jsd_sql() -> str:
    term = "CASE WHEN a + b = 0 THEN 0 ELSE coalesce(CASE WHEN a > 0 THEN a * ln(2 * a / (a + b)) END, 0) / 2 + coalesce(CASE WHEN b > 0 THEN b * ln(2 * b / (a + b)) END, 0) / 2 END"
    return f"WITH {RECORDS}, {scored_sql()}, {scored_sql('c', 'control')}, j AS (SELECT record_id, s.top <> c.top AS flipped, unnest(s.ps) AS a, unnest(c.ps) AS b FROM s JOIN c USING (record_id)) SELECT record_id, any_value(flipped) AS flipped, round(abs(sum({term})), 9) AS divergence FROM j GROUP BY 1"


@query("o07_divergence", _jsd_sql())
def _(spark, sf):
    a = state(spark, sf).select("record_id", F.col("probs").alias("p"), F.col("top_option_id").alias("t"))
    b = state(spark, sf, "control").select("record_id", F.col("probs").alias("q"), F.col("top_option_id").alias("u"))
    return a.join(b, "record_id").select("record_id", (F.col("t") != F.col("u")).alias("flipped"), F.round(scoring.divergence(F.col("p"), F.col("q")), 9).alias("divergence"))


@query("o03_rotations", f"WITH {RECORDS} SELECT record_id, k::INT AS order_index, CASE k WHEN 0 THEN 'high,low,mid' WHEN 1 THEN 'low,mid,high' ELSE 'mid,high,low' END AS order_ids, ((CASE answer_id WHEN 'high' THEN 0 ELSE 1 END - k + 3) % 3)::INT AS gold_index FROM records, (VALUES (0), (1), (2)) t(k)")
def _(spark, sf):
    turned_ = derive.presentations(derive.records(spark, sf), "base")
    return turned_.select("record_id", "order_index", F.array_join("ids", ",").alias("order_ids"), (F.array_position("ids", F.col("answer_id")) - 1).cast("int").alias("gold_index"))


@query("o04_permutations", f"WITH {RECORDS} SELECT record_id, k::INT AS order_index, o AS order_ids FROM records, (VALUES (0, 'high,low,mid'), (1, 'high,mid,low'), (2, 'low,high,mid'), (3, 'low,mid,high'), (4, 'mid,high,low'), (5, 'mid,low,high')) t(k, o)")
def _(spark, sf):
    orders = scoring.permutations(F.array(*map(F.lit, derive.IDS)), 3)
    out = derive.records(spark, sf).select("record_id", F.posexplode(orders).alias("order_index", "ids"))
    return out.select("record_id", "order_index", F.array_join("ids", ",").alias("order_ids"))


#: A text as a JSON string; control characters as Python writes them.
QUOTED = "to_json(text)::VARCHAR"


@query("f02_request_hash", f"""WITH {RECORDS} SELECT record_id, sha256('{{"context":' || {QUOTED} || ',"options":[{{"description":null,"id":"high","label":"High"}},{{"description":null,"id":"low","label":"Low"}},{{"description":null,"id":"mid","label":"Mid"}}],"question":"{derive.QUESTION}"}}') AS request_hash FROM records JOIN documents USING (doc_id)""")
def _(spark, sf):
    rows = derive.whole_requests(spark, sf)
    return rows.select("record_id", T.request_hash(F.col("context"), F.col("question"), F.reverse("options"), control_safe=True).alias("request_hash"))


@query("f09_prompt", f"""WITH {RECORDS} SELECT record_id, '{{"context":' || {QUOTED} || ',"question":"{derive.QUESTION}","options":[{{"symbol":"A","label":"High","description":null}},{{"symbol":"B","label":"Low","description":null}},{{"symbol":"C","label":"Mid","description":null}}]}}' || chr(10) || 'Answer:' || chr(10) AS prompt FROM records JOIN documents USING (doc_id)""")
def _(spark, sf):
    rows = derive.whole_requests(spark, sf)
    return rows.select("record_id", T.prompt(F.col("context"), F.col("question"), F.col("options"), control_safe=True).alias("prompt"))


@query("f05_normalized_groups")
def _(spark, sf):
    texts = derive.table(spark, sf, "documents").select("doc_id", T.nfkc_casefolded("text").alias("t"))
    return texts.groupBy(F.sha2("t", 256).alias("key")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


SLOT = "(['train', 'train', 'train', 'train', 'development', 'calibration', 'test', 'test'])[(('0x' || right(sha256(source), 1))::INT % 8) + 1]"
SPLITS = f"docs AS (SELECT doc_id, source, lang, sha256(text) AS request_hash, {SLOT} AS split FROM documents)"


@query("a10_split_counts", f"WITH {SPLITS} SELECT split, count(*) AS documents, count(DISTINCT source) AS sources FROM docs GROUP BY 1")
def _(spark, sf):
    return derive.splits(spark, sf).groupBy("split").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"))


@query("i04_request_leaks", f"WITH {SPLITS} SELECT request_hash, count(DISTINCT split) AS sides, count(*) AS n FROM docs GROUP BY 1 HAVING count(DISTINCT split) > 1")
def _(spark, sf):
    return records.crossing(derive.splits(spark, sf), ["request_hash"])


@query("i01_audit", f"""WITH {SPLITS}, datasets AS (SELECT DISTINCT lang || '-' || split AS dataset_id, lang AS source_id, lang AS task_family, split FROM docs),
placed AS (SELECT d.*, lang || '-' || d.split AS dataset_id FROM docs d)
SELECT 'source_crosses_splits' AS code, source_id AS key FROM datasets WHERE source_id <> 'de' GROUP BY 2 HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'held_out_family', dataset_id FROM datasets WHERE task_family = 'es' AND split <> 'test'
UNION ALL SELECT 'group_crosses_splits', lang || '/' || source FROM placed GROUP BY 2 HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'request_crosses_splits', request_hash FROM placed GROUP BY 2 HAVING count(DISTINCT split) > 1""")
def _(spark, sf):
    docs = derive.splits(spark, sf).withColumn("dataset_id", F.concat_ws("-", "lang", "split"))
    datasets = docs.select("dataset_id", F.col("lang").alias("source_id"), F.col("lang").alias("task_family"), "split").distinct()
    rows = docs.select(F.col("doc_id").cast("string").alias("record_id"), "dataset_id", F.col("source").alias("source_group_id"), "request_hash")
    return records.audit(rows, datasets, ["es"], ["de"])


@query("j02_bijection", "SELECT count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (d.doc_id IS NULL) AS extra, 0::BIGINT AS repeated, count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS matched FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf):
    return records.bijection(derive.table(spark, sf, "documents").select("doc_id"), derive.table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("d02_dedup", "SELECT min(doc_id) AS doc_id, min_by(source, doc_id) AS source, min_by(lang, doc_id) AS lang, min_by(length(text), doc_id)::INT AS n FROM documents GROUP BY text HAVING min(source) = max(source)")
def _(spark, sf):
    docs = derive.table(spark, sf, "documents").select("doc_id", "source", "lang", F.length("text").alias("n"), F.sha2("text", 256).alias("key"))
    return records.dedup(docs, ["key"], ["doc_id"], "source").drop("key")


GROUPS = """WITH RECURSIVE anchors AS (SELECT doc_id, 't' || lower(text) AS a FROM documents UNION ALL SELECT doc_id, 'p' || lower(string_split(text, chr(10))[1]) FROM documents),
links AS (SELECT DISTINCT x.doc_id AS u, y.doc_id AS v FROM anchors x JOIN (SELECT a, min(doc_id) AS doc_id FROM anchors GROUP BY a) y USING (a)),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u)
SELECT u AS doc_id, min(v) AS component FROM reach GROUP BY 1"""


@query("g01_source_groups", GROUPS)
def _(spark, sf):
    docs = derive.table(spark, sf, "documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("t"), F.lower(F.split("text", "\n")[0]).alias("p"))
    return records.source_groups(docs, "doc_id", [("text", F.col("t")), ("line", F.col("p"))])


RANK = "sha256('select:7:' || doc_id)"


@query("l01_hash_top", f"SELECT doc_id, {RANK} AS rank FROM documents ORDER BY rank LIMIT 32")
def _(spark, sf):
    docs = derive.table(spark, sf, "documents").select("doc_id")
    return docs.withColumn("rank", T.rank("select", 7, F.col("doc_id"))).orderBy("rank").limit(32)


@query("l04_allocate", f"SELECT doc_id, lang, CASE WHEN place <= 5 THEN 'train' WHEN place <= 7 THEN 'development' ELSE 'calibration' END AS part FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {RANK}, doc_id) AS place FROM documents) WHERE place <= 9")
def _(spark, sf):
    docs = derive.table(spark, sf, "documents").select("doc_id", "lang").withColumn("rank", T.rank("select", 7, F.col("doc_id")))
    return records.allocate(docs, "lang", [F.col("rank"), F.col("doc_id")], [("train", 5), ("development", 2), ("calibration", 2)]).select("doc_id", "lang", "part")


@query("l07_one_per_label", f"WITH {RECORDS}, g AS (SELECT source_group_id FROM records GROUP BY 1 HAVING count(DISTINCT answer_id) = 2) SELECT source_group_id, answer_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY source_group_id, answer_id ORDER BY {RANK}, record_id) AS place FROM records SEMI JOIN g USING (source_group_id)) WHERE place = 1")
def _(spark, sf):
    rows = derive.records(spark, sf)
    full = rows.groupBy("source_group_id").agg(F.countDistinct("answer_id").alias("k")).filter("k = 2").select("source_group_id")
    rows = rows.join(full, "source_group_id", "left_semi").withColumn("rank", T.rank("select", 7, F.col("doc_id")))
    return records.first_per(rows, ["source_group_id", "answer_id"], [F.col("rank"), F.col("record_id")]).select("source_group_id", "answer_id", "record_id")


def _losses_sql(tail: str) -> str:
    points = ", ".join(f"({t!r}::DOUBLE)" for t in calibration.grid())
    return f"""WITH {RECORDS}, {scored_sql()}, weights AS (SELECT dataset_id, 1.0::DOUBLE / count(*) AS w FROM records GROUP BY 1),
q AS (SELECT t, record_id, any_value(dataset_id) AS dataset_id, ln(sum(exp((logit - m) / t))) - max((logit - m) / t) FILTER (id = answer_id) AS l FROM s_p, (VALUES {points}) g(t) GROUP BY t, record_id),
losses AS (SELECT t AS temperature, sum(w * l) / sum(w) AS nll FROM q JOIN weights USING (dataset_id) GROUP BY 1) {tail}"""


def _examples(spark, sf):
    rows = derive.outputs(derive.records(spark, sf), "base")
    return calibration.equal_weights(rows.withColumn("gold_index", (F.array_position("ids", F.col("answer_id")) - 1).cast("int")), "dataset_id")


@query("b03_losses", _losses_sql("SELECT round(temperature, 9) AS temperature, round(nll, 9) AS nll FROM losses"))
def _(spark, sf):
    return rounded(calibration.losses(_examples(spark, sf)), "temperature", "nll")


@query("b03_fit", _losses_sql("SELECT round(temperature, 9) AS temperature, round((SELECT nll FROM losses WHERE temperature = 1), 9) AS raw_nll, round(nll, 9) AS fitted_nll, temperature IN (0.05, 10) AS boundary_hit FROM losses ORDER BY losses.nll LIMIT 1"))
def _(spark, sf):
    return rounded(calibration.fit(_examples(spark, sf)), "temperature", "raw_nll", "fitted_nll")


DELTAS = f"""WITH {RECORDS}, {scored_sql(orders=True)}, {scored_sql('c', 'control', True)},
rs AS (SELECT source_group_id, record_id, avg(correct) AS share FROM s GROUP BY ALL), rc AS (SELECT source_group_id, record_id, avg(correct) AS share FROM c GROUP BY ALL),
gs AS (SELECT source_group_id, avg(share) AS a FROM rs GROUP BY 1), gc AS (SELECT source_group_id, avg(share) AS a FROM rc GROUP BY 1),
deltas AS (SELECT 'quality' AS task, row_number() OVER (ORDER BY source_group_id) - 1 AS idx, gs.a - gc.a AS delta FROM gs JOIN gc USING (source_group_id))"""


def _deltas(spark, sf):
    a = metrics.group_accuracy(turned(spark, sf), []).select("source_group_id", F.col("accuracy").alias("a"))
    b = metrics.group_accuracy(turned(spark, sf, "control"), []).select("source_group_id", F.col("accuracy").alias("b"))
    both = a.join(b, "source_group_id").select(F.lit("quality").alias("task"), "source_group_id", (F.col("a") - F.col("b")).alias("delta"))
    return stats.numbered(both, "task", "source_group_id")


@query("t03_bootstrap", f"""{DELTAS}, n AS (SELECT count(*) AS n FROM deltas),
drawn AS (SELECT d AS draw, ('0x' || substr(sha256('quality:' || d || ':' || p), 1, 15))::BIGINT % n AS idx FROM n, range(2000) r(d), (SELECT unnest(range(n)) AS p FROM n)),
means AS (SELECT draw, avg(delta) AS m FROM drawn JOIN deltas USING (idx) GROUP BY 1)
SELECT 'quality' AS task, (SELECT count(*) FROM deltas) AS groups, round((SELECT avg(delta) FROM deltas), 9) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM means""")
def _(spark, sf):
    deltas = _deltas(spark, sf)
    drawn = stats.hashed_bank(deltas.groupBy("task").agg(F.count("*").alias("n")), "task", 2000)
    return rounded(stats.intervals(deltas, drawn, "task"), "mean", "low", "high")


@query("t08_gates", f"WITH {RECORDS}, {scored_sql()}, g AS (SELECT dataset_id, sum(correct)::BIGINT AS hits, count(*) AS n FROM s GROUP BY 1) SELECT dataset_id, hits, n, hits * 3 >= n AS passes FROM g")
def _(spark, sf):
    got = state(spark, sf).groupBy("dataset_id").agg(F.sum("correct").alias("hits"), F.count("*").alias("n"))
    return got.withColumn("passes", stats.gate(F.col("hits"), F.col("n"), 1, 3))


@query("t09_flip_gate", f"WITH {RECORDS}, {scored_sql(orders=True)}, {scored_sql('c', 'control', True)}, a AS (SELECT dataset_id, record_id, (min(top) <> max(top))::INT AS f FROM s GROUP BY ALL), b AS (SELECT dataset_id, record_id, (min(top) <> max(top))::INT AS f FROM c GROUP BY ALL), x AS (SELECT dataset_id, sum(f)::BIGINT AS base FROM a GROUP BY 1), y AS (SELECT dataset_id, sum(f)::BIGINT AS now FROM b GROUP BY 1) SELECT dataset_id, base, now, CASE WHEN base = 0 THEN now = 0 ELSE 4 * (base - now) >= base END AS passes FROM x JOIN y USING (dataset_id)")
def _(spark, sf):
    a = metrics.order_summary(turned(spark, sf), ["dataset_id"]).select("dataset_id", F.col("flips").alias("base"))
    b = metrics.order_summary(turned(spark, sf, "control"), ["dataset_id"]).select("dataset_id", F.col("flips").alias("now"))
    return a.join(b, "dataset_id").withColumn("passes", stats.flip_gate(F.col("base"), F.col("now")))


@query("t13_sequence_faults", "WITH m AS (SELECT conv_id, (turn <= lag(turn) OVER w)::INT AS late, (role <> (['user', 'assistant'])[(row_number() OVER w - 1) % 2 + 1])::INT AS bad FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, count(*) AS n, coalesce(sum(late), 0)::BIGINT AS late, sum(bad)::BIGINT AS unexpected FROM m GROUP BY 1")
def _(spark, sf):
    return stats.sequence_faults(derive.table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "turn", "role", ["user", "assistant"])


@query("t12_over_caps", "SELECT o_custkey, o_orderkey, total FROM (SELECT o_custkey, o_orderkey, (sum(1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS total FROM orders) WHERE total > 10")
def _(spark, sf):
    steps = derive.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.lit(1).alias("amount"))
    return stats.within_caps(steps, "o_custkey", "o_orderkey", "amount", 10).select("o_custkey", "o_orderkey", "total")


@query("r01_routing", "WITH q AS (SELECT p_partkey AS scenario_id, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS parity FROM part), rules(size, parity, destination) AS (VALUES ('big', 'even', 'a'), ('big', 'odd', 'b'), ('small', 'even', 'a')), c AS (SELECT q.scenario_id, coalesce(r.destination, 'no_route') AS d FROM q JOIN (VALUES ('big'), ('small')) s(v) ON q.size IS NULL OR q.size = s.v JOIN (VALUES ('even'), ('odd')) p(v) ON q.parity IS NULL OR q.parity = p.v LEFT JOIN rules r ON r.size = s.v AND r.parity = p.v) SELECT scenario_id, CASE WHEN min(d) = max(d) THEN min(d) ELSE 'insufficient_information' END AS outcome FROM c GROUP BY 1")
def _(spark, sf):
    part = derive.table(spark, sf, "part")
    key = F.col("p_partkey")
    q = part.select(key.alias("scenario_id"), F.when(key % 3 != 0, F.when(F.col("p_size") > 25, "big").otherwise("small")).alias("size"), F.when(key % 5 != 0, F.when(key % 2 == 0, "even").otherwise("odd")).alias("parity"))
    domains = spark.createDataFrame([("size", "big"), ("size", "small"), ("parity", "even"), ("parity", "odd")], "feature string, value string")
    table = spark.createDataFrame([("big", "even", "a"), ("big", "odd", "b"), ("small", "even", "a")], "size string, parity string, destination string")
    return rules.solve_routing(q, domains, table, ["size", "parity"])


@query("r02_tools", "WITH q AS (SELECT s_suppkey AS id, s_suppkey % 3 AS a, s_suppkey % 4 AS c FROM supplier), cases AS (SELECT id, a, c, g FROM q JOIN (VALUES (true), (false)) t(g) ON a = 2 OR (a = 1) = g), fits AS (SELECT id, CASE WHEN g AND c < 3 THEN 'fast' WHEN c < 2 THEN 'slow' ELSE 'no_eligible_tool' END AS o FROM cases) SELECT id AS scenario_id, CASE WHEN min(o) = max(o) THEN min(o) ELSE 'insufficient_information' END AS outcome FROM fits GROUP BY 1")
def _(spark, sf):
    key = F.col("s_suppkey")
    tool = lambda i, caps, needs, cost: F.struct(F.lit(i).alias("id"), F.array(*map(F.lit, caps)).alias("capabilities"), F.array(F.lit("text")).alias("inputs"), F.array(*map(F.lit, needs)).cast("array<string>").alias("needs"), F.lit(cost).alias("cost"))
    return rules.solve_tools(
        derive.table(spark, sf, "supplier").select(
            key.alias("scenario_id"),
            F.when(key % 4 < 2, F.array(F.lit("read"))).when(key % 4 == 2, F.array(F.lit("write"))).otherwise(F.array(F.lit("fly"))).alias("required"),
            F.lit("text").alias("input"),
            F.array(F.lit("net")).alias("permissions"),
            F.array(F.when(key % 3 == 2, F.lit(None)).otherwise(key % 3 == 1)).alias("granted"),
            F.array(tool("fast", ["read", "write"], ["net"], 1), tool("slow", ["read"], [], 5)).alias("tools"),
        )
    )


@query("s14_streamed_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    return streams.hourly(spark, sf).withColumn("total", F.round("total", 6)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


DRAW = "(('0x' || substr(sha256('gen:{0}:' || id), 1, 8))::BIGINT % {1})"


@query("r09_generated", f"WITH g AS (SELECT id, {DRAW.format('family', 4)} AS family, {DRAW.format('ask', 2)} = 0 AS largest, " + ", ".join(f"{DRAW.format(f'amount{i}', 100)} * 3 + {i} AS v{i}" for i in range(3)) + " FROM range(5000) r(id)) SELECT *, CASE CASE WHEN largest THEN greatest(v0, v1, v2) ELSE least(v0, v1, v2) END WHEN v0 THEN 'o0' WHEN v1 THEN 'o1' ELSE 'o2' END AS answer FROM g")
def _(spark, sf):
    return generate.comparisons(spark, 5000, "gen")


@query("r12_schedule", f"""WITH {RECORDS}, a AS (SELECT record_id, row_number() OVER (ORDER BY {RANK}, record_id) - 1 AS i FROM records WHERE answer_id = 'high'), b AS (SELECT record_id, row_number() OVER (ORDER BY {RANK}, record_id) - 1 AS i FROM records WHERE answer_id = 'low'),
s AS (SELECT a.record_id, a.i AS step, 0 AS stream FROM a UNION ALL SELECT b.record_id, a.i, 1 FROM a JOIN b ON b.i = a.i % (SELECT count(*) FROM b))
SELECT record_id, step, stream::INT AS stream, ((step * 2 + stream) // 4)::BIGINT AS update, ((step * 2 + stream) % 4)::INT AS slot FROM s""")
def _(spark, sf):
    rows = derive.records(spark, sf).withColumn("rank", T.rank("select", 7, F.col("doc_id")))
    return generate.interleave([rows.filter("answer_id = 'high'"), rows.filter("answer_id = 'low'")], ["rank", "record_id"], [False, True])


@query("a25_panel_digests", f"WITH {RECORDS}, g AS (SELECT dataset_id, source_group_id, sha256(string_agg(record_id, chr(10) ORDER BY record_id)) AS d FROM records GROUP BY ALL) SELECT dataset_id, sha256(string_agg(d, chr(10) ORDER BY source_group_id, d)) AS digest FROM g GROUP BY 1")
def _(spark, sf):
    return generate.panel_digest(derive.records(spark, sf), "dataset_id", "source_group_id", "record_id")


@query("l02_group_representatives", f"WITH {RECORDS}, g AS (SELECT source_group_id FROM records GROUP BY 1 ORDER BY sha256('groups:3:' || source_group_id) LIMIT 8) SELECT source_group_id, min_by(record_id, {RANK}) AS record_id FROM records SEMI JOIN g USING (source_group_id) GROUP BY 1")
def _(spark, sf):
    rows = derive.records(spark, sf)
    top = rows.select("source_group_id").distinct().orderBy(T.rank("groups", 3, F.col("source_group_id"))).limit(8)
    return rows.join(top, "source_group_id", "left_semi").groupBy("source_group_id").agg(F.min_by("record_id", T.rank("select", 7, F.col("doc_id"))).alias("record_id"))


@query("a20_order_range", f"WITH {RECORDS}, {scored_sql(orders=True)}, o AS (SELECT dataset_id, order_index, avg(correct) AS a FROM s GROUP BY ALL) SELECT dataset_id, round(min(a), 9) AS least, round(max(a), 9) AS most FROM o GROUP BY 1")
def _(spark, sf):
    per = turned(spark, sf).groupBy("dataset_id", "order_index").agg(F.avg("correct").alias("a"))
    return rounded(per.groupBy("dataset_id").agg(F.min("a").alias("least"), F.max("a").alias("most")), "least", "most")


@query("a14_unique_maxima", f"WITH {RECORDS}, {scored_sql()} SELECT dataset_id, round(avg((NOT tied)::INT), 9) AS coverage, round(avg(correct) FILTER (NOT tied), 9) AS accuracy FROM s GROUP BY 1")
def _(spark, sf):
    return rounded(metrics.unique_maxima(state(spark, sf), ["dataset_id"]), "coverage", "accuracy")


@query("a18_strata", f"WITH {RECORDS}, {scored_sql(orders=True)}, q AS (SELECT record_id, dataset_id, source_group_id, max(correct) FILTER (order_index = 0) AS original, min(correct) AS every, (min(top) <> max(top))::INT AS flipped FROM s GROUP BY ALL) SELECT dataset_id, source_group_id, count(*) AS n, sum(original)::BIGINT AS original, sum(every)::BIGINT AS every, sum(flipped)::BIGINT AS flips FROM q GROUP BY GROUPING SETS ((dataset_id), (source_group_id))")
def _(spark, sf):
    return metrics.strata(turned(spark, sf), ["dataset_id", "source_group_id"])


@query("a24_known_sums", "SELECT source, CASE WHEN count(quality) = count(*) THEN sum(quality)::BIGINT END AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(spark, sf):
    both = derive.table(spark, sf, "documents").select("doc_id", "source").join(derive.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return both.groupBy("source").agg(metrics.known_sum(F.col("quality")).alias("quality"))


STATES = ("base", "control", "treatment")


@query("j10_state_pairs", f"WITH {RECORDS}, {', '.join(scored_sql(f's_{x}', x) for x in STATES)}, every AS ({' UNION ALL '.join(f"SELECT '{x}' AS model, record_id, dataset_id, top, correct FROM s_{x}" for x in STATES)}) SELECT l.model AS left_model, r.model AS right_model, l.dataset_id, count(*) AS n, sum((l.top = r.top)::INT)::BIGINT AS agree, sum(l.correct * r.correct)::BIGINT AS both_correct FROM every l JOIN every r ON l.record_id = r.record_id AND l.model < r.model GROUP BY ALL")
def _(spark, sf):
    parts = [state(spark, sf, x).select(F.lit(x).alias("model"), "record_id", "dataset_id", "top_option_id", "correct") for x in STATES]
    return metrics.pairs_of_models(parts[0].union(parts[1]).union(parts[2]), list(STATES), ["dataset_id"])


@query("j13_exclusions", "SELECT doc_id, source, sha256(text) AS digest FROM documents WHERE source NOT IN (SELECT source FROM documents GROUP BY 1 HAVING min(doc_id) % 2 = 0) AND sha256(text) NOT IN (SELECT sha256(text) FROM documents SEMI JOIN labels USING (doc_id) WHERE text IS NOT NULL)")
def _(spark, sf):
    docs = derive.table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    sources = docs.groupBy("source").agg(F.min("doc_id").alias("least")).filter("least % 2 = 0")
    labelled = docs.join(derive.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return records.excluded(docs, (sources, "source"), (labelled, "digest")).select("doc_id", "source", "digest")


@query("j15_pool_overlap", "SELECT sha256(text) AS request_hash, count(DISTINCT source) AS sides, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def _(spark, sf):
    return records.crossing(derive.splits(spark, sf), ["request_hash"], "source")


@query("j25_winner_table", f"WITH {RECORDS}, {scored_sql(orders=True)} SELECT record_id, " + ", ".join(f"max(top) FILTER (order_index = {k}) AS order_{k}" for k in range(3)) + " FROM s GROUP BY 1 HAVING count(DISTINCT order_index) = 3")
def _(spark, sf):
    return metrics.winner_table(turned(spark, sf), 3)


@query("d01_conflicts", "SELECT min(doc_id) AS doc_id, min_by(source, doc_id) AS source, min(source) <> max(source) AS conflict FROM documents GROUP BY text")
def _(spark, sf):
    docs = derive.table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    return records.dedup(docs, ["key"], ["doc_id"], "source", "mark").drop("key")


@query("d04_lowest_rank", f"SELECT doc_id, request_hash FROM (SELECT doc_id, sha256(text) AS request_hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY {RANK}, doc_id) AS place FROM documents) WHERE place = 1")
def _(spark, sf):
    docs = derive.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("request_hash"))
    return records.lowest_rank(docs, ["request_hash"], [T.rank("select", 7, F.col("doc_id")), F.col("doc_id")])


@query("d06_not_one_to_one", "WITH p AS (SELECT DISTINCT lang, source FROM documents) SELECT 'lang' AS side, lang AS value, count(source) AS others FROM p GROUP BY 2 HAVING count(source) > 1 UNION ALL SELECT 'source', source, count(lang) FROM p GROUP BY 2 HAVING count(lang) > 1")
def _(spark, sf):
    return records.not_one_to_one(derive.table(spark, sf, "documents"), "lang", "source")


@query("o06_both_directions", f"WITH {RECORDS} SELECT record_id, order_ids FROM records, (VALUES ('high,low,mid'), ('low,mid,high'), ('mid,high,low'), ('mid,low,high'), ('low,high,mid'), ('high,mid,low')) o(order_ids)")
def _(spark, sf):
    orders = F.explode(scoring.both_directions(F.array(*map(F.lit, derive.IDS))))
    return derive.records(spark, sf).select("record_id", orders.alias("o")).select("record_id", F.array_join("o", ",").alias("order_ids"))


@query("o09_presentation_ids", f"WITH {RECORDS} SELECT record_id, k::INT AS order_index, sha256('panel|' || record_id || '|' || o) AS presentation_id, (list_position(string_split(o, ','), answer_id) - 1)::INT AS gold_index FROM records, (VALUES (0, 'high,low,mid'), (1, 'low,mid,high'), (2, 'mid,high,low')) t(k, o)")
def _(spark, sf):
    rows = derive.presentations(derive.records(spark, sf), "base")
    return rows.select("record_id", "order_index", scoring.presentation_id("panel", F.col("record_id"), F.col("ids")).alias("presentation_id"), (F.array_position("ids", F.col("answer_id")) - 1).cast("int").alias("gold_index"))


@query("l08_balanced_groups", f"WITH {RECORDS}, g AS (SELECT source_group_id, row_number() OVER (ORDER BY sha256('deal:5:' || source_group_id), source_group_id) - 1 AS i FROM records GROUP BY 1 HAVING count(DISTINCT answer_id) = 2), d AS (SELECT source_group_id, CASE i % 2 WHEN 0 THEN 'high' ELSE 'low' END AS answer_id FROM g) SELECT source_group_id, answer_id, min_by(record_id, ({RANK}, record_id)) AS record_id FROM records JOIN d USING (source_group_id, answer_id) GROUP BY ALL")
def _(spark, sf):
    rows = derive.records(spark, sf).withColumn("rank", T.rank("select", 7, F.col("doc_id")))
    got = records.balanced(rows, "source_group_id", "answer_id", ["high", "low"], T.rank("deal", 5, F.col("source_group_id")), [F.col("rank"), F.col("record_id")])
    return got.select("source_group_id", "answer_id", "record_id")


@query("l09_first_of_dataset", f"WITH {RECORDS} SELECT dataset_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY doc_id) AS place FROM records) WHERE place <= 5")
def _(spark, sf):
    return records.first_per(derive.records(spark, sf), ["dataset_id"], [F.col("doc_id")], 5).select("dataset_id", "record_id")


@query("i10_separation", f"WITH {SPLITS} " + " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) AS shared FROM (SELECT {k} FROM docs WHERE split = 'train' INTERSECT SELECT {k} FROM docs WHERE split = 'test')" for k in ("doc_id", "source", "request_hash")))
def _(spark, sf):
    docs = derive.splits(spark, sf)
    return records.separation(docs.filter("split = 'train'"), docs.filter("split = 'test'"), ["doc_id", "source", "request_hash"])


@query("i14_balance", f"WITH {RECORDS} SELECT dataset_id, answer_id, count(*) AS n, max(length(text))::INT AS longest FROM records JOIN documents USING (doc_id) GROUP BY ALL")
def _(spark, sf):
    docs = derive.table(spark, sf, "documents").select("doc_id", F.length("text").alias("size"))
    return derive.records(spark, sf).join(docs, "doc_id").groupBy("dataset_id", "answer_id").agg(F.count("*").alias("n"), F.max("size").alias("longest"))


@query("t01_group_deltas", f"WITH {RECORDS}, {scored_sql()}, {scored_sql('c', 'treatment')} SELECT s.source_group_id, round(avg(c.correct) - avg(s.correct), 9) AS delta FROM s JOIN c USING (record_id) GROUP BY 1")
def _(spark, sf):
    left, right = (state(spark, sf, x).groupBy("source_group_id").agg(F.avg("correct").alias(x)) for x in ("base", "treatment"))
    return left.join(right, "source_group_id").select("source_group_id", F.round(F.col("treatment") - F.col("base"), 9).alias("delta"))


@query("t15_costs", "SELECT l_returnflag, CAST(ceil(sum(CAST(l_quantity AS DECIMAL(12, 2)) * CAST(l_discount AS DECIMAL(12, 2))) * 100) AS BIGINT) AS cents FROM lineitem GROUP BY 1")
def _(spark, sf):
    amount = F.col("l_quantity").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(12,2)")
    return derive.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.ceil(F.sum(amount) * 100).cast("long").alias("cents"))


@query("t04_ratio_bootstrap", f"""WITH {RECORDS}, {scored_sql()}, g AS (SELECT row_number() OVER (ORDER BY source_group_id) - 1 AS idx, hits, total FROM (SELECT source_group_id, sum(correct)::DOUBLE AS hits, count(*)::DOUBLE AS total FROM s GROUP BY 1)), n AS (SELECT count(*) AS n FROM g),
drawn AS (SELECT d AS draw, ('0x' || substr(sha256('quality:' || d || ':' || p), 1, 15))::BIGINT % n AS idx FROM n, range(2000) r(d), (SELECT unnest(range(n)) AS p FROM n)),
ratios AS (SELECT draw, sum(hits) / sum(total) AS r FROM drawn JOIN g USING (idx) GROUP BY 1)
SELECT 'quality' AS task, (SELECT n FROM n) AS groups, round((SELECT sum(hits) / sum(total) FROM g), 9) AS ratio, round(quantile_cont(r, 0.025), 9) AS low, round(quantile_cont(r, 0.975), 9) AS high FROM ratios""")
def _(spark, sf):
    sums = state(spark, sf).groupBy("source_group_id").agg(F.sum("correct").alias("hits"), F.count("*").alias("total"))
    groups = stats.numbered(sums.withColumn("task", F.lit("quality")), "task", "source_group_id")
    drawn = stats.hashed_bank(groups.groupBy("task").agg(F.count("*").alias("n")), "task", 2000)
    return rounded(stats.ratio_intervals(groups, drawn, "task"), "ratio", "low", "high")
