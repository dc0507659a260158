"""Registered queries that write derived tables as files, read them back strictly, and their SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane import evaluate as EV
from scorelane.functions import text as T
from scorelane.operators import prompts, records
from scorelane.operators.workspace import Workspace
from scorelane.plans import derive
from scorelane.queries import NAMES, RECORDS, ROUNDED, report_sql, rounded
from scorelane.registry import query
from scorelane.sources import readers

NATION = "(SELECT n_nationkey AS k, n_name AS name FROM nation)"


def _texts(spark: SparkSession, rows: DataFrame, name: str, value: Column) -> str:
    """The folder of a text file a partition, one line a row."""
    path = Workspace(spark, "files").folder(name)
    rows.select(value.alias("value")).write.text(path)
    return path


def _nations(spark, sf) -> DataFrame:
    """Twenty-five rows (k, name) in one partition in order, as sources of this kind are one small file."""
    return derive.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).coalesce(1).sortWithinPartitions("k")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def _requests(spark, sf) -> DataFrame:
    rows = derive.whole_requests(spark, sf)
    return rows.filter(T.squeeze(F.col("context")) != "").withColumn("request", F.struct("context", "question", "options"))


def record_file(spark, sf) -> str:
    rows = _requests(spark, sf)
    return _texts(spark, rows, "records.jsonl", _json(**{c: F.col(c) for c in ("record_id", "dataset_id", "source_group_id", "request", "answer_id")}))


def prediction_file(spark, sf) -> str:
    rows = _requests(spark, sf)
    logits = F.create_map(*[x for i in derive.IDS for x in (F.lit(i), derive.logit(F.col("record_id"), i, "base"))])
    hashed = T.request_hash(F.col("context"), F.col("question"), F.col("options"), control_safe=True)
    return _texts(spark, rows, "predictions.jsonl", _json(record_id=F.col("record_id"), request_hash=hashed, logits=logits, model_revision=F.lit("base")))


def manifest_file(spark) -> str:
    declared = ",\n".join('  {{"dataset_id": "quality-{0}", "source_id": "{0}", "task_family": "quality", "split": "test", "source_uri": "table://documents", "source_revision": "1", "license": "given"}}'.format(x) for x in ("de", "en", "es", "fr", "it", "pt", "nl", "pl"))
    rows = spark.createDataFrame([(f'{{"data_kind": "fixture", "held_out_families": ["quality"],\n "datasets": [\n{declared}]}}',)], "value string").coalesce(1)
    return _texts(spark, rows, "manifest", F.col("value"))


WORDED = f"{RECORDS}, worded AS (SELECT record_id FROM records JOIN documents USING (doc_id) WHERE regexp_matches(text, '\\S'))"


@query("s01_records", f"WITH {WORDED} SELECT record_id, dataset_id, source_group_id, answer_id, length(text)::INT AS size, 'high,low,mid' AS options FROM records JOIN worded USING (record_id) JOIN documents USING (doc_id)")
def _(spark, sf):
    got = readers.records(spark, record_file(spark, sf))
    return got.select("record_id", "dataset_id", "source_group_id", "answer_id", F.length("request.context").alias("size"), F.array_join(F.transform("request.options", lambda o: o["id"]), ",").alias("options"))


@query("s02_manifest", "SELECT 'quality-' || x AS dataset_id, x AS source_id, 'test' AS split FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it'), ('pt'), ('nl'), ('pl')) t(x)")
def _(spark, sf):
    got = readers.manifest(spark, manifest_file(spark))
    return spark.createDataFrame([(d["dataset_id"], d["source_id"], d["split"]) for d in got["datasets"]], "dataset_id string, source_id string, split string")


@query("s03_predictions", f"WITH {WORDED}, l AS (SELECT record_id, id, ((('0x' || substr(sha256(record_id || ':' || id || ':base'), 1, 4))::INT % 13) - 6)::DOUBLE AS logit FROM worded, (VALUES ('high'), ('low'), ('mid')) o(id)) SELECT record_id, max(logit) FILTER (id = 'high') AS high, max(logit) FILTER (id = 'low') AS low, 'base' AS model_revision FROM l GROUP BY 1")
def _(spark, sf):
    got = readers.predictions(spark, prediction_file(spark, sf))
    return got.select("record_id", F.col("logits")["high"].alias("high"), F.col("logits")["low"].alias("low"), "model_revision")


@query("s04_json_faults", f"SELECT (k + 1)::BIGINT AS line, (['repeated key', 'not a number', 'invalid fields: a.c', 'malformed JSON', 'invalid fields: x, a.b'])[k % 6] AS fault FROM {NATION} WHERE k % 6 > 0")
def _(spark, sf):
    good = F.lit('{"a": {"b": 1, "c": ["x", "y"]}}')
    bad = ['{"a": {"b": 1, "b": 2, "c": []}}', '{"a": {"b": NaN, "c": []}}', '{"a": {"b": 1}}', '{"a": {"b": 1,, "c": []}}', '{"a": {"b": true, "c": []}, "x": 0}']
    text = F.element_at(F.array(good, *map(F.lit, bad)), (F.col("k") % 6 + 1).cast("int"))
    path = _texts(spark, _nations(spark, sf), "values", text)
    return readers.faults(readers.lines(spark, path), {"a": {"b": readers.real, "c": [readers.words]}}).select("line", "fault")


@query("s05_digests", "SELECT sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256 FROM nation")
def _(spark, sf):
    return readers.digest(spark, _texts(spark, _nations(spark, sf), "names", F.col("name"))).select("sha256")


@query("s06_causes", f"SELECT 'i' || k AS id, CASE k % 2 WHEN 0 THEN 'cause' ELSE 'effect' END AS relation, name || ' ' || k AS premise, 'a' || k || '|b' AS choices, (k % 2 + 1)::INT AS answer FROM {NATION}")
def _(spark, sf):
    k = F.col("k").cast("string")
    item = F.concat(F.lit('<item id="i'), k, F.lit('" asks-for="'), F.when(F.col("k") % 2 == 0, "cause").otherwise("effect"), F.lit('" most-plausible-alternative="'), (F.col("k") % 2 + 1).cast("string"), F.lit('"><p> '), F.col("name"), F.lit(" "), k, F.lit("</p><a1>a"), k, F.lit("</a1><a2>b</a2></item>"))
    text = F.concat(F.when(F.col("k") == 0, '<copa-corpus version="1.0">').otherwise(""), item, F.when(F.col("k") == 24, "</copa-corpus>").otherwise(""))
    got = readers.causes(readers.contents(spark, _texts(spark, _nations(spark, sf), "items", text)), 25)
    return got.withColumn("choices", F.array_join("choices", "|"))


PASSAGES = "p AS (SELECT DISTINCT doc_id % 80 AS q, doc_id % 40 AS p, (doc_id % 40) // 4 AS t FROM documents), named AS (SELECT t, sha256('[' || string_agg(DISTINCT '[\"passage\",\"p' || p || '\"]', ',' ORDER BY '[\"passage\",\"p' || p || '\"]') || ',[\"title\",\"t' || t || '\"]]') AS group_id FROM p GROUP BY 1)"


@query("s07_passages", f"WITH {PASSAGES} SELECT sha256('[\"q ' || q || '\",\"p' || p || '\"]') AS item_id, group_id, 'Q ' || q AS question, 'P' || p AS passage, 'T' || t AS title, q < 40 AS answer FROM p JOIN named USING (t)")
def _(spark, sf):
    k = F.col("doc_id")
    name = lambda mark, x: F.concat(F.lit(mark), x.cast("string"))
    rows = derive.table(spark, sf, "documents").select("doc_id")
    path = _texts(spark, rows, "passages", _json(question=name("Q  ", k % 80), passage=name(" P", k % 40), title=name("T", F.floor((k % 40) / 4)), answer=(k % 80) < 40, more=k))
    got = readers.passages(spark, path).withColumns({c: T.squeeze(F.col(c)) for c in ("question", "passage", "title")})
    got = got.withColumns({f"{c}_norm": T.casefolded(c) for c in ("question", "passage", "title")})
    items = records.source_items(got, ["question_norm", "passage_norm"], [("passage", "passage_norm"), ("title", "title_norm")], ["question", "passage", "title"], "answer")[0]
    return items.select("item_id", "group_id", "question", "passage", "title", "answer")


PAIRS = "raw AS (SELECT doc_id, doc_id % 30 AS p, doc_id % 60 AS h, (doc_id % 30) // 3 AS c, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 60 = 11 AND (doc_id // 60) % 2 = 1 THEN 'neutral' ELSE 'entailment' END AS label FROM documents), k AS (SELECT p, h, any_value(c) AS c, count(DISTINCT label) AS labels, count(label) AS labelled, min(doc_id) FILTER (label IS NOT NULL) AS least FROM raw GROUP BY p, h)"


def _pairs(spark, sf):
    k = F.col("doc_id")
    label = F.when(k % 7 == 0, "-").when((k % 60 == 11) & (F.floor(k / 60) % 2 == 1), "neutral").otherwise("entailment")
    name = lambda mark, x: F.concat(F.lit(mark), x.cast("string"))
    rows = derive.table(spark, sf, "documents").select("doc_id")
    path = _texts(spark, rows, "pairs", _json(gold_label=label, pairID=F.lpad(k.cast("string"), 9, "0"), captionID=name("C", F.floor((k % 30) / 3)), sentence1=name("Prem ", k % 30), sentence2=name("Hyp ", k % 60)))
    got = readers.premise_pairs(spark, path, keep_unlabelled=True).withColumns({f"{c}_norm": T.casefolded(c) for c in ("premise", "hypothesis", "caption")})
    return records.source_items(got, ["premise_norm", "hypothesis_norm"], [("premise", "premise_norm"), ("caption", "caption_norm")], ["pair_id", "premise", "hypothesis", "caption"], "label", "exclude")


@query("s08_labelled_pairs", f"WITH {PAIRS} SELECT lpad(doc_id::VARCHAR, 9, '0') AS pair_id, 'Prem ' || p AS premise, label FROM raw WHERE label IS NOT NULL")
def _(spark, sf):
    k = F.col("doc_id")
    label = F.when(k % 7 == 0, "-").when((k % 60 == 11) & (F.floor(k / 60) % 2 == 1), "neutral").otherwise("entailment")
    pair = F.when(k % 7 > 0, F.lpad(k.cast("string"), 9, "0"))  # rows without a label may lack anything else
    path = _texts(spark, derive.table(spark, sf, "documents").select("doc_id"), "pairs", F.to_json(F.struct(label.alias("gold_label"), pair.alias("pairID"), F.concat(F.lit("Prem "), (k % 30).cast("string")).alias("sentence1"), F.lit("h").alias("sentence2"))))
    return readers.premise_pairs(spark, path).select("pair_id", "premise", "label")


@query("s09_pair_items", f"WITH {PAIRS}, g AS (SELECT c, sha256('[[\"caption\",\"c' || c || '\"],' || string_agg(DISTINCT '[\"premise\",\"prem ' || p || '\"]', ',' ORDER BY '[\"premise\",\"prem ' || p || '\"]') || ']') AS group_id FROM k GROUP BY 1) SELECT sha256('[\"prem ' || p || '\",\"hyp ' || h || '\"]') AS item_id, group_id, lpad(least::VARCHAR, 9, '0') AS pair_id, 'entailment' AS label FROM k JOIN g USING (c) WHERE labels = 1")
def _(spark, sf):
    return _pairs(spark, sf)[0].select("item_id", "group_id", "pair_id", "label")


@query("s09_pair_counts", f"WITH {PAIRS} SELECT (SELECT count(*) FROM raw) AS raw_rows, (SELECT count(*) FROM raw WHERE label IS NULL) AS unlabelled_rows, count(*) AS pairs, count(*) FILTER (labels > 1) AS conflicting_pairs, coalesce(sum(labelled) FILTER (labels > 1), 0)::BIGINT AS conflicting_rows, count(*) FILTER (labels = 1) AS consistent_pairs, count(*) FILTER (labels = 0) AS unlabelled_pairs, count(DISTINCT c) AS groups FROM k")
def _(spark, sf):
    return _pairs(spark, sf)[1]


@query("s10_lexical_pairs", f"SELECT 'p' || k AS pair_id, name AS premise, CASE k % 2 WHEN 0 THEN 'entailment' ELSE 'non-entailment' END AS label, 'hans-subcase:' || sha256('s' || k % 4) AS source_group_id FROM {NATION}")
def _(spark, sf):
    k = F.col("k")
    row = F.concat_ws("\t", F.when(k % 2 == 0, "entailment").otherwise("non-entailment"), F.concat(F.lit('"'), "name", F.lit('"')), F.lit("h"), F.concat(F.lit("p"), k.cast("string")), F.lit("x"), F.concat(F.lit("s"), (k % 4).cast("string")), F.lit("t"))
    head = "gold_label\tsentence1\tsentence2\tpairID\theuristic\tsubcase\ttemplate\n"
    text = F.concat(F.when(k == 0, head).otherwise(""), row, F.when(k % 5 == 0, F.concat(F.lit("\n"), row)).otherwise(""))  # every fifth row is there twice
    return readers.lexical_pairs(readers.contents(spark, _texts(spark, _nations(spark, sf), "pairs", text))).select("pair_id", "premise", "label", "source_group_id")


@query("s11_blanks", f"SELECT 'q' || k AS id, replace(name, '_', '-') || ' _ it' AS sentence, 'x|y' || k AS options, (k % 2 + 1)::INT AS answer FROM {NATION}")
def _(spark, sf):
    rows, k = _nations(spark, sf), F.col("k").cast("string")
    data = _texts(spark, rows, "sentences", _json(qID=F.concat(F.lit("q"), k), sentence=F.concat(F.replace("name", F.lit("_"), F.lit("-")), F.lit(" _ it")), option1=F.lit("x"), option2=F.concat(F.lit("y"), k)))
    labels = _texts(spark, rows, "labels", (F.col("k") % 2 + 1).cast("string"))
    got = readers.blanks(readers.contents(spark, data), readers.contents(spark, labels))
    return got.withColumn("options", F.array_join("options", "|"))


@query("s12_choices", f"SELECT 'q' || k AS id, name AS stem, 'A:a B:b' || k AS choices, CASE k % 2 WHEN 0 THEN 'A' ELSE 'B' END AS answer FROM {NATION}")
def _(spark, sf):
    k = F.col("k").cast("string")
    choice = lambda mark, text: F.struct(F.lit(mark).alias("label"), text.alias("text"))
    question = F.struct(F.col("name").alias("stem"), F.array(choice("A", F.lit("a")), choice("B", F.concat(F.lit("b"), k))).alias("choices"))
    path = _texts(spark, _nations(spark, sf), "questions", _json(id=F.concat(F.lit("q"), k), question=question, answerKey=F.when(F.col("k") % 2 == 0, "A").otherwise("B")))
    return readers.choices(readers.contents(spark, path)).withColumn("choices", F.array_join(F.transform("choices", lambda c: F.concat_ws(":", c["label"], c["text"])), " "))


@query("s13_messages", f"SELECT k::BIGINT AS row_id, CASE k % 2 WHEN 0 THEN 'ham' ELSE 'spam' END AS label, name || chr(9) || 'end' AS message FROM {NATION}")
def _(spark, sf):
    text = F.concat_ws("\t", F.when(F.col("k") % 2 == 0, "ham").otherwise("spam"), "name", F.lit("end"))
    return readers.messages(readers.contents(spark, _texts(spark, _nations(spark, sf), "messages", text)))


@query("s14_numbered_parquet", f"SELECT name AS title, k::BIGINT AS row_id, (k % 5)::INT AS label FROM {NATION}")
def _(spark, sf):
    rows = _nations(spark, sf).select(F.col("name").alias("title"), F.lower("name").alias("content"), (F.col("k") % 5).cast("int").alias("label"))
    path = Workspace(spark, "files").folder("classes")
    rows.write.parquet(path)
    return readers.numbered_parquet(spark, path, 25, 5).select("title", "row_id", "label")


@query("s15_native_rows", f"SELECT 'p' || k % 10 AS pair_id, min(k)::BIGINT AS row_id FROM {NATION} WHERE k % 7 > 0 GROUP BY 1")
def _(spark, sf):
    k = F.col("k")
    text = _json(gold_label=F.when(k % 7 == 0, "-").otherwise("neutral"), pairID=F.concat(F.lit(" p"), (k % 10).cast("string")))
    return readers.native_rows(readers.contents(spark, _texts(spark, _nations(spark, sf), "rows", text)), 25)[0]


@query("s16_zip_member", f"SELECT k::BIGINT AS row_id, 'ham' AS label, name AS message FROM {NATION}")
def _(spark, sf):
    plain = readers.contents(spark, _texts(spark, _nations(spark, sf), "messages", F.concat_ws("\t", F.lit("ham"), "name")))

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("other.txt", "x")
                    z.writestr("messages.txt", content)
                yield pa.RecordBatch.from_pydict({"path": [name], "content": [out.getvalue()]}, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    archives = plain.mapInArrow(zipped, "path string, content binary")
    return readers.messages(readers.zip_member(archives, "messages.txt", ["messages.txt"], 5_000_000))


@query("k01_canonical_lines", f"SELECT '{{\"a\":{{\"b\":' || k || ',\"z\":\"' || name || '\"}},\"k\":' || k || '}}' AS line FROM {NATION}")
def _(spark, sf):
    rows = derive.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.struct(F.col("n_name").alias("z"), F.col("n_nationkey").alias("b")).alias("a"))
    return rows.select(readers.canonical_lines(rows).alias("line"))


@query("evaluate_from_files", f"{report_sql('dataset_id')} SELECT dataset_id, n, {ROUNDED} FROM report")
def _(spark, sf):
    report = EV.evaluate(spark, record_file(spark, sf), prediction_file(spark, sf), manifest_file(spark), min_confidence=0.5)
    rows = [(d["dataset_id"], d["record_count"], *[d[c] for c in NAMES]) for d in report["per_dataset"]]
    return rounded(spark.createDataFrame(rows, "dataset_id string, n long, " + ", ".join(f"{c} double" for c in NAMES)), *NAMES)


@query("f12_digests", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 > 0 THEN sha256(n_name) END AS digest FROM nation")
def _(spark, sf):
    h, k = F.sha2("n_name", 256), F.col("n_nationkey")
    return derive.table(spark, sf, "nation").select("n_nationkey", T.sha256_hex(F.when(k % 3 == 0, F.left(h, F.lit(63))).when(k % 3 == 1, F.upper(h)).otherwise(h)).alias("digest"))


@query("f13_redacted", "SELECT p_partkey AS id, 'see (https://h.org/' || p_partkey || ') or http://h.org/a. [REDACTED], [REDACTED] basic [REDACTED] x [REDACTED]!' AS message FROM part")
def _(spark, sf):
    k = F.col("p_partkey").cast("string")
    parts = [F.lit("see (https://u:p"), k, F.lit("@h.org/"), k, F.lit("?token="), k, F.lit(') or http://h.org/a#x. db.passwd = "two words", api-key: a'), k, F.lit(" basic dXNlcjpw x hf_fake-Token_"), k, F.lit("!")]
    return derive.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.redacted(F.concat(*parts)).alias("message"))


@query("f10_compiled", f"WITH {RECORDS} SELECT record_id, (length(record_id) + 226)::INT AS input_tokens, '65,66,67' AS candidate_ids, CASE WHEN length(record_id) + 226 > 232 THEN 'token budget' END AS fault FROM records")
def _(spark, sf):
    options = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(i).alias("label"), F.lit(None).cast("string").alias("description")) for i in derive.IDS])
    rows = derive.records(spark, sf).select("record_id", T.prompt(F.col("record_id"), F.lit(derive.QUESTION), options).alias("prompt"))
    got = rows.select("record_id", prompts.compiled(F.col("prompt"), F.lit(3), lambda t: list(t.encode()), budget=232).alias("c"))
    return got.select("record_id", F.col("c.input_tokens").alias("input_tokens"), F.array_join("c.candidate_ids", ",").alias("candidate_ids"), F.col("c.fault").alias("fault"))
