"""Readers of decision data and its sources, and sinks. Faults come back as rows (path, line, fault) or raise.

Records, predictions and any JSON lines are read in splits of their files, numbered by where a
split begins, so a file of any size is many tasks. Lines end at a line feed; one carriage return
before it goes, blank lines are skipped. JSON is checked as a whole value: repeated keys, constants
that aren't numbers, missing or undeclared keys, and values of another type are faults. Benchmark
sources (XML, tab-separated, ZIP members and lines that also end at U+2028) are small files read
whole, one task a file. Messages name files, lines and fields, never the data.
"""

from __future__ import annotations

import csv
import io
import json
import math
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelane.functions import text as T

RECORD = "record_id string, dataset_id string, source_group_id string, answer_id string, request struct<context string, question string, options array<struct<id string, label string, description string>>>"
PREDICTION = "record_id string, request_hash string, logits map<string, double>, model_revision string"
MANIFEST = "data_kind string, datasets array<struct<dataset_id string, source_id string, task_family string, split string, source_uri string, source_revision string, license string>>, held_out_families array<string>, group_partitioned_sources array<string>"

#: Fixed values of the data model.
SPLITS = ("train", "development", "calibration", "test")
KINDS = ("fixture", "benchmark")
LABELS = ("entailment", "neutral", "contradiction")

# Shapes of JSON values: a test of a plain value, [shape] a list, {key: shape} an object of exactly these keys.
Shape = Callable[[object], bool] | list | dict


def anything(_: object) -> bool:
    return True


def words(v: object) -> bool:
    """Text that isn't blank."""
    return isinstance(v, str) and bool(v.strip())


def real(v: object) -> bool:
    """A finite number, not a truth value."""
    try:
        return isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(float(v))
    except OverflowError:
        return False


def one_of(*values: str) -> Callable[[object], bool]:
    return lambda v: isinstance(v, str) and v in values


class Maybe:
    """A key that may be missing or null."""

    def __init__(self, shape: Shape):
        self.shape = shape


class Open(dict):
    """An object that may hold further keys."""


OPTION = {"id": words, "label": words, "description": Maybe(lambda v: isinstance(v, str))}
RECORD_SHAPE = {"record_id": words, "dataset_id": words, "source_group_id": words, "answer_id": words, "request": {"context": words, "question": words, "options": [OPTION]}}
PREDICTION_SHAPE = {
    "record_id": words, "model_revision": words, "logits": lambda v: isinstance(v, dict) and bool(v) and all(words(k) and real(x) for k, x in v.items()),
    "request_hash": lambda v: isinstance(v, str) and len(v) == 64 and set(v) <= set("0123456789abcdef"),
}
DATASET = {"dataset_id": words, "source_id": words, "task_family": words, "split": one_of(*SPLITS), "source_uri": words, "source_revision": words, "license": words}
MANIFEST_SHAPE = {"data_kind": one_of(*KINDS), "datasets": [DATASET], "held_out_families": Maybe([words]), "group_partitioned_sources": Maybe([words])}


def misfits(value: object, shape: object, at: str = "") -> list[str]:
    """Names of the fields of a value that don't have the shape."""
    if isinstance(shape, Maybe):
        return [] if value is None else misfits(value, shape.shape, at)
    if isinstance(shape, list):
        if not isinstance(value, list):
            return [at or "document"]
        return [m for i, v in enumerate(value) for m in misfits(v, shape[0], f"{at}.{i}".lstrip("."))]
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            return [at or "document"]
        under = lambda k: f"{at}.{k}".lstrip(".")
        extra = [] if isinstance(shape, Open) else [under(k) for k in sorted(value.keys() - shape.keys())]
        missing = [under(k) for k, s in shape.items() if k not in value and not isinstance(s, Maybe)]
        return extra + missing + [m for k, s in shape.items() if k in value for m in misfits(value[k], s, under(k))]
    return [] if shape(value) else [at or "document"]  # type: ignore[operator]


def record_rules(r: dict) -> str | None:
    """What a record of the right shape may still break."""
    ids = [o["id"] for o in r["request"]["options"]]
    if not 2 <= len(ids) <= 16:
        return "number of options"
    if len(set(ids)) < len(ids):
        return "repeated option"
    return None if r["answer_id"] in ids else "answer isn't an option"


def manifest_rules(m: dict) -> str | None:
    names = [d["dataset_id"] for d in m["datasets"]]
    families = m.get("held_out_families") or []
    if not names or len(set(names)) < len(names):
        return "datasets" if not names else "repeated dataset"
    if len(set(families)) < len(families):
        return "repeated family"
    unknown = set(m.get("group_partitioned_sources") or []) - {d["source_id"] for d in m["datasets"]}
    return "undeclared source" if unknown else None


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _constant(_: str) -> None:
    raise ValueError("not a number")


def decoded(text: str, shape: Shape = anything, rules: Callable[[dict], str | None] | None = None) -> tuple[object, str | None]:
    """The value of a strict JSON text and what is wrong with it (None if nothing)."""
    try:
        value = json.loads(text, object_pairs_hook=_pairs, parse_constant=_constant)
    except RecursionError:
        return None, "nested too deeply"
    except ValueError as e:
        return None, str(e) if str(e) in ("repeated key", "not a number") else "malformed JSON"
    wrong = misfits(value, shape)
    if wrong:
        return None, "invalid fields: " + ", ".join(wrong)
    return value, rules(value) if rules else None  # type: ignore[arg-type]


def json_fault(text: str, fields: set[str] | None = None) -> str | None:
    """What is wrong with a strict JSON object, or None; ``fields`` names the keys it may have."""
    value, fault = decoded(text)
    if fault or not isinstance(value, dict):
        return fault or "not an object"
    extra = sorted(set(value) - fields) if fields is not None else []
    return "undeclared fields: " + ", ".join(extra) if extra else None


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of the lines that aren't blank; line numbers are physical, from 1.

    A split's rows are numbered as it is read; only one row a split (where it begins, its first
    number, its rows) is gathered to count the lines before it.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    splits = raw.groupBy("path", "block").agg(F.min("n").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(F.col("path").alias("_path"), F.col("block").alias("_block"), "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    at = raw.join(splits, (F.col("path") == F.col("_path")) & (F.col("block") == F.col("_block")))
    text = F.regexp_replace("value", "\r$", "")
    return at.select("path", (F.col("start") + F.col("n") - F.col("first") + 1).alias("line"), text.alias("text")).filter(T.squeeze(F.col("text")) != "")


def array_items(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of the items of a file that is one JSON array, numbered from 1; one task a file."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value, fault = decoded(content.decode("utf-8"), lambda v: isinstance(v, list))
                if fault:
                    raise ValueError(f"{name}:1: {fault}")
                yield pa.RecordBatch.from_pydict({"path": [name] * len(value), "line": list(range(1, len(value) + 1)), "text": [json.dumps(v, ensure_ascii=False) for v in value]}, schema=pa.schema([("path", pa.string()), ("line", pa.int64()), ("text", pa.string())]))

    return contents(spark, path).mapInArrow(cut, "path string, line long, text string")


def items(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a .jsonl file or items of a .json array; another ending is an error."""
    if path.endswith(".jsonl"):
        return lines(spark, path)
    if path.endswith(".json"):
        return array_items(spark, path)
    raise ValueError(f"{path}: use .json or .jsonl")


def judged(rows: DataFrame, shape: Shape, rules: Callable[[dict], str | None] | None = None) -> DataFrame:
    """(path, line, fault, value): what is wrong with each text, and its value as JSON where nothing is."""

    @F.pandas_udf("fault string, value string")
    def check(texts):  # type: ignore[no-untyped-def]
        import pandas as pd

        found = [decoded(t, shape, rules) for t in texts]
        return pd.DataFrame({"fault": [f for _, f in found], "value": [None if f else json.dumps(v, ensure_ascii=False) for v, f in found]})

    return rows.select("path", "line", check("text").alias("c")).select("path", "line", "c.fault", "c.value")


def faults(rows: DataFrame, shape: Shape, rules: Callable[[dict], str | None] | None = None) -> DataFrame:
    """(path, line, fault) of the texts that aren't strict JSON of the shape."""
    return judged(rows, shape, rules).select("path", "line", "fault").filter(F.col("fault").isNotNull())


def _raise_first(bad: DataFrame) -> None:
    first = bad.orderBy("path", "line").limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['path']}:{first[0]['line']}: {first[0]['fault']}")


def strict_json(spark: SparkSession, path: str, schema: str, shape: Shape, rules: Callable[[dict], str | None] | None = None, key: str | None = None) -> DataFrame:
    """Rows of the schema. The first fault in file order, a repeated ``key`` or an empty file raises ValueError."""
    checked = judged(items(spark, path), shape, rules)
    _raise_first(checked.filter(F.col("fault").isNotNull()))
    out = checked.select("path", "line", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    if key:
        again = out.groupBy(f"r.{key}").agg(F.min("path").alias("path"), F.max("line").alias("line"), F.count("*").alias("n")).filter("n > 1")
        _raise_first(again.select("path", "line", F.lit(f"repeated {key}").alias("fault")))
    if out.isEmpty():
        raise ValueError(f"{path}:1: no rows")
    return out.select("r.*")


def records(spark: SparkSession, path: str) -> DataFrame:
    return strict_json(spark, path, RECORD, RECORD_SHAPE, record_rules, "record_id")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return strict_json(spark, path, PREDICTION, PREDICTION_SHAPE, key="record_id")


def manifest(spark: SparkSession, path: str) -> dict:
    """The manifest, one strict JSON object over any number of lines; lists that may be missing are empty."""
    raw = contents(spark, path).select("content").first()
    text = bytes(raw["content"]).decode("utf-8") if raw else ""
    if not text.strip():
        raise ValueError(f"{path}:1: empty manifest")
    value, fault = decoded(text, MANIFEST_SHAPE, manifest_rules)
    if fault:
        raise ValueError(f"{path}:1: {fault}")
    return {"held_out_families": [], "group_partitioned_sources": []} | {k: v for k, v in value.items() if v is not None}


def record_faults(records: DataFrame) -> DataFrame:
    """(record_id, fault): blank fields, numbers of options, repeated option ids, answers that aren't options, repeated ids."""
    ids = F.transform("request.options", lambda o: o["id"])
    blank = lambda c: c.isNull() | (F.trim(F.regexp_replace(c, r"(?U)\s", " ")) == "")
    n = F.size("request.options")
    checks = [
        (blank(F.col("record_id")) | blank(F.col("dataset_id")) | blank(F.col("source_group_id")) | blank(F.col("request.context")) | blank(F.col("request.question")), "blank field"),
        ((n < 2) | (n > 16), "number of options"),
        (F.size(F.array_distinct(ids)) < n, "repeated option"),
        (F.exists("request.options", lambda o: blank(o["id"]) | blank(o["label"])), "blank option"),
        (~F.array_contains(ids, F.col("answer_id")), "answer isn't an option"),
    ]
    found = records.select("record_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for c, m in checks]))).alias("fault"))
    again = records.groupBy("record_id").count().filter("count > 1").select("record_id", F.lit("repeated record").alias("fault"))
    return found.unionByName(again)


def prediction_faults(predictions: DataFrame) -> DataFrame:
    """(record_id, fault): hashes that aren't 64 lower-case hex digits, no logits, logits that aren't finite."""
    values = F.map_values("logits")
    checks = [(~F.col("request_hash").rlike("^[0-9a-f]{64}$"), "request hash"), (F.size("logits") < 1, "no logits"), (F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), "logit isn't finite")]
    return predictions.select("record_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for c, m in checks]))).alias("fault"))


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def zip_member(archives: DataFrame, member: str, allowed: list[str], most_bytes: int | None = None) -> DataFrame:
    """(path, content) of a member of ZIP archives (path, content).

    A member that isn't allowed, that is missing, a folder, there several times or larger than
    ``most_bytes`` is an error.
    """
    if member not in allowed:
        raise ValueError(f"{member} isn't an allowed member")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        found = [i for i in z.infolist() if i.filename == member]
                        if len(found) != 1 or found[0].is_dir() or (most_bytes is not None and found[0].file_size > most_bytes):
                            raise ValueError(f"{name}: no single member {member} of the size allowed")
                        yield pa.RecordBatch.from_pydict({"path": [f"{name}/{member}"], "content": [z.read(found[0])]}, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))
                except zipfile.BadZipFile:
                    raise ValueError(f"{name}: not a ZIP archive") from None

    return archives.mapInArrow(read, "path string, content binary")


def _parsed(files: DataFrame, parse: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Rows that ``parse`` finds in each whole file; a ValueError of it gets the file's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = parse(content)
                except ValueError as e:
                    why = "not UTF-8" if isinstance(e, UnicodeDecodeError) else str(e)
                    raise ValueError(f"{name}: {why}") from None
                yield pa.RecordBatch.from_pydict({"path": [name] * len(found), "row": [json.dumps(r, ensure_ascii=False) for r in found]}, schema=pa.schema([("path", pa.string()), ("row", pa.string())]))

    return files.mapInArrow(run, "path string, row string").select(F.from_json("row", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def unique(rows: list[dict], key: str, label: str | None = None) -> list[dict]:
    """Rows with one of each key: equal ones become one; the same but for the label, or ambiguous ones, are errors."""
    seen: dict[str, dict] = {}
    for r in rows:
        old = seen.setdefault(r[key], r)
        if old != r:
            same = label is not None and {k: v for k, v in old.items() if k != label} == {k: v for k, v in r.items() if k != label}
            raise ValueError("conflicting labels of one id" if same else "ambiguous id")
    return list(seen.values())


def causes(files: DataFrame, expected: int | None = None) -> DataFrame:
    """Items of an XML file: id, relation, premise, two choices and the number of the likelier one.

    The root and its version, attributes, children, relations, labels and texts are checked; ids and
    items that agree after squeezing, whatever the order of the choices, may not repeat.
    """

    def parse(content: bytes) -> list[dict]:
        try:
            root = ElementTree.fromstring(content)
        except ElementTree.ParseError:
            raise ValueError("malformed XML") from None
        _need(root.tag == "copa-corpus" and root.attrib == {"version": "1.0"}, "root or version")
        out, ids, meanings = [], set(), set()
        for e in root:
            _need(e.tag == "item" and set(e.attrib) == {"id", "asks-for", "most-plausible-alternative"}, "item structure")
            item, relation, answer = (e.attrib[k] for k in ("id", "asks-for", "most-plausible-alternative"))
            _need(bool(item) and item not in ids, "item id")
            _need(relation in ("cause", "effect"), "relation")
            _need(answer in ("1", "2"), "label")
            _need([c.tag for c in e] == ["p", "a1", "a2"] and not any(c.attrib or len(c) for c in e), "item children")
            premise, *choices = [(c.text or "").strip() for c in e]
            _need(all([premise, *choices]), "blank text")
            squeezed = lambda t: " ".join(t.split())
            meaning = (relation, squeezed(premise), *sorted(map(squeezed, choices)))
            _need(meaning not in meanings, "repeated item")
            ids.add(item)
            meanings.add(meaning)
            out.append({"id": item, "relation": relation, "premise": premise, "choices": choices, "answer": int(answer)})
        _need(expected is None or len(out) == expected, f"expected {expected} items")
        return out

    return _parsed(files, parse, "id string, relation string, premise string, choices array<string>, answer int")


def _json_lines(content: bytes, shape: Shape, strict: bool = False) -> list[dict]:
    """Objects of the lines of a file that must have the shape; lines split as str.splitlines does, blank ones are errors if ``strict``."""
    out = []
    for n, t in enumerate(content.decode("utf-8-sig").splitlines(), 1):
        if not t.strip():
            _need(not strict, f"line {n} is blank")
            continue
        value, fault = decoded(t, shape)
        _need(fault is None, f"line {n}: {fault}")
        out.append(value)
    return out


def lexical_pairs(files: DataFrame) -> DataFrame:
    """Rows of a tab-separated file with a header: pair_id, premise, hypothesis, label, heuristic, subcase, template and a group of the subcase."""
    names = ("gold_label", "sentence1", "sentence2", "pairID", "heuristic", "subcase", "template")

    def parse(content: bytes) -> list[dict]:
        reader = csv.DictReader(io.StringIO(content.decode("utf-8-sig"), newline=""), delimiter="\t")
        _need(set(names) <= set(reader.fieldnames or ()), "header")
        out = []
        for row in reader:
            _need(None not in row and None not in row.values(), "malformed row")
            label, premise, hypothesis, pair, heuristic, subcase, template = (row[n].strip() for n in names)
            _need(all((label, premise, hypothesis, pair, heuristic, subcase, template)), "blank field")
            _need(label in ("entailment", "non-entailment"), "label")
            out.append({"pair_id": pair, "premise": premise, "hypothesis": hypothesis, "label": label, "heuristic": heuristic, "subcase": subcase, "template": template})
        return unique(out, "pair_id", "label")

    out = _parsed(files, parse, "pair_id string, premise string, hypothesis string, label string, heuristic string, subcase string, template string")
    return out.withColumn("source_group_id", F.concat(F.lit("hans-subcase:"), F.sha2("subcase", 256)))


def blanks(data: DataFrame, labels: DataFrame) -> DataFrame:
    """Sentences with one blank, two options and the label in the same line of a second file: id, sentence, options, answer."""
    both = data.select("path", F.col("content").alias("a")).crossJoin(labels.select(F.col("content").alias("b")))  # one file each
    shape = Open(qID=words, sentence=words, option1=words, option2=words)

    def parse(content: bytes) -> list[dict]:
        size = int.from_bytes(content[:8], "big")
        first, second = content[8 : 8 + size], content[8 + size :]
        rows, answers = _json_lines(first, shape, strict=True), second.decode("utf-8-sig").splitlines()
        _need(bool(rows) and len(rows) == len(answers), "lines of the two files don't match")
        out = []
        for r, a in zip(rows, map(str.strip, answers), strict=True):
            _need(a in ("1", "2"), "label")
            _need(r["sentence"].strip().count("_") == 1, "not one blank")
            out.append({"id": r["qID"].strip(), "sentence": r["sentence"].strip(), "options": [r["option1"].strip(), r["option2"].strip()], "answer": int(a)})
        return unique(out, "id", "answer")

    head = F.unhex(F.lpad(F.hex(F.length("a")), 16, "0"))
    return _parsed(both.select("path", F.concat(head, "a", "b").alias("content")), parse, "id string, sentence string, options array<string>, answer int")


def choices(files: DataFrame) -> DataFrame:
    """Questions with 2 to 16 labelled choices, labels distinct, the answer among them: id, stem, choices, answer."""
    shape = Open(id=words, question=Open(stem=words, choices=[Open(label=words, text=words)]), answerKey=words)

    def parse(content: bytes) -> list[dict]:
        out = []
        for r in _json_lines(content, shape, strict=True):
            found = [{"label": c["label"], "text": c["text"]} for c in r["question"]["choices"]]
            marks = [c["label"] for c in found]
            _need(2 <= len(marks) <= 16, "number of choices")
            _need(len(set(marks)) == len(marks), "repeated choice")
            _need(r["answerKey"] in marks, "answer isn't a choice")
            out.append({"id": r["id"], "stem": r["question"]["stem"], "choices": found, "answer": r["answerKey"]})
        _need(bool(out), "no rows")
        return unique(out, "id", "answer")

    return _parsed(files, parse, "id string, stem string, choices array<struct<label string, text string>>, answer string")


def messages(files: DataFrame) -> DataFrame:
    """(row_id, label, message) of lines "label TAB message", numbered from 0; another label, a blank message or line is an error."""

    def parse(content: bytes) -> list[dict]:
        out = []
        for n, t in enumerate(content.decode("utf-8").splitlines()):
            label, tab, message = t.partition("\t")
            _need(bool(tab) and label in ("ham", "spam") and bool(message.strip()), f"row {n}: label or message")
            out.append({"row_id": n, "label": label, "message": message})
        _need(bool(out), "no rows")
        return out

    return _parsed(files, parse, "row_id long, label string, message string")


def native_rows(files: DataFrame, expected: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pair_id, row_id) with the first row of each labelled pair, and one row (unlabelled, rows) of counts."""

    def parse(content: bytes) -> list[dict]:
        out = []
        for n, t in enumerate(content.decode("utf-8").splitlines()):
            if not t.strip():
                continue
            value, fault = decoded(t, lambda v: isinstance(v, dict))
            _need(fault is None, f"row {n}: {fault}")
            labelled = value.get("gold_label") != "-"
            _need(not labelled or words(value.get("pairID")), f"row {n}: blank pair")
            out.append({"row_id": n, "pair_id": value["pairID"].strip() if labelled else None})
        _need(expected is None or len(out) == expected, "number of rows")
        return out

    rows = _parsed(files, parse, "row_id long, pair_id string")
    counts = rows.agg(F.count_if(F.col("pair_id").isNull()).alias("unlabelled"), F.count("*").alias("rows"))
    return rows.filter("pair_id IS NOT NULL").groupBy("pair_id").agg(F.min("row_id").alias("row_id")), counts


def passages(spark: SparkSession, path: str) -> DataFrame:
    """Questions about passages: question, passage, title (may be empty) and a yes or no answer."""
    shape = Open(question=words, passage=words, answer=lambda v: isinstance(v, bool), title=Maybe(lambda v: isinstance(v, str)))
    checked = judged(lines(spark, path), shape)
    _raise_first(checked.filter(F.col("fault").isNotNull()))
    out = checked.select(F.from_json("value", "question string, passage string, answer boolean, title string").alias("r")).select("r.*")
    return out.withColumn("title", F.coalesce("title", F.lit("")))


def premise_pairs(spark: SparkSession, path: str, keep_unlabelled: bool = False) -> DataFrame:
    """Pairs of sentences: pair_id, premise, hypothesis, caption and label.

    Rows without an agreed label ("-") go before anything else of them is looked at, unless they
    are kept for their anchors (label null); then the caption must be there.
    """
    caption = (lambda v: isinstance(v, str)) if keep_unlabelled else Maybe(lambda v: isinstance(v, str))
    shape = Open(gold_label=one_of("-", *LABELS), pairID=words, sentence1=words, sentence2=words, captionID=caption)

    def agreed(v: object) -> bool:
        if isinstance(v, dict) and v.get("gold_label") == "-" and not keep_unlabelled:
            return True
        return not misfits(v, shape)

    checked = judged(lines(spark, path), agreed)
    _raise_first(checked.filter(F.col("fault").isNotNull()))
    out = checked.select(F.from_json("value", "gold_label string, pairID string, captionID string, sentence1 string, sentence2 string").alias("r")).select("r.*")
    out = out if keep_unlabelled else out.filter("gold_label <> '-'")
    return out.select(F.col("pairID").alias("pair_id"), F.col("sentence1").alias("premise"), F.col("sentence2").alias("hypothesis"), F.coalesce("captionID", F.lit("")).alias("caption"), F.nullif("gold_label", F.lit("-")).alias("label"))


def numbered_parquet(spark: SparkSession, path: str, rows: int | None = None, each: int | None = None) -> DataFrame:
    """Columns title, content and label with the native row number of each file.

    With ``rows`` and ``each`` the number of rows, and of rows of each label, must be these; null
    titles or contents are an error then.
    """
    out = spark.read.parquet(path).select("title", "content", "label", F.col("_metadata.row_index").alias("row_id"))
    if rows is not None:
        counts = out.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("title").isNull() | F.col("content").isNull()).alias("bad")).agg(F.sum("n").alias("n"), F.min("n").alias("a"), F.max("n").alias("z"), F.sum("bad").alias("bad")).first()
        if counts["n"] != rows or (each is not None and (counts["a"], counts["z"]) != (each, each)) or counts["bad"]:
            raise ValueError(f"{path}: rows, classes or texts don't match")
    return out


def tabbed(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Columns of a tab-separated file with a header, quotes being ordinary characters."""
    out = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    missing = [n for n in names if n not in out.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return out.select(*names)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def pinned(spark: SparkSession, path: str, sha256: str) -> str:
    """The path, if its bytes have the digest; else ValueError."""
    got = [r["sha256"] for r in digest(spark, path).collect()]
    if got != [sha256.lower()]:
        raise ValueError(f"{path}: digest differs")
    return path


def canonical_lines(rows: DataFrame) -> Column:
    """Each row as compact JSON, the keys of every object in order."""
    return T.canonical(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}))


def write_canonical(rows: DataFrame, path: str, order: list[str]) -> None:
    """Sorted canonical JSON lines in a new folder; a folder that exists is an error."""
    rows.orderBy(*order).select(canonical_lines(rows).alias("value")).write.mode("errorifexists").text(path)
