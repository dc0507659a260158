"""Readers, sinks and the evaluation of files: what they take, what they refuse and where they say it is."""

from __future__ import annotations

import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from scorelane import __main__ as cli
from scorelane import evaluate
from scorelane.sources import readers, sinks

OPTIONS = [{"id": "a", "label": "A"}, {"id": "b", "label": "B", "description": None}]


def record(name="r", **more):
    return {"record_id": name, "dataset_id": "d", "source_group_id": "g", "answer_id": "a", "request": {"context": f"c {name} \x1f é", "question": "q", "options": OPTIONS}} | more


def write(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_records_keep_order_of_lines_and_types(spark, tmp_path):
    path = write(tmp_path / "ok.jsonl", json.dumps(record()) + "\r", "", record("s", source_group_id="one line"))
    rows = readers.records(spark, path)
    assert rows.count() == 2 and readers.record_faults(rows).count() == 0
    assert [r["line"] for r in readers.lines(spark, path).orderBy("line").collect()] == [1, 3]
    assert readers.records(spark, write(tmp_path / "ok.json", json.dumps([record(), record("s")], indent=1))).count() == 2


def test_lines_of_many_splits_are_numbered(spark, tmp_path):
    path = write(tmp_path / "big.jsonl", *[f'{{"n": {i}, "pad": "{"x" * (i % 50)}"}}' for i in range(1, 4001)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = readers.lines(spark, path)
        assert got.rdd.getNumPartitions() > 3
        assert all(json.loads(r["text"])["n"] == r["line"] for r in got.collect()) and got.count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(
    ("bad", "said"),
    [
        ('{"record_id":"x","record_id":"y"}', "repeated key"), ("{", "malformed JSON"), (record(record_id=5), "invalid fields: record_id"), (record(extra=1), "invalid fields: extra"),
        (record(request={"context": "c", "question": "q", "options": OPTIONS, "more": 1}), "invalid fields: request.more"), (record(request={"context": "c", "question": " ", "options": OPTIONS}), "invalid fields: request.question"),
        (record(request={"context": "c", "question": "q", "options": [{"id": "a", "label": True}, OPTIONS[1]]}), "invalid fields: request.options.0.label"), (record(answer_id="z"), "answer isn't an option"),
        (record(request={"context": "c", "question": "q", "options": OPTIONS[:1]}), "number of options"), (record(request={"context": "c", "question": "q", "options": [OPTIONS[0]] * 2}), "repeated option"),
    ],
)
def test_bad_records_name_line_and_field(spark, tmp_path, bad, said):
    path = write(tmp_path / "bad.jsonl", record("first"), "", bad)
    with pytest.raises(ValueError, match=f"bad.jsonl:3: {said}"):
        readers.records(spark, path)


def test_repeated_empty_and_unknown_files(spark, tmp_path):
    with pytest.raises(ValueError, match=":2: repeated record_id"):
        readers.records(spark, write(tmp_path / "twice.jsonl", record(), record()))
    with pytest.raises(ValueError, match="no rows"):
        readers.records(spark, write(tmp_path / "empty.jsonl", ""))
    with pytest.raises(ValueError, match="use .json or .jsonl"):
        readers.records(spark, write(tmp_path / "r.txt", record()))
    for logits in ({"a": True}, {"a": "1"}, {}, {"a": math.inf}, {" ": 1}):
        row = {"record_id": "r", "request_hash": "0" * 64, "logits": logits, "model_revision": "m"}
        with pytest.raises(ValueError, match="invalid fields: logits|not a number"):
            readers.predictions(spark, write(tmp_path / "p.jsonl", row))
    assert readers.json_fault('{"a": NaN}') == "not a number" and readers.json_fault('{"a": 1}', {"b"}) == "undeclared fields: a"


MANIFEST = {"data_kind": "fixture", "datasets": [{"dataset_id": "d", "source_id": "s", "task_family": "f", "split": "test", "source_uri": "u", "source_revision": "1", "license": "l"}], "held_out_families": ["f"]}


def test_manifest(spark, tmp_path):
    got = readers.manifest(spark, write(tmp_path / "m.json", json.dumps(MANIFEST, indent=2)))
    assert got["group_partitioned_sources"] == [] and got["datasets"][0]["split"] == "test"
    for change, said in (({"datasets": []}, "datasets"), ({"held_out_families": ["f", "f"]}, "repeated family"), ({"group_partitioned_sources": ["x"]}, "undeclared source"), ({"data_kind": "x"}, "invalid fields: data_kind"), ({"datasets": MANIFEST["datasets"] * 2}, "repeated dataset")):
        with pytest.raises(ValueError, match=said):
            readers.manifest(spark, write(tmp_path / "m.json", json.dumps(MANIFEST | change)))


def files(spark, tmp_path):
    records = [record("r1"), record("r2", answer_id="b"), record("r3")]
    frame = spark.createDataFrame([(json.dumps(r),) for r in records], "t string").select(F.from_json("t", readers.RECORD).alias("r")).select("r.*")
    hashes = {r["record_id"]: r["request_hash"] for r in evaluate.with_hash(frame).collect()}
    logits = {"r1": {"b": 0.0, "a": 2.0}, "r2": {"a": 1.0, "b": 1.0}, "r3": {"a": -1.0, "b": 0.0}}
    predictions = [{"record_id": k, "request_hash": hashes[k], "logits": v, "model_revision": "m"} for k, v in logits.items()]
    return records, predictions


def test_evaluate_files(spark, tmp_path):
    records, predictions = files(spark, tmp_path)
    paths = [write(tmp_path / "r.jsonl", *records), write(tmp_path / "p.jsonl", *reversed(predictions)), write(tmp_path / "m.json", json.dumps(MANIFEST))]
    report = evaluate.evaluate(spark, *paths, min_confidence=0.6)
    p = [1 / (1 + math.exp(-2)), 0.5, 1 / (1 + math.exp(-1))]
    nll = [-math.log(p[0]), -math.log(0.5), -math.log(1 - p[2])]
    own = report["per_dataset"][0]
    assert own["record_count"] == 3 and own["accuracy"] == pytest.approx(1 / 3) and own["nll"] == pytest.approx(sum(nll) / 3) and own["coverage"] == pytest.approx(2 / 3) and own["accepted_risk"] == pytest.approx(1 / 2)
    assert own["brier"] == pytest.approx((2 * (1 - p[0]) ** 2 + 0.5 + 2 * p[2] ** 2) / 3)
    assert own["risk_coverage_curve"][0] == {"coverage": 0.0, "risk": None} and [x["risk"] for x in own["risk_coverage_curve"][1:]] == pytest.approx([0, 1 / 2, 2 / 3])
    assert report["calibration_status"] == "uncalibrated" and report["evaluation_split"] == "test" and report["overall"]["micro_accuracy"] == own["accuracy"]
    evaluate.write(report, str(tmp_path / "out" / "report.json"), paths)
    assert json.loads((tmp_path / "out" / "report.json").read_text())["overall"]["record_count"] == 3 and [p.name for p in (tmp_path / "out").iterdir()] == ["report.json"]
    with pytest.raises(ValueError, match="must not replace"):
        evaluate.write(report, paths[0], paths)
    assert evaluate.validate(spark, paths[0], paths[2])["split_counts"] == {"train": 0, "development": 0, "calibration": 0, "test": 3}


def test_evaluate_refuses_what_does_not_match(spark, tmp_path, capsys):
    records, predictions = files(spark, tmp_path)
    manifest = write(tmp_path / "m.json", json.dumps(MANIFEST))
    cases = [(predictions[:2], "1 missing"), ([*predictions, predictions[0] | {"record_id": "x"}], "1 unexpected"), ([predictions[0] | {"request_hash": "0" * 64}, *predictions[1:]], "request_hash"), ([predictions[0] | {"logits": {"a": 1.0}}, *predictions[1:]], "option_ids"), ([predictions[0] | {"model_revision": "n"}, *predictions[1:]], "several revisions")]
    r = write(tmp_path / "r.jsonl", *records)
    for rows, said in cases:
        with pytest.raises(ValueError, match=said):
            evaluate.evaluate(spark, r, write(tmp_path / "p.jsonl", *rows), manifest)
    held = write(tmp_path / "h.json", json.dumps(MANIFEST | {"held_out_families": ["other"]}))
    with pytest.raises(ValueError, match="held_out_family"):
        evaluate.validate(spark, r, held)
    assert cli.main(["evaluate", "--records", r, "--manifest", manifest, "--predictions", str(tmp_path / "p.jsonl"), "--output", r]) == 2
    assert cli.main(["validate", "--records", r, "--manifest", manifest]) == 0 and "3 records" in capsys.readouterr().out


def content(spark, raw):
    return spark.createDataFrame([("f", raw if isinstance(raw, bytes) else raw.encode())], "path string, content binary")


ITEM = '<item id="{0}" asks-for="cause" most-plausible-alternative="2"><p>P{0}</p><a1>x</a1><a2>y</a2></item>'
QUESTION = {"id": "q", "question": {"stem": "s", "choices": [{"label": "A", "text": "a"}, {"label": "B", "text": "b"}]}, "answerKey": "B"}


@pytest.mark.parametrize(
    ("read", "raw", "said"),
    [
        (readers.causes, "<copa-corpus>" + ITEM.format(1) + "</copa-corpus>", "root or version"), (readers.causes, f'<copa-corpus version="1.0">{ITEM.format(1)}{ITEM.format(1)}</copa-corpus>', "item id"),
        (readers.causes, f'<copa-corpus version="1.0">{ITEM.format(1)}{ITEM.format(1).replace("id=1", "id=2").replace(chr(34) + "1" + chr(34), chr(34) + "9" + chr(34), 1)}</copa-corpus>', "repeated item"),
        (readers.messages, "ham\tx\n\nspam\ty\n", "row 1"), (readers.messages, "eggs\tx\n", "row 0"), (readers.messages, "", "no rows"),
        (readers.choices, json.dumps(QUESTION | {"answerKey": "C"}), "answer isn't a choice"), (readers.choices, json.dumps(QUESTION) + "\n" + json.dumps(QUESTION | {"answerKey": "A"}), "conflicting labels"),
        (readers.lexical_pairs, "a\tb\n1\t2\n", "header"), (readers.lexical_pairs, b"\xff", "not UTF-8"),
    ],
)
def test_sources_refuse(spark, read, raw, said):
    with pytest.raises(Exception, match=said):
        read(content(spark, raw)).collect()


def test_blank_sentences_and_zip(spark):
    row = {"qID": "1", "sentence": "a _ b", "option1": "x", "option2": "y"}
    data, labels = json.dumps(row) + "\n" + json.dumps(row), "1\n1\n"
    assert [tuple(r) for r in readers.blanks(content(spark, data), content(spark, labels)).collect()] == [("1", "a _ b", ["x", "y"], 1)]
    for d, x, said in ((data, "1\n", "don't match"), (data, "1\n2\n", "conflicting"), (data.replace("a _ b", "a _ _"), labels, "one blank")):
        with pytest.raises(Exception, match=said):
            readers.blanks(content(spark, d), content(spark, x)).collect()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("m", "ham\tx")
    archive = content(spark, out.getvalue())
    assert bytes(readers.zip_member(archive, "m", ["m"]).first()["content"]) == b"ham\tx"
    for member, size, said in (("n", None, "no single member"), ("m", 2, "no single member")):
        with pytest.raises(Exception, match=said):
            readers.zip_member(archive, member, [member], size).collect()
    with pytest.raises(ValueError, match="isn't an allowed"):
        readers.zip_member(archive, "m", [])


def test_native_rows_and_unicode_lines(spark):
    rows = [{"gold_label": "-"}, {"gold_label": "neutral", "pairID": " p "}, {"gold_label": "neutral", "pairID": "p"}]
    first, counts = readers.native_rows(content(spark, " ".join(map(json.dumps, rows))), 3)
    assert [tuple(r) for r in first.collect()] == [("p", 1)] and tuple(counts.first()) == (1, 3)


def test_frozen_and_exported_files(spark, tmp_path):
    path = str(tmp_path / "x" / "f")
    assert sinks.write_frozen(path, b"1") is True and sinks.write_frozen(path, b"1") is False
    with pytest.raises(ValueError, match="another file"):
        sinks.write_frozen(path, b"2")
    rows = spark.createDataFrame([(2, "b"), (1, None)], "z int, a string")
    receipt = sinks.export(str(tmp_path / "e"), {"rows": (rows, ["z"])}, {"recipe": {"b": 1, "a": None}})
    assert receipt["rows.jsonl"]["rows"] == 2 and (tmp_path / "e" / "rows.jsonl").read_text() == '{"a":null,"z":1}\n{"a":"b","z":2}\n' and sinks.verify(str(tmp_path / "e")) == []
    (tmp_path / "e" / "rows.jsonl").write_text("changed")
    (tmp_path / "e" / "more").write_text("x")
    assert sinks.verify(str(tmp_path / "e")) == ["more", "rows.jsonl"]
    with pytest.raises(Exception):  # noqa: B017
        sinks.export(str(tmp_path / "broken"), {"rows": (rows.withColumn("x", F.raise_error(F.lit("no"))), ["z"])}, {})
    assert not (tmp_path / "broken").exists() and not list(tmp_path.glob(".broken*"))
    readers.write_canonical(rows.coalesce(1), str(tmp_path / "out"), ["z"])
    with pytest.raises(Exception, match="(?i)exists"):
        readers.write_canonical(rows, str(tmp_path / "out"), ["z"])
    with pytest.raises(ValueError):
        sinks.pretty({"x": math.nan})
