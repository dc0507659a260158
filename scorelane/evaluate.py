"""The evaluation of saved predictions against records: from files to a report."""

from __future__ import annotations

import platform

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import scorelane
from scorelane.functions import text as T
from scorelane.operators import evidence, metrics, scoring
from scorelane.operators import records as R
from scorelane.operators.workspace import Workspace
from scorelane.sources import readers, sinks

FIELDS = ("accuracy", "macro_f1", "nll", "brier", "ece", "coverage", "accepted_risk", "aurc")


def with_hash(records: DataFrame) -> DataFrame:
    r = F.col("request")
    return records.withColumn("request_hash", T.request_hash(r["context"], r["question"], r["options"], control_safe=True))


def audit(spark: SparkSession, records: DataFrame, manifest: dict) -> DataFrame:
    """All violations (code, key) of hashed records against their manifest."""
    datasets = spark.createDataFrame([tuple(d[c] for c in ("dataset_id", "source_id", "task_family", "split")) for d in manifest["datasets"]], "dataset_id string, source_id string, task_family string, split string")
    found = R.audit(records, datasets, manifest["held_out_families"], manifest["group_partitioned_sources"])
    absent = sorted(set(manifest["held_out_families"]) - {d["task_family"] for d in manifest["datasets"]})
    return found.unionByName(spark.createDataFrame([("held_out_family", f) for f in absent], "code string, key string"))


def validate(spark: SparkSession, records_path: str, manifest_path: str) -> dict:
    """Counts of an audited set of records; the first violation raises ValueError."""
    manifest = readers.manifest(spark, manifest_path)
    records = with_hash(readers.records(spark, records_path))
    evidence.demand(audit(spark, records, manifest), "audit")
    split = {d["dataset_id"]: d["split"] for d in manifest["datasets"]}
    per = {r["dataset_id"]: r["count"] for r in records.groupBy("dataset_id").count().collect()}  # one row a declared dataset
    counts = {s: sum(n for d, n in per.items() if split[d] == s) for s in readers.SPLITS}
    return {"data_kind": manifest["data_kind"], "dataset_count": len(manifest["datasets"]), "record_count": sum(per.values()), "split_counts": counts, "held_out_families": manifest["held_out_families"]}


def prediction_match(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """(record_id, fault): missing, unexpected or repeated predictions, other request hashes, other sets of options."""
    ids = F.array_sort(F.transform("request.options", lambda o: o["id"])).alias("option_ids")
    given = predictions.select("record_id", "request_hash", F.array_sort(F.map_keys("logits")).alias("option_ids"))
    return evidence.join_faults(records.select("record_id", "request_hash", ids), given, ["record_id"], ["request_hash", "option_ids"])


def judged(records: DataFrame, predictions: DataFrame, temperature: float = 1.0, min_confidence: float | None = None) -> DataFrame:
    """Records with their logits in the order of their options, scored and judged."""
    ids = F.transform("request.options", lambda o: o["id"])
    rows = records.join(predictions.select("record_id", "logits"), "record_id").withColumn("ids", ids)
    rows = rows.withColumn("logits", scoring.align(F.col("ids"), F.col("logits")))
    return scoring.judged(scoring.scored(rows.select("record_id", "dataset_id", "answer_id", "ids", "logits"), temperature, min_confidence))


def _curve(points: list, total: int) -> list[dict]:
    return [{"coverage": 0.0, "risk": None}, *({"coverage": p["coverage"], "risk": p["risk"]} for p in points)]


def evaluate(spark: SparkSession, records_path: str, predictions_path: str, manifest_path: str, temperature: float = 1.0, calibration_id: str | None = None, min_confidence: float | None = None) -> dict:
    """The report. Faults of the files, the audit or the match raise ValueError.

    Records are scored once and written; metrics are aggregations of what was written. The report
    holds a point of the risk-coverage curve for each distinct confidence, as a report must; where
    these are too many for the driver, use ``judged`` and metrics.risk_curve, which stay distributed.
    """
    manifest = readers.manifest(spark, manifest_path)
    records = with_hash(readers.records(spark, records_path))
    predictions = readers.predictions(spark, predictions_path)
    evidence.demand(audit(spark, records, manifest), "audit")
    declared = {d["dataset_id"]: d for d in manifest["datasets"]}
    splits = {declared[r["dataset_id"]]["split"] for r in records.select("dataset_id").distinct().collect()}
    if len(splits) != 1:
        raise ValueError("records of several splits")
    counts = R.bijection(records.select("record_id"), predictions.select("record_id"), "record_id").first()
    if counts["missing"] or counts["extra"]:
        raise ValueError("; ".join(f"{n} {what} predictions" for n, what in ((counts["missing"], "missing"), (counts["extra"], "unexpected")) if n))
    evidence.demand(prediction_match(records, predictions), "predictions")
    revisions = [r[0] for r in predictions.select("model_revision").distinct().limit(2).collect()]
    if len(revisions) != 1:
        raise ValueError("predictions of several revisions")

    rows = Workspace(spark, "evaluate").save(judged(records, predictions, temperature, min_confidence).drop("ids", "logits", "scaled", "log_probs", "probs"), "judged")
    per = {r["dataset_id"]: r for r in metrics.report(rows, ["dataset_id"]).collect()}
    pooled = metrics.report(rows, []).first()
    curves: dict[str | None, list] = {}
    for r in metrics.risk_curve(rows, ["dataset_id"]).orderBy("dataset_id", F.desc("confidence")).collect():
        curves.setdefault(r["dataset_id"], []).append(r)
    whole = metrics.risk_curve(rows, []).orderBy(F.desc("confidence")).collect()
    shown = lambda r, names: {n: r[n] for n in names}
    datasets = [
        {"dataset_id": d, "task_family": declared[d]["task_family"], "split": declared[d]["split"], "record_count": per[d]["n"], **shown(per[d], FIELDS[:7]), "risk_coverage_curve": _curve(curves[d], per[d]["n"]), "aurc": per[d]["aurc"]}
        for d in sorted(per)
    ]
    mean = lambda c: sum(r[c] for r in per.values()) / len(per)
    overall = {
        "record_count": pooled["n"], "micro_accuracy": pooled["accuracy"], **{f"macro_dataset_{k}": mean(c) for k, c in (("accuracy", "accuracy"), ("f1", "macro_f1"), ("nll", "nll"), ("brier", "brier"), ("ece", "ece"))},
        **{f"pooled_{c}": pooled[c] for c in ("nll", "brier", "ece")}, "coverage": pooled["coverage"], "accepted_risk": pooled["accepted_risk"], "risk_coverage_curve": _curve(whole, pooled["n"]), "aurc": pooled["aurc"],
    }
    digest = lambda path: readers.digest(spark, path).first()["sha256"]
    return {
        "data_kind": manifest["data_kind"], "evaluation_split": splits.pop(), "model_revision": revisions[0], "temperature": float(temperature), "calibration_id": calibration_id,
        "calibration_status": "uncalibrated" if calibration_id is None else "profile_id_supplied", "min_confidence": min_confidence, "records_sha256": digest(records_path), "predictions_sha256": digest(predictions_path),
        "manifest_sha256": digest(manifest_path), "python_version": platform.python_version(), "package_version": scorelane.__version__, "per_dataset": datasets, "overall": overall,
    }


def write(report: dict, output: str, inputs: list[str]) -> None:
    """The report as JSON, in place at once or not at all; an input is never replaced."""
    sinks.write_report(output, sinks.pretty(report), inputs)
