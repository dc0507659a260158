"""The pipeline's stages against what each promises."""

from __future__ import annotations

import pytest

import corpus_pipeline
from scorelane.operators.workspace import Workspace

SF = "/root/testdata/sf0.01"


def test_stages_in_order(spark):
    work, docs = Workspace(spark, "t"), spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = work.save(stage(spark, docs, SF), name)
        seen[name] = docs.toPandas()
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
    kept = set(seen["quality"].doc_id)
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.97 * sum(q == 1 for q in labels.values())
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.1 * sum(q == 0 for q in labels.values())
    windows = [tuple(t.split("\n")[p : p + 3]) for t in seen["lines"].text for p in range(max(1, len(t.split("\n")) - 2))]
    assert len(set(windows)) >= 0.97 * len(windows)
    assert set(seen["near_copies"].doc_id) <= set(seen["lines"].doc_id) and seen["near_copies"].doc_id.is_unique and seen["near_copies"].text.is_unique
    assert set(seen["mixture"].doc_id) <= set(seen["near_copies"].doc_id) and seen["mixture"].groupby("doc_id").size().max() <= 3
    assert len(seen["tokens"]) == len(seen["mixture"]) and seen["tokens"].lossless.all()


ODD = "doc_id long, text string, lang string, source string, n_chars long, _score double, component_id long, fp long, n_removed int, size long, copies int, label int, node long, sid long"


def odd_documents(spark):
    long = " ".join(f"w{i % 977}" for i in range(60000))
    texts = [None, "", "   ", "one", "one", "same\nlines\nhere\nagain", "same\nlines\nhere\nagain", long, long + " end", "é 日本 🙂\r\n\tx", "a\nb\nc\nd"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(4, "one", "en", "s1", 3), (None, "no id at all", "en", "s1", 12), (None, None, None, None, None), (20, "no source here", None, None, None)]
    return spark.createDataFrame([(*r, 0.5, 7, 7, 7, 7, 7, 7, 7, 7) for r in rows], ODD)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_takes_odd_and_empty_tables(spark, name):
    """Nulls, blanks, long texts, repeated rows and clashing columns pass; an empty table gives an empty one."""
    stage, docs = dict(corpus_pipeline.STAGES)[name], odd_documents(spark)
    got = stage(spark, docs, SF).collect()
    ids = {r["doc_id"] for r in docs.collect()}
    assert got and {r["doc_id"] for r in got} <= ids
    if name != "tokens":
        assert list(got[0].asDict()) == corpus_pipeline.COLUMNS
    if name == "lines":
        kept = {r["doc_id"]: r["text"] for r in got}
        assert kept[5] == "same\nlines\nhere\nagain" and 6 not in kept and kept[10] == "a\nb\nc\nd"
    if name == "near_copies":
        assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [0, 3, 5, 7, 9, 10, 20]
        assert sum(r["doc_id"] is None for r in got) == 2
    if name == "tokens":
        assert all(r["lossless"] for r in got) and len(got) == docs.count()
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0 and empty.columns == list(got[0].asDict())
