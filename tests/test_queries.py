from __future__ import annotations

import hashlib
import json

import pytest

import __spark_entry__
from scorelane import evidence_queries, file_queries, queries, registry, rule_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(same, name):
    same(registry.QUERIES[name], registry.SQL[name])


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_requests_hold_whole_texts(spark, tmp_path):
    same = "the same forty letters begin both of these texts, "
    texts = [same + "one", same + "two", "1 \"2\" \\ / é 日本 🙂\t\r\n\x01\x1f\x7f\u2028", "", "word " * 20000]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    hashes = dict(map(tuple, queries.QUERIES["f02_request_hash"](spark, str(tmp_path)).collect()))
    prompts = dict(map(tuple, queries.QUERIES["f09_prompt"](spark, str(tmp_path)).collect()))
    question, labels = "What is the quality of the text?", ["High", "Low", "Mid"]
    for i, t in enumerate(texts):
        request = {"context": t, "options": [{"description": None, "id": x.lower(), "label": x} for x in labels], "question": question}
        assert hashes[f"doc-{i}"] == hashlib.sha256(json.dumps(request, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
        shown = {"context": t, "question": question, "options": [{"symbol": s, "label": x, "description": None} for s, x in zip("ABC", labels, strict=True)]}
        assert prompts[f"doc-{i}"] == json.dumps(shown, ensure_ascii=False, separators=(",", ":")) + "\nAnswer:\n"
    assert len(set(hashes.values())) == len(texts)
