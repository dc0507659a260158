"""Vector and URL operators against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelane.llm import pq_dedup, topk, url_filter
from scorelane.llm.simhash import _roots

SCHEMA = "vec_id long, embedding array<float>"
BROKEN = [(7001, None), (7002, []), (7003, [None] * 8), (7004, [math.nan] * 8), (7005, [math.inf] * 8), (None, [1.0] * 8)]


def vectors(n, seed, spread=0.15):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(1, n // 5), 8))
    x = centres[r.integers(0, len(centres), n)] + spread * r.normal(size=(n, 8))
    return [(int(i), [float(c) for c in v.astype(np.float32)]) for i, v in enumerate(x)]


def test_top_k(spark):
    rows = vectors(600, 1) + [(1000 + i, [0.5] * 8) for i in range(40)]
    frame = spark.createDataFrame([*rows, *BROKEN, rows[0], (5000, [1.0] * 3)], SCHEMA).withColumn("score", F.lit("clash"))
    got = sorted(map(tuple, topk.top_k(frame, 5, F.col("vec_id") % 20 == 0).collect()))
    ids, x = np.array([i for i, _ in rows]), np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    want = []
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            best = sorted((-int(s), int(j)) for s, j in zip(x @ x[i], ids, strict=True) if j != ids[i])[:5]
            want += [(int(ids[i]), k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert [g for g in got if g[0] != 5000] == sorted(want)
    assert topk.top_k(frame.limit(0), 5, F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], SCHEMA)
    assert sorted(map(tuple, topk.top_k(few, 5, F.lit(True)).collect())) == [(0, 1, 1, 0), (1, 1, 0, 0)]


@pytest.mark.parametrize("spread", [0.1, 0.3])
def test_pq_recall(spark, spread):
    rows = vectors(1500, 4, spread) + [(9000 + i, [1.0] * 8) for i in range(30)]
    frame = spark.createDataFrame([*rows, *BROKEN, (7006, [0.0] * 8), (7007, [1.0] * 3)], SCHEMA)
    for name in ("kept", "x", "_x", "node", "row", "key", "own", "component"):
        frame = frame.withColumn(name, F.lit("clash"))
    got = {x["vec_id"]: x for x in pq_dedup.near_duplicates(frame).collect()}
    x = np.array([v for _, v in rows], dtype=np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    links = near.sum(axis=1) - 1
    found = np.array([got[i]["n_links"] for i, _ in rows])
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum()
    for i in (7001, 7002, 7003, 7004, 7005, 7006, 7007):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert not got[None]["kept"] and got[9003]["n_links"] >= 29
    assert pq_dedup.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n", [40, 1400])
def test_pq_links_and_classes_by_length(spark, n):
    """Vectors of each number of components link among themselves, common or rare; counts, classes and kept equal brute force."""
    r = np.random.default_rng(n)
    rows = vectors(n, 9, 0.2) + [(20000 + i, v[:5]) for i, v in vectors(n, 10, 0.2)] + [(100000, [1.0, 0.0]), (100001, [1.0, 0.01]), (100002, [0.0, 1.0]), (100003, [1.0, 0.01])]
    got = {x["vec_id"]: x for x in pq_dedup.near_duplicates(spark.createDataFrame([rows[k] for k in r.permutation(len(rows))], SCHEMA)).collect()}
    for size in (8, 5, 2):
        own = [(i, np.array(np.float32(v), np.float64)) for i, v in rows if len(v) == size]
        x = np.array([v / np.linalg.norm(v) for _, v in own])
        a, b = np.nonzero(x @ x.T >= 0.9)
        label = _roots(len(own), a, b)
        ids = np.array([i for i, _ in own])
        least = [ids[label == k].min() for k in label]
        assert [got[i]["n_links"] for i in ids.tolist()] == ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist()
        assert [got[i]["component_id"] for i in ids.tolist()] == least and [got[i]["kept"] for i in ids.tolist()] == (ids == least).tolist()
    assert got[100000]["n_links"] == 2 and got[100002]["n_links"] == 0


def test_pq_dense_group(spark):
    """A third of the vectors are distinct near copies, spread over more lists than a few probes reach."""
    r = np.random.default_rng(11)
    x = r.normal(size=(6000, 64))
    x[::3] = r.normal(size=64) + 0.23 * r.normal(size=(2000, 64))
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {row["vec_id"]: row for row in pq_dedup.near_duplicates(frame).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert links.sum() > 3_000_000
    assert [got[i]["n_links"] for i in range(len(x))] == links.tolist()


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_filter(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("a.com", "", "block"), ("a.com", "", "allow")]
    urls = [None, "", "no scheme/x", "http://", "http://ORG/x", "http://org", "https://a.example.org/en/12?q#f", "http://example.org/es/1", "http://b.example.org/es", "http://xexample.org/es/", "http://a.com", "http://x.a.com/fr/1", "http://b.com/fr/", "ftp://u@a.com:80/", "x://y://a.com/", "http://É.org/É"]
    pages = spark.createDataFrame([*enumerate(urls), (4, urls[4])], "page_id long, url string").withColumn("verdict", F.lit("clash")).withColumn("u", F.lit("clash")).withColumn("best", F.lit("clash")).withColumn("row", F.lit("clash"))
    listed = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    got = sorted(((x["page_id"], x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter.judge(pages, listed).collect()), key=str)
    firm = [r for r in rules if r != ("a.com", "", "allow")]
    assert got == sorted(((i, *plain(u, firm)) for i, u in [*enumerate(urls), (4, urls[4])]), key=str)
    none = url_filter.judge(pages, listed.limit(0))
    assert {x["verdict"] for x in none.collect()} == {"allow"} and url_filter.judge(pages.limit(0), listed).count() == 0


def test_bloom_has_no_false_negatives():
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20000)
    bloom = np.zeros((512, 8), np.uint64)
    block, at = url_filter._bits(keys[:10000], 512)
    np.bitwise_or.at(bloom, (block[:, None], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    assert url_filter.may_hold(bloom, keys[:10000]).all() and url_filter.may_hold(bloom, keys[10000:]).mean() < 0.02
