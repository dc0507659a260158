"""Text operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

from __future__ import annotations

import base64
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scorelane.llm import bpe, chat_format, line_dedup, mixing, nbsvm, queries, simhash, token_store

SCHEMA = "doc_id long, text string, source string"
ODD = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u200b\u3000aAbeéßzZ03٣'strevmlld.,|#日本🙂́<|>\x00"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts(n=400, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 50))) for _ in range(n)] + ["", "a" * 3000, " " * 500, "one two  three\n\nfour.\n x", "word. next"]


def brute_lines(rows, k=3):
    seen, out = set(), {}
    for i, text, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        ls, gone = text.split("\n"), set()
        for p in range(max(1, len(ls) - k + 1)):
            w = tuple(ls[p : p + k])
            if any(x.strip(" ") for x in w):
                if w in seen:
                    gone |= set(range(p, min(p + k, len(ls))))
                seen.add(w)
        out[i] = ("\n".join(x for p, x in enumerate(ls) if p not in gone), len(gone))
    return out


def test_line_dedup(spark):
    r = random.Random(3)
    rows = [(i, "\n".join(r.choice("abcd ") for _ in range(r.randint(0, 9))), "s") for i in range(200)] + [(900, None, None), (901, "", "s"), (902, "x\n" * 4000, "s")]
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(frame(spark, rows).withColumn("n_lines", F.lit("clash"))).collect()}
    want = brute_lines(rows)
    assert {i: (x["text"], x["n_removed"]) for i, x in got.items() if i != 900} == want
    assert got[900]["text"] is None and got[900]["n_lines"] == 0
    spans = got[902]["removed_spans"]
    assert [(s["first"], s["last"]) for s in spans] == [(1, 3999)]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    assert line_dedup.dedup_lines(frame(spark, [(1, "p\nq\nr", "s")] * 2)).filter("n_removed = 0").count() == 2
    assert line_dedup.dedup_lines(frame(spark, [(None, "p\nq\nr", "s"), (1, "p\nq\nr", "s")])).filter("doc_id = 1").first()["n_removed"] == 3


def plain_fingerprint(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(simhash.LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_matches_spark_hash(spark):
    for t in odd_texts(100):
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_anchors_lose_no_link(threshold):
    r = np.random.default_rng(threshold)
    x = r.integers(-(2**63), 2**63 - 1, 400)
    y = x.copy()
    for _ in range(threshold):
        y ^= np.int64(1) << r.integers(0, 63, 400)
    a, b = (set(zip(*map(np.ndarray.tolist, simhash.anchors(v, threshold)), strict=True)) for v in (x, y))
    assert {p for p, _ in a & b} == set(range(400))


def brute_components(u, limit):
    label = np.arange(len(u))
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= limit):
            a, b = sorted((label[i], label[j]))
            label[label == b] = a
    return label


def test_simhash_components(spark):
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 40))) for _ in range(60)]
    texts = base + [t + " z" for t in base] + base[:20] + [None, "", "A b C"] + [" ".join(r.choice("ab") for _ in range(12)) for _ in range(150)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {x["doc_id"]: (x["fp"] % 2**64, x["component_id"]) for x in simhash.near_duplicates(frame(spark, rows)).collect()}
    fps = np.array([plain_fingerprint(t) for t in texts], dtype=np.uint64)
    assert [got[i][0] for i in range(len(texts))] == fps.tolist()
    assert [got[i][1] for i in range(len(texts))] == brute_components(fps, 2).tolist()
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("threshold", [2, 3])
def test_large_anchor_equals_direct(threshold):
    r = np.random.default_rng(2)
    fp = np.unique(r.integers(0, 2**12, 700).astype(np.uint64))
    a, b = simhash._large(fp, threshold)
    assert (simhash._roots(len(fp), a, b) == brute_components(fp, threshold)).all()


def test_keep_one_of_similar(spark):
    r = random.Random(8)
    doc = [r.choice("abcdefghijklmnop") + str(r.randint(0, 999)) for _ in range(400)]
    near = doc.copy()
    near[200] = "changed"
    other = [r.choice("abcdefghijklmnop") + str(r.randint(0, 999)) for _ in range(400)]
    rows = [(3, " ".join(doc), "s"), (1, " ".join(near), "s"), (2, " ".join(doc), "s"), (7, " ".join(other), "s"), (9, None, "s"), (8, "", "s"), (None, " ".join(doc), "s"), (7, " ".join(other), "s")]
    assert sorted(x["doc_id"] or -1 for x in simhash.keep_one(frame(spark, rows)).collect()) == [-1, 1, 7, 8]
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_similar_classes_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: set(simhash.shingle_set(r["text"]).tolist()) for r in docs.collect()}
    r = random.Random(4)
    base = [f"w{r.randint(0, 99999)}" for _ in range(120)]
    for i, changed in enumerate(range(0, 12)):  # similarities on both sides of the threshold
        words = base.copy()
        for at in range(changed):
            words[at * 10 + 3] = f"other{i}"
        sets[10**6 + i] = set(simhash.shingle_set(" ".join(words)).tolist())
        docs = docs.unionByName(spark.createDataFrame([(10**6 + i, " ".join(words))], "doc_id long, text string"), allowMissingColumns=True)
    ids = sorted(sets)
    at = {}
    for i in ids:
        for h in sets[i]:
            at.setdefault(h, []).append(i)
    label = {i: i for i in ids}
    near = {(a, b) for a in ids for b in {x for h in sets[a] for x in at[h][:400]} if a < b} | {(a, b) for x in at.values() if len(x) > 400 for a in x for b in x if a < b}
    near |= {(a, b) for a in ids for b in ids if a < b and not sets[a] and not sets[b]}
    links = [(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in ids:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert dict(map(tuple, simhash.similar_classes(docs).collect())) == label


def test_similar_classes_in_a_template_group(spark):
    """Pairs just above the threshold among many documents just below it, whose closest links fail."""
    r, texts = np.random.default_rng(3), []
    for i in range(300):
        if i % 15 == 1:  # shares four of fourteen changes with the one before
            places = np.concatenate([places[:4], r.permutation(np.setdiff1d(np.arange(166), places))[:10]])
        else:
            places = r.permutation(166)[:14]
        words = [f"w{k}" for k in range(1000)]
        for k, at in enumerate(places.tolist()):
            words[6 * at + 2] = f"d{i - (i % 15 == 1 and k < 4)}x{at}"
        texts.append(" ".join(words))
    sets = [set(simhash.shingle_set(t).tolist()) for t in texts]
    a, b = np.triu_indices(300, 1)
    alike = np.array([len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in zip(a, b, strict=True)])
    label = simhash._roots(300, a[alike >= 0.8], b[alike >= 0.8])
    assert 20 <= (alike >= 0.8).sum() <= 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(map(tuple, simhash.similar_classes(docs).collect())) == dict(enumerate(label.tolist()))


def test_forest_joins_closest_first():
    r = np.random.default_rng(5)
    a, b = r.integers(0, 40, (2, 600))
    bits = r.integers(0, 9, 600)
    keep = simhash._forest(np.arange(40), a, b, bits)
    assert len(keep) == 40 - len(set(simhash._roots(40, a, b).tolist()))
    for limit in range(9):
        some = keep[bits[keep] <= limit]
        every = bits <= limit
        assert (simhash._roots(40, a[some], b[some]) == simhash._roots(40, a[every], b[every])).all()


def test_similar_pairs_of_hubs_and_blanks(spark):
    text = " ".join(f"w{i}" for i in range(50))
    texts = {1: text, 2: text + " more", 3: None, 4: " ", 5: "x y", **{10 + i: f"{text} end{i}" for i in range(40)}}
    sets = spark.createDataFrame([(k, simhash.shingle_set(t).tobytes()) for k, t in texts.items()], "node long, set binary")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (2, 5), (3, 5), *[(1, 10 + i) for i in range(40)], (5, 30)], "a long, b long")
    got = {frozenset(r) for r in map(tuple, simhash.similar_pairs(sets, pairs, 0.8).collect())}
    assert got == {frozenset((1, 2)), frozenset((3, 4)), *[frozenset((1, 10 + i)) for i in range(40)]}


@pytest.mark.parametrize("few", [simhash.FEW, 0])
def test_keep_one_tells_texts_of_one_id_apart(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)  # broadcast keys, and the joins beyond that
    rows = [(1, "the first text of this id", "s"), (1, "another one that shares nothing with it", "s"), (2, "another one that shares nothing with it", "s"), (1, "the first text of this id", "s")]
    got = sorted((x["doc_id"], x["text"]) for x in simhash.keep_one(frame(spark, rows)).collect())
    assert got == [(1, "another one that shares nothing with it"), (1, "the first text of this id")]


def test_recall_just_above_the_threshold(spark):
    """400 pairs of unrelated texts, each of similarity 0.80 to 0.85: at least nine tenths are joined, and nothing else."""
    r, texts = random.Random(12), []
    while len(texts) < 800:
        n = r.randint(120, 600)
        base = [f"w{r.randint(0, 10**6)}" for _ in range(n)]
        other = base.copy()
        for at in r.sample(range(n // 6), max(1, round(n * 0.021))):
            other[6 * at] = f"o{r.randint(0, 10**6)}"
        a, b = (set(simhash.shingle_set(" ".join(t)).tolist()) for t in (base, other))
        if 0.80 <= len(a & b) / len(a | b) < 0.85:
            texts += [" ".join(base), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(map(tuple, simhash.similar_classes(docs).collect()))
    assert all(got[i] in (i, i - i % 2) for i in got)
    assert sum(got[i + 1] == i for i in range(0, 800, 2)) >= 0.9 * 400, sum(got[i + 1] == i for i in range(0, 800, 2))
    print("joined", sum(got[i + 1] == i for i in range(0, 800, 2)))


def test_pack_and_random_access():
    r = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 4000):
        ids = (r.integers(0, 2**32, n) >> r.integers(0, 32, n)).astype(np.uint32)
        shard = token_store.Shard(token_store.pack([None, 5], np.array([n // 2, n - n // 2]), ids))
        assert [shard[i] for i in range(n)] == ids.tolist() and shard.doc_ids == [None, 5]
        assert (shard.document(1) == ids[n // 2 :]).all() and (shard.slice(n // 3, n // 2) == ids[n // 3 : n // 2]).all()


def test_token_store_round_trip(spark):
    rows = [(i * 3 % 401, t, "s") for i, t in enumerate(odd_texts(300))] + [(5000, None, "s"), (None, "null id", "s")]
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = token_store.store(frame(spark, rows), P.path("byte_bpe_50k.json"), P.PATTERN, 0).orderBy("start").collect()
    assert len(got) == len(rows) and got[0]["doc_id"] is None
    crcs, start = {}, 0
    for d, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        crcs.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for x in got:
        assert x["start"] == start and (x["n_tokens"], x["ids_crc32"]) in crcs[x["doc_id"]]
        start += x["n_tokens"]
    assert token_store.store(frame(spark, []), P.path("byte_bpe_50k.json"), P.PATTERN, 0).count() == 0


@pytest.fixture(scope="module")
def library():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_store_added_tokens(spark):
    """Texts with an added token of the vocabulary get the library's ids of the whole text."""
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "plain text.", "", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext", " two  runs <|endoftext|>\n\nend. "]
    docs = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_store.store(docs, path, P.PATTERN, end_id=0).collect()}
    for i, t in enumerate([*texts, ""]):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_bpe_equals_library(spark, library):
    own = bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = [*odd_texts(1500), "ab" * 4000, "x" * 64, "x" * 65, "é" * 700]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t), repr(t[:60])
        assert own.decode_many(own.encode_many(pa.array([t])))[0].as_py() == t.encode()
    raw = [t.encode() for t in texts if 0 < len(t.encode()) <= 64]
    assert own.merge_many(raw) == [own.merge_one(x) for x in raw]


def test_bpe_round_trip_frame(spark, library):
    rows = [(1, "Hello  world", "s"), (2, None, "s"), (2, "", "s"), (None, "x", "s")]
    got = bpe.round_trip(frame(spark, rows).withColumn("n_tokens", F.lit("clash")), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert sorted((x["doc_id"] or 0, x["n_tokens"], x["lossless"]) for x in got.collect()) == [(0, 1, True), (1, len(library.encode_ordinary("Hello  world")), True), (2, 0, True), (2, 0, True)]
    ids = frame(spark, rows).select("text", bpe.token_ids(F.col("text"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).alias("i"))
    back = ids.select("text", bpe.decoded(F.col("i"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).alias("b")).collect()
    assert all(bytes(x["b"]).decode() == (x["text"] or "") for x in back)
    assert bpe.round_trip(frame(spark, []), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_classifier_on_held_out_rows(spark):
    got = queries.op4_quality_classifier(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert ((got.predicted == 1) == (got.quality == 1)).mean() > 0.98 and got.score.between(0, 1).all()


def test_classifier_edges(spark):
    docs = frame(spark, [(1, "a", "s"), (2, None, "s"), (None, "b", "s")])
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = nbsvm.train(docs, none)
    assert {x["score"] for x in nbsvm.score(docs.withColumn("score", F.lit("clash")), model).collect()} == {0.5}
    assert nbsvm.score(docs.limit(0), model).count() == 0 and 0 <= model.score("") <= 1
    ids = nbsvm.indicators("word " * 50_000)
    assert len(ids) == len(set(ids.tolist())) and len(nbsvm.indicators(None)) == 0


def test_dual_descent_reaches_the_optimum():
    r = np.random.default_rng(1)
    rows = [np.flatnonzero(r.random(30) < 0.3) for _ in range(120)]
    y = np.array([int(3 in set(x.tolist()) or 5 in set(x.tolist())) for x in rows])
    w, b = nbsvm.dual_descent(rows, [np.ones(len(x)) for x in rows], y, rounds=300)
    assert (np.array([w[x].sum() + b > 0 for x in rows]) == (y == 1)).mean() > 0.97


def water_fill(sizes, weights, most=3):
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        level = (total - sum(t for i, t in enumerate(target) if i not in free)) / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] > most * sizes[i]}
        if not over:
            for i in free:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = most * sizes[i]
        free -= over
    return target


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(["a", "é", "Z", None, "tiny"] if i % 50 == 0 else ["a", "é", "Z", None])) for i in range(3000)] + [(9000, None, "a"), (9001, "", "empty"), (9002, None, "empty")]
    got = mixing.mix(frame(spark, rows)).toPandas()
    assert sorted(got["size"]) == sorted(len((t or "").split()) for _, t, _ in rows)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == n) for n in names]
    want = water_fill(sizes, [(1, 2, 3)[i % 3] for i in range(len(names))])
    by = {r_[0]: r_[2] for r_ in rows}
    got["name"] = [by[i] for i in got.doc_id]
    for n, s, t in zip(names, sizes, want, strict=True):
        own = got[got.name.isna()] if n is None else got[got.name == n]
        assert set(own.source_size) == {s} and own.target.iloc[0] == pytest.approx(t) and abs(own.taken.sum() - t) <= max(0.01 * t, 60)
    assert (got.taken <= 3 * got["size"]).all()
    again = mixing.mix(frame(spark, rows[::-1])).toPandas().sort_values("doc_id").taken.tolist()
    assert again == got.sort_values("doc_id").taken.tolist()
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.repeated(frame(spark, rows)).groupBy("doc_id").count().count() == int((got.copies > 0).sum())


def test_mixing_repeated_rows_meets_its_target(spark):
    """A source of equal rows takes about its target, as one of distinct rows does; each row keeps its own place."""
    for ids in (lambda i: 1, lambda i: i):
        rows = [(ids(i), "ten words in a row that are all the same", "a") for i in range(100)] + [(1000 + i, "five words are in here", "b") for i in range(60)] + [(5, None, "a")] * 3
        want = water_fill([1000, 300], [1, 2])
        for got in (mixing.mix(frame(spark, rows)).toPandas(),):
            a, b = got[got.source_size == 1000], got[got.source_size == 300]
            assert len(got) == 163 and abs(a.taken.sum() - want[0]) <= 10 and abs(b.taken.sum() - want[1]) <= 5
            assert (got.taken <= 3 * got["size"]).all()
        copies = mixing.repeated(frame(spark, rows)).groupBy("source").count().collect()
        assert {r["source"]: r["count"] for r in copies} == {"a": a.copies.sum(), "b": b.copies.sum()}


def test_mixing_rates_solve_the_balance(spark):
    """Rates of a source are exp(lambda size), stopped at three, with the one lambda whose tokens meet the target."""
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.randint(1, 40)), "ab"[i % 2]) for i in range(400)]
    got = mixing.mix(frame(spark, rows)).toPandas()
    for _, own in got.groupby("source_size"):
        size, goal = own["size"].to_numpy(float), own.target.iloc[0]
        low, high = -5.0, 5.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (low, mid) if (size * np.minimum(3, np.exp(np.minimum(mid * size, 50)))).sum() > goal else (mid, high)
        assert own.rate.to_numpy() == pytest.approx(np.minimum(3, np.exp(np.minimum(low * size, 50))), rel=1e-5)
        assert (np.abs(own.copies.to_numpy() - own.rate.to_numpy()) < 4).all() and abs((size * own.copies).sum() - goal) <= 40


def test_a_frequent_window_is_split(spark, tmp_path):
    """With low thresholds Spark splits the partition that one window of all documents fills."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    spark.createDataFrame([(i, f"a\nb\nc\nd{i}\ne{i}") for i in range(6000)], "doc_id long, text string").repartition(12).write.parquet(str(tmp_path / "d"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = line_dedup.dedup_lines(spark.read.parquet(str(tmp_path / "d")))
        assert sorted(r["n_removed"] for r in out.collect()) == [0] + [3] * 5999
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)


def plain_indicators(text):
    """The indicators of a text, one at a time."""
    mask, mix = 2**64 - 1, 0x9E3779B97F4A7C15

    def place(h, kind):
        h = (h ^ kind) * mix & mask
        return ((h ^ h >> 29) * mix & mask) >> 46

    raw = (text or "").encode()
    found, words, word = set(), [], b""
    for c in raw + b" ":
        if c in b"\t\n\x0b\x0c\r ":
            words += [word] if word else []
            word = b""
        else:
            word += bytes([c])
    if not words:
        return found
    powers = [pow(0x100000001B3, i, 2**64) for i in range(64)]
    hashes = [(sum((c + 1) * powers[i % 64] for i, c in enumerate(w)) + len(w)) & mask for w in words]
    found |= {place(h, 11) for h in hashes}
    kinds = [ord("a") if c >= 0x80 or chr(c).islower() else ord("A") if chr(c).isupper() else ord("0") if chr(c).isdigit() else 32 if c in (9, 11, 12, 13) else c for c in raw]
    shape = [k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k]
    again = [1 + (i > 0 and hashes[i] == hashes[i - 1]) for i in range(len(hashes))]
    for run, longest, kind, last in ((shape, 5, 21, False), (again, 3, 41, True)):
        for n in range(1, longest + 1):
            for i in range(len(run) - n + 1):
                h = run[i]
                for x in run[i + 1 : i + n]:
                    h = (h * 1000003 + x) & mask
                if not last or run[i + n - 1] > 1:
                    found.add(place(h, kind + n))
    return found


def test_indicators_equal_plain_ones():
    r = random.Random(5)
    texts = ["", None, "  ", "a", "Word word word 12, 12!", "x" * 200 + " é 日本", "\ta\nb\x0bc\rd  e"] + ["".join(r.choice("aB1 .,\n\t\u00e9-") for _ in range(r.randint(1, 300))) for _ in range(60)]
    for t in texts:
        assert set(nbsvm.indicators(t).tolist()) == plain_indicators(t)


def test_classifier_equals_a_plain_refit(spark):
    """Ratios from plain counts, weights at the optimum of the dual found by projected gradients, scores of the query from both."""
    r = np.random.default_rng(3)
    rows = [np.unique(r.integers(0, 40, r.integers(3, 12))) for _ in range(40)]
    y = np.array([int((x < 18).mean() + r.normal() / 5 > 0.45) for x in rows])
    counts = [np.ones(nbsvm.PLACES), np.ones(nbsvm.PLACES)]
    for x, v in zip(rows, y, strict=True):
        for i in x:
            counts[v][i] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert nbsvm.log_count_ratio(rows, y) == pytest.approx(ratio)
    values = [ratio[x] / np.sqrt(len(x)) for x in rows]
    dense = np.zeros((40, 41))
    for k, (x, v) in enumerate(zip(rows, values, strict=True)):
        dense[k, x], dense[k, 40] = v, 1
    signed = dense * np.where(y == 1, 1, -1)[:, None]
    alpha, gram = np.zeros(40), signed @ signed.T
    for _ in range(60000):
        alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, 1)
    w, b = nbsvm.dual_descent(rows, values, y, 1.0, 5000, 1e-12)
    assert np.append(w[:40], b) == pytest.approx(alpha @ signed, abs=1e-5)

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = nbsvm.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = nbsvm.score(docs, model).select("text", "score").collect()
    for x in got[:60]:
        ids = sorted(plain_indicators(x["text"]))
        margin = sum(model.weights[i] for i in ids) / max(1, len(ids)) ** 0.5 + model.bias
        assert x["score"] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.shift))))


def test_added_tokens_as_the_library(spark):
    """The end mark alone, inside words, beside white space and repeated, encoded as the library does at its defaults."""
    mark = "<|endoftext|>"
    texts = [mark, f"a{mark}b", f"hello {mark} world", f"{mark}{mark}", f"\n{mark}\n x", f"<|endoftext{mark}", "<|endoftext| >", None, "", f"{mark.upper()} é{mark}"]
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids, sizes = token_store.encoder(path, P.PATTERN).encode(pa.array(texts), 0)
    at = 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 0]
        at += n


def test_chat_edges(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "u", "hi <|im_end|>"), (1, 1, "u", "hi <|im_end|>"), (1, 300, "v", None), (1, None, None, "?"), (2, 0, "system", "only"), (None, 0, "w", "n")]
    frame_ = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit("clash"))
    got = {(x["conv_id"], x["perspective"]): x for x in chat_format.rotate(frame_).collect()}
    assert set(got) == {(1, "u"), (1, "v"), (None, "w")}
    x = got[1, "u"]
    unknown, system = "<|im_start|>user name=unknown\n?<|im_end|>\n", "<|im_start|>system\nS<|im_end|>\n"
    assert x["text"] == unknown + system + "<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=v\n<|im_end|>\n" and x["n_turns"] == 4
    assert [x["text"][m["first"] : m["end"]] for m in x["mask"]] == ["hi < |im_end|><|im_end|>\n"]
    assert got[1, "v"]["text"] == unknown + system + "<|im_start|>user name=u\nhi < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert chat_format.rotate(frame_.limit(0)).count() == 0


def test_long_chat_is_whole(spark):
    r = random.Random(3)
    rows = [(1, i, r.choice(["ann", "bo", "system"]), "x" * r.randint(0, 30)) for i in range(3000)]
    got = {x["perspective"]: x for x in chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for who in ("ann", "bo"):
        head = {w: "system" if w == "system" else "assistant" if w == who else f"user name={w}" for w in ("ann", "bo", "system")}
        text, spans = "", []
        for _, _, role, said in rows:
            text += f"<|im_start|>{head[role]}\n"
            if role == who:
                spans.append((len(text), len(text) + len(said) + len("<|im_end|>\n")))
            text += said + "<|im_end|>\n"
        assert got[who]["text"] == text and [tuple(m) for m in got[who]["mask"]] == spans and got[who]["n_turns"] == 3000


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(same, name):
    same(queries.QUERIES[name], queries.SQL[name])
