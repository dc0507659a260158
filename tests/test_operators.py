"""Constants worked out by hand, and invariances."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from scorelane.functions import text as T
from scorelane.operators import calibration, components, generate, metrics, records, rules, scoring, stats
from scorelane.operators.workspace import Workspace


def decisions(spark, rows):
    return spark.createDataFrame(rows, "record_id string, ids array<string>, logits array<double>, answer_id string")


def probs(*ps):
    return [math.log(p) for p in ps]


def test_softmax_and_underflow(spark):
    got = scoring.scored(decisions(spark, [("a", ["x", "y"], [1.0, 0.0], "x"), ("b", ["x", "y"], [0.0, -1000.0], "x")])).orderBy("record_id").collect()
    assert got[0]["probs"] == pytest.approx([0.7310585786300049, 0.2689414213699951], abs=1e-15)
    assert got[1]["probs"][1] == 0 and got[1]["log_probs"][1] == -1000


def test_tie_takes_smallest_id_and_abstains(spark):
    got = scoring.scored(decisions(spark, [("a", ["zeta", "alpha"], [2.0, 2.0], "zeta")]), min_confidence=0.9).first()
    assert (got["top_option_id"], got["reason"], got["abstained"]) == ("alpha", "tie", True)


def three(spark, limit=None):
    rows = [("1", ["A", "B"], probs(0.8, 0.2), "A"), ("2", ["A", "B"], probs(0.2, 0.8), "B"), ("3", ["A", "B"], probs(0.6, 0.4), "B")]
    return scoring.judged(scoring.scored(decisions(spark, rows), min_confidence=limit))


def test_three_row_metrics(spark):
    got = metrics.report(three(spark), []).first()
    assert got["accuracy"] == pytest.approx(2 / 3) and got["macro_f1"] == pytest.approx(2 / 3)
    assert got["nll"] == pytest.approx(0.454192611501, abs=1e-12) and got["brier"] == pytest.approx(0.293333333333, abs=1e-12) and got["ece"] == pytest.approx(1 / 3)


def test_threshold_is_strict(spark):
    top = three(spark).agg(F.max("confidence")).first()[0]
    assert metrics.basic(three(spark, top), []).first()["accepted_risk"] == 0
    none = metrics.basic(three(spark, 0.81), []).first()
    assert none["coverage"] == 0 and none["accepted_risk"] is None


def test_tied_confidences_are_one_step(spark):
    rows = [(str(i), ["A", "B"], probs(p, 1 - p), a) for i, (p, a) in enumerate([(0.9, "A"), (0.9, "B"), (0.6, "A"), (0.6, "B")])]
    judged = scoring.judged(scoring.scored(decisions(spark, rows)))
    assert [(r["coverage"], r["risk"]) for r in metrics.risk_curve(judged, []).orderBy("coverage").collect()] == [(0.5, 0.5), (1.0, 0.5)]
    assert metrics.aurc(judged, []).first()[0] == 0.5


def test_confidence_bin_compares(spark):
    got = spark.createDataFrame([(0.8999999999999999,), (0.9,), (1.0,), (0.0,)], "p double").select(T.confidence_bin(F.col("p"))).collect()
    assert [r[0] for r in got] == [8, 9, 9, 0]


def test_divergence(spark):
    got = spark.createDataFrame([([0.8, 0.2], [0.2, 0.8]), ([0.5, 0.5], [0.5, 0.5]), ([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.501, 0.499])], "p array<double>, q array<double>")
    v = [r[0] for r in got.select(scoring.divergence(F.col("p"), F.col("q"))).collect()]
    small = sum(a * math.log(2 * a / (a + b)) / 2 + b * math.log(2 * b / (a + b)) / 2 for a, b in ((0.5, 0.501), (0.5, 0.499)))
    assert v == pytest.approx([0.192744757022, 0, math.log(2), small], abs=1e-12)


def test_calibration_edges(spark):
    assert len(calibration.grid()) == 82
    flat = spark.createDataFrame([([3.0, 3.0, 3.0], 0, 1.0)], "logits array<double>, gold_index int, weight double")
    assert calibration.fit(flat).first()["temperature"] == 1.0
    sure = spark.createDataFrame([([0.5, 0.0], 0, 1.0)] * 2, "logits array<double>, gold_index int, weight double")
    got = calibration.fit(sure).first()
    assert got["temperature"] == 0.05 and got["boundary_hit"]


def test_request_hash_ignores_option_order(spark):
    o = [("b", "B", None), ("a", "A", "x")]
    rows = spark.createDataFrame([("c", "q", o), ("c", "q", o[::-1])], "context string, question string, options array<struct<id string, label string, description string>>")
    got = {r[0] for r in rows.select(T.request_hash(F.col("context"), F.col("question"), F.col("options"), control_safe=True)).collect()}
    want = {"context": "c", "question": "q", "options": [{"id": "a", "label": "A", "description": "x"}, {"id": "b", "label": "B", "description": None}]}
    assert got == {T.python_digest(want)}


def test_normalisation(spark):
    got = spark.createDataFrame([(" Straße  X ",), ("ﬁ",)], "t string").select(T.squeeze(F.col("t")), T.casefolded("t"), T.nfkc_casefolded("t")).collect()
    assert tuple(got[0]) == ("Straße X", "strasse x", "strasse x") and got[1][2] == "fi"


def test_components_chain_and_empty(spark):
    work = Workspace(spark, "t")
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.connected_components(chain, "u", "v", work).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.connected_components(chain.limit(0), "u", "v", work).count() == 0




def test_percentile_and_gate(spark):
    deltas = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate([0, 1, 2, 5])], "task string, idx long, delta double")
    drawn = spark.createDataFrame([("t", i, i) for i in range(4)], "task string, draw int, idx long")
    got = stats.intervals(deltas, drawn, "task").first()
    assert (got["low"], got["high"]) == pytest.approx((0.075, 4.775))
    rows = spark.createDataFrame([(1, 3), (33, 100)], "n long, d long").select(stats.gate(F.col("n"), F.col("d"), 1, 3)).collect()
    assert [r[0] for r in rows] == [True, False]
    import random

    r = random.Random(5)
    assert [x["idx"] for x in stats.bank(spark, 5, [("a", 3), ("b", 2)], 2).collect()] == [r.randrange(n) for n in (3, 3, 3, 3, 3, 3, 2, 2, 2, 2)]


def test_greedy_skips_used_blocks(spark):
    rows = spark.createDataFrame([("s1", "p", 1), ("s1", "q", 2), ("s2", "p", 1), ("s2", "r", 5)], "stratum string, block string, rank int")
    assert records.greedy(rows, "stratum", "block", ["rank"], 1) == [("s1", "p", 1), ("s2", "r", 5)]


def test_tool_tie(spark):
    schema = "scenario_id int, required array<string>, input string, permissions array<string>, granted array<boolean>, tools array<struct<id string, capabilities array<string>, inputs array<string>, needs array<string>, cost int>>"
    rows = spark.createDataFrame([(1, ["a"], "t", [], [], [("x", ["a"], ["t"], [], 1), ("y", ["a"], ["t"], [], 1)]), (2, ["a"], "t", ["n"], [None], [("x", ["a"], ["t"], ["n"], 1), ("y", ["a"], ["t"], [], 2)])], schema)
    assert {r["scenario_id"]: r["outcome"] for r in rules.solve_tools(rows, ties="mark").collect()} == {1: "tie", 2: "insufficient_information"}
    with pytest.raises(Exception, match="tie in scenario 1"):
        rules.solve_tools(rows).collect()


def test_ledger_names_each_step_that_breaks_it(spark):
    plan = spark.createDataFrame([(i, f"s{i}", "ab"[i % 2]) for i in range(6)], "step int, spec string, category string")
    done = spark.createDataFrame([(0, "s0", "a"), (1, "s1", "b"), (2, "x", "a"), (3, "s3", "b"), (4, "s4", "a"), (9, "more", "b")], "step int, spec string, category string")
    got = {tuple(r) for r in stats.ledger_faults(done, plan, "step", "spec", "category", {"a": 2, "b": 9}, 5).collect()}
    assert got == {(2, "not the planned spec"), (4, "category cap"), (9, "not planned"), (9, "total cap")}


def test_sequences_of_calls(spark):
    rows = [("c", 0, 1, "start", []), ("c", 1, 2, "call", ["x"]), ("c", 2, 2, "call", ["x", "y"]), ("c", 3, 4, "end", ["y"]), ("c", 4, 5, "more", ["x", "y"])]
    frame = spark.createDataFrame(rows, "run string, seq int, ts int, kind string, calls array<string>")
    got = {tuple(r) for r in stats.event_faults(frame, "run", "seq", "ts", "kind", ["start", "call", "call", "end"], "calls").collect()}
    assert got == {("c", 2, "time"), ("c", 3, "calls lost"), ("c", 4, "kind")}


def test_truth_table_form_ignores_names():
    table = {(0, 0): "x", (0, 1): "y", (1, 0): "x"}
    swapped = {(b, 1 - a): {"x": "q", "y": "p"}[v] for (a, b), v in table.items()}
    assert generate.truth_table_form([2, 2], table) == generate.truth_table_form([2, 2], swapped)
    assert generate.truth_table_form([2, 2], table) != generate.truth_table_form([2, 2], {**table, (1, 1): "z"})


def test_padding(spark):
    rows = spark.createDataFrame([([7, 8],)], "ids array<int>")
    got = rows.select(*T.left_padded(F.col("ids"), 4, 9)).first()
    assert list(got) == [[9, 9, 7, 8], [0, 0, 1, 1], [0, 0, 0, 1]]


@pytest.mark.parametrize(
    ("message", "shown"),
    [
        ("get https://u:p@h/x?k=v#f now", "get https://h/x now"), ("(see http://a.org/b?c=d).", "(see http://a.org/b)."), ("Authorization: Bearer abc.def, next", "[REDACTED]], next"),
        ("hf_fake-Token_456", "[REDACTED]"), ("passwd=hunter2 x", "[REDACTED] x"), ("api-key: abc", "[REDACTED]"), ("basic dXNlcjpw", "basic [REDACTED]"), ('my.secret="two words" y', "[REDACTED] y"),
        ("db_password : 'a b', z", "[REDACTED], z"), ("nothing here", "nothing here"), ("x" * 3000, "x" * 2000),
    ],
)
def test_redaction(spark, message, shown):
    assert spark.createDataFrame([(message,)], "m string").select(T.redacted(F.col("m"))).first()[0] == shown


def test_numbered_without_gathering(spark):
    rows = spark.createDataFrame([(x % 7, x) for x in range(3000)] + [(None, -1), (3, None)], "a int, b int")
    got = {(r["a"], r["b"]): r["i"] for r in records.numbered(rows.repartition(5), ["a", "b"], "i").collect()}
    want = sorted(got, key=lambda k: (k[0] is not None, k[0] or 0, k[1] is not None, k[1] or 0))
    assert [got[k] for k in want] == list(range(3002))
    assert records.numbered(rows.limit(0), ["a", "b"], "i").count() == 0


def test_one_to_one_separation_and_exclusion(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2), ("y", 3), (None, 4), (None, None)], "a string, b int")
    assert {tuple(r) for r in records.not_one_to_one(rows, "a", "b").collect()} == {("a", "y", 2)}
    assert {tuple(r) for r in records.separation(rows, rows.filter("b = 2"), ["a", "b"]).collect()} == {("a", 1), ("b", 1)}
    assert records.excluded(rows, (rows.filter("a = 'x' OR a IS NULL"), "a")).count() == 4
    assert records.separation(rows.limit(0), rows, ["a"]).first()["shared"] == 0


def test_winner_table_and_known_sum(spark):
    rows = spark.createDataFrame([("r", 0, "p"), ("r", 1, "q"), ("s", 0, "p")], "record_id string, order_index int, top_option_id string")
    assert [tuple(r) for r in metrics.winner_table(rows, 2).collect()] == [("r", "p", "q")]
    known = spark.createDataFrame([(1, 2), (1, None), (2, 5)], "k int, x int").groupBy("k").agg(metrics.known_sum(F.col("x")).alias("x"))
    assert {tuple(r) for r in known.collect()} == {(1, None), (2, 5)}


def test_both_directions_of_two_and_three(spark):
    got = spark.range(1).select(*[scoring.both_directions(F.array(*map(F.lit, ids))).alias(ids) for ids in ("ab", "abc")]).first()
    assert ["".join(o) for o in got["ab"]] == ["ab", "ba"]
    assert ["".join(o) for o in got["abc"]] == ["abc", "bca", "cab", "cba", "bac", "acb"]


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    from scorelane.streaming import events

    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    half = rows.count() // 2
    (tmp_path / "in").mkdir()
    place = lambda name, part: part.coalesce(1).write.parquet(str(tmp_path / name))
    place("a", rows.limit(half))
    place("b", rows.offset(half))
    once = lambda n, name: next((tmp_path / n).glob("*.parquet")).rename(tmp_path / "in" / name)
    once("a", "events-1.parquet")
    read = lambda: {(r["hour"], r["event_type"]): r["n"] for r in events.hourly(spark, str(tmp_path / "in"), f"file://{tmp_path}/state").collect()}
    plain = lambda part: {(r["h"], r["event_type"]): r["count"] for r in part.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"), "event_type").count().collect()}
    assert read() == plain(rows.limit(half))
    before = len(list((tmp_path / "state" / "offsets" / "offsets").iterdir()))
    once("b", "events-2.parquet")
    assert read() == plain(rows)
    assert len(list((tmp_path / "state" / "offsets" / "offsets").iterdir())) > before


def test_running_sums_of_a_hot_group(spark):
    rows = spark.createDataFrame([("hot", i, i % 7) for i in range(2000)] + [("b", 1, 5), (None, 2, 3), (None, 1, 1)], "g string, o int, x int").repartition(6)
    got = {(r["g"], r["o"]): r["t"] for r in records.running(rows, ["g"], [F.col("o")], {"t": F.col("x")}).collect()}
    total, want = 0, {("b", 1): 5, (None, 1): 1, (None, 2): 4}
    for i in range(2000):
        total += i % 7
        want["hot", i] = total
    assert got == want and records.running(rows.limit(0), [], [F.col("o")], {"t": F.col("x")}).count() == 0


def test_confusion_has_rows_of_zeros(spark):
    rows = spark.createDataFrame([("d", "a", "b"), ("d", "z", "a")], "d string, answer_id string, top_option_id string")
    got = {tuple(r) for r in metrics.confusion(rows, ["d"], ["a", "b", "c"]).collect()}
    assert got == {("d", "a", 0, 1, 0), ("d", "b", 0, 0, 0), ("d", "c", 0, 0, 0), ("d", "z", 1, 0, 0)}


def test_epoch_shuffle_equals_one_generator(spark):
    import random

    rows = spark.createDataFrame([(i, f"r{i}", ["a", "b", "c"], "b") for i in range(30)], "place long, record_id string, option_ids array<string>, answer_id string")
    rng, want = random.Random(5 + 3), []
    order = [f"r{i}" for i in range(30)]
    rng.shuffle(order)
    for name in order:
        ids = ["a", "b", "c"]
        rng.shuffle(ids)
        want.append((name, ids, ids.index("b")))
    assert [tuple(r)[1:] for r in generate.epoch_examples(rows.repartition(4), 5, 3).orderBy("place").collect()] == want
    assert generate.epoch_examples(rows.limit(0), 5, 3).count() == 0


def test_hot_joins_of_components_are_split(spark, tmp_path):
    """With low thresholds Spark splits the partition of a hub in both star joins."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    spark.range(1, 20000).selectExpr("id + 30000 AS a", "id % 3 AS b", "30001 - id % 2 AS hub").repartition(12).write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for stars in (components._large_star(e.select("a", "b")), components._small_star(e.select(F.col("hub").alias("a"), (F.col("a") - 30000).alias("b")).filter("a > b"))):
            stars.collect()
            assert "skew=true" in stars._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
