"""Scenarios, prompts, evidence and exact numbers against plain Python and hand-worked cases."""

from __future__ import annotations

import hashlib
import json
from fractions import Fraction
from itertools import permutations, product

import duckdb
import pytest
from pyspark.sql import functions as F

from scorelane import evidence_queries, registry  # noqa: F401
from scorelane.functions.text import split_slot
from scorelane.operators import evidence, exact, generate, prompts, scenarios, scoring
from scorelane.operators.workspace import Workspace
from scorelane.plans import derive

SF = "/root/testdata/sf0.001"


def digest(value):
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def plain_routing(s):
    table = {tuple(r["values"]): r["destination_id"] for r in s["rules"]}
    domains = [f["values"] if q is None else [q] for f, q in zip(s["features"], s["query"], strict=True)]
    return sorted({table.get(c, "no_route") for c in product(*domains)})


def plain_structure(s):
    table = {tuple(r["values"]): r["destination_id"] for r in s["rules"]}
    n, found = len(s["features"]), []
    for order in permutations(range(n)):
        for flips in product((0, 1), repeat=n):
            seen, codes = {}, []
            for cell in product((0, 1), repeat=n):
                at = {f: s["features"][f]["values"][cell[i] ^ flips[i]] for i, f in enumerate(order)}
                to = table.get(tuple(at[f] for f in range(n)))
                codes.append(0 if to is None else seen.setdefault(to, len(seen) + 1))
            found.append(codes)
    return digest({"feature_count": n, "destination_count": len(s["destination_ids"]), "table": min(found)})


def test_routing_scenarios_equal_plain_python(spark):
    s = F.col("scenario")
    rows = derive.routing_scenarios(spark, SF).select("scenario", scenarios.routing_outcomes(s).alias("outcomes"), scenarios.routing_structure(s).alias("structure"), scenarios.routing_identity(s, True).alias("identity")).collect()
    assert len(rows) > 100
    for r in rows:
        v = r["scenario"].asDict(recursive=True)
        assert r["outcomes"] == plain_routing(v) and r["structure"] == plain_structure(v)
        names = [f["name"] for f in v["features"]]
        pairs = lambda values, names=names: sorted(map(list, zip(names, values, strict=True)), key=lambda p: p[0])
        rules = sorted(({"when": pairs(x["values"]), "destination": x["destination_id"]} for x in v["rules"]), key=lambda x: json.dumps(x, sort_keys=True, separators=(",", ":")))
        assert r["identity"] == digest({"features": [{"name": f["name"], "values": sorted(f["values"])} for f in v["features"]], "destinations": sorted(v["destination_ids"]), "rules": rules, "query": pairs(v["query"])})


def test_structures_ignore_names_and_order(spark):
    def routing(values, order, names):
        cells = {("x", "u"): names[0], ("x", "v"): names[1], ("y", "u"): names[0]}
        feats = [("f", ["x", "y"]), ("g", ["u", "v"])]
        feats = [(n, list(reversed(v)) if values else v) for n, v in feats]
        rules = [([k[i] for i in order], d) for k, d in cells.items()]
        return ([feats[i] for i in order], names, rules, [None] * 2)

    rows = [(i, routing(v, o, n)) for i, (v, o, n) in enumerate(product((0, 1), ((0, 1), (1, 0)), (["p", "q"], ["q", "p"])))]
    frame = spark.createDataFrame(rows, f"k int, s {scenarios.ROUTING}")
    assert frame.select(scenarios.routing_structure(F.col("s"))).distinct().count() == 1
    tool = lambda i, caps, cost: (i, caps, ["t"], [], cost)
    base = (["a", "b"], ["t"], [], [tool("x", ["a"], 1), tool("y", ["a", "b"], 5)], ["a"], "t", [])
    same = (["b", "a"], ["t"], [], [tool("n", ["a", "b"], 90), tool("m", ["b"], 7)], ["a"], "t", [])
    other = (["a", "b"], ["t"], [], [tool("x", ["a"], 5), tool("y", ["a", "b"], 1)], ["a"], "t", [])
    frame = spark.createDataFrame([(0, base), (1, same), (2, other)], f"k int, s {scenarios.TOOLS}")
    got = [r[0] for r in frame.orderBy("k").select(scenarios.tool_structure(F.col("s"))).collect()]
    assert got[0] == got[1] != got[2]


def test_tool_cases_and_ties(spark):
    tool = lambda i, cost, needs=(): (i, ["c"], ["t"], list(needs), cost)
    make = lambda tools, granted: (["c"], ["t"], ["p", "q"][: len(granted)], tools, ["c"], "t", granted)
    rows = [
        make([tool("x", 1), tool("y", 2)], []), make([tool("x", 1, ["p"]), tool("y", 2, ["p"])], [False]), make([tool("x", 1, ["p"]), tool("y", 2)], [None]), make([tool("x", 1, ["p"]), tool("y", 2, ["p"])], [None]),
        make([tool("x", 2, ["p"]), tool("y", 1)], [None]), make([tool("x", 1, ["p"]), tool("y", 1)], [None]), make([tool("x", 1, ["p"]), tool("y", 2, ["q"])], [None, None]),
    ]
    frame = spark.createDataFrame(list(enumerate(rows)), f"k int, s {scenarios.TOOLS}").orderBy("k")
    got = frame.select(scenarios.tool_case(F.col("s")), scenarios.settled(scenarios.tool_outcomes(F.col("s")))).collect()
    assert [tuple(r) for r in got] == [
        ("complete_tool", "x"), ("complete_no_eligible", "no_eligible_tool"), ("missing_tool_conflict", "insufficient_information"), ("missing_tool_vs_none", "insufficient_information"),
        ("missing_tool_agree", "y"), (None, "tie"), ("multiple_missing", "insufficient_information"),
    ]


def test_prompts_are_read_only_as_written(spark):
    template = [("one", "Rules:\n", "Where?"), ("two", "Other rules:\n", "Which?")]
    rows = derive.routing_scenarios(spark, SF).limit(20)
    order = scenarios.routing_answers(F.col("scenario"))
    rows = rows.withColumn("t", prompts.prompt(prompts.routing_request(F.col("scenario"), order, template, F.lit("one"))))
    changes = ['"context"', "Where?", "No route applies", "Answer:", '\\"query\\"', '"symbol":"A"']
    variants = rows.select("scenario", F.explode(F.array(F.struct(F.lit("").alias("c"), F.col("t").alias("t")), *[F.struct(F.lit(c).alias("c"), F.replace("t", F.lit(c), F.lit(c[:-1] + "!" + c[-1:])).alias("t")) for c in changes], F.struct(F.lit("two").alias("c"), F.replace("t", F.lit("Rules:"), F.lit("Other rules:")).alias("t")))).alias("v")).select("scenario", "v.*")
    got = variants.select("c", prompts.read_routing(F.col("t"), template).alias("p"), "scenario").collect()
    assert all((r["p"] is not None and r["p"]["scenario"] == r["scenario"]) == (r["c"] == "") for r in got)
    assert spark.createDataFrame([(None,), ("",), ("x\nAnswer:\n",)], "t string").filter(prompts.read_routing(F.col("t"), template).isNotNull()).count() == 0


def test_join_faults_name_each_difference(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None), (4, "d"), (None, "n")], "k int, v string")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (5, "e")], "k int, v string")
    got = {tuple(r) for r in evidence.join_faults(left, right, ["k"], ["v"]).collect()}
    assert got == {(2, "repeated_left"), (3, "differs: v"), (4, "missing"), (5, "unexpected"), (None, "missing")}
    assert evidence.join_faults(left.limit(0), right.limit(0), ["k"], ["v"]).count() == 0
    with pytest.raises(ValueError, match="join: k="):
        evidence.demand(evidence.join_faults(left, right, ["k"]), "join")


def test_exact_means_and_gates_at_equality(spark):
    rows = spark.createDataFrame([("g1", "r1", 1), ("g1", "r1", 0), ("g1", "r1", 0), ("g1", "r2", 1), ("g2", "r3", 0), ("g2", "r3", 1)], "source_group_id string, record_id string, correct int")
    mean = exact.mean_of_groups(exact.group_fractions(rows, []), []).first()
    assert Fraction(int(mean["num"]), int(mean["den"])) == (Fraction(1, 2) * (Fraction(1, 3) + 1) + Fraction(1, 2)) / 2
    values = spark.createDataFrame([("t", "new", 7, 10), ("t", "old", 13, 20)], "task string, state string, num long, den long")
    specs = spark.createDataFrame([("even", "t", "new", "old", 1, 20, False), ("above", "t", "new", "old", 51, 1000, False), ("strict", "t", "new", "old", 1, 20, True), ("none", "u", "new", "old", 0, 1, False)], "gate string, task string, final string, base string, min_num int, min_den int, strict boolean")
    lows = spark.createDataFrame([("strict", 0.0)], "gate string, low double")
    assert {r["gate"]: r["passes"] for r in exact.gates(values, specs, lows).collect()} == {"even": True, "above": False, "strict": False, "none": False}


def test_exact_means_of_groups_of_many_sizes(spark):
    sizes = [*range(1, 60), 4099, 4111, 4127]  # least common multiple: 36 digits
    right = {n: n * (3 * n) // 7 % (n + 1) for n in sizes}
    rows = spark.createDataFrame([(f"g{n}", f"r{n}-{i}", int(i < right[n])) for n in sizes for i in range(n)], "source_group_id string, record_id string, correct int")
    mean = exact.mean_of_groups(exact.group_fractions(rows, []), []).select("num", "den", "n", exact.ratio("num", "den").alias("x")).first()
    want = sum((Fraction(c, n) for n, c in right.items()), Fraction()) / len(sizes)
    assert (Fraction(int(mean["num"]), int(mean["den"])), mean["n"], mean["x"]) == (want, len(sizes), float(want))
    assert len(mean["den"]) > 19


def test_exact_means_of_long_fractions(spark):
    long = [(None, 10**400 + 7, 3**900), ("a", -(7**30), 2**5), ("a", 10**18, 10**18 + 1), ("a", 10**36 - 1, 10**18 + 1), ("a", 5, 2**5), ("b", 0, 9), ("c", None, None)]
    groups = spark.createDataFrame([(t, None if a is None else str(a), None if b is None else str(b)) for t, a, b in long], "task string, num string, den string")
    got = {r["task"]: r for r in exact.mean_of_groups(groups, ["task"]).withColumn("x", exact.ratio("num", "den")).collect()}
    for t in (None, "a", "b"):
        each = [Fraction(a, b) for u, a, b in long if u == t]
        want = sum(each, Fraction()) / len(each)
        assert (got[t]["num"], got[t]["den"], got[t]["n"], got[t]["x"]) == (str(want.numerator), str(want.denominator), len(each), want.numerator / want.denominator)
    assert tuple(got["c"]) == ("c", None, None, 1, None)
    assert exact.mean_of_groups(groups.limit(0), ["task"]).count() == 0


def test_gates_on_long_fractions(spark):
    new, old = Fraction(10**60 + 1, 3**140), Fraction(7, 10**400 + 9)
    values = spark.createDataFrame([("t", s, str(v.numerator), str(v.denominator)) for s, v in (("new", new), ("old", old))], "task string, state string, num string, den string")
    least = {"even": new - old, "above": new - old + Fraction(1, 10**900), "below": new - old - Fraction(1, 10**900)}
    specs = spark.createDataFrame([(g, "t", "new", "old", str(v.numerator), str(v.denominator), False) for g, v in least.items()], "gate string, task string, final string, base string, min_num string, min_den string, strict boolean")
    delta = (new - old).numerator / (new - old).denominator
    assert {tuple(r) for r in exact.gates(values, specs).collect()} == {("even", delta, None, True), ("above", delta, None, False), ("below", delta, None, True)}


def test_anchors_on_long_fractions(spark):
    value, at = Fraction(10**60 + 1, 3**140), Fraction(7, 10**400 + 9)
    values = spark.createDataFrame([(None, "new", str(value.numerator), str(value.denominator))], "task string, state string, num string, den string")
    least = {"even": value - at, "above": value - at + Fraction(1, 10**900), "below": value - at - Fraction(1, 10**900)}
    rows = [(g, None, "new", str(at.numerator), str(at.denominator), str(v.numerator), str(v.denominator)) for g, v in least.items()] + [("none", "t", "new", "1", "3", "0", "1")]
    anchors = spark.createDataFrame(rows, "gate string, task string, state string, at_num string, at_den string, min_num string, min_den string")
    delta = (value - at).numerator / (value - at).denominator
    assert {tuple(r) for r in exact.anchor_gates(values, anchors).collect()} == {("even", delta, True), ("above", delta, False), ("below", delta, True), ("none", None, False)}


@pytest.fixture(scope="module")
def many_sizes(spark, tmp_path_factory):
    """Tables whose groups have 61 sizes, with null languages and sources, and a check against SQL over them."""
    path = tmp_path_factory.mktemp("sizes")
    docs = [(n * 100 + i, ("de", "en", None)[n % 3], f"s{n}" if n else None) for n in [0, *range(1, 60), 61] for i in range(n or 7)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, d * d % 7 % 2) for d, _, _ in docs], "doc_id long, quality long").write.parquet(f"{path}/labels.parquet")

    def check(name):
        with duckdb.connect() as duck:
            for table in ("documents", "labels"):
                duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
            want = duck.sql(registry.SQL[name])
            got = registry.QUERIES[name](spark, str(path)).select(*want.columns).collect()
            assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))

    return check


@pytest.mark.parametrize("name", ["a11_exact_accuracy", "t10_gate_set", "t11_anchors"])
def test_exact_queries_on_groups_of_many_sizes(many_sizes, name):
    many_sizes(name)


def test_gcd_and_lcm(spark):
    rows = spark.createDataFrame([(12, 18, [4, 6, 10]), (17, 5, [1]), (1, 1, [])], "a long, b long, c array<long>")
    assert [tuple(r) for r in rows.select(exact.gcd(F.col("a"), F.col("b")), exact.lcm_all(F.col("c"))).collect()] == [(6, 60), (1, 1), (1, 1)]


def test_bank_and_its_digest():
    import random

    rng = random.Random(9)
    want = {"a": [[rng.randrange(3) for _ in range(3)] for _ in range(4)], "é": [[rng.randrange(2) for _ in range(2)] for _ in range(4)]}
    bank = exact.drawn_bank(9, [("a", 3), ("é", 2)], 4)
    assert bank == want and exact.bank_digest(bank) == hashlib.sha256(json.dumps(want, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def test_orders_and_masks(spark):
    options = lambda n: F.array(*[F.lit(f"o{i}") for i in range(n)])
    got = spark.range(1).select(*[F.size(scoring.orders(options(n))).alias(str(n)) for n in (2, 3, 4, 8, 16)]).first()
    assert list(got) == [2, 6, 4, 8, 16]
    with pytest.raises(Exception, match="no orders for 5 options"):
        spark.range(1).select(scoring.orders(options(5))).collect()
    one = spark.range(1).select(scenarios.mask(F.array(F.lit("c"), F.lit("a")), F.array(*map(F.lit, "abc"))).alias("m")).select("m", scenarios.turned_mask(F.col("m"), F.array(*map(F.lit, (1, 2, 0))))).first()
    assert tuple(one) == (5, 3)


def test_distinct_choice_equals_the_walk(spark):
    import random

    r = random.Random(4)
    rows = [(i, a, f"k{r.randint(0, 40)}") for i in range(30) for a in range(12)] + [(99, 0, "k0"), (98, 0, "k0")]
    taken, want = set(), {}
    for i in sorted({x[0] for x in rows}):
        for a, k in sorted((a, k) for j, a, k in rows if j == i):
            if k not in taken:
                taken.add(k)
                want[i] = (a, k)
                break
    frame = spark.createDataFrame(rows, "item long, attempt int, key string")
    assert {x["item"]: (x["attempt"], x["key"]) for x in generate.distinct_choice(frame, Workspace(spark, "t")).collect()} == want


@pytest.mark.parametrize("kind", ["routing", "tools"])
def test_generated_scenarios(spark, kind):
    counts = {"train": 9, "test": 8}
    make, case, structure = {"routing": (generate.distinct_routing, scenarios.routing_case, scenarios.routing_structure), "tools": (generate.distinct_tools, scenarios.tool_case, scenarios.tool_structure)}[kind]
    s = F.col("scenario")
    rows = make(spark, 3, counts).select("*", case(s).alias("own"), structure(s).alias("again"), split_slot(F.col("structure")).alias("slot")).collect()
    assert len(rows) == 17 and len({r["structure"] for r in rows}) == 17 and sorted(r["item"] for r in rows) == list(range(17))
    kinds = {"routing": generate.ROUTING_KINDS, "tools": generate.TOOL_KINDS}[kind]
    for r in rows:
        at = r["item"] if r["item"] < 9 else r["item"] - 9
        assert r["own"] == r["case_kind"] == kinds[at % 7] and r["again"] == r["structure"] and r["slot"] == r["split"] == ("train" if r["item"] < 9 else "test")
