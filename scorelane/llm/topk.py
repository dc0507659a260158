"""Exact top-k by inner product with a table of pivot distances.

Inner products become distances: with M the largest squared length, a candidate x gains the
component sqrt(M - |x|^2) and a query q gains zero, so |q - x|^2 = |q|^2 + M - 2 q.x. The distances
of every candidate to many pivots are computed once; |d(q,p) - d(x,p)| over all pivots bounds d(q,x)
from below and so the score from above. Groups of candidates keep the range of each pivot's
distances, which bounds a whole group; a query visits only groups that may hold one of its best.
In a group, candidates are evaluated exactly in the order of their bounds until the next bound is
below the k-th best score.

Scores are integers and exact as long as they stay below 2^53; bounds are widened by a relative
1e-9 against rounding. Equal vectors are one candidate with their k + 1 smallest ids, which is all a
query can need, and equal queries are searched once; so copies cost nothing.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, as
query or candidate, nor do rows with a null id; vectors meet only those of the same number of
components; repeated rows (same id and vector) count once; an id with several vectors is several
candidates, and none of them for its own queries; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelane.llm import blocks as B
from scorelane.llm.common import small_batches
from scorelane.operators.workspace import Workspace

PIVOTS, SHELLS = 32, 8
#: Candidates whose scores give every query a first k-th best score, and among which pivots are chosen.
SAMPLE = 2048
SLACK = 1e-9


def _pivots(x: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Numbers of sample rows far from each other, each the farthest from those before."""
    full = np.concatenate([x, extra[:, None]], axis=1)
    chosen = [0]
    far = ((full - full[0]) ** 2).sum(axis=1)
    while len(chosen) < min(PIVOTS, len(x)):
        nxt = int(far.argmax())
        if far[nxt] == 0:
            break
        chosen.append(nxt)
        far = np.minimum(far, ((full - full[nxt]) ** 2).sum(axis=1))
    return np.array(chosen)


def _distances(x: np.ndarray, extra: np.ndarray, p: np.ndarray, p_extra: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2 * x @ p.T + (extra[:, None] - p_extra[None]) ** 2
    return np.sqrt(np.maximum(d, 0))


def _bytes(rows: np.ndarray, kind: str) -> pa.Array:
    return pa.array([r.astype(kind).tobytes() for r in rows], pa.binary())


def top_k(vectors: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row for which ``is_query`` holds.

    Components become floor(scale * x). Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    work = Workspace(spark, "topk")
    whole = F.transform(F.col(vec_col).cast("array<double>"), lambda c: F.floor(c * scale).cast("long"))
    rows = vectors.filter(B.usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.select("id", "v", "asks", *B.vector_key(F.col("v")))
    rows = work.save(rows.dropDuplicates(["id", "x", "y"]), "rows")
    first = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    classes = rows.withColumn("r", first).filter(F.col("r") <= k + 1).groupBy("x", "y").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    classes = work.save(classes, "classes")
    asked = work.save(rows.filter("asks").select("id", "x", "y"), "asked")
    searched = classes.join(asked.select("x", "y").distinct(), ["x", "y"], "left_semi").select("x", "y", "v")
    found = None
    for d in [r[0] for r in classes.select(F.size("v")).distinct().collect()]:
        part = _search(classes.filter(F.size("v") == d), searched.filter(F.size("v") == d), k, work)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("x", "y").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("r", F.row_number().over(best))
    found = found.filter(F.col("r") <= k + 1).drop("r")
    mine = asked.withColumnRenamed("id", "query_id").join(found, ["x", "y"]).filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "x", "y").orderBy(F.desc("score"), "vec_id"))
    return mine.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(classes: DataFrame, searched: DataFrame, k: int, work: Workspace) -> DataFrame:
    """(x, y, vec_id, score): for each searched vector at least the k + 1 best candidate rows."""
    spark = classes.sparkSession
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)
    largest = float(classes.agg(F.max(square)).first()[0])
    shown = B.lists(classes.orderBy("x", "y").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks())
    shown_extra = np.sqrt(np.maximum(largest - (shown * shown).sum(axis=1), 0))
    at = _pivots(shown, shown_extra)
    pivots, pivots_extra = shown[at], shown_extra[at]
    near = _distances(shown, shown_extra, pivots, pivots_extra).min(axis=1)
    edges = np.quantile(near, np.arange(1, SHELLS) / SHELLS)
    sent = spark.sparkContext.broadcast((pivots, pivots_extra, edges, shown, largest))  # SAMPLE rows at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, pe, cut, _, m = sent.value
        for batch in batches:
            x = B.lists(batch.column(0))
            d = _distances(x, np.sqrt(np.maximum(m - (x * x).sum(axis=1), 0)), p, pe)
            group = d.argmin(axis=1) * SHELLS + np.searchsorted(cut, d.min(axis=1))
            yield pa.RecordBatch.from_arrays([_bytes(x, "<i8"), batch.column(1), pa.array(list(d), pa.list_(pa.float64())), pa.array(group.astype(np.int64))], ["v", "ids", "d", "grp"])

    placed = work.save(classes.select("v", "ids").mapInArrow(place, "v binary, ids array<long>, d array<double>, grp long"), "placed")
    n = len(pivots)
    ranges = placed.groupBy("grp").agg(F.ceil(F.count("*") / B.MEMBERS).cast("int").alias("blocks"), *[f(F.get("d", F.lit(i))).alias(f"{name}{i}") for i in range(n) for f, name in ((F.min, "a"), (F.max, "z"))]).toArrow()  # PIVOTS * SHELLS rows at most
    groups = ranges.column("grp").to_numpy()
    low = np.stack([ranges.column(f"a{i}").to_numpy() for i in range(n)], axis=1)
    high = np.stack([ranges.column(f"z{i}").to_numpy() for i in range(n)], axis=1)
    bounds = spark.sparkContext.broadcast((groups, low, high))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, pe, _, known, m = sent.value
        own, a, z = bounds.value
        for batch in batches:
            q = B.lists(batch.column(2))
            d = _distances(q, np.zeros(len(q)), p, pe)
            scores = q @ known.T
            floor = np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)] if len(known) > k else np.full(len(q), -np.inf)
            gap = np.maximum(np.maximum(a[None] - d[:, None], d[:, None] - z[None]).max(axis=2), 0)
            most = _above(q, gap, m)
            visits = [own[row] for row in most >= floor[:, None]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _bytes(q, "<i8"), pa.array(list(d), pa.list_(pa.float64())), pa.array(floor), pa.array(visits, pa.list_(pa.int64()))], ["x", "y", "v", "d", "floor", "visits"])

    sizes = F.broadcast(spark.createDataFrame(list(zip(groups.tolist(), ranges.column("blocks").to_pylist(), strict=True)), "g long, blocks int"))
    none = F.lit(None)
    members = placed.join(sizes, F.col("grp") == F.col("g")).select(
        B.member_block(F.col("g"), F.col("blocks"), F.xxhash64("v")).alias("block"), F.lit(0).alias("role"), none.cast("long").alias("x"), none.cast("long").alias("y"), "v", "d", none.cast("double").alias("floor"), "ids"
    )
    routed = searched.select("x", "y", "v").mapInArrow(route, "x long, y long, v binary, d array<double>, floor double, visits array<long>")
    routed = routed.select("x", "y", "v", "d", "floor", F.explode("visits").alias("g")).join(sizes, "g")
    routed = routed.select(F.explode(B.all_blocks(F.col("g"), F.col("blocks"))).alias("block"), F.lit(1).alias("role"), "x", "y", "v", "d", "floor", none.cast("array<long>").alias("ids"))

    def hold(batch: pa.RecordBatch) -> tuple:
        return B.matrix(batch.column("v"), "<i8"), B.lists(batch.column("d")), batch.column("ids").to_pylist()

    def meet(held: tuple, batch: pa.RecordBatch) -> pa.RecordBatch:
        v, d, ids = held
        m = sent.value[4]
        queries, qd, floors = B.matrix(batch.column("v"), "<i8"), B.lists(batch.column("d")), batch.column("floor").to_numpy()
        out: list[tuple[int, int, int]] = []
        for i, q in enumerate(queries):
            gap = np.abs(d - qd[i]).max(axis=1)
            most = _above(q[None].astype(np.float64), gap[None], m)[0]
            order = np.argsort(-most, kind="stable")
            floor, best = floors[i], []
            for at in range(0, len(order), 256):
                step = order[at : at + 256]
                step = step[most[step] >= floor]
                if not len(step):
                    break
                scores = v[step] @ q
                best += [(-int(s), int(one)) for s, c in zip(scores, step, strict=True) if s >= floor for one in ids[c]]
                best = sorted(best)[: k + 1]
                if len(best) > k:
                    floor = max(floor, -best[-1][0])
            out += [(i, one, -s) for s, one in best]
        i, one, s = (np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([batch.column("x").take(pa.array(i)), batch.column("y").take(pa.array(i)), pa.array(one), pa.array(s)], ["x", "y", "vec_id", "score"])

    return B.compare(members.unionByName(routed), hold, meet, "x long, y long, vec_id long, score long")


def _above(q: np.ndarray, gap: np.ndarray, largest: float) -> np.ndarray:
    """Upper bounds of scores from lower bounds of distances, widened against rounding."""
    square = (q * q).sum(axis=1)[:, None]
    return (square + largest) * (1 + SLACK) / 2 - gap * gap * (1 - SLACK) / 2 + 1
