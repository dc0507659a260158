"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.operators.workspace import Workspace, spread_again


def _mark(df: DataFrame) -> tuple[int, int | None]:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, left: str, right: str, work: Workspace, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge to another node; component is the smallest node.

    Each round is two aggregations and one join per star, so a hub's neighbours are reduced to
    their minimum before the shuffle; the minima are shuffled anew for the join, so that Spark may
    split the partition that holds a hub's edges. The edges of a round are written to the shared folder. Null ends and loops are ignored; an empty
    frame gives an empty frame. Raises RuntimeError if ``rounds`` do not suffice (they grow with
    the logarithm of the diameter).
    """
    e = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
    e = work.save(e.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("a") > F.col("b"))).distinct(), "edges")
    seen = _mark(e)
    for _ in range(rounds if seen[0] else 0):
        e = work.save(_small_star(_large_star(e)), "stars")
        now = _mark(e)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())


def _nearest(e: DataFrame, key: str, other: str) -> DataFrame:
    least: Column = F.min(other)
    return spread_again(e.groupBy(F.col(key).alias("k")).agg(F.least(least, F.first(key)).alias("m")), ["k"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a"))
    m = _nearest(both, "a", "b")
    out = both.filter(F.col("b") > F.col("a")).join(m, F.col("a") == F.col("k"))
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    m = _nearest(e, "a", "b")
    out = e.join(m, F.col("a") == F.col("k")).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") > F.col("b")).distinct()
