"""Near-duplicate vectors by product quantisation with inverted lists and an exact rerank.

Unit vectors are assigned to the nearest of the coarse centroids; the residual is coded by one
centroid in each subspace. A vector may link only into lists that it can reach: those whose
centroid isn't farther than the list's radius and the reach of the threshold together, and whose
cell begins within that reach. Both bounds are exact, so a list left out holds no link. Lists are
packed into groups of neighbouring lists; a vector is compared with every group that holds a list
in reach, of two groups only one asks the other. Asymmetric distances to the decoded members, less
the stored length of the coding error, are lower bounds of true distances; what passes is reranked
by the exact cosine in double precision. No link is lost: recall is 1 by construction.

Centroids are fitted to a bounded sample (``sample`` distinct vectors, those of the smallest
hashes); every vector is indexed and searched. Hot lists are split into blocks of members, past
which the asking vectors stream; links are counted and returned as a star per class, never as
pairs. Vectors without structure reach nearly all lists; then all groups are compared.

Vectors link only with vectors of as many components. Each number of components that more than
SMALL vectors have gets an index of its own; the vectors of all rarer ones are compared directly.

Defined cases: vectors that are null, of length zero, or hold null or non-finite components link
with nothing, and so do rows with a null id (component null); equal vectors are one entry with a
count, so copies link with each other at no cost; repeated rows each give a row and count as
copies; an empty table gives an empty table. Columns pass through whatever their names, and added
columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.llm import blocks as B
from scorelane.llm.common import small_batches
from scorelane.llm.simhash import _roots
from scorelane.operators.components import connected_components
from scorelane.operators.workspace import Workspace

SAMPLE, LISTS, PER_LIST = 16384, 1024, 48
SUBSPACE, CODES = 4, 64
#: Groups that a table is packed into about, and the members that one may hold at least and at most.
GROUPS, SMALL, LARGE = 32, 512, 65536
#: Products of asking vectors and members that are in memory at once.
PRODUCTS = 1 << 20
#: Granted to products in single precision.
SLACK = 1e-5


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(5)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, c, 1)[:, 0]
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest centroids of each row, the nearest first."""
    out = np.zeros((len(x), min(k, len(c))), np.int32)
    half = (c * c).sum(axis=1) / 2
    for at in range(0, len(x), 2048):
        d = half - x[at : at + 2048] @ c.T
        part = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        out[at : at + 2048] = np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(axis=1, kind="stable"), 1)
    return out


@dataclass
class Index:
    coarse: np.ndarray
    books: list[np.ndarray]
    spans: list[tuple[int, int]]

    @staticmethod
    def fit(x: np.ndarray, n: int) -> Index:
        """Centroids of unit vectors x for a table of n."""
        coarse = _kmeans(x, max(1, min(LISTS, n // PER_LIST, len(x) // 8)))
        rest = x - coarse[_nearest(x, coarse, 1)[:, 0]]
        spans = [(a, min(a + SUBSPACE, x.shape[1])) for a in range(0, x.shape[1], SUBSPACE)]
        books = [_kmeans(rest[:, a:b], min(CODES, len(rest))) for a, b in spans]
        return Index(coarse, books, spans)

    def code(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the lengths of what they miss."""
        rest = x - self.coarse[home]
        codes = np.stack([_nearest(rest[:, a:b], book, 1)[:, 0] for (a, b), book in zip(self.spans, self.books, strict=True)], axis=1).astype(np.uint8)
        back = np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((rest - back) ** 2).sum(axis=1))

    def decoded(self, codes: np.ndarray, home: np.ndarray) -> np.ndarray:
        """The vectors that codes and lists stand for."""
        return self.coarse[home] + np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)


@dataclass
class Packing:
    """Lists in groups of about ``size`` members; a list of more is a group of several blocks."""

    group: np.ndarray
    blocks: np.ndarray
    radius: np.ndarray
    coarse: np.ndarray
    apart: np.ndarray

    @staticmethod
    def of(coarse: np.ndarray, count: np.ndarray, radius: np.ndarray, size: int) -> Packing:
        """Lists that follow one another near the same of a few pivots are packed until a group is full."""
        pivots = _kmeans(coarse, max(1, min(GROUPS, len(coarse) // 4)))
        group, members, g = np.zeros(len(coarse), np.int64), [0], 0
        for at in np.argsort(_nearest(coarse, pivots, 1)[:, 0], kind="stable").tolist():
            if members[g] and members[g] + count[at] > size:
                members.append(0)
                g += 1
            group[at] = g
            members[g] += int(count[at])
        apart = np.sqrt(np.maximum(((coarse**2).sum(axis=1)[:, None] + (coarse**2).sum(axis=1)) - 2 * coarse @ coarse.T, 0))
        return Packing(group, np.maximum(1, -(-np.array(members) // size)), radius, coarse, apart)

    def reached(self, x: np.ndarray, home: np.ndarray, reach: float) -> np.ndarray:
        """For each row and group, whether the row asks it: some list may hold a link and it is this side's turn.

        A member y of list c within reach of x has |x - c| <= reach + radius, and lies on c's side of
        the plane between c and x's own centroid, so x is at most reach away from that plane.
        """
        square = np.maximum((x * x).sum(axis=1)[:, None] + (self.coarse**2).sum(axis=1) - 2 * x @ self.coarse.T, 0)
        near = np.sqrt(square) <= reach + self.radius + 1e-6
        near &= square - square[np.arange(len(x)), home][:, None] <= 2 * reach * self.apart[home] + 1e-6
        n, own = len(self.blocks), self.group[home]
        asked = np.zeros((len(x), n), bool)
        row, at = np.nonzero(near)
        asked[row, self.group[at]] = True
        ahead = (np.arange(n) - own[:, None]) % n
        asked &= (2 * ahead < n) | ((2 * ahead == n) & (np.arange(n) > own[:, None]))
        asked[np.arange(len(x)), own] = True
        return asked


def _unit(x: np.ndarray) -> np.ndarray:
    big = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return big / np.sqrt((big * big).sum(axis=1, keepdims=True))


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def links(entries: DataFrame, threshold: float, work: Workspace, sample: int = SAMPLE) -> DataFrame:
    """(node, links, root) rows of distinct vectors (node, n, v): counts of linked rows, and star links."""
    spark = entries.sparkSession
    n = entries.count()
    if n < 2:
        return spark.createDataFrame([], "node long, links long, root long")
    shown = B.lists(entries.orderBy(F.xxhash64("v"), "node").limit(sample).select("v").toArrow().column(0).combine_chunks())
    index = Index.fit(_unit(shown), n)
    sent = spark.sparkContext.broadcast(index)  # at most LISTS centroids, and CODES a subspace
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        for batch in batches:
            x = _unit(B.lists(batch.column(2)))
            home = _nearest(x, ix.coarse, 1)[:, 0]
            codes, miss = ix.code(x, home)
            away = np.sqrt(((x - ix.coarse[home]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _bytes(x), pa.array(home.astype(np.int64)), _bytes(codes), pa.array(miss), pa.array(away)], ["node", "n", "v", "home", "code", "miss", "away"])

    placed = work.save(entries.select("node", "n", "v").mapInArrow(place, "node long, n long, v binary, home long, code binary, miss double, away double"), "placed")
    count, radius = np.zeros(len(index.coarse), np.int64), np.full(len(index.coarse), -np.inf)
    for row in placed.groupBy("home").agg(F.count("*").alias("count"), F.max("away").alias("away")).collect():  # one row a list
        count[row["home"]], radius[row["home"]] = row["count"], row["away"]
    packing = spark.sparkContext.broadcast(Packing.of(index.coarse, count, radius, max(SMALL, min(LARGE, n // GROUPS))))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = packing.value
        for batch in batches:
            home = batch.column(3).to_numpy()
            row, group = np.nonzero(p.reached(B.matrix(batch.column(2), "<f8"), home, reach))
            for b in range(int(p.blocks[group].max(initial=0))):
                more = p.blocks[group] > b
                for at in range(0, int(more.sum()), 4096):
                    r, g = row[more][at : at + 4096], group[more][at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(g * B.SPLIT + b), *[c.take(pa.array(r)) for c in batch.columns]], ["block", "node", "n", "v", "home"])

    spread = F.array(*[F.lit(int(b)) for b in packing.value.blocks[packing.value.group]])
    groups = F.array(*[F.lit(int(g)) for g in packing.value.group])
    at = (F.col("home") + 1).cast("int")
    members = placed.select(B.member_block(F.element_at(groups, at).cast("long"), F.element_at(spread, at), F.xxhash64("node")).alias("block"), F.lit(0).alias("role"), "node", "n", "v", "home", "code", "miss")
    none = [F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("miss")]
    asking = placed.select("node", "n", "v", "home").mapInArrow(ask, "block long, node long, n long, v binary, home long")
    asking = asking.select("block", F.lit(1).alias("role"), "node", "n", "v", "home", *none)

    def hold(batch: pa.RecordBatch) -> dict:
        home, miss = batch.column("home").to_numpy(), batch.column("miss").to_numpy()
        decoded = sent.value.decoded(B.matrix(batch.column("code"), np.uint8), home)
        # |q - d| <= reach + miss, of a unit vector q, is a bound of the product q d
        least = (1 + (decoded * decoded).sum(axis=1) - (reach + miss) ** 2) / 2 - SLACK
        return {
            "node": batch.column("node").to_numpy(), "n": batch.column("n").to_numpy(), "v": B.matrix(batch.column("v"), "<f8"),
            "group": int(packing.value.group[home[0]]), "decoded": decoded.T.astype(np.float32), "least": least.astype(np.float32),
        }

    def meet(m: dict, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        node, count, q = batch.column("node").to_numpy(), batch.column("n").to_numpy(), B.matrix(batch.column("v"), "<f8")
        other = packing.value.group[batch.column("home").to_numpy()] != m["group"]  # its members don't ask back
        ids, label = np.unique(np.concatenate([m["node"], node]), return_inverse=True)
        own_m, own_q = label[: len(m["node"])], label[len(m["node"]) :]
        found = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        step = max(1, PRODUCTS // len(m["node"]))
        for at in range(0, len(q), step):
            part = slice(at, at + step)
            i, j = np.nonzero(q[part].astype(np.float32) @ m["decoded"] >= m["least"])
            keep = node[part][i] != m["node"][j]
            i, j = i[keep], j[keep]
            near = np.concatenate([np.zeros(0, bool), *[np.einsum("ij,ij->i", q[part][i[k : k + 65536]], m["v"][j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)]])
            i, j = i[near], j[near]
            if not len(i):
                continue
            a, b = own_q[part][i], own_m[j]
            found += np.bincount(a, weights=m["n"][j], minlength=len(ids)).astype(np.int64)
            alone = other[part][i]
            found += np.bincount(b[alone], weights=count[part][i][alone], minlength=len(ids)).astype(np.int64)
            apart = root[a] != root[b]
            if apart.any():
                root = _roots(len(ids), root[a[apart]], root[b[apart]])[root]
        hit = np.flatnonzero(found > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(found[hit]), pa.array(ids[root[hit]])], ["node", "links", "root"])

    return B.compare(members.unionByName(asking), hold, meet, "node long, links long, root long")


def direct_links(entries: DataFrame, threshold: float) -> DataFrame:
    """As ``links`` for vectors of numbers of components that at most SMALL entries have each: all of a number meet in one block."""
    rows = entries.select(F.size("v").cast("long").alias("block"), "node", "n", "v")

    def hold(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return batch.column("node").to_numpy(), batch.column("n").to_numpy(), _unit(B.lists(batch.column("v")))

    def meet(held: tuple[np.ndarray, np.ndarray, np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch | None:
        node, n, x = held
        own, q = batch.column("node").to_numpy(), _unit(B.lists(batch.column("v")))
        near = (q @ x.T >= threshold) & (own[:, None] != node)
        order = np.argsort(node)
        place = order[np.searchsorted(node[order], own)]
        i, j = np.nonzero(near)
        label = _roots(len(node), place[i], j)
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, label, node)
        hit = near.any(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(own[hit]), pa.array((near[hit] @ n).astype(np.int64)), pa.array(least[label][place[hit]])], ["node", "links", "root"])

    both = rows.withColumn("role", F.explode(F.array(F.lit(0), F.lit(1)))).select("block", "role", "node", "n", "v")
    return B.compare(both, hold, meet, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, sample: int = SAMPLE) -> DataFrame:
    """``vectors`` without the vector, with n_links, component_id and kept added.

    n_links counts the other rows linked directly, component_id is the smallest id reachable (the
    own one included), kept marks its row. Entries join rows by vector key, one row an entry.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    work = Workspace(spark, "pq")
    vec = F.col(vec_col).cast("array<double>")
    length = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, v: a + v * v))
    takes_part = F.coalesce(B.usable(F.col(vec_col)) & (length > 0) & F.col(id_col).isNotNull(), F.lit(False))
    x, y = B.vector_key(vec)
    rows = vectors.filter(takes_part).select(F.col(id_col).cast("long").alias("node"), vec.alias("v"), x, y)
    entries = rows.groupBy("x", "y").agg(F.min("node").alias("node"), F.count("*").alias("n"), F.first("v").alias("v"))
    entries = work.save(entries, "entries")
    sizes = {r["d"]: r["n"] for r in entries.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # one row a number of components
    common = [d for d, n in sizes.items() if n > SMALL]
    found = [links(entries.filter(F.size("v") == d), threshold, work, sample) for d in common]
    if len(common) < len(sizes) or not sizes:
        found.append(direct_links(entries.filter(~F.size("v").isin(common)) if common else entries, threshold))
    found = work.save(reduce(DataFrame.unionByName, found), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found, "node", "root", work)
    named = entries.select("x", "y", "n", F.col("node").alias("e")).join(counts, F.col("e") == F.col("node"), "left").drop("node")
    named = named.join(parts, F.col("e") == F.col("node"), "left").drop("node")
    named = named.select("x", "y", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "e").alias("component"))

    names = [c for c in vectors.columns if c not in (vec_col, "n_links", "component_id", "kept")]
    key = F.when(takes_part, F.struct(x, y))
    whole = vectors.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(id_col).alias("own"), key.alias("key"))
    out = whole.join(named, (F.col("key.x") == F.col("x")) & (F.col("key.y") == F.col("y")), "left")
    component = F.coalesce("component", "own")
    added = [F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("own") == component, F.lit(False)).alias("kept")]
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *added)
