"""SimHash fingerprints and near-duplicate classes by anchors of a covering code.

Anchors are the words of a covering code of the 64 bit positions: two blocks of 23 bits use the
perfect binary Golay code (every block is within 3 bits of exactly one code word), the last 18
bits are covered by the single word zero. A fingerprint goes to every anchor whose distance
exceeds the covering radius by at most the threshold, the excess counted block by block: if x and
y differ in at most t bits, the anchor nearest to x is within radius plus t of y, so the pair meets
there and no link is lost. Fingerprints of one anchor are compared among themselves; an anchor
returns a star per class, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.llm import blocks as B
from scorelane.llm.common import small_batches, text_key
from scorelane.operators.components import connected_components
from scorelane.operators.workspace import Workspace

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Shingles whose bits are counted at once; bounds memory on very long texts.
SLICE = 1 << 15
#: Generator polynomial of the binary Golay code, block length, radius.
GOLAY, BLOCK, RADIUS = 0b101011100011, 23, 3
#: Up to this many fingerprints an anchor compares neighbours directly, above it by shared one-bit flips.
DIRECT = 48
#: Rows that the flips of a large anchor may take in memory at once.
FLIP_ROWS = 1 << 22


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits; bit i is set if it is set in over half of the hashes of the word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(words, len(tokens))
    start, end = start[: len(tokens) - k + 1], end[k - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(start), SLICE):
        spans = zip(start[at : at + SLICE].tolist(), end[at : at + SLICE].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, words: int = 3) -> Column:
    """The fingerprint as a signed long; null and blank texts give zero."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return fp(text)


@lru_cache
def _errors(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns that lead from a block to the anchors near it, sorted by syndrome and excess.

    Returns patterns, and for each syndrome and budget b the start of its patterns and the number
    of those with an excess of at most b.
    """
    patterns = np.array([sum(1 << i for i in c) for w in range(RADIUS + threshold + 1) for c in combinations(range(BLOCK), w)], dtype=np.int64)
    excess = np.maximum(np.bitwise_count(patterns.astype(np.uint64)).astype(np.int64) - RADIUS, 0)
    s = _syndrome(patterns)
    order = np.lexsort((excess, s))
    counts = np.zeros((1 << 11, threshold + 1), np.int64)
    for b in range(threshold + 1):
        counts[:, b] = np.bincount(s[excess <= b], minlength=1 << 11)
    starts = np.concatenate([[0], np.cumsum(counts[:, -1])[:-1]])
    return patterns[order], starts, counts


def _syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of each block by the generator polynomial."""
    v = v.copy()
    for i in range(BLOCK - 1, 10, -1):
        v ^= np.where(v >> i & 1, GOLAY << (i - 11), 0)
    return v


def _expand(block: np.ndarray, budget: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block, the anchors within radius plus budget: row number, anchor, budget left."""
    patterns, starts, counts = _errors(threshold)
    s = _syndrome(block)
    n = counts[s, budget]
    row = np.repeat(np.arange(len(block)), n)
    e = patterns[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[s], n)]
    excess = np.maximum(np.bitwise_count(e.astype(np.uint64)).astype(np.int64) - RADIUS, 0)
    return row, (block[row] ^ e) >> 11, budget[row] - excess


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor number) of every anchor within covering radius plus threshold."""
    u = fps.astype(np.int64).view(np.uint64)
    mask = np.uint64((1 << BLOCK) - 1)
    low = (u & mask).astype(np.int64)
    high = (u >> np.uint64(BLOCK) & mask).astype(np.int64)
    r1, a1, left = _expand(low, np.full(len(u), threshold), threshold)
    r2, a2, _ = _expand(high[r1], left, threshold)
    return r1[r2], a1[r2] << 12 | a2


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each of n nodes."""
    label = np.arange(n)
    while len(a):
        m = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], m)
        np.minimum.at(label, label[b], m)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    return label


def _near(group: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the threshold, by shifting sorted rows against each other."""
    left, right, k = [], [], 1
    while k < len(fp):
        same = group[k:] == group[:-k]
        if not same.any():
            break
        hit = np.flatnonzero(same)
        hit = hit[np.bitwise_count(fp[hit] ^ fp[hit + k]) <= threshold]
        left.append(hit)
        right.append(hit + k)
        k += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _large(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large anchor. Within two bits two values share a value one flip away from both;

    sorting these flips finds every link without comparing all pairs. A star per shared value is
    returned. Larger thresholds compare in blocks and keep, per block, a star as well.
    """
    n = len(fp)
    if threshold != 2:
        left, right = [], []
        for i in range(0, n, 1024):
            for j in range(i, n, 1024):
                near = np.bitwise_count(fp[i : i + 1024, None] ^ fp[None, j : j + 1024]) <= threshold
                a, b = np.nonzero(near)
                label = _roots(2048, a, b + 1024)
                at = np.flatnonzero(label != np.arange(2048))
                name = lambda x, i=i, j=j: np.where(x < 1024, i + x, j + x - 1024)
                left.append(name(label[at]))
                right.append(name(at))
        return np.concatenate(left), np.concatenate(right)
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    slices = max(1, -(-n * 65 // FLIP_ROWS))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in range(slices):
        value, own = [], []
        for f in flips:
            v = fp ^ f
            at = np.flatnonzero((v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(slices) == part)
            value.append(v[at])
            own.append(at)
        v, o = np.concatenate(value), np.concatenate(own)
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
        first = np.maximum.accumulate(np.where(np.concatenate([[True], v[1:] != v[:-1]]), np.arange(len(v)), 0))
        rest = np.flatnonzero(first != np.arange(len(v)))
        left.append(o[first[rest]])
        right.append(o[rest])
    return np.concatenate(left), np.concatenate(right)


def _stars(anchor: np.ndarray, fp: np.ndarray, threshold: int) -> np.ndarray:
    """Rows (fingerprint, smallest linked fingerprint) of complete anchors sorted by anchor."""
    u = fp.view(np.uint64)
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(anchor)))
    group = np.cumsum(new) - 1
    few = (size <= DIRECT)[group]
    at = np.flatnonzero(few & (size > 1)[group])
    a, b = _near(group[at], u[at], threshold)
    pairs = [(at[a], at[b])]
    for s in np.flatnonzero(size > DIRECT):
        a, b = _large(u[start[s] : start[s] + size[s]], threshold)
        pairs.append((a + start[s], b + start[s]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    label = _roots(len(fp), a, b)
    out = np.flatnonzero(label != np.arange(len(fp)))
    return np.unique(np.stack([fp[out], fp[label[out]]], axis=1), axis=0)


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """Star links (a, b) between the distinct fingerprints of column fp, complete for components."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 2048):
                part = values[at : at + 2048]
                row, anchor = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row])], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def done(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            stars = _stars(anchor, fp, threshold) if len(fp) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], ["a", "b"])

        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows < 1 << 18:
                continue
            anchor, fp = (np.concatenate(x) for x in zip(held, *waiting, strict=True))
            cut = int(np.searchsorted(anchor, anchor[-1]))
            held, waiting, rows = (anchor[cut:], fp[cut:]), [], 0
            yield done(anchor[:cut], fp[:cut])
        yield done(*(np.concatenate(x) for x in zip(held, *waiting, strict=True)))

    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = fps.select("fp").distinct().mapInArrow(spread, "anchor long, fp long")
    placed = placed.repartition(parts, "anchor").sortWithinPartitions("anchor", "fp")
    return placed.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: int = 2, keep: list[str] | None = None) -> DataFrame:
    """One row a document: id, fp (signed long), component_id and the columns named in ``keep``.

    component_id is the smallest id reachable over links of at most ``threshold`` differing bits,
    the row's own included. Texts that are null or without words have fingerprint zero and link
    like others. Null ids are passed over when the smallest id is chosen (null only where a class
    has no other); repeated rows each give a row. ``fp`` and ``component_id`` replace columns of
    these names. Copies share a fingerprint, so a group of any size is one row in the comparison.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "simhash")
    cols = list(dict.fromkeys([id_col, *(keep or [])]))
    kept = [c for c in cols if c not in ("fp", "component_id")]
    rows = work.save(docs.select(*kept, fingerprints(F.col(text_col), words).alias("fp")), "fingerprints")
    least = rows.groupBy("fp").agg(F.min(id_col).alias("own"))
    least = work.save(least, "distinct")
    classes = connected_components(links(least, threshold), "a", "b", work)
    named = least.join(classes, F.col("fp") == F.col("node"), "left").select("fp", "own", F.coalesce("component", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("own").alias("component_id"))
    named = named.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


#: Words of 64 bits in a wide fingerprint, those compared, and anchor blocks of it.
WIDE, COMPARED, TABLES = 6, 4, 16
#: Bits of each anchor block in which two documents may differ.
SLIP = 1
#: Pairs of rows that an anchor compares at once; bounds memory.
PAIRS = 1 << 19
#: Tables searched first; what they link is one label in the others, so that large groups cost few links.
EARLY = 3
#: Rows of three longs that are broadcast at most (6 MB).
FEW = 1 << 18
#: Shingles that a block of a group of candidates holds about, and partners that a block of a hub has at most about.
HELD, PARTNERS = 1 << 20, 1 << 16


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; empty without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(size + 1) - 1
    start = end - size
    k = min(words, len(tokens))
    spans = zip(start[: len(tokens) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64))


def wide_fingerprint(text: str | None, words: int = 5) -> np.ndarray:
    """WIDE words of 64 bits: the signs of WIDE * 64 sums over the distinct word shingles."""
    h = shingle_set(text, words)
    if not len(h):
        return np.zeros(WIDE, np.uint64)
    ones = np.zeros((WIDE, 64), np.int64)
    for w in range(WIDE):
        z = h + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = (z ^ (z >> np.uint64(31))).astype("<u8")
        for at in range(0, len(z), SLICE):
            ones[w] += np.unpackbits(z[at : at + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").view("<u8").ravel()


def bit_limit(similarity: float) -> int:
    """Differing bits, of those compared, up to which two documents may be this similar.

    Sets of equal size and Jaccard similarity s have the cosine 2s / (1 + s); each bit differs with
    the probability of their angle over pi. Three standard deviations are granted: pairs found are
    held against their shingles afterwards, so a wide limit costs time and never a false link.
    """
    p = np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi
    n = 64 * COMPARED
    return int(n * p + 3 * np.sqrt(n * p * (1 - p)))


def _forest(part: np.ndarray, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the links of a spanning forest over the parts, fewest differing bits first.

    Each round joins every part by its best link; links have a strict order, so none closes a ring.
    """
    order = np.lexsort((b, a, bits))
    u, v, at = part[a[order]], part[b[order]], np.arange(len(a))
    chosen = []
    while True:
        apart = u != v
        u, v, at = u[apart], v[apart], at[apart]
        if not len(at):
            return order[np.concatenate([np.zeros(0, np.int64), *chosen])]
        best = np.full(len(part), len(a))
        np.minimum.at(best, u, at)
        np.minimum.at(best, v, at)
        take = np.flatnonzero((best[u] == at) | (best[v] == at))
        chosen.append(at[take])
        root = _roots(len(part), u[take], v[take])
        u, v = root[u], root[v]


def _wide_links(node: np.ndarray, label: np.ndarray, f: np.ndarray, limit: int) -> np.ndarray:
    """Links (node, node) of one anchor between rows of different labels: a spanning forest of all within the limit.

    Rows are compared a few at a time with all that follow. A link inside a tree whose links are
    all closer can't improve it and isn't sorted, so a large group of copies costs little memory.
    """
    n, first = len(node), limit / COMPARED + 3.5 * np.sqrt(limit / COMPARED)
    part = np.unique(label, return_inverse=True)[1]
    left, right, bits = (np.zeros(0, np.int64) for _ in range(3))
    tree, widest = np.arange(n), np.full(n, limit + 1)
    step = max(1, PAIRS // n)
    for at in range(0, n - 1, step):
        rest = f[at:]
        near = np.bitwise_count(f[at : at + step, None, 0] ^ rest[None, :, 0]) <= first
        near &= part[at : at + step, None] != part[None, at:]
        i, j = np.nonzero(near)
        i, j = i[i < j], j[i < j]
        far = np.zeros(len(i), np.int64)
        for w in range(COMPARED):
            far += np.bitwise_count(f[at + i, w] ^ rest[j, w])
        ti, tj = tree[part[at + i]], tree[part[at + j]]
        hit = (far <= limit) & ((ti != tj) | (far < widest[ti]))
        if hit.any():
            left, right, bits = np.append(left, at + i[hit]), np.append(right, at + j[hit]), np.append(bits, far[hit])
            keep = _forest(part, left, right, bits)
            left, right, bits = left[keep], right[keep], bits[keep]
            tree = _roots(n, part[left], part[right])
            widest = np.zeros(n, np.int64)
            np.maximum.at(widest, tree[part[left]], bits)
    return np.stack([np.minimum(node[left], node[right]), np.maximum(node[left], node[right])], axis=1)


def _sets(text: Column, words: int) -> Column:
    """The sorted shingle hashes of a text as bytes."""

    @F.arrow_udf("binary")
    def shingles(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t, words).tobytes() for t in texts.to_pylist()], pa.binary())

    return shingles(text)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a binary column of sets one after the other, and the size of each set."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), np.uint64), np.diff(ends) // 8


class Postings:
    """Which of some sets, given one after the other, hold a hash."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.values, start = np.unique(flat[order], return_index=True)
        self.start, self.sizes = np.append(start, len(flat)), sizes

    def similarity(self, own: np.ndarray) -> np.ndarray:
        """Jaccard similarity of a set with each of the sets; two empty sets are equal."""
        at = np.searchsorted(self.values, own)
        inside = at < len(self.values)
        at = at[inside][self.values[at[inside]] == own[inside]]
        n = self.start[at + 1] - self.start[at]
        places = np.arange(n.sum()) + np.repeat(self.start[at] - (np.cumsum(n) - n), n)
        both = np.bincount(self.owner[places], minlength=len(self.sizes))
        every = self.sizes + len(own) - both
        return np.where(every > 0, both / np.maximum(every, 1), 1.0)


def similar_pairs(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose sets (node, set) have this Jaccard similarity or more.

    Of each pair the node with more pairs is the hub. A hub's set is held once in each of its blocks
    of at most PARTNERS partners, which stream past it, so no set is repeated for every pair.
    """
    degree = pairs.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    known = pairs.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    of_a = F.col("da") >= F.col("db")
    edges = known.select(F.when(of_a, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(of_a, F.col("b")).otherwise(F.col("a")).alias("node"), F.greatest("da", "db").alias("d"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("d") / PARTNERS))
    edges = edges.select(F.xxhash64("hub", part).alias("block"), F.lit(1).alias("role"), "hub", "node")
    hubs = edges.select("block", F.lit(0).alias("role"), "hub", F.col("hub").alias("node")).distinct()
    rows = edges.unionByName(hubs).join(sets.select("node", "set"), "node").select("block", "role", "hub", "node", "set")

    def hold(batch: pa.RecordBatch) -> dict[int, Postings]:
        return {hub: Postings(*_flat(batch.column("set").slice(i, 1))) for i, hub in enumerate(batch.column("hub").to_pylist())}

    def meet(held: dict[int, Postings], batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hashes, sizes = _flat(batch.column("set"))
        hub, ends = batch.column("hub").to_pylist(), np.cumsum(sizes)
        near = [held[h].similarity(hashes[e - n : e])[0] >= similarity for h, e, n in zip(hub, ends.tolist(), sizes.tolist(), strict=True)]
        kept = batch.filter(pa.array(near, pa.bool_()))
        return pa.RecordBatch.from_arrays([kept.column("hub"), kept.column("node")], ["a", "b"])

    return B.compare(rows, hold, meet, "a long, b long")


def group_links(sets: DataFrame, labels: DataFrame, ends: DataFrame, similarity: float, work: Workspace) -> DataFrame:
    """Links (la, lb) between the labels of ``labels`` (node, label), complete within groups of candidates.

    ``ends`` (la, lb) join labels that may be similar; all labels reachable over them are one group.
    In a group all sets of different labels are held against each other. Of a group's labels the one
    of most nodes doesn't ask, as the others ask it. Groups are split into blocks by the number of
    shingles; a block returns a forest over labels.
    """
    groups = connected_components(ends, "la", "lb", work).select(F.col("node").alias("_label"), F.col("component").alias("group"))
    nodes = labels.join(groups, F.col("label") == F.col("_label")).select("node", "label", "group")
    own = work.save(sets.select("node", "set").join(nodes, "node").select("group", "node", "label", "set"), "sets")
    sized = own.groupBy("group", "label").agg(F.count("*").alias("n"), F.sum(F.length("set") / 8).alias("held"))
    sized = sized.groupBy("group").agg(F.ceil(F.sum("held") / HELD).alias("blocks"), F.max_by("label", F.struct("n", "label")).alias("most"))
    sized = work.save(sized.select(F.col("group").alias("_group"), F.greatest("blocks", F.lit(1)).cast("int").alias("blocks"), "most"), "sized")
    rows = own.join(sized, F.col("group") == F.col("_group"))
    # the hash of a group and a block is their place; groups that share one are told apart by their number
    place = lambda b: F.xxhash64("group", b)
    members = rows.select(place(F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")).alias("block"), F.lit(0).alias("role"), "group", "label", "set")
    asking = rows.filter("label <> most").select(F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), place)).alias("block"), F.lit(1).alias("role"), "group", "label", "set")

    def hold(batch: pa.RecordBatch) -> dict:
        return {"group": batch.column("group").to_numpy(), "label": batch.column("label").to_numpy(), "sets": Postings(*_flat(batch.column("set")))}

    def meet(m: dict, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        group, label = batch.column("group").to_numpy(), batch.column("label").to_numpy()
        names, at = np.unique(np.concatenate([m["label"], label]), return_inverse=True)
        held, own = at[: len(m["label"])], at[len(m["label"]) :]
        root, left, right = np.arange(len(names)), [], []
        hashes, sizes = _flat(batch.column("set"))
        for i, (end, size) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)):
            alike = (m["sets"].similarity(hashes[end - size : end]) >= similarity) & (m["group"] == group[i])
            for r in np.setdiff1d(root[held[alike]], root[own[i]]).tolist():
                left.append(names[own[i]])
                right.append(names[r])
                root[root == r] = root[own[i]]
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["la", "lb"])

    return B.compare(members.unionByName(asking), hold, meet, "la long, lb long").distinct()


def few(written: DataFrame) -> DataFrame:
    """``written`` (three longs a row) marked for broadcasting if it has at most FEW rows, so that texts joined with it stay where they are; as it is beyond that."""
    return F.broadcast(written) if written.count() <= FEW else written


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, key, component) of the distinct pairs of an id and a text (key: 128 bits of it): classes of similar texts.

    A wide fingerprint estimates the similarity to a few hundredths. Each of its TABLES blocks of 23
    bits is an anchor space of the Golay code: a text goes to the anchors within covering radius
    plus SLIP of the block, and texts of one anchor are compared over all compared bits. An anchor
    returns a spanning forest of what may be similar, closest first, never its pairs. The links of
    the first EARLY tables are held against the whole sets of shingles. Where such a link fails, others
    of its anchor that the forest left out may be true: labels that failed links and those of the
    other tables join are groups, within which all texts of different labels are held against each
    other. Equal wide fingerprints are one text to the search.

    Defined cases: rows with a null id are left out; null and empty texts and those without
    words are one class; a text of fewer words than a shingle is one shingle; texts of any length are
    read whole; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "similar")
    names = [f"f{w}" for w in range(WIDE)]
    limit = bit_limit(similarity)

    @F.pandas_udf("array<long>")
    def wide(texts: pd.Series) -> pd.Series:
        return pd.Series([wide_fingerprint(t, words).view(np.int64) for t in texts], dtype=object)

    named = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    rows = named.select("id", "key", wide("text").alias("f"))
    rows = work.save(rows.select("id", "key", *[F.col("f")[w].alias(n) for w, n in enumerate(names)]), "fingerprints")
    # the number of a fingerprint is fixed once the table is written
    nodes = work.save(rows.groupBy(*names).agg(F.min("key").alias("key")).withColumn("node", F.monotonically_increasing_id()), "distinct")

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(node, set) of the nodes named: the shingles of one text of each."""
        own = nodes.select("node", F.col("key.x").alias("_x"), F.col("key.y").alias("_y")).join(wanted, "node", "left_semi")
        own = few(work.save(own, "wanted"))
        texts = named.select(F.col("key.x").alias("x"), F.col("key.y").alias("y"), "text")
        found = texts.join(own, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).dropDuplicates(["node"])
        return work.save(found.select("node", _sets(F.col("text"), words).alias("set")), "texts")

    def spread(batches: Iterator[pa.RecordBatch], tables: range) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                f = np.stack([c.to_numpy() for c in part.columns[2:]], axis=1)
                bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1, bitorder="little")
                for t in tables:
                    block = bits[:, t * BLOCK : (t + 1) * BLOCK].astype(np.int64) @ (1 << np.arange(BLOCK))
                    row, anchor, _ = _expand(block, np.full(len(block), SLIP), SLIP)
                    yield pa.RecordBatch.from_arrays([pa.array((t << 12 | anchor).astype(np.int32)), *[c.take(pa.array(row)) for c in part.columns[:2]], *[pa.array(f[row, w]) for w in range(COMPARED)]], ["anchor", "node", "label", *names[:COMPARED]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            pairs = np.zeros((0, 2), np.int64)
            if t.num_rows > 1:
                pairs = _wide_links(t.column(1).to_numpy(), t.column(2).to_numpy(), np.stack([c.to_numpy() for c in t.columns[3:]], axis=1).view(np.uint64), limit)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        own = None
        for batch in batches:
            anchor = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]]).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and anchor[a] != own:
                    yield close()
                    held = []
                own = anchor[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield close()

    longs = lambda cols: ", ".join(f"{c} long" for c in cols)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labels = nodes.withColumn("label", F.col("node"))

    def between(pairs: DataFrame) -> DataFrame:
        own = labels.select("node", "label")
        return pairs.join(own.toDF("a", "la"), "a").join(own.toDF("b", "lb"), "b").filter("la <> lb").select("la", "lb").distinct()

    def merged(ends: DataFrame) -> DataFrame:
        classes = connected_components(ends, "la", "lb", work).withColumnRenamed("node", "_label")
        joined = labels.join(classes, F.col("label") == F.col("_label"), "left").withColumn("label", F.coalesce("component", "label"))
        return work.save(joined.select("node", "label", *names), "labels")

    met = []
    for tables in (range(EARLY), range(EARLY, TABLES)):
        placed = labels.select("node", "label", *names).mapInArrow(lambda batches, tables=tables: spread(batches, tables), f"anchor int, node long, label long, {longs(names[:COMPARED])}")
        found = placed.repartition(parts, "anchor").sortWithinPartitions("anchor", "node").mapInArrow(compare, "a long, b long").distinct()
        met.append(work.save(found, "found"))
        if len(met) == 1:  # the links of the others are held against each other in their groups
            ends = met[0].select(F.explode(F.array("a", "b")).alias("node")).distinct()
            labels = merged(between(work.save(similar_pairs(sets_of(ends), met[0], similarity), "linked")))
    ends = work.save(between(reduce(DataFrame.union, met)), "between")
    joined = ends.select(F.explode(F.array("la", "lb")).alias("label")).distinct()
    asked = labels.select("node", "label").join(joined, "label", "left_semi")
    labels = merged(work.save(group_links(sets_of(asked.select("node")), asked, ends, similarity, work), "linked"))
    named = labels.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("label").alias("component"))
    same = reduce(and_, (F.col(n) == F.col(f"_{n}") for n in names))
    return rows.join(named, same).select("id", "key", "component").distinct()


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id) of the distinct pairs of an id and a text; component_id is the smallest id of the class (see similar_rows)."""
    rows = similar_rows(docs, id_col, text_col, words, similarity)
    least = rows.groupBy(F.col("component").alias("_c")).agg(F.min("id").alias("component_id"))
    return rows.join(least, F.col("component") == F.col("_c")).select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class of similar texts: the one of the smallest id, then text key.

    Rows of one id with different texts are rows of their own; of rows that agree in id and text one
    stays. Rows without an id pass through, and columns whatever their names. See similar_rows for
    the other cases. Texts are shuffled only where more rows go, or are repeated, than are broadcast.
    """
    work = Workspace(docs.sparkSession, "kept")
    rows = work.save(similar_rows(docs, id_col, text_col, words, similarity), "classes")
    first = rows.groupBy(F.col("component").alias("_c")).agg(F.min(F.struct("id", "key")).alias("first"))
    others = rows.join(first, F.col("component") == F.col("_c")).filter(F.struct("id", "key") != F.col("first"))
    named = lambda df: few(work.save(df.select(F.col("id").alias("_k_id"), F.col("key.x").alias("_k_x"), F.col("key.y").alias("_k_y")), "rows"))
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"))
    same = (F.col("_id") == F.col("_k_id")) & (F.col("_key.x") == F.col("_k_x")) & (F.col("_key.y") == F.col("_k_y"))
    kept = whole.join(named(others), same, "left_anti")
    again = whole.filter("_id IS NOT NULL").groupBy(F.col("_id").alias("id"), F.col("_key").alias("key")).agg(F.count("*").alias("n")).filter("n > 1")
    again = named(again)
    if again.isEmpty():
        return kept.select("row.*")
    once = kept.join(again, same, "left_semi").dropDuplicates(["_id", "_key"])
    return kept.join(again, same, "left_anti").unionByName(once).select("row.*")
