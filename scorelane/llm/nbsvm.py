"""A text classifier of naive Bayes features and a linear support vector machine.

A text becomes a set of hashed n-gram indicators: its words, runs of one to five marks of its
shape (upper case, lower case, digit, space, or the punctuation mark itself, with repeats
collapsed), and runs of words that repeat the word before. Each indicator is scaled by the
log-ratio of its smoothed frequency in the two classes; a linear model with hinge loss is fitted
to the scaled, length-normed vectors by dual coordinate descent. A logistic curve fitted to
margins of rows that a first model did not see turns margins into scores between 0 and 1.

Only the labelled sample (at most ``max_rows`` rows, those of the smallest hashes of their ids) is
held by the driver; scoring reads whole texts in Arrow batches.

Defined cases: null and empty texts have no indicators, so the bias alone scores them; labels that
are null or that contradict each other for one id are not learnt from; without rows of both
classes every score is the share of label 1 (0.5 without rows). Repeated rows each give a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.llm.common import small_batches

#: Hash places of the indicators.
PLACES = 1 << 18
#: Most labelled rows that a model is fitted to.
MAX_ROWS = 8000
SHAPE_GRAMS = 5

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[0x80:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[[9, 11, 12, 13]] = 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[1], np.full(63, 0x100000001B3)]).astype(np.uint64), dtype=np.uint64)


def _places(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind)) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return (h >> np.uint64(64 - 18)).astype(np.int64)


def _grams(h: np.ndarray, longest: int, kind: int) -> list[np.ndarray]:
    """Places of the runs of 1 to ``longest`` neighbours of h."""
    out, acc = [], h.astype(np.uint64)
    for n in range(1, longest + 1):
        if n > 1:
            if len(acc) < 2:
                break
            acc = acc[:-1] * np.uint64(1000003) + h[n - 1 :]
        out.append(_places(acc, kind + n))
    return out


def indicators(text: str | None) -> np.ndarray:
    """Sorted distinct places of the indicators of a text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    blank = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.int32)
    begins = np.zeros(len(raw), np.int64)
    begins[start] = start
    power = _POWERS[np.arange(len(raw)) - np.maximum.accumulate(begins) & 63]
    word = np.add.reduceat(np.where(blank, np.uint64(0), (raw.astype(np.uint64) + np.uint64(1)) * power), start) + (end - start).astype(np.uint64)
    shape = _CLASS[raw]
    shape = shape[np.concatenate([[True], shape[1:] != shape[:-1]])].astype(np.uint64)
    again = np.concatenate([[False], word[1:] == word[:-1]]).astype(np.uint64) + np.uint64(1)
    found = [_places(word, 11), *_grams(shape, SHAPE_GRAMS, 21)]
    found += [p[a > 0] for p, a in zip(_grams(again, 3, 41), (again - 1, again[1:] - 1, again[2:] - 1), strict=False)]
    seen = np.zeros(PLACES, bool)
    for p in found:
        seen[p] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weights[ids].sum() / np.sqrt(max(1, len(ids))) + self.bias)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(indicators(text)) + self.shift, -500, 500))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the indicators' smoothed shares of class 1 over those of class 0."""
    counts = [np.bincount(np.concatenate([np.zeros(0, np.int32), *[r for r, v in zip(rows, y, strict=True) if v == k]]), minlength=PLACES) + smooth for k in (0, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = 1.0, rounds: int = 30, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias (a constant input) that minimise the hinge loss, one dual variable at a time."""
    w, b = np.zeros(PLACES), 0.0
    alpha = np.zeros(len(rows))
    sign = np.where(y == 1, 1.0, -1.0)
    square = np.array([v @ v + 1 for v in values])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)).tolist():
            r, v = rows[i], values[i]
            g = sign[i] * (w[r] @ v + b) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost)
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[r] += step * sign[i] * v
                b += step * sign[i]
                worst = max(worst, abs(step))
        if worst < tolerance:
            break
    return w, b


def _linear(rows: list[np.ndarray], y: np.ndarray, cost: float) -> tuple[np.ndarray, float]:
    ratio = log_count_ratio(rows, y)
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    w, b = dual_descent(rows, values, y, cost)
    return w * ratio, b


def fit(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0) -> Model:
    """The model of labelled indicator sets; a fifth of the rows is held back to fit the curve."""
    share = (y.sum() + 1) / (len(y) + 2)
    flat = Model(np.zeros(PLACES), 0.0, 0.0, float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return flat
    back = np.random.default_rng(11).permutation(len(y)) % 5 == 0
    shown = [r for r, h in zip(rows, back, strict=True) if not h]
    if len(set(y[~back].tolist())) < 2:
        shown, back = rows, np.zeros(len(y), bool)
    w, b = _linear(shown, y[~back], cost)
    first = Model(w, b, 1.0, 0.0)
    held = back if back.any() else ~back
    margins = np.array([first.margin(r) for r, h in zip(rows, held, strict=True) if h])
    slope, shift = _logistic(margins, y[held])
    w, b = _linear(rows, y, cost)
    return Model(w, b, slope, shift)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic curve with smoothed targets, by Newton steps."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a = np.stack([x, np.ones_like(x)], axis=1)
    c = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -500, 500)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (p - t))
        c -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(c[0]), 0.0), float(c[1])


def fold(id_col: Column) -> Column:
    """Remainder by 5 of the crc32 of the id in decimal digits."""
    return F.crc32(id_col.cast("string")) % 5


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Model:
    """A model of the labelled rows outside fold 0, at most ``max_rows`` ids, the same on every run."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (fold(F.col("_id")) != 0))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).filter("_y = _z")
    sample = known.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(max_rows).select("_id", "_y")

    @F.pandas_udf("array<int>")
    def places(texts: pd.Series) -> pd.Series:
        return pd.Series([indicators(t) for t in texts], dtype=object)

    own = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_text"))
    # at most max_rows ids and labels are broadcast
    picked = own.join(F.broadcast(sample), F.col("_d") == F.col("_id")).select("_id", "_y", F.xxhash64("_text").alias("k"), places("_text").alias("p"))
    got = picked.orderBy("_id", "k").limit(max_rows).select("_y", "p").toArrow().combine_chunks()
    lists = got.column("p").combine_chunks()
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    return fit([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], got.column("_y").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text; the column replaces one of the same name."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # PLACES weights whatever the input

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([sent.value.score(t) for t in texts.to_pylist()], pa.float64())

    return docs.withColumn(name, scored(F.col(text_col)))
