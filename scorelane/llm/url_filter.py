"""URL filtering by a blocked Bloom filter and an exact join.

Rules list canonical URLs (host and path start) with a verdict. Every URL gives the canonical
strings under which a rule that fits it may be listed: each suffix of its host at a dot, with each
start of its path whose length occurs in the list. A blocked Bloom filter (all bits of a string in
one block of 512) lets possible hits pass; an exact hash join with the list removes false
positives; the longest rule left wins.

Defined cases: a null URL and one without "://" have an empty host and path; no rule fits an empty
host unless one is listed for it; a rule listed twice counts once, block before allow; URLs without
a rule get ``otherwise``; repeated rows each give a row; an empty list leaves ``otherwise`` for all.
Rules with a null part are ignored; an empty table of pages gives an empty table; a URL of any length
is judged whole. Columns pass through whatever their names; those added replace columns of the same
name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS, HASHES, BITS_PER_KEY = 512, 8, 16
#: Blocks at most (64 MiB of filter): past 33 million rules hits get more, results stay exact.
MOST_BLOCKS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path of a URL; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each 64-bit key and its bit positions in the block."""
    k = keys.astype(np.int64).view(np.uint64)
    block = (k >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)
    step = (k & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    odd = step * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32) | np.uint64(1)
    at = (step[:, None] + np.arange(HASHES, dtype=np.uint64) * odd[:, None]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(55)
    return block.astype(np.int64), at.astype(np.int64)


def build(keys: DataFrame) -> np.ndarray:
    """The filter of a column of 64-bit keys as rows of eight words; blocks are combined by executors."""
    spark = keys.sparkSession
    n = keys.count()
    blocks = min(MOST_BLOCKS, 1 << max(0, int(np.ceil(np.log2(max(1, n * BITS_PER_KEY / BLOCK_BITS))))))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, at = _bits(batch.column(0).to_numpy(), blocks)
            word, bit = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(block, HASHES)), pa.array(word.ravel()), pa.array(bit.ravel().view(np.int64))], ["block", "word", "bits"])

    words = keys.mapInArrow(fill, "block long, word long, bits long").groupBy("block", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros((blocks, BLOCK_BITS // 64), np.uint64)
    out[words.column("block").to_numpy(), words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def may_hold(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    block, at = _bits(keys, len(bloom))
    return ((bloom[block[:, None], at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict added; rules has columns host, path, verdict.

    Distinct URLs are judged, so a frequent one is looked up once. The lengths of listed paths
    (as many as differ) and the filter (at most MOST_BLOCKS blocks) go to all executors.
    """
    spark = pages.sparkSession
    listed = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict").dropna()
    listed = listed.groupBy("r_host", "r_path").agg(F.max(F.when(F.col("verdict") == "block", "block").otherwise("allow")).alias("r_verdict"))
    lengths = sorted(r[0] for r in listed.select(F.length("r_path")).distinct().collect())
    sent = spark.sparkContext.broadcast(build(listed.select(F.xxhash64("r_host", "r_path"))))

    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(url_col).alias("u")).filter(F.col("u").isNotNull()).distinct()
    h, p = host_and_path(F.col("u"))
    named = urls.select("u", h.alias("h"), p.alias("p")).withColumn("labels", F.split("h", r"\."))
    named = named.select("u", "p", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))).alias("r_host"))
    starts = F.filter(F.array(*[F.when(F.length("p") >= n, F.substring("p", 1, n)) for n in lengths]), lambda s: s.isNotNull()) if lengths else F.array().cast("array<string>")
    keys = named.select("u", "r_host", F.explode(starts).alias("r_path"))

    @F.arrow_udf("boolean")
    def possible(hashes: pa.Array) -> pa.Array:
        return pa.array(may_hold(sent.value, hashes.to_numpy(zero_copy_only=False)))

    # the exact join: possible hits meet the list's rows in a hash table
    hits = keys.filter(possible(F.xxhash64("r_host", "r_path"))).join(listed.hint("shuffle_hash"), ["r_host", "r_path"])
    rule = F.concat("r_host", "r_path")
    best = hits.groupBy("u").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), "r_verdict")).alias("best"))
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    whole = pages.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    judged = whole.join(best, F.col("url") == F.col("u"), "left")
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(otherwise)).alias("verdict"))
