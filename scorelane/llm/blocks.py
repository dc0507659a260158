"""Vectors in blocks: members of a block are held, what is compared with them streams past."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members that a block holds about; a group with more is split by hash into blocks of this size.
MEMBERS = 4096
#: Blocks that a group may be split into.
SPLIT = 1 << 24


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def vector_key(vector: Column) -> tuple[Column, Column]:
    """128 bits that stand for a vector."""
    return F.xxhash64(vector).alias("x"), F.xxhash64(F.lit(1), vector).alias("y")


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of a binary column of equal lengths as a matrix."""
    n = len(column)
    raw = b"".join(v.as_buffer().to_pybytes() for v in column) if n else b""
    return np.frombuffer(raw, kind).reshape(n, -1)


def lists(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def split_sizes(placed: DataFrame, group: str) -> DataFrame:
    """(group, blocks): how many blocks the members of each group fill; one row a group."""
    return placed.groupBy(group).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))


def member_block(group: Column, blocks: Column, key: Column) -> Column:
    return group * F.lit(SPLIT) + F.pmod(key, blocks.cast("long"))


def all_blocks(group: Column, blocks: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: group * F.lit(SPLIT) + b)


def compare(rows: DataFrame, against: Callable[[pa.RecordBatch], object], meet: Callable[[object, pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Run ``meet(against(members), batch)`` over rows (block, role, ...): role 0 are members, 1 passes by.

    A block's members are in one task and held once; the others of the block stream past in
    batches, so memory is bounded by a block and a batch however many there are.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None
        for batch in batches:
            mark = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(mark[1:] != mark[:-1]) + 1, [len(mark)]]).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                own, role = divmod(int(mark[a]), 2)
                if own != block:
                    block, held, ready = own, [], None
                part = batch.slice(a, b - a)
                if role == 0:
                    held.append(part)
                    continue
                if not held and ready is None:
                    continue
                if ready is None:
                    ready = against(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                if (out := meet(ready, part)) is not None and out.num_rows:
                    yield out

    return rows.repartition(parts, "block").sortWithinPartitions("block", "role").mapInArrow(run, schema)
