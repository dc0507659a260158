"""Shared folder for written intermediate tables, which cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset, a temporary one if all tasks run in this process, as in tests; on a cluster
    RuntimeError, since each executor would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "scorelane-work")
    return root.rstrip("/")


def spread_again(df: DataFrame, key: list[str]) -> DataFrame:
    """``df`` (one row a key) in partitions that a join on ``key`` can't use as they are.

    A join with it then shuffles both its sides, which is what lets Spark split the partitions of a
    hot key on the other side while the query runs. Costs one more shuffle of ``df``.
    """
    names = df.columns
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(F.struct(*names).alias("_row"), F.xxhash64(F.lit(7), *key).alias("_at")).repartition(parts, "_at").select(*[F.col(f"_row.`{n}`").alias(n) for n in names])


class Workspace:
    """A fresh folder under the shared root; it is removed when the driver process ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.remove)

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return a frame that reads it back."""
        path = self.folder(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended; the folder's owner cleans it
            pass
