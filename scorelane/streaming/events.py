"""Incremental counts over a stream of events, which can be resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.operators.workspace import Workspace


def hourly(spark: SparkSession, sf_dir: str, state: str | None = None) -> DataFrame:
    """Events per hour and type, summed by a stream that reads what is there and stops.

    ``state`` names the folder of the stream's offsets, sums and updates. A run that names the folder
    of an earlier one, ended or broken off, reads only what has come since and goes on from its
    sums; without it, every run starts anew in a folder that is removed with the session. The last
    update of a window is its result; events more than a day late don't count.
    """
    folder = state.rstrip("/") if state else Workspace(spark, "stream").folder("hourly")
    out = f"{folder}/updates"
    schema = spark.read.option("pathGlobFilter", "events*.parquet").parquet(sf_dir).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(f"{sf_dir}")
    counts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("start"), "event_type", "n", "total", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    run = counts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/offsets").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    updates = spark.read.schema("start timestamp, event_type string, n long, total double, batch int").parquet(out)
    last = updates.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("hour"), "event_type", "v.n", "v.total")
