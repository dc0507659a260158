"""Decision records, scores and scenarios derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.operators import generate

IDS = ("high", "low", "mid")
QUESTION = "What is the quality of the text?"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a labelled document: record_id, dataset_id, source_group_id, answer_id, doc_id."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    both = labels.join(docs, "doc_id")
    answer = F.when(F.col("quality") == 1, "high").otherwise("low")
    return both.select(F.concat(F.lit("doc-"), "doc_id").alias("record_id"), F.concat(F.lit("quality-"), "lang").alias("dataset_id"), F.col("source").alias("source_group_id"), answer.alias("answer_id"), "doc_id")


def logit(record: Column, option: Column | str, salt: str) -> Column:
    """A whole number from -6 to 6 that a digest gives; coarse, so that ties occur."""
    option = F.lit(option) if isinstance(option, str) else option
    return (F.conv(F.substring(F.sha2(F.concat_ws(":", record, option, F.lit(salt)), 256), 1, 4), 16, 10).cast("int") % 13 - 6).cast("double")


def outputs(rows: DataFrame, salt: str) -> DataFrame:
    """Records with their ids and logits under a state."""
    return rows.withColumn("ids", F.array(*map(F.lit, IDS))).withColumn("logits", F.array(*[logit(F.col("record_id"), i, salt) for i in IDS]))


def presentations(rows: DataFrame, salt: str) -> DataFrame:
    """Each record once a rotation of its options, with logits of that order."""
    from scorelane.operators.scoring import rotations

    turned = rows.withColumn("orders", rotations(F.array(*map(F.lit, IDS)))).select("*", F.posexplode("orders").alias("order_index", "ids")).drop("orders")
    return turned.withColumn("logits", F.transform("ids", lambda i: logit(F.concat_ws(":", F.col("record_id"), F.col("order_index")), i, salt)))


def whole_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the whole text as context, a question and options."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_d"), F.col("text").alias("context"))
    options = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(i.title()).alias("label"), F.lit(None).cast("string").alias("description")) for i in IDS])
    return records(spark, sf_dir).join(docs, F.col("doc_id") == F.col("_d")).drop("_d").withColumn("question", F.lit(QUESTION)).withColumn("options", options)


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the split of their source and a digest of their text."""
    from scorelane.functions.text import split_slot

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", F.sha2("text", 256).alias("request_hash"), split_slot(F.sha2("source", 256)).alias("split"))


def routing_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario_id, scenario): one to three binary features, up to six destinations and a drawn table a part."""
    key = F.col("p_partkey")
    scenario = generate.routing_scenario(key, 1 + key % 3, 2 * (1 + F.floor(key / 3) % 3))
    return table(spark, sf_dir, "part").select(key.alias("scenario_id"), scenario.alias("scenario"))


def tool_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scenario_id, scenario): two to six drawn tools over three capabilities, two inputs and two permissions a part."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("scenario_id"), generate.tool_scenario(key, 2 * (1 + key % 3)).alias("scenario"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presentations (three rotations of each record) with identity, question and the digest of their prompt; the context is the record's name."""
    from scorelane.functions.text import prompt, request_hash

    rows = presentations(records(spark, sf_dir), "base").withColumnRenamed("ids", "order_ids")
    options = F.transform("order_ids", lambda i: F.struct(i.alias("id"), F.initcap(i).alias("label"), F.lit(None).cast("string").alias("description")))
    rows = rows.withColumn("options", options).withColumn("presentation_id", F.concat_ws(":", F.lit("panel"), "record_id", "order_index"))
    shown = prompt(F.col("record_id"), F.lit(QUESTION), F.col("options"))
    hashed = request_hash(F.col("record_id"), F.lit(QUESTION), F.col("options"))
    return rows.select("presentation_id", "record_id", "dataset_id", "source_group_id", hashed.alias("request_hash"), "order_index", "order_ids", F.sha2(shown, 256).alias("prompt_sha256"), "logits", "answer_id", "doc_id")


def scored_panel(spark: SparkSession, sf_dir: str, faulty: bool = False) -> DataFrame:
    """Outputs for the panel; with ``faulty``, rows are missing, doubled or changed by the number of their document."""
    from scorelane.operators.scoring import winner

    rows = panel(spark, sf_dir).withColumnRenamed("logits", "candidate_logits").withColumn("input_tokens", F.length("prompt_sha256") + F.col("order_index"))
    rows = rows.withColumn("winner_option_id", winner(F.col("order_ids"), F.col("candidate_logits"))).drop("answer_id")
    if not faulty:
        return rows.drop("doc_id")
    k, first = F.col("doc_id"), F.col("order_index") == 0
    rows = rows.filter(~((k % 7 == 0) & first))
    rows = rows.withColumns(
        {
            "dataset_id": F.when((k % 11 == 0) & first, "other").otherwise(F.col("dataset_id")), "winner_option_id": F.when((k % 13 == 0) & first, "none").otherwise(F.col("winner_option_id")),
            "input_tokens": F.when((k % 17 == 0) & first, 4096).otherwise(F.col("input_tokens")), "prompt_sha256": F.when((k % 19 == 0) & first, "0").otherwise(F.col("prompt_sha256")),
            "candidate_logits": F.when((k % 23 == 0) & first, F.slice("candidate_logits", 1, 2)).otherwise(F.col("candidate_logits")),
        }
    )
    return rows.union(rows.filter((k % 29 == 0) & first)).drop("doc_id")
