"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes any table with the columns of ``documents`` and gives a defined result for nulls
in any column, empty and very long texts, ties, repeated rows, an empty table (an empty one comes
back, with the stage's columns) and further columns, whose names don't matter: they are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.llm import bpe, line_dedup, mixing, nbsvm, simhash
from scorelane.llm.common import table
from scorelane.llm.queries import ACCEPT
from scorelane.operators.workspace import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of ``docs``.

    Null and empty texts are scored by the bias alone; rows without an id are scored but not learnt
    from; scores equal to the limit are accepted; repeated rows each stay or go.
    """
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"), "quality")
    return nbsvm.score(docs.select(COLUMNS), model, name="_score").filter(F.col("_score") >= ACCEPT).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; n_chars follows the text, texts left without words go.

    Null, empty and blank texts that nothing was removed from stay; of equal windows the first by
    (id, text key, line) stays, null ids first; rows equal in id and text get the same result.
    """
    out = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.regexp_count("text", F.lit(r"\S")) == 0)
    return out.filter(~emptied).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, similarity 0.8): that of the smallest id, then text key.

    Null and empty texts and those without words are one class; rows without an id stay; rows of one
    id with different texts are different documents, rows equal in id and text are one.
    """
    return simhash.keep_one(docs).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mix to target weights takes it.

    Null is a source of its own; documents without words, null texts included, aren't taken; repeated
    rows are numbered and rounded as one running quantity; ties of rates are broken by hashes.
    """
    return mixing.repeated(docs).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text left, checked by decoding: counts and digests, without the text.

    A null text is empty and has no ids; every row gives a row, repeated ones too.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]

#: Fitted weights, fingerprints and rounding aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
