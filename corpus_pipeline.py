"""Corpus pipeline: quality, exact and near duplicates, benchmark passages, tokens."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from quarry.llm.common import cut, keyed, remove, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without(docs: DataFrame, find: Callable[[DataFrame], DataFrame], *, once: bool = False) -> DataFrame:
    """docs without those whose key find returns as doc_id. once: of rows of one id and text one stays."""
    rows, _ = keyed(docs.select(COLUMNS))
    gone = find(rows.withColumn("doc_id", F.col("key")).select(COLUMNS)).select(F.col("doc_id").alias("key"))
    kept = rows.join(gone, "key", "left_anti")
    again = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")) if once else None
    if again is None or again.isEmpty():
        return kept.select(COLUMNS)
    first = F.row_number().over(Window.partitionBy("key").orderBy("lang", "source", "n_chars", F.col("text").isNull()))
    one = kept.join(again, "key", "left_semi").withColumn("nth", first).where("nth = 1")
    return kept.join(again, "key", "left_anti").select(COLUMNS).unionByName(one.select(COLUMNS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score under 0.5; the model learns from labels of rows in docs."""
    return without(docs, lambda d: quality.classify(d, table(spark, sf_dir, "labels")).where("predicted = 0"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, of the largest doc_id; a null id stays only where all are null."""
    found = cut(exact_dedup.duplicates(docs).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), (F.col("group_size") > 1).alias("shared"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays")))
    rows = docs.select(COLUMNS).withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("sha"))
    kept = rows.join(found.where("not stays"), same, "left_anti")
    again = cut(found.where("shared and stays").groupBy("id", "sha").agg(F.count("*").alias("n")).where("n > 1"))
    if again.isEmpty():
        return kept.select(COLUMNS)
    first = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("lang", "source", "n_chars", F.col("text").isNull()))
    one = kept.join(again, same, "left_semi").withColumn("nth", first).where("nth = 1")
    return kept.join(again, same, "left_anti").select(COLUMNS).unionByName(one.select(COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the one of the smallest key stays."""
    return without(docs, lambda d: jaccard_join.linked(d).where("component_id <> doc_id"), once=True)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    return without(docs, lambda d: decontaminate.matches(d, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes that they decode to."""
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("tokenize", token_stage),
]
#: The classifier and the token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written as Parquet to the shared folder and read again by the next; a stage's input is deleted once it
    has been read."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        if k:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
