"""Exact deduplication by recipes of content-defined chunks (native)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import cut, table, texts

#: A chunk has 512 to 4096 characters and ends where the text itself says so; the last one may be shorter.
CHUNK = r"(?s).{510,4094}?[\s,.][d-mD-M]|.{1,4096}"


#: Parts that the rows of one text are dealt to.
SALT = 16


def duplicates(docs: DataFrame, identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Null and empty texts are equal to each other; of equal texts the largest doc_id stays; a repeated doc_id counts per
    row, and all rows of the kept id have kept, as has a null id (the pipeline keeps one of them); other columns are ignored; an
    empty table gives none. A chunk's identifier is its 64-bit hash (identify), verified against all distinct chunks: where one hash
    stands for several contents, their rank within the hash completes it. Rows of one text, however many, are dealt to SALT tasks.
    """
    cut_up = texts(docs).select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0)).alias("chunks"))
    recipes = cut_up.select("doc_id", "text_sha256", F.transform("chunks", lambda c: identify(c)).alias("recipe"))
    chunks = cut_up.select(F.explode("chunks").alias("chunk"))
    distinct = chunks.groupBy(identify(F.col("chunk")).alias("h"), "chunk").agg(F.lit(1).alias("one"))
    clashes = cut(distinct.groupBy("h").agg(F.sum("one").alias("n")).where("n > 1").select("h"))
    if not clashes.isEmpty():
        ranked = distinct.join(clashes, "h").select("h", "chunk", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).alias("nth"))
        fixes = (  # of a text, whatever its rows' ids
            cut_up.select("text_sha256", F.posexplode("chunks").alias("at", "chunk"))
            .withColumn("h", identify(F.col("chunk")))
            .join(ranked, ["h", "chunk"])
            .groupBy("text_sha256")
            .agg(F.array_sort(F.collect_set(F.struct(F.col("at").cast("bigint").alias("at"), F.col("nth").cast("bigint").alias("nth")))).alias("fix"))
        )
        flat = F.flatten(F.transform("fix", lambda x: F.array(x["at"], x["nth"])))
        recipes = recipes.join(fixes, "text_sha256", "left").select(
            "doc_id", "text_sha256", F.when(F.col("fix").isNull(), F.col("recipe")).otherwise(F.concat("recipe", F.array(F.lit(-1).cast("bigint")), flat)).alias("recipe")
        )
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    every = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    return recipes.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))).join(every, ["recipe", "salt"], "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("keep_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
