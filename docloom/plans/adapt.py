"""The engine's tables out of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import DOMAINS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one with texts that is read in fewer tasks than half the cores is dealt out to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    keys = {"documents": "doc_id", "pages": "page_id"}
    return rows.repartition(cores, keys[name]) if name in keys and 2 * rows.rdd.getNumPartitions() <= cores else rows


def domain(key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (F.pmod(F.col(key), F.lit(3)) + 1).cast("int"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: chunk_id, document_id, text, domain, source_date, split, checksum_sha256, relative_path."""
    docs = read(spark, sf_dir, "documents")
    split = F.when(F.col("doc_id") % 5 == 0, "evaluation").otherwise("development")
    return docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), "text", domain("doc_id").alias("domain"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("source_date"),
        split.alias("split"), F.sha2(F.col("text").cast("binary"), 256).alias("checksum_sha256"), F.concat(split, F.lit("/"), domain("doc_id"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".html")).alias("relative_path"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark as queries: query_id, question, and filters for a part of them."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def filtered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """questions with filters: even ones a domain, all a first date, those divisible by 3 a last date."""
    q = questions(spark, sf_dir)
    return q.select(
        "*", F.when(F.col("query_id") % 2 == 0, domain("query_id")).alias("domain"), F.lit(None).cast("long").alias("document_id"),
        F.lit("2024-02-01").cast("date").alias("date_from"), F.when(F.col("query_id") % 3 == 0, F.lit("2024-10-01").cast("date")).alias("date_to"),
    )


#: The same in SQL, for the queries' oracles.
SQL = """
corpus AS (
  SELECT doc_id AS chunk_id, doc_id AS document_id, text, ['financial', 'legal', 'research'][doc_id % 3 + 1] AS domain,
         DATE '2024-01-01' + (doc_id % 365)::INT AS source_date, CASE WHEN doc_id % 5 = 0 THEN 'evaluation' ELSE 'development' END AS split,
         sha256(text) AS checksum_sha256,
         (CASE WHEN doc_id % 5 = 0 THEN 'evaluation' ELSE 'development' END) || '/' || ['financial', 'legal', 'research'][doc_id % 3 + 1] || '/' || doc_id || '.html' AS relative_path
  FROM documents),
questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)
"""
