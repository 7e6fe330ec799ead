"""Exact deduplication against a persistent digest index.

The index is a table with one row per distinct text, bucketed and sorted by the
text's digest. New documents are reduced to (digest, smallest id, count) before
they move, anti-joined with the index by sort-merge (the index side is neither
shuffled nor sorted again while a bucket is one file) and what is new is appended.
DataFrame functions only.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import digest, discard, documents, join_by_key, staged, work_dir


class DigestIndex:
    """Distinct texts seen so far: digest binary, keep_id long, n long (copies in the batch that brought it).

    table: name in the session's catalog; path: where its files are (the shared folder if not given).
    """

    def __init__(self, spark: SparkSession, table: str | None = None, path: str | None = None, buckets: int = 64) -> None:
        self.spark, self.buckets = spark, buckets
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or work_dir(spark)

    def create(self) -> None:
        """An empty index, unless there is one."""
        if not self.spark.catalog.tableExists(self.table):
            self.append(self.spark.createDataFrame([], "digest binary, keep_id long, n long"))

    def drop(self) -> None:
        discard(self.read())
        self.spark.sql(f"DROP TABLE {self.table}")

    def append(self, entries: DataFrame) -> None:
        # dealt like the buckets, so that each task writes one file of one bucket
        out = entries.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.format("parquet")
        out.mode("append").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def new_entries(self, batch: DataFrame) -> DataFrame:
        """The entries of batch that the index lacks, by sort-merge anti-join."""
        return batch.hint("merge").join(self.read().select("digest"), "digest", "left_anti")

    def known_entries(self, batch: DataFrame) -> DataFrame:
        """The other entries of batch, with the index's keep_id as old_id."""
        return batch.hint("merge").join(self.read().select("digest", F.col("keep_id").alias("old_id")), "digest")


def _appended(docs: DataFrame, index: DigestIndex) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest) of a batch, and its texts (digest, keep_id, n, new); what the index lacked is in it now."""
    rows = staged(docs.select("doc_id", digest(F.col("text")).alias("digest")))
    groups = staged(rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
    index.create()
    new = staged(index.new_entries(groups))
    known = staged(index.known_entries(groups))
    index.append(new)
    return rows, new.withColumn("new", F.lit(True)).unionByName(known.select("digest", F.col("old_id").alias("keep_id"), "n", F.lit(False).alias("new")))


def dedup(docs: DataFrame, index: DigestIndex, upto: tuple[int, ...] = ()) -> DataFrame:
    """Verdict on each row of docs (doc_id, text and any others): doc_id, keep_id, group_size, kept, digest; its new texts go into the index.

    Texts are equal if they are identical after replacing each run of white space
    (space, tab to carriage return) by one space; a null text is empty. Of equal
    texts the smallest doc_id stays, unless an earlier call brought the text: then
    keep_id is that call's and no row is kept. group_size counts the rows of docs
    with the text. Rows that repeat the keeping doc_id itself are all kept;
    a null doc_id is kept only in a group that has no other id. No rows: no result.
    Texts of any length are hashed whole, where they lie.

    upto: ascending doc_ids at which docs are cut into batches that go through the
    index one after another (the last one holds what is over and null doc_ids): a batch
    finds the texts of those before it in the index.
    """
    at, low = F.col("doc_id"), None
    batches = []
    for high in upto:
        batches.append(docs.filter((at <= high) if low is None else (at > low) & (at <= high)))
        low = high
    batches.append(docs if low is None else docs.filter((at > low) | at.isNull()))
    done = [_appended(b, index) for b in batches]
    rows, groups = (reduce(DataFrame.unionByName, x) for x in zip(*done))
    # a text of several batches has one keep_id: the index's
    groups = staged(groups.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.max("new").alias("new")))
    found = join_by_key(rows, groups, "digest", "n")
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("new")).alias("kept"), "digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = DigestIndex(spark)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    found = dedup(docs, index, () if low is None else ((low + high) // 2,))
    index.drop()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
