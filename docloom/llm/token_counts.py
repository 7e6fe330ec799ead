"""Token counts by the whole-token shortcut (see encoders.WholeTokenCounter)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import column, documents, slices, table
from docloom.llm.encoders import counter, tokenizer_file

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and whether they are over limit, of each row; other columns are not read.

    A null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; a
    repeated row gives repeated results. Strings of special tokens inside a text
    count as the library takes them. One scan, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, out = counter(tokenizer), table(SCHEMA)
        for batch, texts in slices(batches):
            n = count.count(texts)
            yield out({"doc_id": column(batch, "doc_id"), "n_bytes": [len(t) if t.isascii() else len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]})
        count.forget()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
