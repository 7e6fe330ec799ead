"""From documents to packed training sequences: language, lines, near duplicates, mix, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import language_id, line_dedup, mixing, near_dedup, packing
from docloom.llm.common import documents, staged
from docloom.llm.encoders import tokenizer_file


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that language identification does not reject."""
    return language_id.accepted(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines whose template an earlier document has; n_chars follows the text."""
    columns = docs.columns
    return line_dedup.deduplicated(docs).withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.deduplicated(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.packed(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("line_dedup", fresh_lines),
    ("near_dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: Training, signatures, flow and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written and read again by the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
