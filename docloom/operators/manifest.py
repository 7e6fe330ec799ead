"""The manifest of a corpus on disk: written with its fingerprint, read back with every check made again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.errors import CorpusError
from docloom.operators.corpus import require_none, row_fingerprint, split_leakage

#: Columns that name a document's place and content; the fingerprint is over these.
IDENTITY = ["checksum_sha256", "domain", "relative_path", "split"]


def escapes(path: Column) -> Column:
    """Whether a relative path would leave its root."""
    return path.startswith("/") | path.contains("\\") | F.array_contains(F.split(path, "/"), "..")


def write(docs: DataFrame, path: str) -> None:
    """docs (IDENTITY and any others) as Parquet, and a header of one row: documents and fingerprint. Documents of equal content in both splits are an error."""
    require_none(split_leakage(docs, "checksum_sha256"), "content in both splits")
    docs.write.mode("overwrite").parquet(f"{path}/documents")
    row_fingerprint(docs, IDENTITY).write.mode("overwrite").json(f"{path}/header")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a written manifest; an error if they don't have its fingerprint, leak between splits, or leave the root."""
    docs = spark.read.parquet(f"{path}/documents")
    said = spark.read.schema("n long, fingerprint string").json(f"{path}/header").first()
    found = row_fingerprint(docs, IDENTITY).first()
    if said is None or (said.n, said.fingerprint) != (found.n, found.fingerprint):
        raise CorpusError("the manifest's documents don't have its fingerprint")
    require_none(split_leakage(docs, "checksum_sha256"), "content in both splits")
    require_none(docs.filter(escapes(F.col("relative_path"))).select("relative_path"), "path outside the root")
    return docs


def subset(docs: DataFrame, domain: str | None = None, split: str | None = None) -> DataFrame:
    return docs.filter((F.lit(domain is None) | (F.col("domain") == domain)) & (F.lit(split is None) | (F.col("split") == split)))
