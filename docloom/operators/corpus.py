"""Corpus manifest: duplicates, split leakage, identity, fingerprints, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DOMAINS
from docloom.errors import CorpusError

SPLITS = ("development", "evaluation")


def duplicate_groups(docs: DataFrame, checksum: str = "checksum_sha256", key: str = "document_id", path: str = "relative_path") -> DataFrame:
    """checksum, document_ids, relative_paths of groups of two or more, members by path."""
    both = F.sort_array(F.collect_list(F.struct(path, key)))
    groups = docs.groupBy(checksum).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # only members of groups are gathered into arrays
    found = docs.join(groups.drop("n"), checksum).groupBy(checksum).agg(both.alias("m"))
    return found.select(checksum, F.col("m")[key].alias("document_ids"), F.col("m")[path].alias("relative_paths"))


def split_leakage(docs: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys found in more than one split, with the splits."""
    return docs.groupBy(key).agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"), F.count(F.lit(1)).alias("n")).filter("first_split <> last_split")


def require_none(violations: DataFrame, what: str, error: type[Exception] = CorpusError) -> None:
    """Raises error with an example if there is a row."""
    if rows := violations.take(1):
        raise error(f"{what}: {rows[0].asDict()}")


def parse_layout(path: Column, root: str) -> dict[str, Column]:
    """split, domain and relative path from <root>/<split>/<domain>/<...>; null where the layout or a name is wrong."""
    relative = F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.lit(1 << 20))
    parts = F.split(relative, "/")
    split, domain = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    ok = (F.size(parts) >= 3) & split.isin(*SPLITS) & domain.isin(*DOMAINS)
    return {"relative_path": relative, "split": F.when(ok, split), "domain": F.when(ok, domain)}


def logical_title(path: Column) -> Column:
    """The file's stem with _ and - as spaces; the file's name if nothing is left."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(F.trim(F.translate(stem, "_-", "  ")), F.lit("")), name)


def row_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a fingerprint of rows that doesn't depend on their order.

    Each row's SHA-256 is taken; sums of the digests' words modulo 2^64 (as decimals)
    and the count are hashed again, so nothing is collected or sorted.
    """
    h = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"), 256)
    word = lambda i: F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    sums = rows.select(*(word(i).alias(f"w{i}") for i in range(4))).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"w{i}").alias(f"w{i}") for i in range(4)))
    return sums.select("n", F.sha2(F.concat_ws("-", F.col("n").cast("string"), *(F.coalesce(F.col(f"w{i}").cast("string"), F.lit("0")) for i in range(4))), 256).alias("fingerprint"))


def manifest_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of manifest (relative_path, checksum_sha256) whose path leaves the root, or whose file is missing or has another checksum, with the reason."""
    from docloom.operators.manifest import escapes

    there = files.select("relative_path", F.col("checksum_sha256").alias("found"))
    joined = manifest.join(there, "relative_path", "left")
    reason = F.when(escapes(F.col("relative_path")), "outside_root").when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("checksum_sha256"), "checksum")
    return joined.withColumn("reason", reason).filter("reason is not null").select("relative_path", "reason")


def evaluation_violations(records: DataFrame, manifest: DataFrame, corpus_fingerprint: str | None = None) -> DataFrame:
    """rule, key: broken rules of evaluation records (example_id, split, supporting_document_ids, supporting_chunk_ids, corpus_fingerprint) against manifest (document_id, split)."""
    def rule(name: str, rows: DataFrame, key: str = "example_id") -> DataFrame:
        return rows.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))

    support = records.select("example_id", F.explode("supporting_document_ids").alias("document_id"))
    known = manifest.select("document_id", F.col("split").alias("document_split"))
    out = rule("duplicate_example", records.groupBy("example_id").count().filter("count > 1"))
    out = out.unionByName(rule("repeated_support", records.filter(F.size("supporting_document_ids") != F.size(F.array_distinct("supporting_document_ids")))))
    out = out.unionByName(rule("not_held_out", records.filter(F.col("split") != "evaluation")))
    out = out.unionByName(rule("unknown_document", support.join(known, "document_id", "left_anti")))
    out = out.unionByName(rule("wrong_split", support.join(known, "document_id").filter("document_split <> 'evaluation'")))
    if corpus_fingerprint:
        out = out.unionByName(rule("other_corpus", records.filter(F.col("corpus_fingerprint") != corpus_fingerprint)))
    return out


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of greatest order for each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")
