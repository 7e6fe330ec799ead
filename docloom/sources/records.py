"""Evaluation records in and out, reports, append-only logs, checkpoints."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.errors import EvaluationError

RECORDS = (
    "example_id string, question string, reference_answer string, domain string, supporting_document_ids array<string>, supporting_chunk_ids array<string>, "
    "tags array<string>, table_parsing_required boolean, split string, reviewer_status string, reviewer string, corpus_fingerprint string"
)


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORDS) -> DataFrame:
    """Strict JSON lines: a bad line or an unknown field is an error; blank lines are skipped."""
    known = {f.split()[0] for f in schema.split(", ")}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.json_object_keys("value").alias("keys"))
    bad = parsed.filter(F.col("keys").isNull() | F.col("r").isNull() | F.col("r.example_id").isNull() | (F.size(F.array_except("keys", F.array(*map(F.lit, sorted(known))))) > 0))
    if rows := bad.take(1):
        raise EvaluationError(f"not an evaluation record: {rows[0].value[:200]}")
    return parsed.select("r.*")


def write_jsonl(records: DataFrame, path: str) -> None:
    """Sorted by example_id, in files whose order is that of their names."""
    records.orderBy("example_id").write.mode("overwrite").json(path)


def write_review_csv(records: DataFrame, path: str) -> None:
    """For reviewers: arrays joined by |, booleans in lower case."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c).cast("string").alias(c) for c, t in records.dtypes]
    records.select(flat).orderBy("example_id").write.mode("overwrite").option("header", True).csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_runs(results: DataFrame, path: str) -> None:
    """A folder for each configuration; a run replaces its own only."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("config_id").parquet(path)


def report_markdown(slices: DataFrame, title: str = "Evaluation") -> str:
    """A table of metric slices; they are few by nature (metrics times domains)."""
    rows = slices.orderBy("metric", F.col("domain").asc_nulls_first()).collect()
    lines = [f"# {title}", "", "| metric | domain | count | mean |", "| --- | --- | --- | --- |"]
    return "\n".join(lines + [f"| {r.metric} | {r.domain or 'all'} | {r['count']} | {r.mean_score:.6f} |" for r in rows]) + "\n"


def report_html(slices: DataFrame, title: str = "Evaluation") -> str:
    rows = slices.orderBy("metric", F.col("domain").asc_nulls_first()).collect()
    cells = "".join(f"<tr><td>{html.escape(r.metric)}</td><td>{html.escape(r.domain or 'all')}</td><td>{r['count']}</td><td>{r.mean_score:.6f}</td></tr>" for r in rows)
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr><th>metric</th><th>domain</th><th>count</th><th>mean</th></tr>{cells}</table>"


def report_json(slices: DataFrame, failures: DataFrame | None = None, title: str = "Evaluation") -> str:
    """Slices, and how often each failure (category, n) occurs."""
    rows = slices.orderBy("metric", F.col("domain").asc_nulls_first()).collect()
    out = {"title": title, "slices": [{"metric": r.metric, "domain": r.domain, "count": r["count"], "mean_score": r.mean_score} for r in rows]}
    if failures is not None:
        out["failures"] = {r.category: r.n for r in failures.orderBy("category").collect()}
    return json.dumps(out, ensure_ascii=False, indent=1) + "\n"


def cache_put(answers: DataFrame, path: str, now: float) -> None:
    """Appends answers (cache_key, payload) made at a time (seconds) to the query cache."""
    answers.select("cache_key", "payload").withColumn("made", F.lit(float(now))).write.mode("append").parquet(path)


def cache_get(requests: DataFrame, path: str, now: float, ttl: float) -> DataFrame:
    """requests (cache_key and others) with payload: the latest that is not older than ttl seconds, or null."""
    stored = requests.sparkSession.read.schema("cache_key string, payload string, made double").parquet(path).filter(F.col("made") >= now - ttl)
    return requests.join(stored.groupBy("cache_key").agg(F.max_by("payload", "made").alias("payload")), "cache_key", "left")
