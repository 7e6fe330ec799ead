"""Quality rules per document, judged again by host.

A document's own rules may fail by chance; a host whose documents keep failing is
suspect as a whole. Failures are summed by host, each host's rate is shrunk towards
a beta prior fitted to all hosts, and a host whose shrunk rate is over the limit
loses all its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import WordHashes, column, documents, gram_hashes, join_by_key, slices, split_words, staged, table

SYMBOLS = "#*$%&|<>"
COUNTS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
_BLANK = " \t\n\v\f\r"


def _dup_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def repeat_words(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each text, the number of words in 3-word windows that the text has twice or more; hashes: all texts' words, starts: where each text's begin, and the end."""
    n = len(starts) - 1
    out = np.zeros(n, np.int64)
    if len(hashes) < 4:
        return out
    grams = gram_hashes(hashes, 3)
    doc = np.repeat(np.arange(n), np.diff(starts))
    inside = doc[:-2] == doc[2:]
    with np.errstate(over="ignore"):
        key = grams ^ (doc[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at = np.flatnonzero(inside)
    order = at[np.argsort(key[at], kind="stable")]
    ks = key[order]
    same = np.zeros(len(ks), bool)
    if len(ks):
        eq = (ks[1:] == ks[:-1]) & (doc[order][1:] == doc[order][:-1])
        same[1:] |= eq
        same[:-1] |= eq
    covered = np.zeros(len(hashes), bool)
    hit = order[same]
    for i in range(3):
        covered[hit + i] = True
    return np.bincount(doc[covered], minlength=n)


def rule_counts(docs: DataFrame, host: str = "source", min_words: int = 50, most_repeat: int = 50) -> DataFrame:
    """The counts of COUNTS for each row; base_failed: under min_words words, or over most_repeat percent of them in repeated 3-word windows. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, known = table(COUNTS), WordHashes()
        for batch, texts in slices(batches):
            words = [split_words(t) for t in texts]
            n = np.array([len(w) for w in words], np.int64)
            hashes = known([x for w in words for x in w])
            rep = repeat_words(hashes, np.concatenate([[0], np.cumsum(n)]))
            yield out({
                "doc_id": column(batch, "doc_id"), "host": column(batch, "_host"), "n_words": n, "word_chars": [sum(map(len, w)) for w in words],
                "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts], "n_dup_lines": [_dup_lines(t) for t in texts], "n_repeat_words": rep, "base_failed": (n < min_words) | (100 * rep > most_repeat * n),
            })

    return docs.select("doc_id", "text", F.col(host).alias("_host")).mapInArrow(run, COUNTS)


def host_rates(rules: DataFrame) -> DataFrame:
    """host, n, failed, and rate: the mean of the host's beta posterior under the prior fitted to all hosts.

    The prior is fitted by moments: with m the mean and v the variance of hosts' raw
    rates, less what chance adds (mean of m(1-m)/n), alpha + beta = m(1-m)/v - 1, at
    least 1 and at most 1000; with no such spread, 1000. One row for all hosts is
    joined to each, the hosts stay a table.
    """
    hosts = rules.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    raw = F.col("failed") / F.col("n")
    prior = hosts.agg(F.avg(raw).alias("m"), F.coalesce(F.var_pop(raw), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n")).alias("inv"))
    chance = F.col("m") * (1 - F.col("m"))
    spread = F.col("v") - chance * F.col("inv")
    strength = F.when(spread > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), chance / spread - 1))).otherwise(1000.0)
    prior = prior.select(F.col("m"), strength.alias("strength"))
    shrunk = (F.col("failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n", "failed", shrunk.alias("rate"))


def judged(docs: DataFrame, host: str = "source", max_rate: float = 0.5, **rules) -> DataFrame:
    """rule_counts() with host_rate and kept: the document's own rules pass and its host's shrunk rate is not over max_rate.

    A null or empty text has no words and fails; a null host is a host of its own;
    repeated rows count again. The hosts' table is joined by its key, hot hosts by
    broadcast of at most 1000 rows (common.join_by_key).
    """
    counts = staged(rule_counts(docs, host, **rules).withColumn("host", F.coalesce(F.concat(F.lit("="), "host"), F.lit("-"))))
    rates = staged(host_rates(counts))
    found = join_by_key(counts, rates, "host", "n")
    keep = ~F.col("base_failed") & (F.col("rate") <= max_rate)
    return found.withColumns({"host": F.when(F.col("host") != "-", F.substring("host", 2, 1 << 30)), "host_rate": F.round("rate", 9), "kept": keep}).drop("rate", "n", "failed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).drop("host_rate")


SQL = r"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT r, i, ws[i] || chr(32) || ws[i+1] || chr(32) || ws[i+2] AS gram FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS k FROM g),
p AS (SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) v(d) WHERE k > 1 GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM w) q WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
b AS (SELECT doc_id, host, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws) AS base_failed
      FROM w LEFT JOIN p USING (r) LEFT JOIN l USING (r)),
h AS (SELECT host, count(*) AS n, sum(base_failed::INT) AS failed FROM b GROUP BY host),
m AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v, avg(1 / n) AS inv FROM h),
s AS (SELECT m, CASE WHEN v - m * (1 - m) * inv > 0 THEN greatest(1.0, least(1000.0, m * (1 - m) / (v - m * (1 - m) * inv) - 1)) ELSE 1000.0 END AS k FROM m)
SELECT b.*, NOT base_failed AND (failed + m * k) / (n + k) <= 0.5 AS kept
FROM b JOIN h ON b.host IS NOT DISTINCT FROM h.host CROSS JOIN s
"""
