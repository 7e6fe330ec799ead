"""Evaluation: retrieval and answer metrics, slices, failure classes, regression gates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.errors import EvaluationError
from docloom.functions.text import judge_tokens
from docloom.operators.corpus import require_none

#: At most so many beginnings of questions make one automaton.
MAX_BEGINNINGS = 2000
METRICS = ("context_precision", "context_recall", "faithfulness", "answer_relevancy")


def _ids(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def context_precision(retrieved: Column, support: Column) -> Column:
    r, s = _ids(retrieved), _ids(support)
    return F.when(F.size(r) == 0, F.when(F.size(s) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(r, s)) / F.nullif(F.size(r), F.lit(0)))


def context_recall(retrieved: Column, support: Column) -> Column:
    r, s = _ids(retrieved), _ids(support)
    return F.when(F.size(s) == 0, 1.0).otherwise(F.size(F.array_intersect(r, s)) / F.nullif(F.size(s), F.lit(0)))


def holding(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id: chunks (chunk_id, text) that contain a query's question.

    Texts that hold the beginning of any question are found in one pass by an automaton
    of all beginnings; only these are held against each question.
    """
    asked, texts = queries.select("query_id", "question").filter("question is not null"), chunks.select("chunk_id", "text")
    found = asked.select(F.substring("question", 1, 32).alias("b")).distinct().limit(MAX_BEGINNINGS + 1).collect()
    if len(found) <= MAX_BEGINNINGS:
        pattern = "|".join("".join(c if c.isalnum() and c.isascii() else f"\\x{{{ord(c):x}}}" for c in r.b) for r in found)

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pc.match_substring_regex(batch.column(1), pattern))

        texts = texts.mapInArrow(some, texts.schema)
    return texts.join(F.broadcast(asked), F.contains(F.col("text"), F.col("question"))).select("query_id", "chunk_id")


def claims(answer: Column, citation_claims: Column, insufficient: Column) -> Column:
    """The citations' claims; without any, the answer's sentences; of a refusal none."""
    clean = lambda a: F.array_distinct(F.filter(F.transform(a, lambda c: F.trim(c)), lambda c: c != ""))
    cited = clean(citation_claims)
    none = F.array().cast("array<string>")
    return F.when(insufficient, none).when(F.size(cited) > 0, cited).otherwise(clean(F.split(F.trim(answer), r"(?<=[.!?])\s+")))


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def claim_support(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """example_id, claim, score (1 contained in a chunk, 0.5 half its tokens in one, else 0), evidence (the smallest such chunk_id) for rows (example_id, claim) against contexts (example_id, chunk_id, text)."""
    pairs = rows.join(contexts, "example_id", "left")
    claim, text = _spaced(F.col("claim")), _spaced(F.coalesce("text", F.lit("")))
    mine = judge_tokens(claim)
    share = F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, judge_tokens(text))) / F.nullif(F.size(mine), F.lit(0))).otherwise(0.0)
    inside = (claim != "") & F.contains(text, claim)
    scored = pairs.select("example_id", "claim", "chunk_id", F.when(inside, 2.0).otherwise(share).alias("s"))
    best = scored.groupBy("example_id", "claim").agg(F.max("s").alias("s"), F.min_by("chunk_id", F.struct(-F.col("s"), "chunk_id")).alias("evidence"))
    score = F.when(F.col("s") == 2.0, 1.0).when(F.col("s") >= 0.5, 0.5).otherwise(0.0)
    return best.select("example_id", "claim", score.alias("score"), F.when(F.col("s") > 0, F.col("evidence")).alias("evidence"))


def answer_relevancy(answer: Column, question: Column, reference: Column) -> Column:
    """The share of the question's and reference's tokens that the answer has."""
    target = F.array_union(judge_tokens(question), judge_tokens(reference))
    return F.when((F.size(judge_tokens(answer)) == 0) | (F.size(target) == 0), 0.0).otherwise(F.size(F.array_intersect(judge_tokens(answer), target)) / F.nullif(F.size(target), F.lit(0)))


def relevancy_verdict(score: Column) -> Column:
    return F.when(score >= 0.6, "relevant").when(score >= 0.2, "partially_relevant").otherwise("irrelevant")


def evaluate(records: DataFrame, observations: DataFrame, contexts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row an example: the four metrics and hallucinated (faithfulness below threshold).

    records: example_id, question, reference_answer, domain, supporting_chunk_ids;
    observations: example_id, retrieved_chunk_ids, answer, citation_claims,
    insufficient_context; contexts: example_id, chunk_id, text. Examples must be the same.
    """
    require_none(records.join(observations, "example_id", "left_anti").select("example_id"), "records without observation", EvaluationError)
    require_none(observations.join(records, "example_id", "left_anti").select("example_id"), "observations without record", EvaluationError)
    rows = records.join(observations, "example_id")
    said = rows.select("example_id", F.explode(claims(F.col("answer"), F.col("citation_claims"), F.col("insufficient_context"))).alias("claim"))
    faith = claim_support(said, contexts).groupBy("example_id").agg(F.avg("score").alias("f"))
    out = rows.join(faith, "example_id", "left").withColumn("faithfulness", F.coalesce("f", F.when(F.col("insufficient_context"), 1.0).otherwise(0.0))).drop("f")
    return out.select(
        "example_id", "domain", context_precision(F.col("retrieved_chunk_ids"), F.col("supporting_chunk_ids")).alias("context_precision"), context_recall(F.col("retrieved_chunk_ids"), F.col("supporting_chunk_ids")).alias("context_recall"),
        "faithfulness", answer_relevancy(F.col("answer"), F.col("question"), F.col("reference_answer")).alias("answer_relevancy"), (F.col("faithfulness") < threshold).alias("hallucinated"),
    )


def long_metrics(evaluated: DataFrame) -> DataFrame:
    """A row for each metric and the hallucination flag: metric, score, other columns as they are."""
    rest = [c for c in evaluated.columns if c not in (*METRICS, "hallucinated")]
    entries = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score")) for m in METRICS), F.struct(F.lit("hallucination").alias("metric"), F.col("hallucinated").cast("double").alias("score")))
    return evaluated.select(*rest, F.inline(entries))


def metric_slices(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """count and mean_score by metric and by metric and domain (domain null: over all), in one pass by grouping sets."""
    by = by or []
    sets = [[*map(F.col, by), F.col("metric")], [*map(F.col, by), F.col("metric"), F.col("domain")]]
    return metrics.groupingSets(sets, *by, "metric", "domain").agg(F.count(F.lit(1)).alias("count"), F.avg("score").alias("mean_score"))


def failures(rows: DataFrame) -> DataFrame:
    """example_id, categories of the examples with a failure.

    rows: the metrics, hallucinated, tags, table_required, reranker_error, pipeline,
    cited, context_ids (arrays), insufficient_context.
    """
    tags = F.transform("tags", lambda t: F.replace(F.lower(t), F.lit("-"), F.lit("_")))
    tag = lambda *names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
    lost = F.col("context_recall") < 1.0
    rule = lambda name, holds: F.when(holds, F.lit(name))
    named = F.array_compact(F.array(
        rule("table_fragmentation", F.col("table_required") & lost), rule("vocabulary_mismatch", tag("vocabulary_mismatch") & lost), rule("long_range_reference", tag("long_range_reference", "long_range") & lost),
        rule("retrieval_miss", F.col("context_recall") == 0.0), rule("reranker_error", (F.col("pipeline") == "hybrid_rerank") & (F.col("reranker_error") | tag("reranker_error"))),
        rule("citation_failure", ~F.col("insufficient_context") & ((F.size("cited") == 0) | (F.size(F.array_except("cited", "context_ids")) > 0))), rule("generation_unsupported_claim", F.col("hallucinated")),
    ))
    worse = F.least(*METRICS) < 1.0
    found = rows.withColumn("categories", named).withColumn("categories", F.when((F.size("categories") == 0) & worse, F.array(F.lit("unknown"))).otherwise(F.col("categories")))
    return found.filter(F.size("categories") > 0).select("example_id", "categories")


def failure_histogram(found: DataFrame) -> DataFrame:
    """category, n of failures()."""
    return found.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def observation_violations(records: DataFrame, observations: DataFrame) -> DataFrame:
    """rule, key: why records and observations (both example_id, question) can't be evaluated together: one side alone, an example twice, another question."""
    rule = lambda rows, name: rows.select(F.lit(name).alias("rule"), F.col("example_id").cast("string").alias("key"))
    twice = lambda rows: rows.groupBy("example_id").count().filter("count > 1")
    out = rule(records.join(observations, "example_id", "left_anti"), "without_observation").unionByName(rule(observations.join(records, "example_id", "left_anti"), "without_record"))
    out = out.unionByName(rule(twice(records), "duplicate_record")).unionByName(rule(twice(observations), "duplicate_observation"))
    both = records.select("example_id", F.col("question").alias("q")).join(observations.select("example_id", "question"), "example_id")
    return out.unionByName(rule(both.filter(~F.col("q").eqNullSafe(F.col("question"))), "other_question")).distinct()


#: The form of a judge's output, and its verdicts (fixed values).
JUDGEMENT = "score double, verdict string, rationale string"
VERDICTS = ("supported", "partially_supported", "unsupported", "relevant", "partially_relevant", "irrelevant")


def judgement(output: Column) -> dict[str, Column]:
    """score and verdict of a judge's JSON, and judge_error: null, malformed, unknown_field, missing_field, score_out_of_range or unknown_verdict."""
    r, keys = F.from_json(output, JUDGEMENT), F.json_object_keys(output)
    known = F.array(*(F.lit(f.split()[0]) for f in JUDGEMENT.split(", ")))
    null = r["score"].isNull() | r["verdict"].isNull() | r["rationale"].isNull()
    error = F.when(keys.isNull(), "malformed").when(F.size(F.array_except(keys, known)) > 0, "unknown_field").when(null, "missing_field").when(~r["score"].between(0.0, 1.0), "score_out_of_range").when(~r["verdict"].isin(*VERDICTS), "unknown_verdict")
    return {"score": r["score"], "verdict": r["verdict"], "judge_error": error}


def release_violations(gates: DataFrame, slices: DataFrame) -> DataFrame:
    """config_id, rule: releases that say otherwise than their slices. gates: config_id, passed; slices: metric_slices() by config_id; a release passes if no overall slice fails gate(), and needs a slice of each metric."""
    overall = slices.filter("domain is null")
    fails = gate(overall).groupBy("config_id").agg(F.count(F.lit(1)).alias("failing"))
    held = overall.filter(F.col("metric").isin(*METRICS)).groupBy("config_id").agg(F.count_distinct("metric").alias("metrics"))
    rows = gates.join(fails, "config_id", "left").join(held, "config_id", "left")
    rules = F.array_compact(F.array(
        F.when(F.coalesce("metrics", F.lit(0)) < len(METRICS), "metric_missing"), F.when(F.col("passed") & (F.coalesce("failing", F.lit(0)) > 0), "passed_below_floor"), F.when(~F.col("passed") & F.col("failing").isNull(), "failed_without_cause"),
    ))
    return rows.select("config_id", F.explode(rules).alias("rule"))


def compare_slices(baseline: DataFrame, candidate: DataFrame, thresholds: DataFrame, mode: str = "pr_fast") -> DataFrame:
    """A finding for each threshold (metric, domain, max_drop, min_score, min_samples): status, delta, blocking (pr_fast), alert (nightly_full). Domains match null to null."""
    side = lambda df, p: df.select(F.col("metric").alias(f"{p}_metric"), F.col("domain").alias(f"{p}_domain"), F.col("count").alias(f"{p}_count"), F.col("mean_score").alias(f"{p}_score"))
    on = lambda p: (F.col("metric") == F.col(f"{p}_metric")) & F.col("domain").eqNullSafe(F.col(f"{p}_domain"))
    rows = thresholds.join(side(baseline, "baseline"), on("baseline"), "left").join(side(candidate, "candidate"), on("candidate"), "left")
    b, c = F.col("baseline_count"), F.col("candidate_count")
    delta = F.col("candidate_score") - F.col("baseline_score")
    bad = (delta < -F.col("max_drop")) | F.coalesce(F.col("candidate_score") < F.col("min_score"), F.lit(False))
    few = (b != c) | (b < F.col("min_samples")) | (c < F.col("min_samples"))
    status = F.when(b.isNull() | c.isNull(), "missing_metric").when(few, "sample_size_mismatch").when(bad, "degradation").when(delta > 0, "improvement").otherwise("stable")
    rows = rows.withColumn("status", status)
    violation = ~F.col("status").isin("stable", "improvement")
    return rows.select("metric", "domain", "status", F.when(~F.col("status").isin("missing_metric", "sample_size_mismatch"), delta).alias("delta"), "baseline_count", "candidate_count", (violation & F.lit(mode == "pr_fast")).alias("blocking"), (violation & F.lit(mode == "nightly_full")).alias("alert"))


def domain_winners(metrics: DataFrame) -> DataFrame:
    """config_id, domain, composite (equal mean of the four metrics' means), best (within 1e-12 of the domain's best)."""
    means = metrics.filter(F.col("metric").isin(*METRICS)).groupBy("config_id", "domain", "metric").agg(F.avg("score").alias("m"))
    comp = means.groupBy("config_id", "domain").agg(F.avg("m").alias("composite"))
    return comp.withColumn("best", F.col("composite") >= F.max("composite").over(Window.partitionBy("domain")) - 1e-12)


#: Floors that a release must reach, and the most hallucination (fixed values).
FLOORS = {"context_precision": 0.80, "context_recall": 0.80, "faithfulness": 0.80, "answer_relevancy": 0.70}


def gate(slices: DataFrame, floors: dict[str, float] = FLOORS, most_hallucination: float = 0.34, least: int = 3) -> DataFrame:
    """Overall slices that fail the gate."""
    floor = F.create_map(*(F.lit(x) for k, v in floors.items() for x in (k, v)))[F.col("metric")]
    fails = (F.col("mean_score") < floor) | ((F.col("metric") == "hallucination") & (F.col("mean_score") > most_hallucination)) | (F.col("count") < least)
    return slices.filter(F.col("domain").isNull() & F.coalesce(fails, F.lit(False)))


def pending(configs: DataFrame, examples: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """config_id, example_id still to run: all pairs of the (few) configurations and the examples that have no checkpoint of the same fingerprints; a checkpoint of other fingerprints is an error."""
    todo = examples.select("example_id", "dataset_fingerprint").crossJoin(configs.select("config_id", "config_fingerprint"))
    done = checkpoints.select("config_id", "example_id", F.col("dataset_fingerprint").alias("_d"), F.col("config_fingerprint").alias("_c"))
    rows = todo.join(done, ["config_id", "example_id"], "left")
    other = F.col("_d").isNotNull() & ((F.col("_d") != F.col("dataset_fingerprint")) | (F.col("_c") != F.col("config_fingerprint")))
    require_none(rows.filter(other).select("config_id", "example_id"), "checkpoint of another run", EvaluationError)
    return rows.filter("_d is null").select("config_id", "example_id")
