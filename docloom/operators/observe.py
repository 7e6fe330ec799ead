"""Drift, latencies, histograms, rates, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import Drift
from docloom.operators.chunk import nearest_rank

#: Upper bounds of latency buckets, in seconds (fixed values).
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)


def drift(rows: DataFrame, config: Drift = Drift(), side: str = "side", value: str = "value", order: str | None = None) -> DataFrame:
    """One row from rows whose side is baseline or current: counts, means, extremes, relative_mean_shift, status. order: only the latest config.max_samples of each side count."""
    if order:
        w = Window.partitionBy(side).orderBy(F.desc(order))
        rows = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= config.max_samples)
    part = lambda name: [f(F.when(F.col(side) == name, F.col(value))).alias(f"{name}_{k}") for k, f in (("count", F.count), ("mean", F.avg), ("min", F.min), ("max", F.max))]
    out = rows.agg(*part("baseline"), *part("current"))
    enough = (F.col("baseline_count") >= config.min_samples) & (F.col("current_count") >= config.min_samples)
    shift = F.when(enough, F.abs(F.col("current_mean") - F.col("baseline_mean")) / F.greatest(F.abs("baseline_mean"), F.lit(1e-12)))
    out = out.withColumn("relative_mean_shift", shift)
    status = F.when(~enough, "insufficient_data").when(F.col("relative_mean_shift") > config.relative_shift_threshold, "potential_shift").otherwise("stable")
    return out.fillna(0.0, [c for c in out.columns if c.endswith(("_mean", "_min", "_max"))]).withColumn("status", status)


def latency_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, min, mean, nearest-rank p50, p95, p99, max; a negative latency is an error."""
    v = F.when(F.col(value) >= 0, F.col(value)).otherwise(F.raise_error(F.lit("negative latency")).cast("double"))
    plain = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.min(v).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return plain.join(nearest_rank(rows, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), by)


def histogram(rows: DataFrame, by: list[str], value: str, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """by, le (null: unbounded), cumulative: counts of values at or below each bound. One aggregation, a column a bound, then turned to rows."""
    counts = rows.groupBy(*by).agg(*(F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(buckets)), F.count(F.lit(1)).alias("_all"))
    entries = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cumulative")) for i, b in enumerate(buckets)), F.struct(F.lit(None).cast("double").alias("le"), F.col("_all").alias("cumulative")))
    return counts.select(*by, F.inline(entries))


def bucket_quantile(hist: DataFrame, by: list[str], q: float) -> DataFrame:
    """by and the q quantile of a histogram(), interpolated within its bucket; the last bound beyond it."""
    w = Window.partitionBy(*by).orderBy(F.col("le").asc_nulls_last())
    rows = hist.withColumns({"below": F.coalesce(F.lag("cumulative").over(w), F.lit(0)), "low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "total": F.max("cumulative").over(Window.partitionBy(*by))})
    hit = rows.filter((F.col("cumulative") >= q * F.col("total")) & (F.col("below") < q * F.col("total")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (q * F.col("total") - F.col("below")) / F.nullif(F.col("cumulative") - F.col("below"), F.lit(0))
    return hit.select(*by, F.when(F.col("le").isNull(), F.col("low")).otherwise(inside).alias("quantile"))


def rate_windows(events: DataFrame, by: list[str], every: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """window_start, by, n, per_second of events in tumbling windows."""
    w = F.window(ts, every)
    out = events.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", (F.col("n") / (F.unix_timestamp("w.end") - F.unix_timestamp("w.start"))).alias("per_second"))


def rate_limited(requests: DataFrame, limit: int = 120, every: str = "60 seconds", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """requests with allowed: the first limit of each key in a tumbling window."""
    w = Window.partitionBy(key, F.window(ts, every)["start"]).orderBy(ts)
    return requests.withColumn("allowed", F.row_number().over(w) <= limit)


def rate_limited_exact(requests: DataFrame, limit: int = 120, seconds: int = 60, key: str = "user_id", ts: str = "ts", order: str = "ts") -> DataFrame:
    """requests (key, ts, order) with allowed: the first limit of each window, which begins with a key's first request after the window before has ended.

    A window's begin depends on all before, so it is carried along a key's requests by
    an aggregate over their times: no UDF. Keys' requests are gathered, so a key's
    number of requests bounds the memory; rate_limited() needs none.
    """
    us = F.collect_list(F.struct(F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(order).alias("o")))
    rows = requests.groupBy(key).agg(F.array_sort(us).alias("r"))
    state = F.struct(F.lit(-(1 << 62)).cast("long").alias("first"), F.lit(0).alias("k"), F.array().cast("array<boolean>").alias("ok"))
    step = lambda s, x: F.struct(
        F.when(x["t"] - s["first"] >= seconds * 1_000_000, x["t"]).otherwise(s["first"]).alias("first"),
        F.when(x["t"] - s["first"] >= seconds * 1_000_000, 1).otherwise(s["k"] + 1).alias("k"),
        F.concat(s["ok"], F.array(F.when(x["t"] - s["first"] >= seconds * 1_000_000, F.lit(limit >= 1)).otherwise(s["k"] + 1 <= limit))).alias("ok"),
    )
    done = rows.select(key, F.arrays_zip("r", F.aggregate("r", state, step)["ok"].alias("ok")).alias("z"))
    return done.select(key, F.explode("z").alias("z")).select(key, F.timestamp_micros("z.r.t").alias("ts"), F.col("z.r.o").alias("order"), F.col("z.ok").alias("allowed"))


def hit_ratio(lookups: DataFrame, hit: str, every: str = "5 minutes", ts: str = "ts") -> DataFrame:
    """window_start, hits, ratio of hits to lookups in tumbling windows; the divisor is at least 1e-9."""
    out = lookups.groupBy(F.window(ts, every).alias("w")).agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "hits", (F.col("hits") / F.greatest(F.col("n"), F.lit(1e-9))).alias("ratio"))


def bounded_label(value: Column, allowed: tuple[str, ...], other: str = "other") -> Column:
    return F.when(value.isin(*allowed), value).otherwise(other)


def redacted(question: Column) -> dict[str, Column]:
    """What a trace keeps of a question: its digest and length."""
    return {"query_sha256": F.sha2(question.cast("binary"), 256), "query_length": F.length(question)}


def without_secrets(message: Column) -> Column:
    """A log message with the values of keys that look secret replaced."""
    return F.regexp_replace(message, r"(?i)((?:api[_-]?key|token|secret|password|authorization)[\"']?\s*[:=]\s*[\"']?)[^\s\"',}]+", "$1[REDACTED]")


def cache_key(request: Column) -> Column:
    """SHA-256 of a struct's JSON, nulls included, its fields in the order given (pass them sorted)."""
    return F.sha2(F.to_json(request, {"ignoreNullFields": "false"}), 256)
