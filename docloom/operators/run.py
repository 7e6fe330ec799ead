"""Evaluation runs that can be resumed: checkpoints as a table, each pair of configuration and example made once."""

from __future__ import annotations

import platform
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import fingerprint
from docloom.errors import EvaluationError
from docloom.operators.corpus import require_none
from docloom.operators.evaluate import pending

CHECKPOINTS = "config_id string, example_id long, dataset_fingerprint string, config_fingerprint string, attempts int, observation string"


def environment(spark: SparkSession, revision: str = "") -> dict[str, str]:
    """What a run's results may depend on besides its inputs."""
    return {"revision": revision, "spark": spark.version, "python": platform.python_version(), "machine": platform.machine(), "system": platform.system()}


def run_id(dataset_fingerprint: str, config_fingerprints: list[str]) -> str:
    return "run_" + fingerprint({"dataset": dataset_fingerprint, "configs": sorted(config_fingerprints)})[:32]


def load(spark: SparkSession, path: str) -> DataFrame:
    """The checkpoints below path; none if there is no such table yet."""
    try:
        return spark.read.schema(CHECKPOINTS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHECKPOINTS)


def resume(configs: DataFrame, examples: DataFrame, produce: Callable[[DataFrame, int], DataFrame], path: str, attempts: int = 3) -> DataFrame:
    """All checkpoints of configs (config_id, config_fingerprint) x examples (example_id, dataset_fingerprint), after making those that path lacks.

    produce gets the pending pairs and the attempt's number, and returns config_id,
    example_id, observation (JSON) of those that succeed; what fails is tried again, up
    to attempts times, and then is an error: a run is whole or none. What succeeded stays
    in path, so a run that starts again makes only the rest. Checkpoints of other
    fingerprints are an error.
    """
    spark = configs.sparkSession
    for attempt in range(1, attempts + 1):
        todo = pending(configs, examples, load(spark, path))
        if todo.isEmpty():
            break
        made = produce(todo, attempt).join(todo, ["config_id", "example_id"], "left_semi")
        rows = made.join(configs.select("config_id", "config_fingerprint"), "config_id").join(examples.select("example_id", "dataset_fingerprint"), "example_id")
        rows.withColumn("attempts", F.lit(attempt)).select(*(f.split()[0] for f in CHECKPOINTS.split(", "))).write.mode("append").parquet(path)
    done = load(spark, path)
    require_none(pending(configs, examples, done), "an example without observation after all attempts", EvaluationError)
    return done.join(configs.select("config_id"), "config_id", "left_semi").join(examples.select("example_id"), "example_id", "left_semi")


def load_evidence(requests: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """by, requests, seconds (from the first to the last) and per_second (null where all came at once)."""
    out = requests.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))).alias("_us"))
    seconds = F.col("_us") / 1_000_000
    return out.select(*by, "requests", seconds.alias("seconds"), (F.col("requests") / F.when(seconds > 0, seconds)).alias("per_second"))
