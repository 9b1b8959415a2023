"""Experiment runs kept as tables: parameters, metrics, states, searches."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TIMING_COLUMNS
from .counters import ERROR_SUFFIX
from .numbering import ordered_by

RUN = ["run_id", "experiment_id"]
FINISHED, FAILED = "FINISHED", "FAILED"

# Names of the parameters and metrics of a run that made an answer.
RUN_PARAMS = ["original_product_name", "original_product_category"]
RUN_METRICS = ["output_product_count", "chat_history_length", "response_length_chars", "generation_time_seconds", "success"]

T = TypeVar("T")


def param_rows(runs: DataFrame, params: list[str]) -> DataFrame:
    """Wide run rows to (run_id, experiment_id, key, value)."""
    texts = runs.select(*RUN, *[F.col(p).cast("string").alias(p) for p in params])
    return texts.unpivot(RUN, params, "key", "value")


def metric_rows(runs: DataFrame, metrics: list[str], step: str = "step", ts: str = "ts") -> DataFrame:
    """Wide run rows to (run_id, experiment_id, key, value, step, ts); nulls are not logged."""
    kept = [*RUN, step, ts]
    numbers = runs.select(*kept, *[F.col(m).cast("double").alias(m) for m in metrics])
    rows = numbers.unpivot(kept, metrics, "key", "value").filter(F.col("value").isNotNull())
    number = F.coalesce(F.col(step).cast("int"), F.lit(0))  # metrics without a step belong to step 0
    return rows.select(*RUN, "key", "value", number.alias("step"), F.col(ts).alias("ts"))


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def ensure_experiments(existing: DataFrame, names: DataFrame) -> DataFrame:
    """(experiment_id, name): what exists plus the names that are new.

    The id of a new experiment is a hash of its name, so concurrent jobs agree on it.
    """
    wanted = names.select("name").distinct()
    new = wanted.join(existing, "name", "left_anti")
    return existing.select("experiment_id", "name").unionByName(
        new.select(F.md5("name").alias("experiment_id"), "name")
    )


def run_states(attempts: DataFrame) -> DataFrame:
    """Latest state per run from (run_id, ts, error) rows."""
    failed = F.col("error").isNotNull().cast("int")
    last = attempts.groupBy("run_id").agg(
        F.max_by(failed, ordered_by(F.unix_micros("ts"), failed)).alias("failed"), F.max("ts").alias("ended_at")
    )
    return last.select("run_id", F.when(F.col("failed") == 1, FAILED).otherwise(FINISHED).alias("status"), "ended_at")


def logged_at() -> Column:
    """The order metric values were logged in: by step, then by time."""
    return ordered_by(F.col("step"), F.unix_micros("ts"))


def search_runs(
    metrics: DataFrame, experiment_id: str, keys: list[str], runs: DataFrame | None = None,
    params: DataFrame | None = None, param_keys: list[str] | None = None,
) -> DataFrame:
    """One row per run of the experiment with the latest value of each named metric.

    With ``runs`` (run_id, experiment_id, status, ...) every run has a row, whether it
    logged a metric or not, with all its columns; with ``params`` a column per named
    parameter is added.  The keys are known, so a pivot is one aggregate and one shuffle.
    """

    def latest(key: str) -> Column:
        here = F.col("key") == key
        return F.max_by(F.when(here, F.col("value")), F.when(here, logged_at())).alias(key)

    here = F.col("experiment_id") == experiment_id
    found = metrics.filter(here).groupBy("run_id").agg(*[latest(k) for k in keys])
    if runs is None:
        return found
    rows = runs.filter(here).join(found, "run_id", "left")
    if params is None:
        return rows
    texts = params.filter(here).groupBy("run_id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in param_keys or []])
    return rows.join(texts, "run_id", "left")


def best_of(found: DataFrame, key: str, ascending: bool = False) -> DataFrame:
    """The whole row of the best run that ``search_runs`` found; equal values go to the lowest run id."""
    value = F.col(key).asc() if ascending else F.col(key).desc()
    return found.filter(F.col(key).isNotNull()).orderBy(value, "run_id").limit(1)


def best_run(metrics: DataFrame, experiment_id: str, key: str, ascending: bool = False) -> DataFrame:
    """The run whose latest value of ``key`` is best; no row if nothing was logged.

    Equal values go to the lowest run id.
    """
    latest = (
        metrics.filter((F.col("experiment_id") == experiment_id) & (F.col("key") == key))
        .groupBy("run_id")
        .agg(F.max_by("value", logged_at()).alias("value"))
    )
    distance = F.col("value") if ascending else -F.col("value")
    best = F.min_by(F.struct("run_id", "value"), F.struct(distance, F.col("run_id")))
    return latest.agg(best.alias("best")).filter(F.col("best").isNotNull()).select("best.run_id", "best.value")


def recommendation_runs(responses: DataFrame, no_text: str) -> DataFrame:
    """Wide run rows of generated answers.

    ``responses`` has (query_id, text, images, product_count, history_length,
    generation_s, error).  A failed answer records its error and success 0.
    """
    failed = F.col("error").isNotNull()
    return responses.select(
        F.col("query_id").cast("string").alias("run_id"),
        F.when(failed, F.lit("recommendation_generation_failed")).otherwise(F.lit("recommendation_generation")).alias("run_name"),
        F.when(~failed, F.col("product_count")).alias("output_product_count"),
        F.when(~failed, F.col("history_length")).alias("chat_history_length"),
        F.when(~failed, F.char_length("text")).alias("response_length_chars"),
        F.col("generation_s").alias("generation_time_seconds"),
        F.when(failed | (F.col("text") == no_text), 0.0).otherwise(1.0).alias("success"),
        "error",
        *[c for c in RUN_PARAMS if c in responses.columns],
    )


def timed(spark: SparkSession, query_type: str, path: str, job: Callable[[], T]) -> T:
    """Run a batch job and append (query_type, duration_s, outcome, ts) to a table.

    A job that raises is recorded under the type with the error suffix, then raises.
    """
    began = time.time()
    kind, outcome = query_type, "ok"
    try:
        return job()
    except Exception:
        kind, outcome = query_type + ERROR_SUFFIX, "error"
        raise
    finally:
        row = spark.createDataFrame([(kind, time.time() - began, outcome)], TIMING_COLUMNS)
        row.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(path)
