"""Comparison of a run with the one before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.rules import RELEASE_TEXTS
from verdictframe.operators.ordered import previous_row, range_blocks
from verdictframe.session import materialize

COMPARABLE = ("dataset_name", "model_version")


def previous_run(runs: DataFrame, by: Sequence[str] = COMPARABLE, blocks: int | None = None) -> DataFrame:
    """Add the latest strictly earlier run of the same data set and model, as ``prev_*`` columns."""
    values = ["run_id", "items_total", "eval_passed", "failures_total"]
    found = previous_row(range_blocks(runs, by, ["ended_at", "run_id"], blocks), by, ["ended_at", "run_id"], values)
    return found.select(*runs.columns, *[F.col(f"previous.{v}").alias(f"prev_{v}") for v in values])


def cluster_diff(runs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Error types that appeared or went away since the previous run, one row per type and run.

    ``runs`` has run_id and prev_run_id (null when there is none).
    """
    # of the largest table; written once, since a run's types are read for it and for the run after it
    types = materialize(clusters.select("run_id", "error_type").distinct(), "types")
    now = runs.select("run_id").join(types, "run_id").withColumn("in_current", F.lit(True))
    before = (
        runs.where(F.col("prev_run_id").isNotNull())
        .select(F.col("run_id").alias("_run"), F.col("prev_run_id").alias("run_id"))
        .join(types, "run_id")
        .select(F.col("_run").alias("run_id"), "error_type", F.lit(True).alias("in_previous"))
    )
    both = now.join(before, ["run_id", "error_type"], "full_outer")
    return both.select(
        "run_id",
        "error_type",
        F.when(F.col("in_previous").isNull(), "introduced").when(F.col("in_current").isNull(), "recovered").otherwise("kept").alias("change"),
    )


def release_decision(runs: DataFrame, clusters: DataFrame, blocks: int | None = None) -> DataFrame:
    """Gate PASS, WATCH or BLOCKED per run, pass-rate delta, counts of recovered and introduced types."""
    paired = materialize(previous_run(runs, blocks=blocks), "paired")
    changes = cluster_diff(paired.select("run_id", "prev_run_id"), clusters).groupBy("run_id").agg(
        F.count_if(F.col("change") == "recovered").alias("n_recovered"),
        F.count_if(F.col("change") == "introduced").alias("n_introduced"),
        F.count_if(F.col("change") != "recovered").alias("n_current"),
    )

    def rate(passed: str, items: str):
        return F.when(F.col(items) > 0, F.col(passed) / F.col(items)).otherwise(0.0)

    now, before = rate("eval_passed", "items_total"), rate("prev_eval_passed", "prev_items_total")
    first = F.col("prev_run_id").isNull()
    recovered, introduced, current = (
        F.coalesce(F.col(c), F.lit(0)) for c in ("n_recovered", "n_introduced", "n_current")
    )
    empty, below = F.col("items_total") <= 0, now <= 0
    better = (introduced == 0) & (F.col("failures_total") <= F.col("prev_failures_total")) & (now >= before)
    clean = F.col("failures_total") == 0
    gate = (
        F.when(empty | below, "BLOCKED").when(first & clean, "PASS").when(first, "WATCH")
        .when(better, "PASS").otherwise("BLOCKED")
    )
    text = (
        F.when(empty, RELEASE_TEXTS["empty"]).when(below, RELEASE_TEXTS["below"])
        .when(first & clean, RELEASE_TEXTS["first_clean"]).when(first, RELEASE_TEXTS["first_failing"])
        .when(better, RELEASE_TEXTS["better"]).otherwise(RELEASE_TEXTS["worse"])
    )
    return paired.join(changes, "run_id", "left").select(
        "run_id",
        gate.alias("gate"),
        F.when(~empty & ~first, F.round(now - before, 6)).alias("pass_rate_delta"),
        F.when(empty, 0).otherwise(recovered).cast("bigint").alias("n_recovered"),
        F.when(empty, current).otherwise(introduced).cast("bigint").alias("n_introduced"),
        text.alias("summary"),
    )
