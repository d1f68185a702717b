"""Run event log: stage metrics, start/end pairing, rebuilt summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.functions import rules
from verdictframe.operators.ordered import range_blocks, running_sums

STAGE_KEY = ("run_id", "stage")


def fifo_durations(events: DataFrame, key: Sequence[str] = STAGE_KEY, blocks: int | None = None) -> DataFrame:
    """Pair the k-th end of a stage with its k-th open start, first in, first out.

    With s starts and e ends seen so far, the ends that found no open start number
    ``greatest(0, max(e - s))``; the others are the first, second, ... paired end. Running counts
    are taken over blocks, so one run may own most of the log. Ends without a start are left out.
    """
    is_start = (F.col("status") == "start").cast("bigint")
    is_end = F.col("status").isin("ok", "fail").cast("bigint")
    rows = events.where(F.col("ts").isNotNull() & F.col("status").isin("start", "ok", "fail")).select(
        *key, "event_id", "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    )
    order = ["at", "event_id"]
    counted = running_sums(
        range_blocks(rows, key, order, blocks),
        list(key),
        order,
        sums={"starts": is_start, "ends": is_end},
        maxes={"excess": ("ends", "starts")},
    )
    orphans_before = F.greatest(F.lit(0), F.col("excess"))
    orphan = F.col("ends") - F.col("starts") > orphans_before
    starts = counted.where(F.col("status") == "start").select(
        *key, F.col("starts").alias("k"), F.col("at").alias("started"), F.col("event_id").alias("start_id")
    )
    ends = counted.where((F.col("status") != "start") & ~orphan).select(
        *key, (F.col("ends") - orphans_before).alias("k"), F.col("at").alias("ended"), F.col("event_id").alias("end_id")
    )
    return starts.join(ends, [*key, "k"]).select(
        *key, "k", "start_id", "end_id", (F.col("ended") - F.col("started")).alias("duration_us")
    )


def top_code(events: DataFrame, key: Sequence[str], code: str, idx: str, where=None) -> DataFrame:
    """Most common non-empty code per key; ties go to the code seen first."""
    rows = events.where(F.coalesce(code, F.lit("")) != "")
    if where is not None:
        rows = rows.where(where)
    counts = rows.groupBy(*key, code).agg(F.count("*").alias("_n"), F.min(idx).alias("_first"))
    best = counts.groupBy(*key).agg(F.min_by(code, F.struct((-F.col("_n")).alias("n"), "_first")).alias("top_failure_code"))
    return best


def stage_counts(events: DataFrame, key: Sequence[str] = STAGE_KEY) -> DataFrame:
    """Starts of any time stamp; ok and fail events need a readable one."""
    timed = F.col("ts").isNotNull()
    return events.groupBy(*key).agg(
        F.count_if(F.col("status") == "start").alias("starts"),
        F.count_if((F.col("status") == "ok") & timed).alias("ok"),
        F.count_if((F.col("status") == "fail") & timed).alias("fail"),
    )


def stage_metrics(events: DataFrame, results: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """Per run and stage: input, ok and fail counts, mean duration, top failure code.

    Every run gets all stages, except DATA_REQUESTS when the run never reached it. Stages of the run
    itself count one input when they ended without a start. VERIFY falls back to the error types of
    the results when no event names a failure code.
    """
    counts = stage_counts(events)
    mean = fifo_durations(events, blocks=blocks).groupBy(*STAGE_KEY).agg(
        (F.sum("duration_us") / F.count("*") / F.lit(1000)).alias("avg_latency_ms")
    )
    ordered = events.withColumn("_at", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id"))
    top = top_code(ordered, STAGE_KEY, "failure_code", "_at", F.col("status") == "fail")
    stages = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(a).alias("agent"), F.lit(s).alias("stage"), F.lit(label).alias("label"))
            for i, (a, s, label) in enumerate(rules.STAGES)
        ]
    )
    seen = counts.groupBy("run_id").agg(F.bool_or(F.col("stage") == "DATA_REQUESTS").alias("_requests"))
    grid = seen.select("run_id", "_requests", F.inline(stages)).where((F.col("stage") != "DATA_REQUESTS") | F.col("_requests"))
    full = (
        grid.join(counts, list(STAGE_KEY), "left")
        .join(mean, list(STAGE_KEY), "left")
        .join(top, list(STAGE_KEY), "left")
    )
    starts, ok, fail = (F.coalesce(F.col(c), F.lit(0)) for c in ("starts", "ok", "fail"))
    code = F.col("top_failure_code")
    if results is not None:
        errors = top_code(results, ["run_id"], "error_type", "idx").withColumnRenamed("top_failure_code", "_error")
        full = full.join(errors, "run_id", "left")
        code = F.coalesce(code, F.when(F.col("stage") == "VERIFY", F.col("_error")))
    inputs = F.when(F.col("stage").isin(*rules.RUN_LEVEL_STAGES) & (starts == 0) & (ok + fail > 0), 1).otherwise(starts)
    return full.select(
        "run_id", "position", "agent", "stage", "label",
        inputs.cast("bigint").alias("input_count"),
        ok.alias("ok_count"),
        fail.alias("fail_count"),
        "avg_latency_ms",
        code.alias("top_failure_code"),
    )


def run_flags(events: DataFrame) -> DataFrame:
    """Per run: what the log says about its stages. Blocked = failed QA and never reached the model."""
    stage, status = F.col("stage"), F.col("status")
    return events.groupBy("run_id").agg(
        F.count_if((stage == "GENERATE_ITEM") & (status == "start")).alias("generate_starts"),
        F.count_if((stage == "QA_GATE") & (status == "fail")).alias("qa_fails"),
        F.count_if((stage == "RUN_MODEL") & (status == "start")).alias("model_starts"),
        F.bool_or(stage == "RUN_MODEL").alias("has_model"),
        F.bool_or(stage == "VERIFY").alias("has_verify"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    ).withColumn("blocked", (F.col("qa_fails") > 0) & ~F.col("has_model") & ~F.col("has_verify"))


def rebuild_summary(stored: DataFrame, events: DataFrame, results: DataFrame) -> DataFrame:
    """Run summary from the best source at hand: results, else events, else the stored counts."""
    flags = run_flags(events)
    counted = results.groupBy("run_id").agg(
        F.count("*").alias("_n"), F.count_if(F.col("verdict") == "pass").alias("_passed")
    )
    all_runs = stored.join(flags, "run_id", "full_outer").join(counted, "run_id", "full_outer")
    items, passed, failed = (F.coalesce(F.col(c), F.lit(0)) for c in ("items_total", "eval_passed", "failures_total"))
    from_events = (items == 0) & (F.coalesce("generate_starts", F.lit(0)) > 0)
    event_failures = (
        F.when(F.col("qa_fails") > 0, F.col("qa_fails")).when(F.col("model_starts") == 0, F.col("generate_starts")).otherwise(0)
    )
    has_results = F.col("_n").isNotNull()
    rebuilt = all_runs.select(
        "run_id",
        F.when(has_results, F.col("_n")).when(from_events, F.col("generate_starts")).otherwise(items).cast("bigint").alias("items_total"),
        F.when(has_results, F.col("_passed")).when(from_events, 0).otherwise(passed).cast("bigint").alias("eval_passed"),
        F.when(has_results, F.col("_n") - F.col("_passed")).when(from_events, event_failures).otherwise(failed).cast("bigint").alias("failures_total"),
        F.coalesce("blocked", F.lit(False)).alias("blocked"),
        "first_ts",
        "last_ts",
    )
    return rebuilt.withColumn(
        "pass_rate",
        F.when(F.col("items_total") > 0, F.round(F.col("eval_passed") / F.col("items_total"), 6)).otherwise(F.lit(0.0)),
    )
