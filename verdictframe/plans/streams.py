"""Queries that run the event log through Structured Streaming and return what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.plans.registry import query
from verdictframe.plans.runs import FIFO
from verdictframe.plans.views import table
from verdictframe.session import scratch_path
from verdictframe.streaming import live

_STAGE = "CASE WHEN event_type IN ('click', 'purchase', 'error') THEN 'VERIFY' ELSE 'GENERATE_ITEM' END"
_STATUS = "CASE WHEN event_type IN ('click', 'view') THEN 'start' WHEN event_type = 'error' THEN 'fail' ELSE 'ok' END"


BATCHES = 3
#: Windows of event time that state is held for.
WIDTH = "1 day"


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event log as it would arrive: parts in time order, each a batch of its own."""
    log, folder = table(spark, sf, "events"), scratch_path(spark, "feed")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = log.select(F.percentile_approx(at, [i / BATCHES for i in range(1, BATCHES)])).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda b: b < at))
    # each part is as many files as the log has partitions, and a batch takes as many: a part is a batch, and spread
    files = log.rdd.getNumPartitions()
    for i in range(BATCHES):
        log.where(part == i).repartition(files).write.parquet(f"{folder}/part={i}")
    return live.read_stream(spark, f"{folder}/part=*", log.schema, files_per_trigger=files).select(
        "event_id", F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.expr(_STAGE).alias("stage"), F.expr(_STATUS).alias("status"),
    )


@query("stream_stage_counts", """
    SELECT run_id, stage, count(*) FILTER (WHERE status = 'start') AS starts, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'fail') AS fail
    FROM v_stage_events GROUP BY ALL""", ("v_stage_events",))
def stream_stage_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = live.stage_counters(event_stream(spark, sf), width=WIDTH)
    return live.merge_counters(live.run_to_table(counts, "update", ["run_id", "stage", live.WINDOW], "counts"))


@query("stream_progress", """
    SELECT run_id, arg_max(stage, (ts, event_id)) AS stage, arg_max(status, (ts, event_id)) AS status,
           arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_events FROM v_stage_events GROUP BY run_id""", ("v_stage_events",))
def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    latest = live.progress(event_stream(spark, sf), width=WIDTH)
    return live.merge_progress(live.run_to_table(latest, "update", ["run_id", live.WINDOW], "progress"))


@query("stream_dedup", "SELECT user_id AS run_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_stream(spark, sf).select("run_id", "event_id", "ts")
    first = live.first_seen(rows, "run_id", "event_id", width=WIDTH)
    found = live.run_to_table(first, "update", ["run_id", live.WINDOW], "dedup")
    return live.merge_first_seen(found, "run_id", "event_id").select("run_id", "event_id")


@query("stream_fifo", f"WITH {FIFO} SELECT run_id, stage, start_id, end_id, duration_us FROM fifo", ("v_stage_events",))
def stream_fifo(spark: SparkSession, sf: str) -> DataFrame:
    return live.fifo_stream(event_stream(spark, sf)).select("run_id", "stage", "start_id", "end_id", "duration_us")


@query("stream_failure_rate", """
    SELECT epoch_us(date_trunc('hour', ts)) AS window_us, count(*) AS n_ended, count(*) FILTER (WHERE status = 'fail') AS n_failed
    FROM v_stage_events WHERE status <> 'start' GROUP BY ALL""", ("v_stage_events",))
def stream_failure_rate(spark: SparkSession, sf: str) -> DataFrame:
    rates = live.run_to_table(live.failure_rate(event_stream(spark, sf)), "update", ["window_start"], "rate")
    return rates.select(F.unix_micros("window_start").alias("window_us"), "n_ended", "n_failed")
