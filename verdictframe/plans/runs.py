"""Queries over runs and their event logs: stages, durations, summaries, releases, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.functions import rules
from verdictframe.operators import clusters, events, release
from verdictframe.plans.registry import query
from verdictframe.plans.scalars import sql_text
from verdictframe.plans.views import view
from verdictframe.sources.files import list_runs

# pairs of the k-th end with the k-th open start, with DuckDB window functions
FIFO = """
    o AS (SELECT *, CAST(status = 'start' AS INT) AS s, CAST(status <> 'start' AS INT) AS e FROM v_stage_events),
    c AS (SELECT *, sum(s) OVER w AS cs, sum(e) OVER w AS cf FROM o WINDOW w AS (PARTITION BY run_id, stage ORDER BY ts, event_id)),
    x AS (SELECT *, greatest(0, max(cf - cs) OVER (PARTITION BY run_id, stage ORDER BY ts, event_id)) AS orph FROM c),
    y AS (SELECT *, coalesce(lag(orph) OVER (PARTITION BY run_id, stage ORDER BY ts, event_id), 0) AS porph FROM x),
    fifo AS (SELECT a.run_id, a.stage, CAST(a.cs AS BIGINT) AS k, a.event_id AS start_id, b.event_id AS end_id,
                epoch_us(b.ts) - epoch_us(a.ts) AS duration_us
             FROM y a JOIN y b ON a.run_id = b.run_id AND a.stage = b.stage AND a.s = 1 AND b.e = 1 AND b.orph = b.porph
                  AND a.cs = b.cf - b.orph)"""


@query("fifo_durations", f"WITH {FIFO} SELECT run_id, stage, k, start_id, end_id, duration_us FROM fifo", ("v_stage_events",))
def fifo_durations(spark: SparkSession, sf: str) -> DataFrame:
    return events.fifo_durations(view(spark, sf, "v_stage_events"))


@query("top_failure_code", """
    WITH n AS (SELECT run_id, failure_code, count(*) AS n, min(event_id) AS first_id FROM v_stage_events WHERE failure_code <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, first_id) AS rn FROM n)
    SELECT run_id, failure_code AS top_failure_code FROM r WHERE rn = 1""", ("v_stage_events",))
def top_failure_code(spark: SparkSession, sf: str) -> DataFrame:
    return events.top_code(view(spark, sf, "v_stage_events"), ["run_id"], "failure_code", "event_id")


_STAGE_VALUES = ", ".join(f"({i}, {sql_text(a)}, {sql_text(s)}, {sql_text(label)})" for i, (a, s, label) in enumerate(rules.STAGES))


@query("stage_metrics", f"""
    WITH {FIFO},
    d AS (SELECT run_id, stage, sum(duration_us) / count(*) / 1000 AS avg_latency_ms FROM fifo GROUP BY ALL),
    n AS (SELECT run_id, stage, count(*) FILTER (WHERE status = 'start') AS starts, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'fail') AS fail
          FROM v_stage_events GROUP BY ALL),
    fc AS (SELECT run_id, stage, failure_code, count(*) AS n, min((ts, event_id)) AS first_at FROM v_stage_events
           WHERE status = 'fail' AND failure_code <> '' GROUP BY ALL),
    fr AS (SELECT *, row_number() OVER (PARTITION BY run_id, stage ORDER BY n DESC, first_at) AS rn FROM fc),
    stages(position, agent, stage, label) AS (VALUES {_STAGE_VALUES}),
    grid AS (SELECT run_id, stages.* FROM (SELECT DISTINCT run_id FROM v_stage_events), stages WHERE stage <> 'DATA_REQUESTS')
    SELECT g.run_id, g.position, g.agent, g.stage, g.label, coalesce(n.starts, 0) AS input_count, coalesce(ok, 0) AS ok_count,
           coalesce(fail, 0) AS fail_count, avg_latency_ms, fr.failure_code AS top_failure_code
    FROM grid g LEFT JOIN n ON g.run_id = n.run_id AND g.stage = n.stage LEFT JOIN d ON g.run_id = d.run_id AND g.stage = d.stage
         LEFT JOIN fr ON g.run_id = fr.run_id AND g.stage = fr.stage AND fr.rn = 1""", ("v_stage_events",))
def stage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return events.stage_metrics(view(spark, sf, "v_stage_events"))


_FLAGS = """
    g AS (SELECT run_id, count(*) FILTER (WHERE stage = 'GENERATE_ITEM' AND status = 'start') AS gen, count(*) FILTER (WHERE stage = 'QA_GATE' AND status = 'fail') AS qa,
             count(*) FILTER (WHERE stage = 'RUN_MODEL' AND status = 'start') AS model_starts, count(*) FILTER (WHERE stage = 'RUN_MODEL') AS model,
             count(*) FILTER (WHERE stage = 'VERIFY') AS verify, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us
          FROM v_run_events GROUP BY run_id)"""


@query("blocked_runs", f"WITH {_FLAGS} SELECT run_id, qa AS qa_fails FROM g WHERE qa > 0 AND model = 0 AND verify = 0", ("v_run_events",))
def blocked_runs(spark: SparkSession, sf: str) -> DataFrame:
    return events.run_flags(view(spark, sf, "v_run_events")).where("blocked").select("run_id", "qa_fails")


@query("run_summary_rebuild", f"""
    WITH {_FLAGS},
    st AS (SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 0 ELSE items_total END AS items_total,
              CASE WHEN run_id % 2 = 0 THEN 0 ELSE eval_passed END AS eval_passed,
              CASE WHEN run_id % 2 = 0 THEN 0 ELSE failures_total END AS failures_total FROM v_runs WHERE run_id % 3 <> 0),
    rs AS (SELECT l_orderkey AS run_id, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R') AS p FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY l_orderkey),
    a AS (SELECT coalesce(st.run_id, g.run_id, rs.run_id) AS run_id, coalesce(items_total, 0) AS i, coalesce(eval_passed, 0) AS e,
             coalesce(failures_total, 0) AS f, g.* EXCLUDE (run_id), n, p
          FROM st FULL JOIN g ON st.run_id = g.run_id FULL JOIN rs ON coalesce(st.run_id, g.run_id) = rs.run_id),
    b AS (SELECT run_id, CASE WHEN n IS NOT NULL THEN n WHEN i = 0 AND coalesce(gen, 0) > 0 THEN gen ELSE i END AS items_total,
             CASE WHEN n IS NOT NULL THEN p WHEN i = 0 AND coalesce(gen, 0) > 0 THEN 0 ELSE e END AS eval_passed,
             CASE WHEN n IS NOT NULL THEN n - p WHEN i = 0 AND coalesce(gen, 0) > 0 THEN
                  CASE WHEN qa > 0 THEN qa WHEN model_starts = 0 THEN gen ELSE 0 END ELSE f END AS failures_total,
             coalesce(qa > 0 AND model = 0 AND verify = 0, false) AS blocked, first_us, last_us FROM a)
    SELECT *, CASE WHEN items_total > 0 THEN round(eval_passed / items_total, 6) ELSE 0.0::DOUBLE END AS pass_rate FROM b""",
       ("v_run_events", "v_runs"))
def run_summary_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    empty = F.col("run_id") % 2 == 0
    stored = view(spark, sf, "v_runs").where(F.col("run_id") % 3 != 0).select(
        "run_id", *[F.when(empty, 0).otherwise(F.col(c)).alias(c) for c in ("items_total", "eval_passed", "failures_total")]
    )
    results = spark.read.parquet(f"{sf}/lineitem.parquet").where(F.col("l_orderkey") % 5 == 0).select(
        F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") != "R", "pass").otherwise("fail").alias("verdict")
    )
    rebuilt = events.rebuild_summary(stored, view(spark, sf, "v_run_events"), results)
    return rebuilt.select(
        "run_id", "items_total", "eval_passed", "failures_total", "blocked", "pass_rate",
        F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"),
        F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"),
    )


@query("runs_listing", "SELECT run_id, dataset_name, items_total FROM v_runs WHERE items_total <> 0 AND run_id % 23 <> 0", ("v_runs",))
def runs_listing(spark: SparkSession, sf: str) -> DataFrame:
    runs = view(spark, sf, "v_runs").withColumn("dataset_name", F.when(F.col("run_id") % 23 != 0, F.col("dataset_name")))
    return list_runs(runs).select("run_id", "dataset_name", "items_total")


@query("recent_runs", "SELECT run_id, dataset_name, epoch_us(ended_at) AS ended_us FROM v_runs ORDER BY ended_at DESC, run_id DESC LIMIT 50", ("v_runs",))
def recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = view(spark, sf, "v_runs").select("run_id", "dataset_name", F.unix_micros(F.col("ended_at").cast("timestamp")).alias("ended_us"))
    return runs.orderBy(F.col("ended_us").desc(), F.col("run_id").desc()).limit(50)


_PREV = """
    p AS (SELECT *, lag(run_id) OVER w AS prev_run_id, lag(items_total) OVER w AS prev_items, lag(eval_passed) OVER w AS prev_passed,
             lag(failures_total) OVER w AS prev_failures FROM v_runs
          WINDOW w AS (PARTITION BY dataset_name, model_version ORDER BY ended_at, run_id))"""


@query("previous_run", f"WITH {_PREV} SELECT run_id, prev_run_id, prev_passed AS prev_eval_passed FROM p", ("v_runs",))
def previous_run(spark: SparkSession, sf: str) -> DataFrame:
    return release.previous_run(view(spark, sf, "v_runs")).select("run_id", "prev_run_id", "prev_eval_passed")


_DIFF = """
    ct AS (SELECT DISTINCT run_id, error_type FROM v_run_clusters),
    cur AS (SELECT p.run_id, error_type FROM p JOIN ct USING (run_id)),
    prv AS (SELECT p.run_id, error_type FROM p JOIN ct ON p.prev_run_id = ct.run_id),
    diff AS (SELECT coalesce(cur.run_id, prv.run_id) AS run_id, coalesce(cur.error_type, prv.error_type) AS error_type,
                CASE WHEN prv.run_id IS NULL THEN 'introduced' WHEN cur.run_id IS NULL THEN 'recovered' ELSE 'kept' END AS change
             FROM cur FULL JOIN prv ON cur.run_id = prv.run_id AND cur.error_type = prv.error_type)"""


@query("cluster_diff", f"WITH {_PREV}, {_DIFF} SELECT run_id, error_type, change FROM diff", ("v_runs", "v_run_clusters"))
def cluster_diff(spark: SparkSession, sf: str) -> DataFrame:
    paired = release.previous_run(view(spark, sf, "v_runs")).select("run_id", "prev_run_id")
    return release.cluster_diff(paired, view(spark, sf, "v_run_clusters"))


@query("release_decision", f"""
    WITH {_PREV}, {_DIFF},
    n AS (SELECT run_id, count(*) FILTER (WHERE change = 'recovered') AS rec, count(*) FILTER (WHERE change = 'introduced') AS intro FROM diff GROUP BY run_id),
    x AS (SELECT p.*, coalesce(rec, 0) AS rec, coalesce(intro, 0) AS intro,
             CASE WHEN items_total > 0 THEN eval_passed / items_total ELSE 0 END AS rate,
             CASE WHEN prev_items > 0 THEN prev_passed / prev_items ELSE 0 END AS prev_rate FROM p LEFT JOIN n USING (run_id))
    SELECT run_id, CASE WHEN items_total <= 0 OR rate <= 0 THEN 'BLOCKED'
               WHEN prev_run_id IS NULL THEN CASE WHEN failures_total = 0 THEN 'PASS' ELSE 'WATCH' END
               WHEN intro = 0 AND failures_total <= prev_failures AND rate >= prev_rate THEN 'PASS' ELSE 'BLOCKED' END AS gate,
           CASE WHEN items_total > 0 AND prev_run_id IS NOT NULL THEN round(rate - prev_rate, 6) END AS pass_rate_delta,
           CASE WHEN items_total <= 0 THEN 0 ELSE rec END AS n_recovered, intro AS n_introduced FROM x""", ("v_runs", "v_run_clusters"))
def release_decision(spark: SparkSession, sf: str) -> DataFrame:
    return release.release_decision(view(spark, sf, "v_runs"), view(spark, sf, "v_run_clusters")).drop("summary")


_EXAMPLES = """
    x AS (SELECT *, row_number() OVER (PARTITION BY error_type, evidence_code, task_type, eval_method ORDER BY idx) AS rn
          FROM v_results WHERE error_type <> ''),
    ex AS (SELECT idx, item_id, error_type || CASE WHEN evidence_code <> '' THEN '/' || evidence_code ELSE '' END || '|' || task_type
              || '|' || eval_method AS cluster_id FROM x WHERE rn <= 5)"""


def plan_examples(spark: SparkSession, sf: str) -> DataFrame:
    from verdictframe.functions.decide import cluster_id

    top = clusters.top_examples(view(spark, sf, "v_results"))
    return top.select("idx", "item_id", cluster_id(*clusters.KEYS).alias("cluster_id"))


@query("plan_membership", f"WITH {_EXAMPLES} SELECT cluster_id, item_id FROM ex WHERE idx % 2 = 0", ("v_results",))
def plan_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Action plans that name one of the wanted items among their examples."""
    wanted = view(spark, sf, "v_result_items").where("idx % 2 = 0").select("item_id").unionByName(
        view(spark, sf, "v_results").where("idx % 50 = 0").select("item_id")
    )
    return plan_examples(spark, sf).join(wanted, "item_id", "left_semi").select("cluster_id", "item_id")


@query("item_trace_events", """
    SELECT r.idx, e.event_id, e.run_id, e.stage, e.status, e.failure_code
    FROM v_results r JOIN v_run_events e ON e.item_id <> '' AND CAST(split_part(e.item_id, '_', 2) AS BIGINT) = r.idx""", ("v_results", "v_run_events"))
def item_trace_events(spark: SparkSession, sf: str) -> DataFrame:
    """All events of each item as rows; an item with very many is not gathered."""
    log = view(spark, sf, "v_run_events").where("item_id <> ''").select(
        F.split_part("item_id", F.lit("_"), F.lit(2)).cast("bigint").alias("idx"), "event_id", "run_id", "stage", "status", "failure_code"
    )
    return log.join(view(spark, sf, "v_results").select("idx"), "idx")


@query("item_trace", f"""
    WITH {_EXAMPLES},
    ev AS (SELECT CAST(split_part(item_id, '_', 2) AS BIGINT) AS k, count(*) AS n_events, min(event_id) AS first_event, arg_max(stage, event_id) AS last_stage
           FROM v_run_events WHERE item_id <> '' GROUP BY ALL)
    SELECT r.idx, r.item_id, i.task_type, i.difficulty, o.eval_method, r.verdict, r.error_type, r.model_version, ex.cluster_id,
           coalesce(ev.n_events, 0) AS n_events, ev.first_event, ev.last_stage
    FROM v_results r JOIN v_result_items i ON r.item_id = i.item_id JOIN v_result_oracles o ON r.item_id = o.item_id
         LEFT JOIN ex ON ex.idx = r.idx LEFT JOIN ev ON ev.k = r.idx""", ("v_results", "v_result_items", "v_result_oracles", "v_run_events"))
def item_trace(spark: SparkSession, sf: str) -> DataFrame:
    """Everything known about each item: item, oracle, result, plan that shows it, and its events in short."""
    results = view(spark, sf, "v_results").select("idx", "item_id", "verdict", "error_type", "model_version")
    items = view(spark, sf, "v_result_items").select("item_id", "task_type", "difficulty")
    oracles = view(spark, sf, "v_result_oracles").select("item_id", "eval_method")
    log = view(spark, sf, "v_run_events").where("item_id <> ''").groupBy(
        F.split_part("item_id", F.lit("_"), F.lit(2)).cast("bigint").alias("idx")
    ).agg(
        F.count("*").alias("n_events"), F.min("event_id").alias("first_event"), F.max_by("stage", "event_id").alias("last_stage")
    )
    plans = plan_examples(spark, sf).select("idx", "cluster_id")
    full = results.join(items, "item_id").join(oracles, "item_id").join(plans, "idx", "left").join(log, "idx", "left")
    return full.withColumn("n_events", F.coalesce("n_events", F.lit(0)))
