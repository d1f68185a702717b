"""Queries over evaluation results: joins, slices, clusters, requests, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.functions import rules
from verdictframe.operators import clusters, metrics
from verdictframe.plans.registry import query
from verdictframe.plans.scalars import sql_case, sql_text
from verdictframe.plans.views import table, view

JOINED = """
    j AS (SELECT r.idx, r.item_id, r.run_id, r.verdict, r.latency_ms, i.task_type, i.difficulty, i.tag1, i.tag2, o.eval_method
          FROM v_results r JOIN v_result_items i ON r.item_id = i.item_id JOIN v_result_oracles o ON r.item_id = o.item_id)"""
JOIN_VIEWS = ("v_results", "v_result_items", "v_result_oracles")
_RATES = "count(*) AS n, count(*) FILTER (WHERE verdict = 'pass') AS n_pass, round(count(*) FILTER (WHERE verdict = 'pass') / count(*), 4) AS pass_rate"


def joined(spark: SparkSession, sf: str) -> DataFrame:
    results = view(spark, sf, "v_results").select("idx", "item_id", "run_id", "verdict", "latency_ms")
    items = view(spark, sf, "v_result_items").select(
        "item_id", "task_type", "difficulty", F.array("tag1", "tag2").alias("domain_tags")
    )
    return metrics.join_results(results, items, view(spark, sf, "v_result_oracles").select("item_id", "eval_method"))


@query("join_results", f"WITH {JOINED} SELECT idx, item_id, verdict, task_type, difficulty, eval_method FROM j", JOIN_VIEWS)
def join_results(spark: SparkSession, sf: str) -> DataFrame:
    return joined(spark, sf).select("idx", "item_id", "verdict", "task_type", "difficulty", "eval_method")


@query("join_results_last_wins", """
    WITH i AS (SELECT item_id, arg_max(difficulty, place) AS difficulty FROM (
            SELECT item_id, difficulty, idx AS place FROM v_result_items
            UNION ALL SELECT item_id, 'again', idx + 1000000000 FROM v_result_items WHERE idx % 4 = 1) GROUP BY item_id)
    SELECT r.idx, r.item_id, r.verdict, i.difficulty, o.eval_method
    FROM v_results r JOIN i ON r.item_id = i.item_id JOIN v_result_oracles o ON r.item_id = o.item_id""", JOIN_VIEWS)
def join_results_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth item and every oracle comes twice."""
    items = view(spark, sf, "v_result_items").select("item_id", "difficulty", F.col("idx").alias("place"))
    again = items.where("place % 4 = 1").select("item_id", F.lit("again").alias("difficulty"), F.col("place") + 1_000_000_000)
    oracles = view(spark, sf, "v_result_oracles").select("item_id", "eval_method", F.col("idx").alias("place"))
    results = view(spark, sf, "v_results").select("idx", "item_id", "verdict")
    joined_once = metrics.join_results(results, items.union(again), oracles.union(oracles), ["place"])
    return joined_once.select("idx", "item_id", "verdict", "difficulty", "eval_method")


def _slice_query(column: str) -> None:
    @query(f"slice_{column}", f"WITH {JOINED} SELECT {column} AS slice_value, {_RATES} FROM j GROUP BY {column}", JOIN_VIEWS)
    def one_slice(spark: SparkSession, sf: str) -> DataFrame:
        return metrics.slice_by(joined(spark, sf), column)


for _c in ("task_type", "difficulty", "eval_method"):
    _slice_query(_c)


@query("slice_domain_tag", f"""
    WITH {JOINED}, t AS (SELECT verdict, tag1 AS slice_value FROM j UNION ALL SELECT verdict, tag2 FROM j)
    SELECT slice_value, {_RATES} FROM t GROUP BY slice_value""", JOIN_VIEWS)
def slice_domain_tag(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.slice_by_tag(joined(spark, sf))


@query("slice_all", f"""
    WITH {JOINED}, t AS (SELECT verdict, 'task_type' AS slice, task_type AS slice_value FROM j
        UNION ALL SELECT verdict, 'difficulty', difficulty FROM j UNION ALL SELECT verdict, 'eval_method', eval_method FROM j
        UNION ALL SELECT verdict, 'domain_tags', tag1 FROM j UNION ALL SELECT verdict, 'domain_tags', tag2 FROM j)
    SELECT slice, slice_value, {_RATES} FROM t GROUP BY ALL""", JOIN_VIEWS)
def slice_all(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.slice_all(joined(spark, sf), ["task_type", "difficulty", "eval_method"])


@query("latency_trunc", """
    SELECT run_id, CAST(floor(quantile_cont(latency_ms, 0.5)) AS BIGINT) AS p50,
           CAST(floor(quantile_cont(latency_ms, 0.9)) AS BIGINT) AS p90 FROM v_results GROUP BY run_id""", ("v_results",))
def latency_trunc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.latency_percentiles(view(spark, sf, "v_results"), ["run_id"])


@query("latency_round", """
    SELECT CAST(round_even(quantile_cont(latency_ms, 0.5), 0) AS BIGINT) AS p50,
           CAST(round_even(quantile_cont(latency_ms, 0.9), 0) AS BIGINT) AS p90 FROM v_results""", ("v_results",))
def latency_round(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.latency_percentiles(view(spark, sf, "v_results"), rounding="bankers")


@query("qa_throughput", """
    SELECT count(*) FILTER (WHERE stage = 'GENERATE_ITEM' AND status = 'start') AS attempted, count(*) FILTER (WHERE stage = 'VERIFY' AND status = 'ok') AS evaluated,
           count(*) FILTER (WHERE stage = 'QA_GATE' AND status = 'fail' AND failure_code <> 'DISTRIBUTION_MISMATCH') AS aborted FROM v_run_events""",
       ("v_run_events",))
def qa_throughput(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.qa_throughput(view(spark, sf, "v_run_events")).drop("qa_failed")


@query("run_metrics", """
    WITH e AS (SELECT CAST(split_part(item_id, '_', 2) AS BIGINT) AS idx, stage, status, failure_code FROM v_run_events WHERE item_id <> ''),
    q AS (SELECT r.run_id, count(*) FILTER (WHERE stage = 'GENERATE_ITEM' AND status = 'start') AS attempted,
                 count(*) FILTER (WHERE stage = 'QA_GATE' AND status = 'fail') AS qa_failed,
                 count(*) FILTER (WHERE stage = 'QA_GATE' AND status = 'fail' AND failure_code <> 'DISTRIBUTION_MISMATCH') AS aborted
          FROM e JOIN v_results r ON r.idx = e.idx GROUP BY ALL),
    m AS (SELECT run_id, count(*) AS items_total, count(*) FILTER (WHERE verdict = 'pass') AS eval_passed, count(*) FILTER (WHERE verdict = 'fail') AS failures_total
          FROM v_results GROUP BY run_id)
    SELECT run_id, items_total, eval_passed, failures_total, coalesce(attempted, 0) AS attempted, coalesce(qa_failed, 0) AS qa_failed, coalesce(aborted, 0) AS aborted
    FROM m LEFT JOIN q USING (run_id)""", ("v_results", "v_run_events"))
def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Events count for the run that their item's result belongs to."""
    results = view(spark, sf, "v_results").select("idx", "run_id", "verdict")
    log = view(spark, sf, "v_run_events").where("item_id <> ''").select(
        F.split_part("item_id", F.lit("_"), F.lit(2)).cast("bigint").alias("idx"), "stage", "status", "failure_code"
    )
    return metrics.run_metrics(results, ["run_id"], log.join(results.select("idx", "run_id"), "idx"))


@query("model_versions", """
    WITH v AS (SELECT DISTINCT user_id, 'm' || (event_id % 1000) // 990 AS model_version FROM events)
    SELECT user_id, string_agg(model_version, ',' ORDER BY model_version) AS model_versions,
           CASE WHEN count(*) = 1 THEN min(model_version) ELSE 'mixed' END AS model_version FROM v GROUP BY user_id""")
def model_versions(spark: SparkSession, sf: str) -> DataFrame:
    version = F.concat(F.lit("m"), F.floor(F.col("event_id") % 1000 / 990))
    return metrics.model_versions(table(spark, sf, "events").select("user_id", version.alias("model_version")), ["user_id"])


_N = """n AS (SELECT error_type, evidence_code, task_type, eval_method, count(*) AS n, min(idx) AS first_idx
              FROM v_results WHERE error_type <> '' GROUP BY ALL)"""


@query("failure_clusters", f"""
    WITH {_N}, t AS (SELECT count(*) AS total FROM v_results),
    r AS (SELECT *, row_number() OVER (ORDER BY n DESC, first_idx) AS rank FROM n)
    SELECT rank, error_type || CASE WHEN evidence_code <> '' THEN '/' || evidence_code ELSE '' END || '|' || task_type || '|' || eval_method
           AS cluster_id, n, CASE WHEN error_type = 'EXACT_MATCH_FAILED' THEN 'model'
             WHEN evidence_code = 'TOOL_ARGS_SCHEMA_FAILED' THEN 'tooling' WHEN evidence_code = 'TOOL_BINDING_MISMATCH' THEN 'model'
             ELSE 'eval' END AS owner,
           CASE WHEN n / total >= 0.3 OR n >= 10 THEN 1 WHEN n / total >= 0.1 OR n >= 3 THEN 2 ELSE 3 END AS priority
    FROM r, t""", ("v_results",))
def failure_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.failure_clusters(view(spark, sf, "v_results")).select("rank", "cluster_id", "n", "owner", "priority")


@query("cluster_members", f"""
    WITH {_N}, r AS (SELECT *, row_number() OVER (ORDER BY n DESC, first_idx) AS rank FROM n)
    SELECT v.error_type || CASE WHEN v.evidence_code <> '' THEN '/' || v.evidence_code ELSE '' END || '|' || v.task_type || '|' || v.eval_method
           AS cluster_id, v.idx, v.item_id FROM v_results v JOIN r USING (error_type, evidence_code, task_type, eval_method)""", ("v_results",))
def cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    results = view(spark, sf, "v_results")
    return clusters.cluster_members(results, clusters.failure_clusters(results))


@query("topk_clusters", f"""
    WITH n AS (SELECT run_id, error_type, evidence_code, task_type, eval_method, count(*) AS n, min(idx) AS first_idx
               FROM v_results WHERE error_type <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, first_idx) AS rank FROM n)
    SELECT run_id, rank, error_type, evidence_code, task_type, eval_method, n FROM r WHERE rank <= 3""", ("v_results",))
def topk_clusters(spark: SparkSession, sf: str) -> DataFrame:
    counts = clusters.cluster_counts(view(spark, sf, "v_results"), ["run_id"])
    top = clusters.top_rows(counts, ["run_id"], [F.col("n").desc(), "first_idx"], 3)
    return top.select("run_id", "rank", *clusters.KEYS, "n")


@query("pass_cluster", f"""
    WITH f AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 25)
    SELECT e.user_id, CASE WHEN f.user_id IS NULL THEN 'PASS' ELSE 'TRAJECTORY_CHECK_FAILED' END AS cluster_id,
           CASE WHEN f.user_id IS NULL THEN 4 ELSE CASE WHEN n / total >= 0.3 OR n >= 10 THEN 1
                WHEN n / total >= 0.1 OR n >= 3 THEN 2 ELSE 3 END END AS priority,
           CASE WHEN f.user_id IS NULL THEN 0 ELSE n END AS n
    FROM (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error' AND value > 25) AS n FROM events GROUP BY user_id) e
    LEFT JOIN f USING (user_id)""")
def pass_cluster(spark: SparkSession, sf: str) -> DataFrame:
    failed = (F.col("event_type") == "error") & (F.col("value") > 25)
    results = table(spark, sf, "events").select(
        "user_id", F.col("event_id").alias("idx"), F.when(failed, "TRAJECTORY_CHECK_FAILED").otherwise("").alias("error_type"),
        *[F.lit("").alias(c) for c in ("evidence_code", "task_type", "eval_method")],
    )
    found = clusters.failure_clusters(results, ["user_id"])
    return clusters.with_pass_cluster(found, results, ["user_id"]).select("user_id", "cluster_id", "priority", "n")


_OWNER_SQL = {k: v[0] for k, v in rules.OWNER_BY_ERROR.items()}


@query("clusters_by_error", f"""
    WITH f AS (SELECT run_id, CASE WHEN error_type = '' THEN 'UNKNOWN_FAILURE' ELSE error_type END AS error_type, idx, item_id,
                  row_number() OVER (PARTITION BY run_id, error_type ORDER BY idx) AS rn FROM v_results WHERE verdict <> 'pass')
    SELECT run_id, error_type, count(*) AS n, string_agg(CASE WHEN rn <= 10 THEN item_id END, ',' ORDER BY idx) AS sample_item_ids,
           {sql_case("error_type", _OWNER_SQL, sql_text(rules.DEFAULT_OWNER[0]))} AS owner FROM f GROUP BY run_id, error_type""", ("v_results",))
def clusters_by_error(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.clusters_by_error(view(spark, sf, "v_results"), ["run_id"]).drop("recommended_action")


@query("clusters_from_events", f"""
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY failure_code ORDER BY CASE WHEN item_id = '' THEN 1 ELSE 0 END, event_id) AS rn
               FROM v_run_events WHERE stage = 'QA_GATE' AND status = 'fail')
    SELECT failure_code AS error_type, count(*) AS n,
           string_agg(CASE WHEN rn <= 10 AND item_id <> '' THEN item_id END, ',' ORDER BY event_id) AS sample_item_ids,
           {sql_case("failure_code", _OWNER_SQL, sql_text(rules.DEFAULT_OWNER[0]))} AS owner FROM f GROUP BY failure_code""", ("v_run_events",))
def clusters_from_events(spark: SparkSession, sf: str) -> DataFrame:
    events = view(spark, sf, "v_run_events").withColumnRenamed("event_id", "idx")
    return clusters.clusters_from_events(events, []).drop("recommended_action")


@query("top_examples", """
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY error_type, evidence_code, task_type, eval_method ORDER BY idx) AS example
               FROM v_results WHERE error_type <> '')
    SELECT error_type, evidence_code, task_type, eval_method, item_id, example FROM f WHERE example <= 5""", ("v_results",))
def top_examples(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.top_examples(view(spark, sf, "v_results")).drop("idx")


@query("cluster_representative", """
    WITH n AS (SELECT run_id, error_type, evidence_code, task_type, eval_method, count(*) AS n, min(idx) AS first_idx
               FROM v_results WHERE error_type <> '' GROUP BY ALL)
    SELECT n.*, v.item_id AS rep_item_id, v.message AS rep_message FROM n JOIN v_results v ON first_idx = v.idx""", ("v_results",))
def cluster_representative(spark: SparkSession, sf: str) -> DataFrame:
    results = view(spark, sf, "v_results")
    return clusters.cluster_counts(results, ["run_id"], carry=["item_id", "message"]).drop("last_idx")


@query("enrich_clusters", f"""
    WITH {_N}, r AS (SELECT *, row_number() OVER (ORDER BY n DESC, first_idx) AS rank FROM n)
    SELECT rank, CASE WHEN rank % 2 = 0 THEN 'note ' || first_idx END AS title,
           CASE WHEN rank % 2 = 0 THEN 'cause ' || first_idx ELSE '' END AS cause,
           CASE WHEN rank % 2 = 0 THEN 'tooling' WHEN error_type = 'EXACT_MATCH_FAILED' THEN 'model'
             WHEN evidence_code = 'TOOL_ARGS_SCHEMA_FAILED' THEN 'tooling' WHEN evidence_code = 'TOOL_BINDING_MISMATCH' THEN 'model'
             ELSE 'eval' END AS owner FROM r""", ("v_results",))
def enrich_clusters(spark: SparkSession, sf: str) -> DataFrame:
    found = clusters.failure_clusters(view(spark, sf, "v_results"))
    analyst = found.where(F.col("rank") % 2 == 0).select(
        "cluster_id",
        F.concat(F.lit("note "), "first_idx").alias("title"),
        F.concat(F.lit("cause "), "first_idx").alias("likely_root_cause"),
        F.lit("Tool team").alias("owner"),
    )
    named = clusters.enrich_clusters(found, analyst)
    cause = F.when(F.col("title").isNotNull(), F.col("hypothesis")).otherwise("")
    return named.select("rank", "title", cause.alias("cause"), "owner")


_REQUEST_VALUES = ", ".join(
    f"({sql_text(r[0])}, {r[1]}, {sql_text(r[2])}, {sql_text(r[3])})"
    for r in {rule[1][0]: rule[1] for rule in rules.DATA_REQUESTS[:7]}.values()
)
_ISSUE = """CASE WHEN error_type = 'EXACT_MATCH_FAILED' THEN 'LABEL_OR_FIELD_VALUE_WRONG'
              WHEN evidence_code = 'TOOL_BINDING_MISMATCH' THEN 'TOOL_RESULT_IGNORED_OR_HALLUCINATION'
              WHEN evidence_code = 'TOOL_ARGS_SCHEMA_FAILED' THEN 'TOOL_ARGS_BAD'
              WHEN contains(message, 'bindings mismatch') THEN 'TOOL_RESULT_IGNORED_OR_HALLUCINATION'
              WHEN contains(message, 'arg_schema failed') THEN 'TOOL_ARGS_BAD' ELSE 'MISSING_OR_WRONG_TOOL_SEQUENCE' END"""
REQUESTS_SQL = f"""
    n AS (SELECT run_id, error_type, evidence_code, task_type, eval_method, count(*) AS n, min(idx) AS first_idx
          FROM v_results WHERE error_type <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, first_idx) AS rank FROM n),
    i AS (SELECT r.run_id, r.rank, r.error_type || CASE WHEN r.evidence_code <> '' THEN '/' || r.evidence_code ELSE '' END || '|'
              || r.task_type || '|' || r.eval_method AS cluster_id, {_ISSUE.replace("error_type", "r.error_type").replace("evidence_code", "r.evidence_code")} AS issue_type
          FROM r JOIN v_results v ON v.idx = first_idx),
    v(issue_type, priority, owner_type, what_to_collect) AS (VALUES {_REQUEST_VALUES}),
    q AS (SELECT run_id, issue_type, min(rank) AS position, arg_max(cluster_id, rank) AS cluster_id FROM i GROUP BY ALL)"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    results = view(spark, sf, "v_results")
    return clusters.data_requests(clusters.failure_clusters(results, ["run_id"], carry=["message"]), ["run_id"])


@query("data_requests", f"""
    WITH {REQUESTS_SQL} SELECT run_id, position, issue_type, cluster_id, priority, owner_type, what_to_collect FROM q JOIN v USING (issue_type)""",
       ("v_results",))
def data_requests(spark: SparkSession, sf: str) -> DataFrame:
    return requests(spark, sf).select(
        "run_id", "position", "issue_type", "cluster_id", "priority", "owner_type", "what_to_collect"
    )


@query("request_fallback", f"""
    SELECT idx, {_ISSUE} AS issue_type FROM v_results WHERE error_type <> ''""", ("v_results",))
def request_fallback(spark: SparkSession, sf: str) -> DataFrame:
    from verdictframe.functions.decide import data_request

    failed = view(spark, sf, "v_results").where(F.col("error_type") != "")
    return failed.select("idx", data_request("error_type", "evidence_code", "task_type", "message")["issue_type"].alias("issue_type"))


@query("requests_by_issue", f"WITH {REQUESTS_SQL} SELECT issue_type, count(*) AS n FROM q GROUP BY issue_type", ("v_results",))
def requests_by_issue(spark: SparkSession, sf: str) -> DataFrame:
    return requests(spark, sf).groupBy("issue_type").agg(F.count("*").alias("n"))


@query("duplicate_counts", """
    WITH d AS (SELECT CASE WHEN idx % 4 = 0 THEN '(unknown)' ELSE family_id END AS f, blueprint_id AS b, task_type AS m FROM v_items WHERE idx % 3 = 0)
    SELECT 'family_id' AS dimension, f AS value, count(*) AS n FROM d GROUP BY f
    UNION ALL SELECT 'blueprint_id', b, count(*) FROM d GROUP BY b
    UNION ALL SELECT 'materializer_type', m, count(*) FROM d GROUP BY m""", ("v_items",))
def duplicate_counts(spark: SparkSession, sf: str) -> DataFrame:
    reports = view(spark, sf, "v_items").select(
        F.when(F.col("idx") % 4 != 0, F.col("family_id")).alias("family_id"), "blueprint_id",
        F.col("task_type").alias("materializer_type"),
        F.when(F.col("idx") % 3 == 0, "DUPLICATE_ITEM").otherwise("").alias("failure_code"),
    )
    return clusters.duplicate_counts(reports)


@query("regression_gate", """
    WITH g AS (SELECT user_id % 200 AS suite, value < 90 AS ok, event_type, CAST(props->>'$.k' AS BIGINT) AS k FROM events)
    SELECT suite, count(*) AS n, round(count(*) FILTER (WHERE ok) / count(*), 6) AS pass_rate, count(*) FILTER (WHERE NOT ok AND k % 9 = 0) AS critical_hits,
           count(*) FILTER (WHERE ok) / count(*) >= 0.95 AND count(*) FILTER (WHERE NOT ok AND k % 9 = 0) = 0 AS passed FROM g GROUP BY suite""")
def regression_gate(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("value") < 90
    k = F.get_json_object("props", "$.k").cast("bigint")
    results = table(spark, sf, "events").select(
        (F.col("user_id") % 200).alias("suite"),
        F.when(ok, "pass").otherwise("fail").alias("verdict"),
        F.when(ok, "").when(k % 9 == 0, "TRAJECTORY_CHECK_FAILED").otherwise("EXACT_MATCH_FAILED").alias("error_type"),
    )
    return metrics.regression_gate(results, ["suite"])


@query("critical_intersect", f"""
    SELECT DISTINCT run_id, error_type FROM v_results WHERE error_type IN ({", ".join(map(sql_text, rules.CRITICAL_FAILURE_CODES))})""",
       ("v_results",))
def critical_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.critical_codes(view(spark, sf, "v_results"), ["run_id"])


@query("gate_composite", """
    WITH s AS (SELECT run_id, bool_and(verdict = 'pass' OR error_type = 'EXACT_MATCH_FAILED') AS scenarios_met,
                  count(*) FILTER (WHERE verdict = 'pass') / count(*) AS rate, count(*) FILTER (WHERE error_type = 'TRAJECTORY_CHECK_FAILED') AS hits FROM v_results GROUP BY run_id)
    SELECT run_id, scenarios_met, rate >= 0.5 AND hits = 0 AS regression_passed, scenarios_met AND rate >= 0.5 AND hits = 0 AS passed FROM s""",
       ("v_results",))
def gate_composite(spark: SparkSession, sf: str) -> DataFrame:
    results = view(spark, sf, "v_results")
    met = (F.col("verdict") == "pass") | (F.col("error_type") == "EXACT_MATCH_FAILED")
    scenarios = results.groupBy("run_id").agg(F.bool_and(met).alias("scenarios_met"))
    regression = metrics.regression_gate(results, ["run_id"], 0.5).select("run_id", F.col("passed").alias("regression_passed"))
    return scenarios.join(regression, "run_id").withColumn("passed", F.col("scenarios_met") & F.col("regression_passed"))


@query("failures_only", "SELECT idx, item_id, error_type FROM v_results WHERE verdict = 'fail'", ("v_results",))
def failures_only(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_results").where("verdict = 'fail'").select("idx", "item_id", "error_type")


@query("latest_by_key", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ended_at DESC, seq DESC) AS rn FROM v_run_log)
    SELECT run_id, seq, model_version, items_total, eval_passed FROM r WHERE rn = 1""", ("v_run_log",))
def latest_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.latest_by_key(view(spark, sf, "v_run_log"), ["run_id"], ["ended_at", "seq"]).drop("ended_at")


@query("slice_evidence", """
    SELECT conv_id, string_agg(CASE WHEN turn < 3 THEN role END, ',' ORDER BY turn) AS first_three FROM conversations GROUP BY conv_id""")
def slice_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """At most three messages per item, cut before they are gathered."""
    top = clusters.top_rows(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], 3)
    return top.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ",").alias("first_three")
    )


@query("data_card", """
    SELECT 'documents' AS dataset_name, '1.0.0' AS dataset_spec_version, count(*) || ' synthetic items across domains ['
           || (SELECT string_agg(domain_tag, ', ' ORDER BY domain_tag) FROM (SELECT DISTINCT domain_tag FROM v_items)) || '].' AS composition
    FROM v_items""", ("v_items",))
def data_card(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.data_card(view(spark, sf, "v_items").select("domain_tag"), "documents", "1.0.0")
