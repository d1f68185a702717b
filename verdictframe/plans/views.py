"""Evaluation tables derived from the driver tables.

The text of a view is shared by both engines: ``@table`` names a driver table and ``@k`` the
integer field ``k`` of an event's JSON properties.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from verdictframe.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

CLOSED_ANSWER = (
    '{"type":"object","additionalProperties":false,"required":["answer"],"properties":{"answer":{"type":"integer"}}}'
)
OPEN_ANSWER = '{"type":"object","required":["answer"],"properties":{"answer":{"type":"integer","maximum":1500}}}'

VIEWS: dict[str, str] = {
    # evaluation items and their oracles, one per document
    "v_items": """
        SELECT doc_id AS idx,
               CASE WHEN doc_id % 9 = 0 THEN 'Item ' ELSE 'item_' END || lpad(CAST(doc_id AS STRING), 12, '0') AS item_id,
               text AS prompt, lang AS domain_tag, source AS family_id,
               'bp_' || source || '_' || CAST(doc_id % 3 AS STRING) AS blueprint_id,
               CASE WHEN n_chars < 500 THEN 'easy' WHEN n_chars < 2000 THEN 'medium'
                    WHEN n_chars < 8000 THEN 'hard' ELSE 'expert' END AS difficulty,
               CASE doc_id % 4 WHEN 0 THEN 'json_extract_email' WHEN 1 THEN 'json_classify_sentiment'
                    WHEN 2 THEN 'trajectory_email_then_answer' ELSE 'factual_grounded_qa' END AS task_type,
               CASE doc_id % 6 WHEN 0 THEN 'exact_match' WHEN 1 THEN 'programmatic_check' WHEN 2 THEN 'trajectory_check'
                    WHEN 3 THEN 'schema_check' WHEN 4 THEN 'rubric_judge' ELSE
                    CASE WHEN doc_id % 5 = 0 THEN 'unit_test' ELSE 'exact_match' END END AS eval_method,
               CASE WHEN doc_id % 10 = 4 THEN NULL WHEN doc_id % 10 = 6 THEN '{}'
                    ELSE '{"required_evidence":["reasoning"]}' END AS evidence_requirements,
               CASE doc_id % 11 WHEN 0 THEN '{}' WHEN 1 THEN '{"type":"object"}'
                    WHEN 2 THEN '{"type":"object","properties":{"note":{"type":"string"}}}'
                    ELSE '{"type":"object","required":["answer"],"properties":{"answer":{"type":"string"}}}' END
                    AS output_schema,
               doc_id % 13 <> 0 AS leak_passed
        FROM @documents""",
    # integer-addition responses
    "v_math": """
        SELECT l_orderkey, l_linenumber, l_partkey AS a, l_suppkey AS b,
               CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_linenumber AS BIGINT) END AS c,
               l_orderkey + l_linenumber AS h, l_returnflag AS flag,
               CASE WHEN (l_orderkey + l_linenumber) % 17 = 0 THEN 'oops'
                    WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN '{"answer":"x"}'
                    ELSE '{"answer":' || CAST(l_partkey + l_suppkey
                         + CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber ELSE 0 END
                         + CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN 1 ELSE 0 END AS STRING) || '}'
               END AS raw_output
        FROM @lineitem""",
    # evaluation results, one per event
    "v_results": """
        SELECT event_id AS idx, 'ev_' || lpad(CAST(event_id AS STRING), 10, '0') AS item_id,
               'run_' || CAST(user_id % 20 AS STRING) AS run_id, event_type AS task_type,
               CAST(floor(value) AS BIGINT) AS latency_ms, ts AS created_at,
               CASE WHEN event_type = 'error' OR @k % 10 = 0 THEN 'fail' ELSE 'pass' END AS verdict,
               CASE WHEN event_type = 'error' THEN 'TRAJECTORY_CHECK_FAILED'
                    WHEN @k % 10 = 0 THEN 'EXACT_MATCH_FAILED' ELSE '' END AS error_type,
               CASE WHEN event_type <> 'error' THEN '' WHEN @k % 3 = 0 THEN 'TOOL_BINDING_MISMATCH'
                    WHEN @k % 3 = 1 THEN 'TOOL_ARGS_SCHEMA_FAILED' ELSE '' END AS evidence_code,
               CASE @k % 3 WHEN 0 THEN 'exact_match' WHEN 1 THEN 'programmatic_check'
                    ELSE 'trajectory_check' END AS eval_method,
               CASE WHEN @k % 2 = 0 THEN 'bindings mismatch: seen' ELSE 'arg_schema failed for tool' END AS message,
               'm' || CAST(user_id % 3 AS STRING) AS model_version
        FROM @events""",
    "v_result_items": """
        SELECT event_id AS idx, 'ev_' || lpad(CAST(event_id AS STRING), 10, '0') AS item_id, event_type AS task_type,
               CASE @k % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'expert' END AS difficulty,
               'team_' || CAST(user_id % 4 AS STRING) AS tag1, 'topic_' || CAST(@k % 5 AS STRING) AS tag2
        FROM @events WHERE event_id % 50 <> 0""",
    "v_result_oracles": """
        SELECT event_id AS idx, 'ev_' || lpad(CAST(event_id AS STRING), 10, '0') AS item_id,
               CASE @k % 3 WHEN 0 THEN 'exact_match' WHEN 1 THEN 'programmatic_check'
                    ELSE 'trajectory_check' END AS eval_method
        FROM @events WHERE event_id % 70 <> 1""",
    # event log of long runs: one run per user, two stages
    "v_stage_events": """
        SELECT event_id, user_id AS run_id, ts,
               CASE WHEN event_type IN ('click', 'purchase', 'error') THEN 'VERIFY' ELSE 'GENERATE_ITEM' END AS stage,
               CASE WHEN event_type IN ('click', 'view') THEN 'start' WHEN event_type = 'error' THEN 'fail'
                    ELSE 'ok' END AS status,
               CASE WHEN event_type <> 'error' THEN ''
                    ELSE 'CODE_' || CAST(@k % 4 AS STRING) END AS failure_code
        FROM @events""",
    # event log of short runs that pass through five stages
    "v_run_events": """
        SELECT event_id, CAST(floor(event_id / 4) AS BIGINT) AS run_id, ts,
               CASE @k % 5 WHEN 0 THEN 'GENERATE_ITEM' WHEN 1 THEN 'QA_GATE' WHEN 2 THEN 'RUN_MODEL'
                    WHEN 3 THEN 'VERIFY' ELSE 'QA_GATE' END AS stage,
               CASE WHEN event_type IN ('click', 'view') THEN 'start' WHEN event_type = 'error' THEN 'fail'
                    WHEN event_type = 'signup' THEN 'fail' ELSE 'ok' END AS status,
               CASE WHEN event_type = 'error' THEN 'DUPLICATE_ITEM' WHEN event_type = 'signup' THEN 'SCHEMA_INVALID'
                    ELSE '' END AS failure_code,
               CASE WHEN @k % 7 = 0 THEN '' ELSE 'item_' || CAST(@k AS STRING) END AS item_id
        FROM @events""",
    # tool-call traces in long form
    "v_traces": "SELECT conv_id AS item_id, turn AS seq, role AS name, text AS payload FROM @conversations",
    # two judges and an arbiter per labelled document
    "v_judges": """
        SELECT l.doc_id AS item_id, d.n_chars,
               CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'pass' ELSE 'fail' END AS verdict_1,
               CASE WHEN l.quality = 1 AND l.toxic = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS score_1,
               CASE WHEN d.n_chars >= 500 THEN 'pass' ELSE 'fail' END AS verdict_2,
               CASE WHEN d.n_chars >= 4000 THEN CAST(0.95 AS DOUBLE) WHEN d.n_chars >= 500 THEN CAST(0.8 AS DOUBLE)
                    ELSE CAST(0.2 AS DOUBLE) END AS score_2,
               CASE WHEN l.doc_id % 17 = 0 THEN NULL WHEN l.toxic = 0 THEN 'pass' ELSE 'fail' END AS verdict_3,
               CAST(0.5 AS DOUBLE) AS score_3,
               CASE WHEN l.doc_id % 19 = 0 THEN NULL ELSE '{"required_evidence":["reasoning"]}' END
                    AS evidence_requirements
        FROM @labels l JOIN @documents d ON l.doc_id = d.doc_id""",
    # evaluated runs, one per order
    "v_runs": """
        SELECT o.o_orderkey AS run_id, o.o_orderpriority AS dataset_name,
               'm' || CAST(o.o_custkey % 10 AS STRING) AS model_version, o.o_orderdate AS ended_at,
               CAST(coalesce(l.items_total, 0) AS BIGINT) AS items_total,
               CAST(coalesce(l.eval_passed, 0) AS BIGINT) AS eval_passed,
               CAST(coalesce(l.items_total - l.eval_passed, 0) AS BIGINT) AS failures_total
        FROM @orders o LEFT JOIN (
            SELECT l_orderkey, count(*) AS items_total,
                   sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS eval_passed
            FROM @lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey""",
    # failing line items give each run its failure clusters
    "v_run_clusters": """
        SELECT l_orderkey AS run_id, CASE l_linenumber % 4 WHEN 0 THEN 'EXACT_MATCH_FAILED'
               WHEN 1 THEN 'PROGRAMMATIC_CHECK_FAILED' WHEN 2 THEN 'TRAJECTORY_CHECK_FAILED'
               ELSE 'MODEL_OUTPUT_NOT_JSON' END AS error_type
        FROM @lineitem WHERE l_returnflag = 'R'""",
    # run records arriving more than once per run
    "v_run_log": """
        SELECT o_custkey AS run_id, o_orderkey AS seq, o_orderdate AS ended_at, 'm' || CAST(o_orderkey % 7 AS STRING)
               AS model_version, o_orderkey % 40 AS items_total, (o_orderkey % 40) - (o_orderkey % 5) AS eval_passed
        FROM @orders""",
    # capability targets, one per part
    "v_targets": """
        SELECT p_partkey AS idx, p_partkey AS target_id, p_brand AS family_id, p_type AS task_type,
               CAST(p_size AS BIGINT) AS quota_weight,
               CAST(CASE WHEN p_partkey % 13 = 5 THEN NULL WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS min_count,
               CAST(CASE WHEN p_partkey % 97 = 3 THEN NULL ELSE p_partkey % 7 END AS BIGINT) AS max_count
        FROM @part""",
    # multi-field extraction, one per customer
    "v_structured": """
        SELECT c_custkey AS idx, c_name AS exp_name, c_mktsegment AS exp_segment,
               '{' || '"name":"' || CASE WHEN c_custkey % 5 = 0 THEN c_name || 'X'
                                         WHEN c_custkey % 3 = 0 THEN '  ' || c_name || ' ' ELSE c_name END || '"'
                   || CASE WHEN c_custkey % 7 = 0 THEN ''
                           ELSE ',"segment":" ' || lower(c_mktsegment) || '"' END
                   || CASE WHEN c_custkey % 11 = 0 THEN ',"extra":1' ELSE '' END || '}' AS raw_output
        FROM @customer""",
    # label classification, one per order
    "v_canon": """
        SELECT o_orderkey AS idx, o_orderpriority AS exp_label,
               CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN lower(o_orderpriority)
                    WHEN 2 THEN ' ' || o_orderpriority || ' ' ELSE '1-URGENT' END AS label
        FROM @orders""",
    # model responses as they arrive over the wire
    "v_envelope": """
        SELECT event_id AS idx, CASE WHEN @k % 20 = 0 THEN 500 ELSE 200 END AS status_code,
               CASE WHEN @k % 15 = 0 THEN 'gateway text'
                    WHEN @k % 14 = 0 THEN '{"output":"plain ' || CAST(@k AS STRING) || '","model_version":"m9"}'
                    ELSE '{"output":{"k":' || CAST(@k AS STRING) || '},"model_version":"m'
                         || CAST(user_id % 3 AS STRING) || '","latency_ms":' || CAST(CAST(floor(value) AS BIGINT) AS STRING)
                         || '}' END AS body
        FROM @events""",
}

_K = {"spark": "CAST(get_json_object(props, '$.k') AS BIGINT)", "duckdb": "CAST(props->>'$.k' AS BIGINT)"}


def _text(name: str, engine: str, sf_dir: str = "") -> str:
    text = re.sub(r"@k\b", lambda _: _K[engine], VIEWS[name])
    for table in TABLES:
        target = f"parquet.`{sf_dir}/{table}.parquet`" if engine == "spark" else table
        text = re.sub(rf"@{table}\b", lambda _: target, text)
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """A derived table; ``wide`` spreads small scans over all cores before heavy per-row work."""
    text = _text(name, "spark", sf_dir.rstrip("/"))
    if wide:
        for source in TABLES:
            path = f"parquet.`{sf_dir.rstrip('/')}/{source}.parquet`"
            if path in text:
                alias = f"wide_{source}_{abs(hash(path))}"
                spread(table(spark, sf_dir, source)).createOrReplaceTempView(alias)
                text = text.replace(path, alias)
    return spark.sql(text)


def duckdb_with(uses: tuple[str, ...], sql: str) -> str:
    if not uses:
        return sql.strip()
    ctes = ",\n".join(f"{u} AS ({_text(u, 'duckdb').strip()})" for u in uses)
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"
