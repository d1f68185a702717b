"""Queries that score responses: schema, checkers, trajectories, judges, the router."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.operators import clusters, scoring, trajectory, verify
from verdictframe.operators.rubric import accept_mean, judge_evidence, rubric_outcome
from verdictframe.plans.registry import query
from verdictframe.plans.scalars import sql_text
from verdictframe.plans.views import CLOSED_ANSWER, OPEN_ANSWER, table, view
from verdictframe.session import spread

# code of each addition response, with DuckDB's own JSON functions
MATH_CODES = """
    answered AS (SELECT *, CASE WHEN json_valid(raw_output) THEN json_type(raw_output, '$.answer') END AS kind,
                 CASE WHEN json_valid(raw_output) THEN json_extract_string(raw_output, '$.answer') END AS answer FROM v_math),
    coded AS (SELECT *, CASE WHEN NOT json_valid(raw_output) THEN 'MODEL_OUTPUT_NOT_JSON'
                             WHEN kind NOT IN ('UBIGINT', 'BIGINT') THEN 'MODEL_OUTPUT_SCHEMA_VIOLATION'
                             WHEN try_cast(answer AS BIGINT) <> a + b + coalesce(c, 0) THEN 'PROGRAMMATIC_CHECK_FAILED'
                             ELSE '' END AS error_type FROM answered)"""


def score_math(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_math", wide=True).withColumn("output_schema", F.lit(CLOSED_ANSWER))
    checked = scoring.schema_check(rows)
    answer = F.try_variant_get("parsed", "$.answer", "bigint")
    result = scoring.math_sum(F.col("a"), F.col("b"), F.col("c"), answer)
    error = F.when(F.col("schema_error") != "", F.col("schema_error")).otherwise(result["code"])
    return checked.withColumn("error_type", error)


@query("verify_math", f"""
    WITH {MATH_CODES}
    SELECT l_orderkey, l_linenumber, a, b, error_type, CASE WHEN error_type = '' THEN 'pass' ELSE 'fail' END AS verdict,
           CASE WHEN error_type = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM coded""", ("v_math",))
def verify_math(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("error_type") == ""
    return score_math(spark, sf).select(
        "l_orderkey", "l_linenumber", "a", "b", "error_type",
        F.when(ok, "pass").otherwise("fail").alias("verdict"), F.when(ok, 1.0).otherwise(0.0).alias("score"),
    )


@query("math_failure_report", f"""
    WITH {MATH_CODES},
    n AS (SELECT error_type, flag AS task_type, count(*) AS n FROM coded WHERE error_type <> '' GROUP BY ALL),
    t AS (SELECT count(*) AS total FROM coded)
    SELECT error_type, task_type, n, CASE WHEN n / total >= 0.3 OR n >= 10 THEN 1 WHEN n / total >= 0.1 OR n >= 3 THEN 2
           ELSE 3 END AS priority,
           CASE error_type WHEN 'PROGRAMMATIC_CHECK_FAILED' THEN 'model' ELSE 'product' END AS owner FROM n, t""", ("v_math",))
def math_failure_report(spark: SparkSession, sf: str) -> DataFrame:
    results = score_math(spark, sf).select(
        "error_type",
        F.lit("").alias("evidence_code"),
        F.col("flag").alias("task_type"),
        F.lit("programmatic_check").alias("eval_method"),
        F.col("h").alias("idx"),
    )
    return clusters.failure_clusters(results).select("error_type", "task_type", "n", "priority", "owner")


@query("verify_schema", """
    SELECT l_orderkey, l_linenumber, a, b,
           CASE WHEN NOT json_valid(raw_output) THEN 'MODEL_OUTPUT_NOT_JSON'
                WHEN json_type(raw_output, '$.answer') NOT IN ('UBIGINT', 'BIGINT') THEN 'MODEL_OUTPUT_SCHEMA_VIOLATION'
                WHEN l_linenumber % 2 = 0 AND try_cast(json_extract_string(raw_output, '$.answer') AS BIGINT) > 1500
                THEN 'MODEL_OUTPUT_SCHEMA_VIOLATION' ELSE '' END AS schema_error,
           CASE WHEN NOT json_valid(raw_output) THEN ''
                WHEN json_type(raw_output, '$.answer') NOT IN ('UBIGINT', 'BIGINT') THEN '$.answer: type integer'
                WHEN l_linenumber % 2 = 0 AND try_cast(json_extract_string(raw_output, '$.answer') AS BIGINT) > 1500
                THEN '$.answer: maximum' ELSE '' END AS messages
    FROM v_math""", ("v_math",))
def verify_schema(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("l_linenumber") % 2 == 0
    rows = view(spark, sf, "v_math", wide=True).withColumn("output_schema", F.when(even, OPEN_ANSWER).otherwise(CLOSED_ANSWER))
    checked = scoring.schema_check(rows)
    return checked.select(
        "l_orderkey", "l_linenumber", "a", "b", "schema_error",
        F.coalesce(F.array_join("schema_messages", "; "), F.lit("")).alias("messages"),
    )


# a schema of its own for nearly every row, one in nine of them no JSON and one in ten with a broken pattern
_MANY_SCHEMAS = """CASE WHEN h % 9 = 0 THEN '{"type":' WHEN h % 10 = 0 THEN '{"properties":{"answer":{"pattern":"("}},"not":{"type":"string"}}'
    ELSE '{"$defs":{"n":{"type":"integer","exclusiveMaximum":' || CAST(a + 60 AS STRING) || '}},"properties":{"answer":{"anyOf":[{"$ref":"#/$defs/n"},{"const":"x"}]}}}' END"""


@query("verify_many_schemas", """
    WITH n AS (SELECT *, CASE WHEN json_valid(raw_output) THEN try_cast(json_extract_string(raw_output, '$.answer') AS BIGINT) END AS answer FROM v_math)
    SELECT l_orderkey, l_linenumber, a, b,
           CASE WHEN NOT json_valid(raw_output) THEN '' WHEN h % 9 = 0 THEN '$: unusable schema'
                WHEN h % 10 = 0 THEN CASE WHEN answer IS NULL THEN '$: unusable schema' ELSE '' END
                WHEN answer >= a + 60 THEN '$.answer: anyOf' ELSE '' END AS messages FROM n""", ("v_math",))
def verify_many_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict of a row depends on its own schema only, however many there are and whatever is wrong with others."""
    rows = view(spark, sf, "v_math", wide=True).withColumn("output_schema", F.expr(_MANY_SCHEMAS))
    return scoring.schema_check(rows).select(
        "l_orderkey", "l_linenumber", "a", "b", F.coalesce(F.array_join("schema_messages", "; "), F.lit("")).alias("messages")
    )


@query("verify_exact", """
    SELECT event_id, CASE WHEN CAST(props->>'$.k' AS BIGINT) % 4 = 0 THEN 'EXACT_MATCH_FAILED' ELSE '' END AS code FROM events""")
def verify_exact(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    # same object with other key order and spacing; a changed value every fourth time
    raw = F.concat(F.lit('{ "t":"'), "event_type", F.lit('", "k": '), F.when(k % 4 == 0, k + 1).otherwise(k), F.lit("}"))
    expected = F.concat(F.lit('{"k":'), k, F.lit(',"t":"'), "event_type", F.lit('"}'))
    result = scoring.exact_match(scoring.parse(raw), scoring.parse(expected))
    return table(spark, sf, "events").select("event_id", result["code"].alias("code"))


@query("verify_structured", """
    SELECT idx, CASE WHEN idx % 7 = 0 THEN 'STRUCTURED_FIELD_MISSING' WHEN idx % 11 = 0 THEN 'STRUCTURED_EXTRA_FIELD_PRESENT'
           WHEN idx % 5 = 0 THEN 'STRUCTURED_FIELD_VALUE_MISMATCH' ELSE '' END AS code,
           CASE WHEN idx % 7 = 0 THEN 'segment' WHEN idx % 11 = 0 THEN '' WHEN idx % 5 = 0 THEN 'name' ELSE '' END AS field
    FROM v_structured""", ("v_structured",))
def verify_structured(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_structured", wide=True)
    expected = F.parse_json(F.to_json(F.struct(F.col("exp_name").alias("name"), F.col("exp_segment").alias("segment"))))
    config = F.parse_json(F.lit('{"field_normalize":{"name":"strip","segment":"strip_lower"}}'))
    row = {"input": F.lit(None), "parsed": scoring.parse("raw_output"), "expected": expected, "config": config,
           "rules": F.lit(None).cast("array<struct<from:string,to:string>>")}
    return rows.select("idx", scoring.CHECKERS["structured_extraction_v1"](row).alias("r")).select(
        "idx", "r.code", F.coalesce("r.field", F.lit("")).alias("field")
    )


_ALLOWED = ["1-urgent", "2-high", "3-medium", "4-not specified"]


@query("verify_canonical", f"""
    WITH m AS (SELECT idx, lower(trim(exp_label)) AS target, CASE WHEN idx % 3 = 0
               THEN CASE label WHEN '1-URGENT' THEN '1-urgent' WHEN '2-HIGH' THEN '2-high' ELSE label END
               ELSE lower(trim(label)) END AS canon FROM v_canon)
    SELECT idx, CASE WHEN canon = target AND canon IN ({", ".join(map(sql_text, _ALLOWED))}) THEN ''
           ELSE 'PROGRAMMATIC_CHECK_FAILED' END AS code FROM m""", ("v_canon",))
def verify_canonical(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_canon")
    rewrite = F.when(
        F.col("idx") % 3 == 0,
        F.array(
            F.struct(F.lit("1-URGENT").alias("from"), F.lit("1-urgent").alias("to")),
            F.struct(F.lit("2-HIGH").alias("from"), F.lit("2-high").alias("to")),
        ),
    )
    out = scoring.canonical_label(
        F.col("label"), F.col("exp_label"), rewrite, F.lit(None).cast("map<string,string>"), F.array(*map(F.lit, _ALLOWED))
    )
    return rows.select("idx", out["code"].alias("code"))


@query("verify_unknown_checker", """
    SELECT l_orderkey, l_linenumber, a, b, CASE h % 3 WHEN 0 THEN 'UNKNOWN_CHECKER' ELSE
           CASE WHEN h % 17 = 0 OR h % 13 = 0 OR h % 11 = 0 THEN 'PROGRAMMATIC_CHECK_FAILED' ELSE '' END END AS code
    FROM v_math""", ("v_math",))
def verify_unknown_checker(spark: SparkSession, sf: str) -> DataFrame:
    pick = F.col("h") % 3
    name = F.when(pick == 0, "no_such_checker").when(pick == 1, "math_add_v1")
    # texts are parsed in a step of their own: the checkers name them many times
    read = view(spark, sf, "v_math", wide=True).select(
        "*", F.parse_json(F.to_json(F.struct("a", "b", "c"))).alias("input"), scoring.parse("raw_output").alias("parsed")
    )
    numbers = scoring.math_numbers(F.col("input"), F.col("parsed"))
    read = read.select("*", *[value.alias(f"number_{n}") for n, value in numbers.items()])
    row = {
        "input": F.col("input"),
        "parsed": F.col("parsed"),
        "numbers": {n: F.col(f"number_{n}") for n in numbers},
        "expected": F.parse_json(F.lit("null")),
        "config": F.parse_json(F.lit("null")),
        "rules": F.lit(None).cast("array<struct<from:string,to:string>>"),
    }
    out = scoring.programmatic_check(name, row)
    return read.select("l_orderkey", "l_linenumber", "a", "b", out["code"].alias("code"))


# --- trajectories --------------------------------------------------------------------------------------

TRACE_SPEC = {
    "required_first": ["user"],
    "must_include": ["assistant"],
    "max_calls": {"user": 3},
    "required_sequence": ["user", "assistant", "user", "assistant", "user"],
    "arg_schema": {
        "tool": "user",
        "schema": {
            "type": "object",
            "required": ["text"],
            "properties": {"text": {"type": "string", "minLength": 3, "maxLength": 300}},
        },
    },
    "bindings": [
        {"tool": "assistant", "tool_path": "$.text", "output_path": "$.final"},
        {"tool": "user", "tool_path": "$.size", "output_path": "$.asked"},
    ],
}

TRACE_FLAGS = """
    g AS (SELECT item_id, count(*) AS n_calls, arg_min(name, seq) <> 'user' AS bad_required_first,
             count(*) FILTER (WHERE name = 'assistant') = 0 AS bad_must_include, count(*) FILTER (WHERE name = 'user') > 3 AS bad_max_calls,
             NOT string_agg('[' || name || ']', '' ORDER BY seq) LIKE '%[user]%[assistant]%[user]%[assistant]%[user]%' AS bad_sequence,
             count(*) FILTER (WHERE name = 'user') = 0 AS bad_args_missing,
             coalesce(length(arg_min(payload, seq) FILTER (name = 'user')) NOT BETWEEN 3 AND 300, false) AS bad_args,
             item_id % 10 = 3 AS bad_binding_output, count(*) FILTER (WHERE name = 'assistant') > 0 AS told, count(*) FILTER (WHERE name = 'user') > 0 AS asked,
             coalesce(arg_min(payload, seq) FILTER (name = 'assistant') <> arg_max(payload, seq) FILTER (name = 'assistant'), false) AS other
          FROM v_traces GROUP BY item_id),
    f AS (SELECT *, NOT bad_binding_output AND (NOT told OR (NOT other AND NOT asked)) AS bad_binding_missing,
             NOT bad_binding_output AND told AND (other OR (asked AND item_id % 7 = 0)) AS bad_binding FROM g)"""


def long_traces(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as calls, each with a result, against outputs that quote the last answer and the length of the first question."""
    calls = view(spark, sf, "v_traces").withColumn("result", F.to_json(F.struct(F.col("payload").alias("text"), F.length("payload").alias("size"))))
    last = lambda who, by: by(F.when(F.col("name") == who, F.col("payload")), F.when(F.col("name") == who, F.col("seq")))
    outputs = calls.groupBy("item_id").agg(last("assistant", F.max_by).alias("final"), last("user", F.min_by).alias("first"))
    asked = F.length("first") + F.when(F.col("item_id") % 7 == 0, 1).otherwise(0)
    text = F.when(F.col("item_id") % 10 == 3, "no JSON {").otherwise(F.to_json(F.struct("final", asked.alias("asked"))))
    return trajectory.long_trace_codes(calls, TRACE_SPEC, outputs.select("item_id", text.alias("output")))


_TRACE_QUERIES = {
    "traj_required_first": ("bad_required_first",),
    "traj_must_include": ("bad_must_include",),
    "traj_max_calls": ("bad_max_calls",),
    "traj_sequence": ("bad_sequence",),
    "traj_args": ("bad_args",),
    "traj_binding": ("bad_binding_output", "bad_binding_missing", "bad_binding"),
}


def _trace_query(name: str, flags: tuple[str, ...]) -> None:
    @query(name, f"WITH {TRACE_FLAGS} SELECT item_id, n_calls, {', '.join(flags)} FROM f", ("v_traces",))
    def one_step(spark: SparkSession, sf: str) -> DataFrame:
        return long_traces(spark, sf).select("item_id", "n_calls", *flags)


for _name, _flags in _TRACE_QUERIES.items():
    _trace_query(_name, _flags)


@query("verify_trajectory", f"""
    WITH {TRACE_FLAGS}
    SELECT item_id, CASE WHEN bad_required_first OR bad_must_include THEN 'TOOL_SEQUENCE_MISSING'
        WHEN bad_max_calls THEN 'TOOL_MAX_CALLS_EXCEEDED' WHEN bad_sequence OR bad_args_missing THEN 'TOOL_SEQUENCE_MISSING'
        WHEN bad_args THEN 'TOOL_ARGS_SCHEMA_FAILED' WHEN bad_binding_output THEN 'TOOL_BINDING_MISSING_OUTPUT' WHEN bad_binding_missing THEN 'TOOL_BINDING_MISSING_TOOL'
        WHEN bad_binding THEN 'TOOL_BINDING_MISMATCH' ELSE '' END AS code,
        CASE WHEN bad_required_first THEN 'required_first' WHEN bad_must_include THEN 'must_include' WHEN bad_max_calls THEN 'max_calls' WHEN bad_sequence THEN 'sequence'
        WHEN bad_args_missing THEN 'args_missing' WHEN bad_args THEN 'args' WHEN bad_binding_output THEN 'binding_output' WHEN bad_binding_missing THEN 'binding_missing'
        WHEN bad_binding THEN 'binding' ELSE '' END AS step FROM f""", ("v_traces",))
def verify_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    return long_traces(spark, sf).select("item_id", "code", "step")


ROW_TRACE_SPEC = {
    "required_first": ["search"],
    "max_calls": {"search": 1},
    "required_sequence": ["search", "answer"],
    "arg_schema": {"tool": "search", "schema": {"type": "object", "properties": {"query": {"type": "string", "minLength": 5}}}},
    "bindings": [{"tool": "search", "tool_path": "$.hit.k", "output_path": "$.k"}],
}


def row_traces(spark: SparkSession, sf: str) -> DataFrame:
    """One response per event with a short trace: search (args, result), maybe again, answer."""
    k = F.get_json_object("props", "$.k").cast("bigint")

    def call(name: str, args, result) -> object:
        return F.struct(F.lit(name).alias("name"), F.parse_json(args).alias("args"), F.parse_json(result).alias("result"))

    query_args = F.concat(F.lit('{"query":"'), "event_type", F.lit('"}'))
    hit = F.concat(F.lit('{"hit":{"k":'), F.when(k % 7 == 0, k + 1).otherwise(k), F.lit("}}"))
    empty = F.lit("{}")
    search, answer = call("search", query_args, hit), call("answer", empty, empty)
    trace = (
        F.when(k % 11 == 0, F.lit(None))
        .when(k % 5 == 0, F.array(answer, search))
        .when(k % 6 == 0, F.array(search, search, answer))
        .when(k % 8 == 0, F.array(search))
        .otherwise(F.array(search, answer))
    )
    return spread(table(spark, sf, "events")).select(
        "event_id", k.alias("k"), "event_type", F.concat(F.lit('{"k":'), k, F.lit("}")).alias("raw_output"),
        trace.alias("tool_trace"),
    )


_ROW_TRACE_CODE = """CASE WHEN k % 11 = 0 THEN 'TOOL_TRACE_NOT_LIST' WHEN k % 5 = 0 THEN 'TOOL_SEQUENCE_MISSING'
           WHEN k % 6 = 0 THEN 'TOOL_MAX_CALLS_EXCEEDED' WHEN k % 8 = 0 THEN 'TOOL_SEQUENCE_MISSING'
           WHEN length(event_type) < 5 THEN 'TOOL_ARGS_SCHEMA_FAILED' WHEN k % 7 = 0 THEN 'TOOL_BINDING_MISMATCH' ELSE '' END"""


@query("traj_type", f"""
    WITH e AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events)
    SELECT event_id, {_ROW_TRACE_CODE} AS code FROM e""")
def traj_type(spark: SparkSession, sf: str) -> DataFrame:
    rows = row_traces(spark, sf).withColumn("expected", trajectory.spec_json(ROW_TRACE_SPEC)).withColumn(
        "parsed", scoring.parse("raw_output")
    )
    return trajectory.trace_codes(rows, "expected", "tool_trace", "parsed").select("event_id", "trajectory.code")


# --- judges --------------------------------------------------------------------------------------------


@query("judge_agreement", """
    SELECT item_id, verdict_1 = verdict_2 AS verdicts_match, round(abs(score_1 - score_2), 6) AS score_delta,
           verdict_1 = verdict_2 AND abs(score_1 - score_2) < 0.15 AS accept_mean FROM v_judges""", ("v_judges",))
def judge_agreement(spark: SparkSession, sf: str) -> DataFrame:
    v1, s1, v2, s2 = (F.col(c) for c in ("verdict_1", "score_1", "verdict_2", "score_2"))
    return view(spark, sf, "v_judges").select(
        "item_id", (v1 == v2).alias("verdicts_match"), F.round(F.abs(s1 - s2), 6).alias("score_delta"),
        accept_mean(v1, s1, v2, s2).alias("accept_mean"),
    )


_RUBRIC = """
    r AS (SELECT *, evidence_requirements IS NOT NULL AS asked,
             verdict_1 = verdict_2 AND abs(score_1 - score_2) < 0.15 AS agreed FROM v_judges),
    o AS (SELECT *, CASE WHEN NOT asked THEN 'fail' WHEN agreed THEN verdict_1 ELSE coalesce(verdict_3, 'fail') END AS verdict,
             CASE WHEN NOT asked OR (NOT agreed AND verdict_3 IS NULL) THEN 0.0::DOUBLE WHEN agreed THEN (score_1 + score_2) / 2
                  ELSE score_3 END AS score,
             CASE WHEN NOT asked THEN 'none' WHEN agreed THEN 'no' ELSE 'used' END AS arbitration FROM r)"""


@query("verify_rubric", f"""
    WITH {_RUBRIC}
    SELECT item_id, verdict, round(score, 6) AS score, arbitration FROM o""", ("v_judges",))
def verify_rubric(spark: SparkSession, sf: str) -> DataFrame:
    return rubric_outcome(view(spark, sf, "v_judges")).select(
        "item_id", "verdict", F.round("score", 6).alias("score"), "arbitration"
    )


@query("judge_missing", f"""
    WITH {_RUBRIC}
    SELECT item_id, CASE WHEN verdict = 'pass' THEN '' WHEN asked AND NOT agreed AND verdict_3 IS NULL THEN 'JUDGE_SYSTEM_ERROR'
           ELSE 'RUBRIC_JUDGE_FAILED' END AS error_type FROM o""", ("v_judges",))
def judge_missing(spark: SparkSession, sf: str) -> DataFrame:
    return rubric_outcome(view(spark, sf, "v_judges")).select("item_id", "error_type")


@query("judge_evidence", """
    WITH j AS (SELECT *, verdict_1 = verdict_2 AND abs(score_1 - score_2) < 0.15 AS agreed FROM v_judges),
    p AS (SELECT *, NOT agreed AND verdict_3 IS NOT NULL AS used,
             coalesce(CASE WHEN agreed THEN verdict_1 ELSE verdict_3 END, 'fail') = 'pass' AS passed FROM j)
    SELECT item_id, 'judge_prompt_version=v1 rubric_schema_version=v1 judge_models=judge,judge'
           || '|judge_1=' || verdict_1 || ' judge_2=' || verdict_2 || ' accept_mean=' || CASE WHEN agreed THEN 'True' ELSE 'False' END
           || ' arbitration=' || CASE WHEN used THEN 'used' ELSE 'no' END
           || CASE WHEN passed THEN '' ELSE '|judge_1_reason=r1 ' || item_id || '|judge_2_reason=r2 ' || item_id END
           || CASE WHEN used AND NOT passed THEN '|arbiter_reason=r3 ' || item_id ELSE '' END
           || CASE WHEN used THEN '|tone: arbiter' ELSE '|tone: judge' END AS evidence FROM p""", ("v_judges",))
def judge_evidence_lines(spark: SparkSession, sf: str) -> DataFrame:
    def judge(i: int, observation: str) -> object:
        cited = F.array(F.struct(F.lit("tone").alias("rule"), F.lit(observation).alias("observation")))
        return F.struct(
            F.col(f"verdict_{i}").alias("verdict"),
            F.concat(F.lit(f"r{i} "), "item_id").alias("reason"),
            F.lit("judge").alias("model_version"),
            cited.alias("evidence"),
        )

    rows = view(spark, sf, "v_judges")
    agreed = accept_mean(F.col("verdict_1"), F.col("score_1"), F.col("verdict_2"), F.col("score_2"))
    passed = F.coalesce(F.when(agreed, F.col("verdict_1")).otherwise(F.col("verdict_3")), F.lit("fail")) == "pass"
    arbiter = F.when(F.col("verdict_3").isNotNull(), judge(3, "arbiter"))
    lines = judge_evidence(judge(1, "judge"), judge(2, "judge"), arbiter, agreed, passed, F.lit("v1"))
    shown = F.transform(lines, lambda e: F.coalesce(e["message"], F.concat(e["rule"], F.lit(": "), e["observation"])))
    return rows.select("item_id", F.array_join(shown, "|").alias("evidence"))


# --- router --------------------------------------------------------------------------------------------

MIXED = """
    mixed AS (
      SELECT 'm' || l_orderkey || '_' || l_linenumber || '_' || a || '_' || b AS item_id, 'programmatic_check' AS eval_method,
             error_type, CASE WHEN error_type = 'PROGRAMMATIC_CHECK_FAILED' THEN error_type ELSE '' END AS evidence_code
      FROM coded
      UNION ALL
      SELECT 's' || idx, 'programmatic_check', CASE WHEN code = '' THEN '' ELSE 'PROGRAMMATIC_CHECK_FAILED' END, code FROM (
        SELECT idx, CASE WHEN idx % 7 = 0 THEN 'STRUCTURED_FIELD_MISSING' WHEN idx % 11 = 0 THEN 'STRUCTURED_EXTRA_FIELD_PRESENT'
           WHEN idx % 5 = 0 THEN 'STRUCTURED_FIELD_VALUE_MISMATCH' ELSE '' END AS code FROM v_structured)
      UNION ALL
      SELECT 'e' || event_id, method, CASE method WHEN 'schema_check' THEN '' WHEN 'unit_test' THEN 'EVAL_METHOD_UNSUPPORTED'
             WHEN 'exact_match' THEN CASE WHEN k % 9 = 0 THEN 'EXACT_MATCH_FAILED' ELSE '' END
             ELSE CASE WHEN code = '' THEN '' ELSE 'TRAJECTORY_CHECK_FAILED' END END,
             CASE method WHEN 'schema_check' THEN '' WHEN 'unit_test' THEN 'UNSUPPORTED_EVAL_METHOD'
             WHEN 'exact_match' THEN CASE WHEN k % 9 = 0 THEN 'EXACT_MATCH_FAILED' ELSE '' END ELSE code END
      FROM (SELECT event_id, k, CASE event_id % 4 WHEN 0 THEN 'schema_check' WHEN 1 THEN 'unit_test' WHEN 2 THEN 'exact_match'
                   ELSE 'trajectory_check' END AS method, """ + _ROW_TRACE_CODE + """ AS code
            FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events)))"""

ANY_OBJECT = '{"type":"object"}'


RESPONSE_COLUMNS = (
    "item_id", "eval_method", "output_schema", "raw_output", "checker_name", "input", "expected", "checker_config", "tool_trace",
)


def _responses(df: DataFrame, **columns) -> DataFrame:
    empty = {n: F.lit(None).cast(verify.TRACE_TYPE if n == "tool_trace" else "string") for n in RESPONSE_COLUMNS}
    return df.select(*[columns.get(n, empty[n]).alias(n) for n in RESPONSE_COLUMNS])


def math_responses(spark: SparkSession, sf: str) -> DataFrame:
    return _responses(
        view(spark, sf, "v_math", wide=True),
        item_id=F.concat(F.lit("m"), F.concat_ws("_", "l_orderkey", "l_linenumber", "a", "b")),
        eval_method=F.lit("programmatic_check"), output_schema=F.lit(CLOSED_ANSWER), raw_output=F.col("raw_output"),
        input=F.to_json(F.struct("a", "b", "c")),
    )


def structured_responses(spark: SparkSession, sf: str) -> DataFrame:
    return _responses(
        view(spark, sf, "v_structured", wide=True),
        item_id=F.concat(F.lit("s"), "idx"),
        eval_method=F.lit("programmatic_check"), output_schema=F.lit(ANY_OBJECT), raw_output=F.col("raw_output"),
        checker_name=F.lit("structured_extraction_v1"),
        expected=F.to_json(F.struct(F.col("exp_name").alias("name"), F.col("exp_segment").alias("segment"))),
        checker_config=F.lit('{"field_normalize":{"name":"strip","segment":"strip_lower"}}'),
    )


def call_responses(spark: SparkSession, sf: str) -> DataFrame:
    pick = F.col("event_id") % 4
    method = F.when(pick == 0, "schema_check").when(pick == 1, "unit_test").when(pick == 2, "exact_match").otherwise("trajectory_check")
    exact = F.concat(F.lit('{"k":'), F.when(F.col("k") % 9 == 0, F.col("k") + 1).otherwise(F.col("k")), F.lit("}"))
    return _responses(
        row_traces(spark, sf),
        item_id=F.concat(F.lit("e"), "event_id"),
        eval_method=method, output_schema=F.lit(ANY_OBJECT), raw_output=F.col("raw_output"),
        expected=F.when(pick == 3, F.to_json(trajectory.spec_json(ROW_TRACE_SPEC))).otherwise(exact),
        tool_trace=F.col("tool_trace"),
    )


def mixed_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of every method in one table."""
    return math_responses(spark, sf).unionByName(structured_responses(spark, sf)).unionByName(call_responses(spark, sf))


def _verify_mixed(df: DataFrame) -> DataFrame:
    return verify.verify(df)


@query("verify_all", f"""
    WITH {MATH_CODES}, {MIXED}
    SELECT item_id, CASE WHEN error_type = '' THEN 'pass' ELSE 'fail' END AS verdict,
           CASE WHEN error_type = '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, error_type, evidence_code,
           CASE WHEN error_type LIKE 'MODEL_OUTPUT%' THEN 'schema_check:ran:false' WHEN eval_method = 'schema_check' THEN 'schema_check:ran:true'
                WHEN eval_method = 'unit_test' THEN 'schema_check:ran:true>unit_test:skipped:false'
                ELSE 'schema_check:ran:true>' || eval_method || ':ran:' || CASE WHEN error_type = '' THEN 'true' ELSE 'false' END END AS ladder
    FROM mixed""", ("v_math", "v_structured"))
def verify_all(spark: SparkSession, sf: str) -> DataFrame:
    step = lambda e: F.concat_ws(":", e["method"], F.when(e["ran"], "ran").otherwise("skipped"), e["passed"].cast("string"))
    return _verify_mixed(mixed_responses(spark, sf)).select(
        "item_id", "verdict", "score", "error_type", "evidence_code",
        F.array_join(F.transform("verification_ladder", step), ">").alias("ladder"),
    )


@query("verify_evidence", f"""
    WITH e AS (SELECT *, {_ROW_TRACE_CODE} AS tc, CASE event_id % 4 WHEN 0 THEN 'schema_check' WHEN 1 THEN 'unit_test' WHEN 2 THEN 'exact_match'
                   ELSE 'trajectory_check' END AS method FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events)),
    s AS (SELECT idx, exp_name, raw_output, CASE WHEN idx % 7 = 0 THEN 'STRUCTURED_FIELD_MISSING' WHEN idx % 11 = 0 THEN 'STRUCTURED_EXTRA_FIELD_PRESENT'
             WHEN idx % 5 = 0 THEN 'STRUCTURED_FIELD_VALUE_MISMATCH' END AS code FROM v_structured),
    r AS (SELECT *, evidence_requirements IS NOT NULL AS asked, verdict_1 = verdict_2 AND abs(score_1 - score_2) < 0.15 AS agreed FROM v_judges),
    o AS (SELECT item_id, CASE WHEN NOT asked THEN 'RUBRIC_JUDGE_FAILED' WHEN agreed THEN CASE WHEN verdict_1 = 'fail' THEN 'RUBRIC_JUDGE_FAILED' END
                 WHEN verdict_3 IS NULL THEN 'JUDGE_SYSTEM_ERROR' WHEN verdict_3 = 'fail' THEN 'RUBRIC_JUDGE_FAILED' END AS code FROM r)
    SELECT 'e' || event_id AS item_id, CASE method WHEN 'unit_test' THEN 'router' ELSE method END AS kind,
           CASE method WHEN 'unit_test' THEN 'UNSUPPORTED_EVAL_METHOD' WHEN 'exact_match' THEN CASE WHEN k % 9 = 0 THEN 'EXACT_MATCH_FAILED' END
                       WHEN 'trajectory_check' THEN nullif(tc, '') END AS code,
           CASE WHEN method <> 'trajectory_check' OR tc = '' THEN NULL WHEN tc = 'TOOL_BINDING_MISMATCH' THEN 'grounding'
                WHEN tc = 'TOOL_ARGS_SCHEMA_FAILED' THEN 'schema' ELSE 'tool_use' END AS dimension,
           CASE WHEN method = 'trajectory_check' AND tc IN ('TOOL_MAX_CALLS_EXCEEDED', 'TOOL_ARGS_SCHEMA_FAILED', 'TOOL_BINDING_MISMATCH') THEN 'search' END AS tool_name,
           CASE WHEN method <> 'trajectory_check' THEN NULL WHEN tc = 'TOOL_MAX_CALLS_EXCEEDED' THEN '{{"max_calls":1}}'
                WHEN tc = 'TOOL_SEQUENCE_MISSING' AND k % 5 = 0 THEN '{{"required_first":["search"]}}'
                WHEN tc = 'TOOL_SEQUENCE_MISSING' THEN '{{"required_sequence":["search","answer"]}}'
                WHEN tc = 'TOOL_ARGS_SCHEMA_FAILED' THEN '{{"schema":{{"properties":{{"query":{{"minLength":5,"type":"string"}}}},"type":"object"}}}}'
                WHEN tc = 'TOOL_BINDING_MISMATCH' THEN '{{"output_path":"$.k","value":' || (k + 1) || '}}' END AS expected,
           CASE WHEN method <> 'trajectory_check' THEN NULL WHEN tc = 'TOOL_MAX_CALLS_EXCEEDED' THEN '{{"count":2}}'
                WHEN tc = 'TOOL_SEQUENCE_MISSING' AND k % 5 = 0 THEN '{{"first_tool":"answer"}}'
                WHEN tc = 'TOOL_SEQUENCE_MISSING' THEN '{{"names":["search"]}}'
                WHEN tc = 'TOOL_ARGS_SCHEMA_FAILED' THEN '{{"args":{{"query":"' || event_type || '"}},"validation_errors":["$.query: minLength"]}}'
                WHEN tc = 'TOOL_BINDING_MISMATCH' THEN '{{"value":' || k || '}}' END AS observed,
           CASE WHEN method = 'trajectory_check' AND tc = 'TOOL_BINDING_MISMATCH' THEN '{{"tool_path":"$.hit.k","output_path":"$.k"}}' END AS locator FROM e
    UNION ALL
    SELECT 's' || idx, 'programmatic_check', code, CASE WHEN code IS NOT NULL THEN 'programmatic' END, NULL,
           CASE WHEN code = 'STRUCTURED_FIELD_MISSING' THEN '"' || (SELECT c_mktsegment FROM customer WHERE c_custkey = idx) || '"'
                WHEN code = 'STRUCTURED_FIELD_VALUE_MISMATCH' THEN '"' || exp_name || '"' END,
           CASE WHEN code = 'STRUCTURED_FIELD_VALUE_MISMATCH' THEN '"' || json_extract_string(raw_output, '$.name') || '"' END,
           CASE WHEN code = 'STRUCTURED_FIELD_MISSING' THEN '{{"field":"segment"}}' WHEN code = 'STRUCTURED_FIELD_VALUE_MISMATCH' THEN '{{"field":"name"}}' END FROM s
    UNION ALL SELECT 'j' || item_id, 'rubric_judge', code, NULL, NULL, NULL, NULL, NULL FROM o""", ("v_structured", "v_judges"))
def verify_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What each result rests on: code, expected, observed, locator and dimension, for tool calls, fields and judges."""
    judges = [f"{n}_{i}" for i in (1, 2, 3) for n in ("verdict", "score")]
    rubric = view(spark, sf, "v_judges").select(
        F.concat(F.lit("j"), "item_id").alias("item_id"), F.lit("rubric_judge").alias("eval_method"), F.lit(ANY_OBJECT).alias("output_schema"),
        F.lit("{}").alias("raw_output"), "evidence_requirements", *judges,
    )
    rows = structured_responses(spark, sf).unionByName(call_responses(spark, sf)).unionByName(rubric, allowMissingColumns=True)
    # there is always evidence; a plain inline would have the planner test for that first, with the whole scorer in the test
    return verify.verify(rows).select("item_id", F.inline_outer("evidence")).drop("message")


@query("expectation_check", f"""
    WITH {MATH_CODES}, {MIXED},
    x AS (SELECT *, CASE WHEN item_id LIKE 's%' THEN 'pass'
              WHEN item_id LIKE 'm%' THEN CASE WHEN (TRY_CAST(split_part(substr(item_id, 2), '_', 1) AS BIGINT) + TRY_CAST(split_part(item_id, '_', 2) AS BIGINT)) % 17 = 0 THEN 'fail' ELSE 'pass' END
              WHEN TRY_CAST(substr(item_id, 2) AS BIGINT) % 3 <> 0 THEN 'fail' END AS want FROM mixed)
    SELECT item_id, want AS expected_verdict, error_type,
           CASE WHEN want = 'pass' THEN error_type = '' WHEN item_id LIKE 'm%' THEN error_type = 'MODEL_OUTPUT_NOT_JSON' ELSE error_type = 'EXACT_MATCH_FAILED' END AS met FROM x""", ("v_math", "v_structured"))
def expectation_check(spark: SparkSession, sf: str) -> DataFrame:
    """Every response against what is expected of its id; an id is expected once, however many responses it has."""
    rows = mixed_responses(spark, sf)
    kind, parts = F.substring("item_id", 1, 1), F.split(F.expr("substring(item_id, 2)"), "_")
    number = F.get(parts, 0).cast("bigint")
    broken = F.when((number + F.get(parts, 1).cast("bigint")) % 17 == 0, "fail").otherwise("pass")
    wanted = rows.select("item_id").distinct().select(
        "item_id",
        F.when(kind == "s", "pass").when(kind == "m", broken).when(number % 3 != 0, "fail").alias("expected_verdict"),
        F.when(kind == "m", "MODEL_OUTPUT_NOT_JSON").otherwise("EXACT_MATCH_FAILED").alias("expected_error_type"),
        F.lit(None).cast("string").alias("expected_evidence_code"),
    )
    return verify.expectation_check(_verify_mixed(rows), wanted, "item_id").select(
        "item_id", "expected_verdict", "error_type", "met"
    )


@query("replay_overrides", """
    SELECT idx, CASE WHEN idx % 2 = 0 THEN '' WHEN idx % 7 = 0 THEN 'STRUCTURED_FIELD_MISSING'
           WHEN idx % 11 = 0 THEN 'STRUCTURED_EXTRA_FIELD_PRESENT' WHEN idx % 5 = 0 THEN 'STRUCTURED_FIELD_VALUE_MISMATCH'
           ELSE '' END AS evidence_code FROM v_structured""", ("v_structured",))
def replay_overrides(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "v_structured", wide=True)
    expected = F.to_json(F.struct(F.col("exp_name").alias("name"), F.col("exp_segment").alias("segment")))
    responses = rows.select(
        F.col("idx").alias("item_id"), "raw_output", F.lit("programmatic_check").alias("eval_method"),
        F.lit(ANY_OBJECT).alias("output_schema"), F.lit("structured_extraction_v1").alias("checker_name"),
        expected.alias("expected"),
        F.lit('{"field_normalize":{"name":"strip","segment":"strip_lower"}}').alias("checker_config"),
    )
    overrides = rows.where(F.col("idx") % 2 == 0).select(F.col("idx").alias("item_id"), expected.alias("raw_output"))
    scored = verify.replay(responses, overrides)
    return scored.select(F.col("item_id").alias("idx"), "evidence_code")
