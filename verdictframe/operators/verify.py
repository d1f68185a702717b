"""The verification router: schema pre-check, then the scorer named by each row's method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.operators import scoring, trajectory
from verdictframe.operators.rubric import rubric_outcome

TRACE_TYPE = "array<struct<name:string,args:variant,result:variant>>"
OPTIONAL = {
    "checker_name": "string",
    "input": "string",
    "expected": "string",
    "checker_config": "string",
    "rules": "array<struct<from:string,to:string>>",
    "tool_trace": TRACE_TYPE,
    "task_type": "string",
    "evidence_requirements": "string",
    "status_code": "int",
    **{f"verdict_{i}": "string" for i in (1, 2, 3)},
    **{f"score_{i}": "double" for i in (1, 2, 3)},
}


def _entry(method: Column | str, ran: Column, passed: Column, reason: Column) -> Column:
    name = method if isinstance(method, Column) else F.lit(method)
    return F.struct(name.alias("method"), ran.alias("ran"), passed.alias("passed"), reason.alias("reason"))


EVIDENCE = "array<struct<kind:string,code:string,dimension:string,tool_name:string,expected:string,observed:string,locator:string,message:string>>"


def _evidence(kind: Column | str, message: Column, code: Column | str | None = None, **more: Column) -> Column:
    """One entry; parts that do not apply are null, a code only where something failed."""
    given = {"kind": kind, "code": code, "message": message, **more}
    names = ("kind", "code", "dimension", "tool_name", "expected", "observed", "locator", "message")
    return F.struct(*[(v if isinstance(v := given.get(n), Column) else F.lit(v)).cast("string").alias(n) for n in names])


def verify(responses: DataFrame) -> DataFrame:
    """Score every response.

    Needs item_id, eval_method, output_schema and raw_output; see ``OPTIONAL`` for the rest (JSON texts
    are parsed here, once). Adds verdict, score, error_type, evidence_code, message, the evidence and the
    verification_ladder; a scorer that cannot read a row fails that row, never the job.
    """
    given = responses.columns
    df = responses.select("*", *[F.lit(None).cast(kind).alias(n) for n, kind in OPTIONAL.items() if n not in given])
    df = scoring.schema_check(df)
    df = df.select(
        "*",
        *[scoring.parse(c).alias(f"_{c}") for c in ("input", "expected", "checker_config")],
    )
    numbers = scoring.math_numbers(F.col("_input"), F.col("parsed"))
    df = df.withColumns({f"_number_{n}": c for n, c in numbers.items()})
    df = df.withColumn("_spec", F.when(F.col("eval_method") == "trajectory_check", F.col("_expected")))
    df = trajectory.trace_codes(df, "_spec", "tool_trace", "parsed")
    judged = rubric_outcome(df.drop("verdict", "score", "error_type"))

    method, pre = F.col("eval_method"), F.col("schema_error")
    row = {
        "input": F.col("_input"),
        "parsed": F.col("parsed"),
        "expected": F.col("_expected"),
        "config": F.col("_checker_config"),
        "rules": F.col("rules"),
        "numbers": {n: F.col(f"_number_{n}") for n in numbers},
    }
    rubric = scoring.outcome(
        F.col("error_type") == "",
        F.lit(""),
        F.concat(F.lit("arbitration="), F.col("arbitration")),
    )
    passed_schema = scoring.outcome(F.lit(True), F.lit(""), F.lit("schema_check passed"))
    unsupported = scoring.outcome(
        F.lit(False), F.lit("UNSUPPORTED_EVAL_METHOD"), F.concat(F.lit("unsupported eval_method="), method)
    )
    main = (
        F.when(method == "schema_check", passed_schema)
        .when(method == "programmatic_check", scoring.programmatic_check("checker_name", row))
        .when(method == "exact_match", scoring.exact_match("parsed", "_expected"))
        .when(method == "trajectory_check", F.col("trajectory"))
        .when(method == "rubric_judge", rubric)
        .otherwise(unsupported)
    )
    scored = judged.withColumn("_main", F.when(pre == "", main))
    ok = F.coalesce(F.col("_main.ok"), F.lit(False))
    code = F.coalesce(F.col("_main.code"), F.lit(""))
    http_failed = F.coalesce(F.col("status_code") != 200, F.lit(False))
    failed_as = (
        F.when(http_failed, "SUT_HTTP_ERROR")
        .when(pre != "", pre)
        .when(ok, "")
        .when(code.isin("UNKNOWN_CHECKER", "UNSUPPORTED_EVAL_METHOD"), "EVAL_METHOD_UNSUPPORTED")
        .when(method == "programmatic_check", "PROGRAMMATIC_CHECK_FAILED")
        .when(method == "exact_match", "EXACT_MATCH_FAILED")
        .when(method == "trajectory_check", "TRAJECTORY_CHECK_FAILED")
        .otherwise(F.col("error_type"))
    )
    score = F.when(http_failed | (pre != ""), 0.0).when(method == "rubric_judge", F.col("score")).otherwise(
        F.when(ok, 1.0).otherwise(0.0)
    )
    first = _entry(
        "schema_check", F.lit(True), pre == "",
        F.when(pre == "", "schema_check passed").when(pre == "MODEL_OUTPUT_NOT_JSON", "output is not valid JSON")
        .otherwise(F.concat(F.lit("output violates output_schema: "), F.array_join("schema_messages", "; "))),
    )
    second = _entry(method, code != "UNSUPPORTED_EVAL_METHOD", ok, F.col("_main.message"))
    ladder = F.when(http_failed, F.array().cast("array<struct<method:string,ran:boolean,passed:boolean,reason:string>>")).otherwise(
        F.when((pre != "") | (method == "schema_check"), F.array(first)).otherwise(F.array(first, second))
    )
    main_message, failing = F.col("_main.message"), F.when(code != "", code)
    trace = F.col("trajectory_details")
    field = F.col("_main.field")

    def at_field(source: str) -> Column:
        return F.when(field.isNotNull(), F.to_json(F.try_element_at(F.try_variant_get(source, "$", "map<string,variant>"), field)))

    programmatic = _evidence(
        "programmatic_check", main_message, failing,
        dimension=F.when(~ok, F.when(F.col("task_type") == "json_extract_structured", "structured_extraction").otherwise("programmatic")),
        expected=F.when(~ok, at_field("_expected")), observed=F.when(~ok, at_field("parsed")),
        locator=F.when(~ok & field.isNotNull(), F.to_json(F.struct(field.alias("field")))),
    )
    trajectory_ = _evidence(
        "trajectory_check", main_message, failing, **{n: trace[n] for n in ("dimension", "tool_name", "expected", "observed", "locator")}
    )
    evidence = (
        F.when(http_failed, _evidence("transport", F.concat(F.lit("status_code="), "status_code"), "SUT_HTTP_ERROR"))
        .when(pre != "", _evidence("schema_check", first["reason"], pre, dimension=F.lit("schema")))
        .when(code.isin("UNKNOWN_CHECKER", "UNSUPPORTED_EVAL_METHOD"), _evidence("router", main_message, code))
        .when(method == "programmatic_check", programmatic)
        .when(method == "trajectory_check", trajectory_)
        .when(method == "rubric_judge", _evidence("rubric_judge", main_message, F.when(F.col("error_type") != "", F.col("error_type"))))
        .otherwise(_evidence(method, main_message, failing))
    )
    return scored.select(
        *responses.columns,
        *[c for c in ("task_type",) if c not in responses.columns],
        F.when(failed_as == "", "pass").otherwise("fail").alias("verdict"),
        score.cast("double").alias("score"),
        failed_as.alias("error_type"),
        F.when(http_failed | (pre != ""), "").otherwise(code).alias("evidence_code"),
        F.coalesce(F.col("_main.message"), F.array_join("schema_messages", "; ")).alias("message"),
        F.array(evidence).cast(EVIDENCE).alias("evidence"),
        ladder.alias("verification_ladder"),
    )


def replay(responses: DataFrame, overrides: DataFrame) -> DataFrame:
    """Score again with overridden outputs: ``overrides`` has item_id and raw_output, one row per item."""
    changed = overrides.select("item_id", F.col("raw_output").alias("_override"))
    merged = responses.join(changed, "item_id", "left").withColumn(
        "raw_output", F.coalesce("_override", "raw_output")
    )
    return verify(merged.drop("_override"))


def expectation_check(results: DataFrame, expected: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Compare results with expectations (verdict, error type, evidence code; null = not asked).

    Expecting a pass looks at the verdict only; otherwise a verdict of fail is needed when it is asked
    for, and the named codes must be equal.
    """
    want = expected.select(
        key, *[F.col(c).alias(f"_{c}") for c in ("expected_verdict", "expected_error_type", "expected_evidence_code")]
    )
    verdict = F.col("_expected_verdict")
    same_verdict = F.when(verdict == "fail", F.col("verdict") == "fail").otherwise(F.lit(True))
    same_error = F.col("_expected_error_type").isNull() | (F.col("error_type") == F.col("_expected_error_type"))
    same_code = F.col("_expected_evidence_code").isNull() | (F.col("evidence_code") == F.col("_expected_evidence_code"))
    met = F.when(verdict == "pass", F.col("verdict") == "pass").otherwise(same_verdict & same_error & same_code)
    return want.join(results, key, "left").select(
        key,
        verdict.alias("expected_verdict"),
        F.col("_expected_error_type").alias("expected_error_type"),
        F.col("_expected_evidence_code").alias("expected_evidence_code"),
        "verdict",
        "error_type",
        "evidence_code",
        F.coalesce(met, F.lit(False)).alias("met"),
    )
