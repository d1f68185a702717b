"""Rubric scoring from judge verdicts: normalisation, agreement, arbitration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions import rules
from verdictframe.functions.text import col


def normalize_judgement(raw: Column | str) -> Column:
    """Struct of a judge's raw JSON (VARIANT): verdict, score in 0..1, reason, evidence."""
    v = col(raw)
    verdict = F.when(F.lower(F.try_variant_get(v, "$.verdict", "string")) == "pass", "pass").otherwise("fail")
    given = F.try_variant_get(v, "$.score", "double")
    # a missing score follows the verdict exactly as written
    default = F.when(F.try_variant_get(v, "$.verdict", "string") == "pass", 1.0).otherwise(0.0).cast("double")
    score = F.when(given.isNull(), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), given)))
    evidence = F.filter(
        F.coalesce(F.try_variant_get(v, "$.evidence", "array<variant>"), F.array().cast("array<variant>")),
        lambda e: F.try_variant_get(e, "$", "map<string,variant>").isNotNull(),
    )
    return F.struct(
        verdict.alias("verdict"),
        score.alias("score"),
        F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit("")).alias("reason"),
        F.transform(
            evidence,
            lambda e: F.struct(
                F.coalesce(F.try_variant_get(e, "$.rule", "string"), F.lit("unknown")).alias("rule"),
                F.coalesce(F.try_variant_get(e, "$.observation", "string"), F.lit("")).alias("observation"),
            ),
        ).alias("evidence"),
        F.coalesce(F.try_variant_get(v, "$.model_version", "string"), F.lit("stub")).alias("model_version"),
    )


def ask_judges(prompts: DataFrame, judge: Callable[[pd.Series], pd.Series], judges: int = 2) -> DataFrame:
    """Verdicts of independent judges: one row per item and judge, normalised.

    ``prompts`` has item_id and prompt; ``judge`` maps a batch of prompts to raw JSON texts and runs in
    the tasks. Text that is no JSON object gives a null verdict.
    """

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item_id": batch["item_id"], "judge_index": batch["judge_index"], "raw": judge(batch["prompt"])})

    indexed = prompts.select("item_id", "prompt", F.explode(F.sequence(F.lit(1), F.lit(judges))).alias("judge_index"))
    kind = dict(prompts.dtypes)["item_id"]
    raw = indexed.mapInPandas(answer, f"item_id {kind}, judge_index int, raw string")
    parsed = F.try_parse_json("raw")
    is_object = F.try_variant_get(parsed, "$", "map<string,variant>").isNotNull()
    return raw.select("item_id", "judge_index", F.when(is_object, normalize_judgement(parsed)).alias("judgement"))


def accept_mean(v1: Column, s1: Column, v2: Column, s2: Column, delta: float = rules.JUDGE_SCORE_DELTA) -> Column:
    return (v1 == v2) & (F.abs(s1 - s2) < delta)


def _has_evidence_requirements(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.trim(c).isin("", "{}", "null"), F.lit(False))


def rubric_outcome(df: DataFrame, requirements: str = "evidence_requirements") -> DataFrame:
    """Add final verdict, score and error type from columns verdict_1/score_1 .. verdict_3/score_3.

    Two agreeing judges give their mean; otherwise the arbiter decides. Without evidence
    requirements the item fails with score 0. A missing verdict is a judge system error.
    """
    v1, s1, v2, s2 = (F.col(c) for c in ("verdict_1", "score_1", "verdict_2", "score_2"))
    asked = _has_evidence_requirements(F.col(requirements))
    agreed = F.coalesce(accept_mean(v1, s1, v2, s2), F.lit(False))
    missing = asked & (v1.isNull() | v2.isNull() | (~agreed & F.col("verdict_3").isNull()))
    verdict = F.when(~asked | missing, "fail").when(agreed, v1).otherwise(F.col("verdict_3"))
    mean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s1 + s2) / 2.0))
    score = F.when(~asked | missing, F.lit(0.0)).when(agreed, mean).otherwise(F.col("score_3")).cast("double")
    return df.select(
        "*",
        agreed.alias("accept_mean"),
        F.when(~asked, "none").when(agreed, "no").otherwise("used").alias("arbitration"),
        verdict.alias("verdict"),
        score.alias("score"),
        F.when(verdict == "pass", "").when(missing, "JUDGE_SYSTEM_ERROR").otherwise("RUBRIC_JUDGE_FAILED").alias("error_type"),
    )


def verdict_error(verdict: Column | str, given: Column | str) -> Column:
    """Error type of a judge verdict PASS / FAIL / ERROR; one the judge named itself wins."""
    v = col(verdict)
    named = F.when(F.coalesce(col(given), F.lit("")) != "", col(given))
    return F.when(v == "PASS", "").otherwise(
        F.coalesce(named, F.when(v == "ERROR", "JUDGE_SYSTEM_ERROR").otherwise("RUBRIC_JUDGE_FAILED"))
    )


def judge_evidence(j1: Column, j2: Column, arbiter: Column, agreed: Column, passed: Column, schema_version: Column) -> Column:
    """Messages that explain a rubric result: versions, verdicts, reasons of a failure, final citations."""
    def line(*parts: Column | str) -> Column:
        return F.struct(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("message"),
                        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("observation"))

    used = ~agreed & arbiter.isNotNull()
    head = F.array(
        line("judge_prompt_version=v1 rubric_schema_version=", schema_version, " judge_models=",
             j1["model_version"], ",", j2["model_version"]),
        line("judge_1=", j1["verdict"], " judge_2=", j2["verdict"], " accept_mean=",
             F.initcap(agreed.cast("string")), " arbitration=", F.when(used, "used").otherwise("no")),
    )
    reasons = F.array_compact(F.array(
        F.when(~passed, line("judge_1_reason=", j1["reason"])),
        F.when(~passed, line("judge_2_reason=", j2["reason"])),
        F.when(~passed & used, line("arbiter_reason=", arbiter["reason"])),
    ))
    cited = F.transform(
        F.when(used, arbiter["evidence"]).otherwise(j1["evidence"]),
        lambda e: F.struct(F.lit(None).cast("string").alias("message"), e["rule"].alias("rule"),
                           e["observation"].alias("observation")),
    )
    return F.concat(head, reasons, cited)


def judge_prompt(task_type: Column | str, prompt: Column | str, requirements: Column | str, output: Column | str,
                 schema_version: Column | str) -> Column:
    """Text sent to a judge."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# Rubric judge (prompt_version=v1, rubric_schema_version="), col(schema_version), F.lit(")")),
        F.lit(""),
        F.lit("## Task"),
        F.concat(F.lit("- task_type: "), col(task_type)),
        F.concat(F.lit("- raw_prompt: "), col(prompt)),
        F.lit(""),
        F.lit("## Evidence requirements (you must cite these rule-by-rule)"),
        col(requirements),
        F.lit(""),
        F.lit("## Model output to evaluate (parsed)"),
        col(output),
        F.lit(""),
        F.lit("## Instructions"),
        F.lit(JUDGE_INSTRUCTIONS),
    )


# fixed values: closing instructions, headings and the line on disagreement in both prompts
JUDGE_INSTRUCTIONS = (
    "Return a JSON object with: verdict (pass|fail), score (0-1), reason (short), evidence (array of {rule, observation} "
    "for each evidence requirement). Do not rely on free text alone; every conclusion must be backed by structured "
    "evidence."
)
ARBITER_INSTRUCTIONS = (
    "Return a JSON object: verdict (pass|fail), score (0-1), reason (short), evidence (array of {rule, observation} for "
    "each rubric rule). You must provide cited rule-by-rule evidence."
)


def arbiter_prompt(task_type: Column | str, requirements: Column | str, judge_1: Column, judge_2: Column,
                   output: Column | str, schema_version: Column | str) -> Column:
    """Text sent to the arbiter; ``judge_1`` and ``judge_2`` are structs."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# Arbiter (rubric_schema_version="), col(schema_version), F.lit(")")),
        F.lit(""),
        F.lit("## Task"),
        F.concat(F.lit("- task_type: "), col(task_type)),
        F.lit("- You are resolving disagreement between two judges. Your output must cite rule-by-rule evidence."),
        F.lit(""),
        F.lit("## Evidence requirements"),
        col(requirements),
        F.lit(""),
        F.lit("## Judge 1"),
        F.to_json(judge_1),
        F.lit(""),
        F.lit("## Judge 2"),
        F.to_json(judge_2),
        F.lit(""),
        F.lit("## Model output"),
        col(output),
        F.lit(""),
        F.lit("## Instructions"),
        F.lit(ARBITER_INSTRUCTIONS),
    )
