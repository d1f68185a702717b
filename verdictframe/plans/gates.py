"""Queries of the quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.functions import rules
from verdictframe.functions.hashing import dedup_fingerprint
from verdictframe.functions.text import normalize_prompt
from verdictframe.operators import gates
from verdictframe.operators.ordered import id_blocks, running_rank
from verdictframe.operators.leaks import contained_texts
from verdictframe.operators.metrics import duplicate_audit
from verdictframe.plans.registry import query
from verdictframe.plans.scalars import sql_case, sql_text
from verdictframe.plans.views import table, view
from verdictframe.session import materialize, spread

ALLOWED_TAGS = ["en", "fr", "de"]
ALLOWED_TASKS = ["json_extract_email", "json_classify_sentiment", "trajectory_email_then_answer"]
MAX_PROMPT = 8000
SLOT = ["task_type", "difficulty"]

_IN = lambda values: "(" + ", ".join(map(sql_text, values)) + ")"
_MACHINE = _IN(rules.MACHINE_METHODS)
_GIVEN = "(evidence_requirements IS NOT NULL AND evidence_requirements <> '{}')"
_HEADER = (
    "lower(CASE WHEN strpos(prompt, 'Input JSON:') > 0 THEN substr(prompt, 1, strpos(prompt, 'Input JSON:') - 1) "
    "WHEN strpos(prompt, 'input json:') > 0 THEN substr(prompt, 1, strpos(prompt, 'input json:') - 1) "
    "WHEN strpos(prompt, chr(10) || 'Input ') > 0 THEN substr(prompt, 1, strpos(prompt, chr(10) || 'Input ') - 1) "
    "WHEN strpos(prompt, chr(10) || 'input ') > 0 THEN substr(prompt, 1, strpos(prompt, chr(10) || 'input ') - 1) "
    "ELSE prompt END)"
)
_HAS = lambda phrases: "(" + " OR ".join(f"contains({_HEADER}, {sql_text(p)})" for p in phrases) + ")"

# the gate predicates in DuckDB
SQL = {
    "schema": "(NOT regexp_matches(item_id, '^[a-z0-9_\\-]{8,64}$') OR length(prompt) NOT BETWEEN 1 AND 20000)",
    "domain_tag": f"domain_tag NOT IN {_IN(ALLOWED_TAGS)}",
    "task_type": f"task_type NOT IN {_IN(ALLOWED_TASKS)}",
    "method": f"eval_method NOT IN {_IN(rules.MACHINE_METHODS + ['rubric_judge'])}",
    "rubric": f"(eval_method = 'rubric_judge' AND NOT {_GIVEN})",
    "output_schema": "output_schema = '{}'",
    "prompt_len": f"length(prompt) > {MAX_PROMPT}",
    "leak": "NOT leak_passed",
    "subjective": _HAS(rules.SUBJECTIVE_PHRASES),
    "ambiguous": f"({_HAS(rules.AMBIGUOUS_PHRASES)} AND NOT (eval_method IN {_MACHINE} OR (eval_method = 'rubric_judge' AND {_GIVEN})))",
    "unverifiable": f"(eval_method NOT IN {_MACHINE} AND (output_schema = '{{}}' OR (eval_method = 'rubric_judge' AND NOT {_GIVEN})))",
    "multi_answer": "(output_schema = '{\"type\":\"object\"}' OR "
    f"(contains(output_schema, '\"note\"') AND eval_method NOT IN {_MACHINE}))",
}


def gate_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose prompts carry taste words now and then."""
    items = view(spark, sf, "v_items", wide=True)
    lead = (
        F.when(F.col("idx") % 14 == 5, "In your opinion WHICH one? ")
        .when(F.col("idx") % 12 == 7, "Pick the BEST option. ")
        .otherwise("")
    )
    return items.withColumns({"prompt": F.concat(lead, "prompt"), "domain_tags": F.array("domain_tag")})


GATE_ITEMS = """
    gi AS (SELECT * REPLACE (CASE WHEN idx % 14 = 5 THEN 'In your opinion WHICH one? ' WHEN idx % 12 = 7 THEN 'Pick the BEST option. '
           ELSE '' END || prompt AS prompt) FROM v_items)"""


def predicates() -> dict[str, Column]:
    c = F.col
    return {
        "schema": gates.item_violations(),
        "domain_tag": gates.bad_domain_tag(c("domain_tags"), ALLOWED_TAGS),
        "task_type": gates.bad_task_type(c("task_type"), ALLOWED_TASKS),
        "method": gates.bad_method(c("eval_method")),
        "rubric": gates.rubric_incomplete(c("eval_method"), c("evidence_requirements")),
        "output_schema": gates.bad_output_schema(c("output_schema")),
        "prompt_len": gates.prompt_too_long(c("prompt"), MAX_PROMPT),
        "leak": gates.oracle_leak(c("leak_passed")),
        "subjective": gates.subjective(c("prompt")),
        "ambiguous": gates.ambiguous(c("prompt"), c("eval_method"), c("evidence_requirements")),
        "unverifiable": gates.unverifiable(c("eval_method"), c("evidence_requirements"), c("output_schema")),
        "multi_answer": gates.multiple_answers(c("eval_method"), c("output_schema")),
    }


def _gate_query(name: str) -> None:
    @query(f"gate_{name}", f"WITH {GATE_ITEMS} SELECT idx, {SQL[name]} AS failed FROM gi", ("v_items",))
    def gate(spark: SparkSession, sf: str) -> DataFrame:
        return gate_items(spark, sf).select("idx", predicates()[name].alias("failed"))


for _name in SQL:
    _gate_query(_name)

_FP = r"""sha256(trim(regexp_replace(lower(prompt), '\s+', ' ', 'g')) || chr(1) || task_type || chr(1) || difficulty
           || chr(1) || 'b=' || blueprint_id || chr(1) || 'f=' || family_id)"""

# sequential semantics of the statistical gate, for rows that reached it
STAT_SQL = """
    firsts AS (SELECT fp, task_type, difficulty, min(idx) AS first_idx FROM reached GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY task_type, difficulty ORDER BY first_idx) AS slot_rank FROM firsts),
    stat AS (SELECT r.idx, k.slot_rank, CASE WHEN k.slot_rank > planned + 1 THEN 'DISTRIBUTION_MISMATCH'
                WHEN r.idx = first_idx THEN '' ELSE 'DUPLICATE_ITEM' END AS stat_code
             FROM reached r JOIN ranked k USING (fp) JOIN plan p ON p.task_type = r.task_type AND p.difficulty = r.difficulty)"""

# three quarters of each slot are planned
PLAN_SQL = """plan AS (SELECT task_type, difficulty, count(*) * 3 // 4 AS planned FROM v_items GROUP BY ALL)"""


def plan(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_items").groupBy(*SLOT).agg(F.floor(F.count("*") * 3 / 4).alias("planned"))


def with_fp(items: DataFrame) -> DataFrame:
    fp = dedup_fingerprint("prompt", "task_type", "difficulty", "blueprint_id", "family_id")
    return items.select("idx", *SLOT, fp.alias("fp"))


def copies(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose fingerprint ignores the blueprint, so that copied documents collide."""
    fp = dedup_fingerprint("prompt", F.lit("any"), "difficulty")
    return view(spark, sf, "v_items", wide=True).select("idx", F.lit("any").alias("task_type"), "difficulty", fp.alias("fp"))


COPIES_SQL = r"""
    reached AS (SELECT idx, 'any' AS task_type, difficulty,
        sha256(trim(regexp_replace(lower(prompt), '\s+', ' ', 'g')) || chr(1) || 'any' || chr(1) || difficulty) AS fp FROM v_items)"""
COPIES_PLAN = "plan AS (SELECT 'any' AS task_type, difficulty, count(*) * 3 // 4 AS planned FROM v_items GROUP BY difficulty)"


@query("gate_duplicate", f"""
    WITH {COPIES_SQL} SELECT idx, fp, idx <> min(idx) OVER (PARTITION BY fp) AS duplicate FROM reached""", ("v_items",))
def gate_duplicate(spark: SparkSession, sf: str) -> DataFrame:
    return gates.flag_first(copies(spark, sf)).select("idx", "fp", (~F.col("is_first")).alias("duplicate"))


@query("duplicate_report", r"""
    WITH r AS (SELECT idx, task_type, family_id, blueprint_id, difficulty, trim(regexp_replace(lower(prompt), '\s+', ' ', 'g')) AS p FROM v_items),
    h AS (SELECT *, sha256(p || chr(1) || 'any' || chr(1) || difficulty) AS fp FROM r),
    w AS (SELECT *, min(idx) OVER (PARTITION BY fp) AS first_idx, count(*) OVER (PARTITION BY fp) AS n_copies FROM h)
    SELECT idx, fp, task_type, family_id, blueprint_id, substring(p, 1, 500) AS prompt_preview, first_idx, n_copies FROM w WHERE idx > first_idx""", ("v_items",))
def duplicate_report(spark: SparkSession, sf: str) -> DataFrame:
    """The duplicates of ``gate_duplicate`` with what they repeat."""
    fp = dedup_fingerprint("prompt", F.lit("any"), "difficulty")
    return gates.duplicate_report(view(spark, sf, "v_items", wide=True).withColumn("fp", fp), ["task_type", "family_id", "blueprint_id"])


@query("dedup_first_seen", f"WITH {COPIES_SQL} SELECT fp, min(idx) AS first_idx, count(*) AS n_copies FROM reached GROUP BY fp", ("v_items",))
def dedup_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return gates.first_seen(copies(spark, sf)).select("fp", "first_idx", "n_copies")


def narrow_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Ids, slots and hashes, written once: the texts are read a single time."""
    return materialize(copies(spark, sf), "fingerprints")


def _copies_plan(items: DataFrame) -> DataFrame:
    return items.groupBy(*SLOT).agg(F.floor(F.count("*") * 3 / 4).alias("planned"))


@query("slot_overflow", f"""
    WITH {COPIES_SQL}, {COPIES_PLAN}, {STAT_SQL}
    SELECT fp, first_idx, slot_rank, slot_rank <= planned + 1 AS accepted FROM ranked JOIN plan USING (difficulty)""", ("v_items",))
def slot_overflow(spark: SparkSession, sf: str) -> DataFrame:
    items = narrow_copies(spark, sf)
    return gates.slot_ranks(items, SLOT, _copies_plan(items)).select("fp", "first_idx", "slot_rank", "accepted")


@query("gate_distribution", f"WITH {COPIES_SQL}, {COPIES_PLAN}, {STAT_SQL} SELECT idx, stat_code FROM stat", ("v_items",))
def gate_distribution(spark: SparkSession, sf: str) -> DataFrame:
    items = narrow_copies(spark, sf)
    return gates.stat_gate(items, SLOT, _copies_plan(items)).select("idx", "stat_code")


@query("gate_distribution_split", f"""
    WITH {COPIES_SQL}, s AS (SELECT *, idx % 3 AS split FROM reached), plan AS (SELECT difficulty, split, count(*) // 4 AS planned FROM s GROUP BY ALL),
    firsts AS (SELECT fp, min(idx) AS first_idx, arg_min(difficulty, idx) AS difficulty, arg_min(split, idx) AS split FROM s GROUP BY fp),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY difficulty, split ORDER BY first_idx) AS slot_rank FROM firsts)
    SELECT s.idx, CASE WHEN slot_rank > planned + 1 THEN 'DISTRIBUTION_MISMATCH' WHEN s.idx = first_idx THEN '' ELSE 'DUPLICATE_ITEM' END AS stat_code
    FROM s JOIN ranked k USING (fp) JOIN plan p ON p.difficulty = k.difficulty AND p.split = k.split""", ("v_items",))
def gate_distribution_split(spark: SparkSession, sf: str) -> DataFrame:
    """Slots by a column that the fingerprint does not know: copies lie in other slots than their first."""
    items = narrow_copies(spark, sf).withColumn("split", F.col("idx") % 3)
    slot = ["difficulty", "split"]
    planned = items.groupBy(*slot).agg(F.floor(F.count("*") / 4).alias("planned"))
    return gates.stat_gate(items, slot, planned).select("idx", "stat_code")


_EARLY = f"""CASE WHEN {SQL["schema"]} THEN 'SCHEMA_INVALID' WHEN {SQL["domain_tag"]} THEN 'DISALLOWED_DOMAIN_TAG'
    WHEN {SQL["task_type"]} THEN 'SCHEMA_INVALID' WHEN {SQL["method"]} THEN 'SCHEMA_INVALID'
    WHEN {SQL["rubric"]} THEN 'RUBRIC_INCOMPLETE' WHEN {SQL["output_schema"]} THEN 'SCHEMA_INVALID'
    WHEN {SQL["prompt_len"]} THEN 'PROMPT_TOO_LONG' WHEN {SQL["leak"]} THEN 'ORACLE_LEAK'
    WHEN {SQL["subjective"]} THEN 'SUBJECTIVE_TASK' WHEN {SQL["ambiguous"]} THEN 'AMBIGUOUS_TASK'
    WHEN {SQL["unverifiable"]} THEN 'UNVERIFIABLE_OUTPUT' WHEN {SQL["multi_answer"]} THEN 'MULTI_VALID_ANSWER' ELSE '' END"""

QA_SQL = f"""
    {GATE_ITEMS}, {PLAN_SQL.replace("3 // 4", "1 // 4")},
    early AS (SELECT idx, item_id, task_type, difficulty, domain_tag, {_FP} AS fp, {SQL["schema"]} AS schema_failed, {_EARLY} AS early_code FROM gi),
    reached AS (SELECT * FROM early WHERE early_code = ''), {STAT_SQL},
    qa AS (SELECT e.idx, item_id, task_type, difficulty, CASE WHEN early_code <> '' THEN early_code ELSE stat_code END AS failure_code,
              CASE WHEN schema_failed THEN 'schema' WHEN early_code <> '' THEN 'semantic' WHEN stat_code <> '' THEN 'stat' ELSE '' END AS failed_gate
           FROM early e LEFT JOIN stat s ON e.idx = s.idx)"""


def qa_reports(spark: SparkSession, sf: str) -> DataFrame:
    items = gate_items(spark, sf)
    planned = items.groupBy(*SLOT).agg(F.floor(F.count("*") / 4).alias("planned"))
    return gates.qa_gate(items, planned, ALLOWED_TAGS, ALLOWED_TASKS, MAX_PROMPT, SLOT)


@query("qa_gate", f"""
    WITH {QA_SQL}
    SELECT idx, item_id, failure_code = '' AS passed, failed_gate, failure_code,
           CASE WHEN failure_code = '' THEN '' ELSE {sql_case("failure_code", rules.PATCHES, "''")} END AS patch_instructions,
           CASE failed_gate WHEN 'schema' THEN 'schema:false' WHEN 'semantic' THEN 'schema:true>semantic:false'
                WHEN 'stat' THEN 'schema:true>semantic:true>stat:false' ELSE 'schema:true>semantic:true>stat:true' END AS gates
    FROM qa""", ("v_items",))
def qa_gate(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.transform(
        gates.gates_array(F.col("failed_gate"), F.col("failure_code")), lambda g: F.concat_ws(":", g["gate"], g["passed"].cast("string"))
    )
    return qa_reports(spark, sf).withColumn("gates", F.array_join(shown, ">"))


@query("locked_field_drift", """
    SELECT item_id, 'TASK_DEFINITION_DRIFT:' || CASE WHEN idx % 7 = 0 THEN 'domain_tag' ELSE 'difficulty' END AS failure_code,
           CASE WHEN idx % 7 = 0 AND idx % 9 = 0 THEN 'domain_tag,difficulty' WHEN idx % 7 = 0 THEN 'domain_tag' ELSE 'difficulty' END AS drifted
    FROM v_items WHERE idx % 9 = 0 OR idx % 7 = 0""", ("v_items",))
def locked_field_drift(spark: SparkSession, sf: str) -> DataFrame:
    old = view(spark, sf, "v_items").select("idx", "item_id", "domain_tag", "difficulty", "task_type")
    new = old.withColumns({
        "difficulty": F.when(F.col("idx") % 9 == 0, "changed").otherwise(F.col("difficulty")),
        "domain_tag": F.when(F.col("idx") % 7 == 0, F.lit(None)).otherwise(F.col("domain_tag")),
    })
    return gates.locked_field_drift(old, new, ["domain_tag", "difficulty", "task_type"])


@query("leak_corpus_scan", """
    SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))""")
def leak_corpus_scan(spark: SparkSession, sf: str) -> DataFrame:
    return contained_texts(spread(table(spark, sf, "documents")), table(spark, sf, "benchmark"))


@query("duplicate_audit", f"""
    WITH {COPIES_SQL} SELECT count(*) AS n, count(DISTINCT fp) AS n_distinct, count(*) - count(DISTINCT fp) AS n_duplicates FROM reached""", ("v_items",))
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_audit(copies(spark, sf))


@query("suite_dedupe", r"""
    WITH k AS (SELECT min(idx) AS idx, task_type FROM v_items GROUP BY task_type, trim(regexp_replace(lower(prompt), '\\s+', ' ', 'g'))),
    r AS (SELECT idx, task_type, row_number() OVER (ORDER BY idx) AS place FROM k)
    SELECT idx, task_type, place FROM r WHERE place <= (SELECT count(*) * 4 // 5 FROM v_items)""", ("v_items",))
def suite_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """First item per task and whole normalised prompt until the quota is full."""
    items = view(spark, sf, "v_items").select("idx", "task_type", F.sha2(normalize_prompt("prompt"), 256).alias("key"))
    kept = items.groupBy("task_type", "key").agg(F.min("idx").alias("idx"))
    quota = items.select(F.floor(F.count("*") * 4 / 5)).scalar()
    ranked = running_rank(id_blocks(kept.select("idx", "task_type"), "idx"), [], ["idx"], "place")
    return ranked.where(F.col("place") <= quota).select("idx", "task_type", "place")
