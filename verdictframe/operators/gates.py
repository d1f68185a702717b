"""Quality gates for evaluation items: schema, semantic rules, duplicates and slot quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions import rules
from verdictframe.functions.decide import lookup
from verdictframe.functions.hashing import dedup_fingerprint
from verdictframe.functions.schema import violated
from verdictframe.functions.text import contains_any, instruction_header, normalize_prompt
from verdictframe.operators.ordered import attach, id_blocks, running_rank
from verdictframe.session import materialize

# fixed values: bounds of the item record
ITEM_SCHEMA = {
    "type": "object",
    "required": ["item_id", "domain_tags", "difficulty", "task_type", "prompt"],
    "properties": {
        "item_id": {"type": "string", "pattern": r"^[a-z0-9_\-]{8,64}$"},
        "domain_tags": {
            "type": "array",
            "items": {"type": "string", "minLength": 1, "maxLength": 64},
            "minItems": 1,
            "maxItems": 8,
        },
        "difficulty": {"type": "string", "enum": ["easy", "medium", "hard", "expert"]},
        "task_type": {"type": "string", "minLength": 1, "maxLength": 64},
        "prompt": {"type": "string", "minLength": 1, "maxLength": 20000},
    },
}
# fixed values: bounds of the oracle record
ORACLE_SCHEMA = {
    "type": "object",
    "required": ["eval_method"],
    "properties": {
        "eval_method": {
            "type": "string",
            "enum": [
                "programmatic_check",
                "schema_check",
                "exact_match",
                "trajectory_check",
                "rubric_judge",
                "unit_test",
            ],
        },
    },
}

_TEXT = {"type": "string"}
_NAME = {"type": "string", "minLength": 1, "maxLength": 64}
_OBJECT = {"type": "object"}
# fixed values: the whole item and oracle records, closed objects with all their required fields
ITEM_RECORD = {
    "type": "object",
    "additionalProperties": False,
    "required": [
        "item_id", "dataset_spec_version", "domain_tags", "difficulty", "task_type", "prompt", "input", "input_schema", "output_schema",
        "constraints", "provenance",
    ],
    "properties": {
        **ITEM_SCHEMA["properties"],
        "dataset_spec_version": _NAME,
        "input": _OBJECT,
        "input_schema": _OBJECT,
        "output_schema": _OBJECT,
        "constraints": {
            "type": "object",
            "additionalProperties": False,
            "required": ["no_subjective_judgement", "safety_notes", "locked_fields"],
            "properties": {
                "no_subjective_judgement": {"const": True},
                "safety_notes": {"type": "string", "maxLength": 2000},
                "locked_fields": {"type": "array", "items": _TEXT, "minItems": 1, "maxItems": 32},
            },
        },
        "provenance": {
            "type": "object",
            "additionalProperties": False,
            "required": ["created_at", "created_by", "source"],
            "properties": {
                "created_at": _TEXT,
                "created_by": {"type": "string", "minLength": 1, "maxLength": 128},
                "source": {"type": "string", "enum": ["synthetic", "prod_log", "human_curated", "web_grounded", "image_grounded"]},
                **{k: {"type": "array", "items": _OBJECT} for k in ("source_refs", "asset_refs", "tool_calls")},
                **{k: {"type": "string", "maxLength": 64} for k in ("blueprint_id", "family_id", "materializer_type")},
            },
        },
        "version_bundle": _OBJECT,
        "judge_spec_id": _NAME,
    },
}
ORACLE_RECORD = {
    "type": "object",
    "additionalProperties": False,
    "required": ["item_id", "eval_method", "expected", "method_justification", "evidence_requirements", "leak_check", "created_at"],
    "properties": {
        "item_id": ITEM_SCHEMA["properties"]["item_id"],
        **ORACLE_SCHEMA["properties"],
        "expected": {},
        "method_justification": {"type": "string", "minLength": 1, "maxLength": 4000},
        "evidence_requirements": {"type": ["object", "null"]},
        "leak_check": {
            "type": "object",
            "additionalProperties": False,
            "required": ["passed", "notes"],
            "properties": {"passed": {"type": "boolean"}, "notes": {"type": "string", "maxLength": 2000}},
        },
        "created_at": _TEXT,
        "checker_name": _NAME,
        "checker_config": _OBJECT,
        "failure_taxonomy": {"type": "array", "items": {"type": "string", "minLength": 1, "maxLength": 128}},
        "canonicalization_rules": {"type": "array"},
        "candidate_methods": {"type": "array", "items": _TEXT},
        "selected_method": _TEXT,
        "selection_rationale": _TEXT,
        "rejected_methods": {"type": "array", "items": _OBJECT},
        "rubric_schema_version": _TEXT,
        "version_bundle": _OBJECT,
    },
}


def record_violations(item: Column, oracle: Column) -> Column:
    """True where a whole item or oracle record (VARIANT) is missing or breaks its schema."""
    return item.isNull() | oracle.isNull() | violated(ITEM_RECORD, item) | violated(ORACLE_RECORD, oracle)


def as_variant(columns: Sequence[str]) -> Column:
    return F.to_variant_object(F.struct(*columns))


def item_violations() -> Column:
    """True where the typed item columns break the item or the oracle schema."""
    item = as_variant(list(ITEM_SCHEMA["properties"]))
    oracle = as_variant(list(ORACLE_SCHEMA["properties"]))
    return violated(ITEM_SCHEMA, item) | violated(ORACLE_SCHEMA, oracle)


# --- semantic rules; each is True where the item fails -------------------------------------------------


def bad_domain_tag(tags: Column, allowed: Sequence[str]) -> Column:
    return F.size(F.array_except(tags, F.array(*map(F.lit, allowed)))) > 0


def bad_task_type(task: Column, allowed: Sequence[str]) -> Column:
    return ~task.isin(*allowed)


def bad_method(method: Column) -> Column:
    return ~method.isin(*rules.MACHINE_METHODS, "rubric_judge")


def _given(requirements: Column) -> Column:
    """Evidence requirements that are neither absent nor an empty object."""
    return F.coalesce(~F.to_json(F.try_parse_json(requirements)).isin("{}", "null"), F.lit(False))


def rubric_incomplete(method: Column, requirements: Column) -> Column:
    return (method == "rubric_judge") & ~_given(requirements)


def _schema_part(schema: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(F.try_parse_json(schema), path, kind)


def _structured(schema: Column) -> Column:
    properties = F.coalesce(F.size(_schema_part(schema, "$.properties", "map<string,variant>")), F.lit(0))
    return _schema_part(schema, "$.type").isNotNull() | (properties > 0)


def bad_output_schema(schema: Column) -> Column:
    return ~_structured(schema)


def prompt_too_long(prompt: Column, limit: int) -> Column:
    return F.length(prompt) > limit


def oracle_leak(leak_passed: Column) -> Column:
    return F.coalesce(~leak_passed, F.lit(False))


def subjective(prompt: Column) -> Column:
    return contains_any(F.lower(instruction_header(prompt)), rules.SUBJECTIVE_PHRASES)


def ambiguous(prompt: Column, method: Column, requirements: Column) -> Column:
    vague = contains_any(F.lower(instruction_header(prompt)), rules.AMBIGUOUS_PHRASES)
    measurable = method.isin(*rules.MACHINE_METHODS) | ((method == "rubric_judge") & _given(requirements))
    return vague & ~measurable


def conflicting(prompt: Column) -> Column:
    """Never fires; the code is kept in the vocabulary."""
    return F.lit(False)


def unverifiable(method: Column, requirements: Column, schema: Column) -> Column:
    open_ended = ~_structured(schema) | ((method == "rubric_judge") & ~_given(requirements))
    return ~method.isin(*rules.MACHINE_METHODS) & open_ended


def multiple_answers(method: Column, schema: Column) -> Column:
    properties = F.coalesce(
        _schema_part(schema, "$.properties", "map<string,variant>"), F.create_map().cast("map<string,variant>")
    )
    required = F.coalesce(_schema_part(schema, "$.required", "array<string>"), F.array().cast("array<string>"))
    bare_object = (F.size(properties) == 0) & (F.coalesce(_schema_part(schema, "$.type", "string"), F.lit("")) == "object")
    free_text = F.exists(
        F.map_entries(properties),
        lambda e: (F.coalesce(F.try_variant_get(e["value"], "$.type", "string"), F.lit("")) == "string")
        & F.try_variant_get(e["value"], "$.enum", "variant").isNull()
        & ~F.array_contains(required, e["key"]),
    )
    return bare_object | (free_text & ~method.isin(*rules.MACHINE_METHODS))


def first_failure(
    allowed_tags: Sequence[str], allowed_tasks: Sequence[str], max_prompt: int, schema_gate: Column
) -> Column:
    """Code of the first gate or rule that fails before the statistical gate, else an empty string."""
    c = F.col
    checks = [
        (schema_gate, "SCHEMA_INVALID"),
        (bad_domain_tag(c("domain_tags"), allowed_tags), "DISALLOWED_DOMAIN_TAG"),
        (bad_task_type(c("task_type"), allowed_tasks), "SCHEMA_INVALID"),
        (bad_method(c("eval_method")), "SCHEMA_INVALID"),
        (rubric_incomplete(c("eval_method"), c("evidence_requirements")), "RUBRIC_INCOMPLETE"),
        (bad_output_schema(c("output_schema")), "SCHEMA_INVALID"),
        (prompt_too_long(c("prompt"), max_prompt), "PROMPT_TOO_LONG"),
        (oracle_leak(c("leak_passed")), "ORACLE_LEAK"),
        (subjective(c("prompt")), "SUBJECTIVE_TASK"),
        (ambiguous(c("prompt"), c("eval_method"), c("evidence_requirements")), "AMBIGUOUS_TASK"),
        (conflicting(c("prompt")), "CONFLICTING_CONSTRAINTS"),
        (unverifiable(c("eval_method"), c("evidence_requirements"), c("output_schema")), "UNVERIFIABLE_OUTPUT"),
        (multiple_answers(c("eval_method"), c("output_schema")), "MULTI_VALID_ANSWER"),
    ]
    return F.coalesce(*[F.when(test, F.lit(code)) for test, code in checks], F.lit(""))


# --- statistical gate ----------------------------------------------------------------------------------


def first_seen(items: DataFrame, key: str = "fp", idx: str = "idx") -> DataFrame:
    """One row per key: its first id and how many rows share it (combined before the shuffle)."""
    return items.groupBy(key).agg(F.min(idx).alias("first_idx"), F.count("*").alias("n_copies"))


def flag_first(items: DataFrame, key: str = "fp", idx: str = "idx") -> DataFrame:
    """Add ``is_first``. Joined back on the unique id, never on the key that many copies share."""
    firsts = first_seen(items, key, idx).select(F.col("first_idx").alias(idx), F.lit(True).alias("is_first"))
    return items.join(firsts, idx, "left").withColumn("is_first", F.coalesce("is_first", F.lit(False)))


#: Characters of a duplicate's normalised prompt that its report shows.
PREVIEW = 500


def duplicate_report(items: DataFrame, keep: Sequence[str] = (), key: str = "fp", idx: str = "idx", prompt: str = "prompt") -> DataFrame:
    """What each item that is not the first of its fingerprint repeats: the first item, the number of copies, the
    beginning of the normalised prompt, and the ``keep`` columns (family, blueprint, task type).

    Prompts are read once; a fingerprint that a third of all items share is spread over tasks.
    """
    preview = F.substring(normalize_prompt(prompt), 1, PREVIEW).alias("prompt_preview")
    narrow = materialize(items.select(idx, key, *keep, preview), "previews")
    repeated = first_seen(narrow, key, idx).where(F.col("n_copies") > 1)
    found = attach(narrow, repeated, [key], idx, "n_copies")
    return found.where(F.col(idx) > F.col("first_idx"))


def slot_ranks(
    items: DataFrame, slot: Sequence[str], planned: DataFrame, key: str = "fp", idx: str = "idx"
) -> DataFrame:
    """First-seen rows with their place in the slot and whether the plan still has room.

    ``planned`` has the slot columns and ``planned``; a slot without a plan has 0. A key counts in the slot of
    its first row, also where copies lie in other slots.
    """
    firsts = materialize(
        items.groupBy(key).agg(F.min(idx).alias("first_idx"), F.count("*").alias("n_copies"), F.min_by(F.struct(*slot), idx).alias("_slot"))
        .select(key, "first_idx", "n_copies", "_slot.*"),
        "firsts",
    )
    ranked = running_rank(id_blocks(firsts, "first_idx"), list(slot), ["first_idx"], "slot_rank")
    return (
        ranked.join(planned, list(slot), "left")
        .withColumn("accepted", F.col("slot_rank") <= F.coalesce("planned", F.lit(0)) + rules.DISTRIBUTION_TOLERANCE)
        .select(key, *slot, "first_idx", "n_copies", "slot_rank", "accepted")
    )


def stat_gate(
    items: DataFrame, slot: Sequence[str], planned: DataFrame, key: str = "fp", idx: str = "idx"
) -> DataFrame:
    """Add ``stat_code``: DUPLICATE_ITEM, DISTRIBUTION_MISMATCH or empty.

    A copy counts as a duplicate only when the first row of its key was accepted; a key whose first
    row found its slot full never enters the set of seen keys, so its copies overflow as well.
    """
    ranks = slot_ranks(items, slot, planned, key, idx).select(key, "first_idx", "n_copies", "accepted")
    joined = attach(items, ranks, [key], spread_by=idx, copies="n_copies")
    return joined.withColumn(
        "stat_code",
        F.when(~F.col("accepted"), "DISTRIBUTION_MISMATCH")
        .when(F.col(idx) == F.col("first_idx"), "")
        .otherwise("DUPLICATE_ITEM"),
    ).drop("first_idx", "n_copies", "accepted")


def qa_gate(
    items: DataFrame,
    planned: DataFrame,
    allowed_tags: Sequence[str],
    allowed_tasks: Sequence[str],
    max_prompt: int,
    slot: Sequence[str] = ("task_type", "difficulty"),
    schema_gate: Column | None = None,
) -> DataFrame:
    """QA report per item: passed, failing gate, code and patch instruction.

    Prompts are read once, where they lie; ids, hashes and short codes are written to a narrow table,
    and only these are shuffled.
    """
    gate = item_violations() if schema_gate is None else schema_gate
    kind = F.col("materializer_type") if "materializer_type" in items.columns else None
    fp = dedup_fingerprint("prompt", "task_type", "difficulty", "blueprint_id", "family_id", kind)
    early = first_failure(allowed_tags, allowed_tasks, max_prompt, F.col("schema_failed"))
    narrow = materialize(
        items.withColumn("schema_failed", gate).select(
            "idx", "item_id", *slot, fp.alias("fp"), "schema_failed", early.alias("early_code")
        ),
        "gate",
    )
    judged = stat_gate(narrow.where(F.col("early_code") == "").select("idx", "item_id", *slot, "fp"), slot, planned)
    late = judged.select(
        "idx", "item_id", *slot, F.lit(False).alias("schema_failed"), F.lit("").alias("early_code"), "stat_code"
    )
    early = narrow.where(F.col("early_code") != "").select(
        "idx", "item_id", *slot, "schema_failed", "early_code", F.lit("").alias("stat_code")
    )
    both = early.unionByName(late)
    code = F.when(F.col("early_code") != "", F.col("early_code")).otherwise(F.col("stat_code"))
    gate_name = (
        F.when(F.col("schema_failed"), "schema").when(F.col("early_code") != "", "semantic")
        .when(F.col("stat_code") != "", "stat").otherwise("")
    )
    return both.select(
        "idx",
        "item_id",
        (code == "").alias("passed"),
        gate_name.alias("failed_gate"),
        code.alias("failure_code"),
        F.when(code == "", "").otherwise(lookup(code, rules.PATCHES, rules.DEFAULT_PATCH)).alias("patch_instructions"),
    )


def gates_array(failed_gate: Column, code: Column) -> Column:
    """Gate results in order, ending with the gate that failed."""
    def gate(name: str, when: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(name).alias("gate"),
                (failed_gate != name).alias("passed"),
                F.when(failed_gate == name, code).otherwise("").alias("failure_code"),
            ),
        )

    return F.array_compact(
        F.array(
            gate("schema", F.lit(True)),
            gate("semantic", failed_gate != "schema"),
            gate("stat", ~failed_gate.isin("schema", "semantic")),
        )
    )


def locked_field_drift(old: DataFrame, new: DataFrame, locked: Sequence[str], key: str = "item_id") -> DataFrame:
    """One row per item whose locked fields differ between two versions; the first drifted field is named."""
    after = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in locked])
    drifted = F.array_compact(
        F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_new_{c}")), F.lit(c)) for c in locked])
    )
    return (
        old.join(after, key)
        .withColumn("fields", drifted)
        .where(F.size("fields") > 0)
        .select(key, F.concat(F.lit("TASK_DEFINITION_DRIFT:"), F.get("fields", 0)).alias("failure_code"),
                F.array_join("fields", ",").alias("drifted"))
    )
