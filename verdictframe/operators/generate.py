"""Evaluation items from a plan: templates chosen by hash, grounding texts joined in."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions import rules
from verdictframe.functions.decide import applicable_methods, lookup, pick_by_priority
from verdictframe.functions.text import extract_email, extract_name
from verdictframe.operators.ordered import attach

# (task type, scenario, source text, instruction); {email} {name} {decoy} {a} {b} {c} are filled in
TEMPLATES = [
    ("json_math_add", "default", "", "Add the integers a and b."),
    ("json_math_add", "carry_chain", "", "Add the integers a and b; mind every carry."),
    ("json_math_add", "wording_distraction", "", "Whatever else is said here, report the total of a and b."),
    ("json_math_add", "multi_step", "", "Add a and b, then add c to the result."),
    ("json_extract_email", "default", "You can reach the desk at {email} on weekdays.", "Extract the email address."),
    ("json_extract_email", "distractor", "Write to {email}. Do not use {decoy}.", "Extract the address that may be used."),
    ("json_extract_email", "noisy", "[Ticket 7] >>> sender {email} <<< [footer]", "Extract the sender address."),
    ("json_extract_email", "multi", "To: {email} / Cc: {decoy}", "Extract the main recipient."),
    ("json_extract_email", "wrapped", "--- {email} --- signed {decoy}", "Extract the address between the dashes."),
    ("json_extract_structured", "default", "Contact {name} at {email} for support.", "Extract email and name."),
    ("json_extract_structured", "distractor", "Contact {name} at {email}. Do not use {decoy}.", "Extract email and name."),
    ("json_extract_structured", "noisy", "[Ticket 9] Contact {name} at {email} [end]", "Extract email and name."),
    ("json_extract_structured", "multi_record", "Contact {name} at {email} . A second record names {decoy}.",
     "Extract the contact, not the second record."),
    ("json_extract_structured", "conflicting_fields", "Contact {name} at {email} (primary), {decoy} (other).",
     "Extract the primary email and name."),
    ("trajectory_email_then_answer", "default", "Look up the owner of {email}.", "Call search_email_db, then answer."),
    ("trajectory_email_then_answer", "tool_order_trap", "Answer with {email}.", "The order matters: call search_email_db first."),
    ("trajectory_email_then_answer", "missing_tool_arg_risk", "Contact on file: {email}.",
     "Pass the whole document to search_email_db, then answer."),
    ("trajectory_email_then_answer", "distractor_email", "Primary: {email}. Other: {decoy}.",
     "Call search_email_db, then answer with the Primary address."),
    ("trajectory_email_then_answer", "multi_step_dependency", "Step 1 finds the owner; step 2 returns {email}.",
     "Follow Step 1 with search_email_db, then answer."),
    ("factual_grounded_qa", "default", "{name} opened the office in {a}.", "When did the office open?"),
    ("factual_grounded_qa", "distractor_context", "{name} opened the office in {a}. Unrelated: it rained in {b}.",
     "When did the office open?"),
    ("factual_grounded_qa", "near_match", "{name} opened the office; a namesake closed it.", "Give the exact name of the opener."),
    ("factual_grounded_qa", "multi_hopish", "Step 1: {name} came in {a}. Step 2: the office opened that year.",
     "When did the office open?"),
    ("factual_grounded_qa", "citation_conflict", "Source A: opened in {a}. Source B: opened by {name}.", "Use Source A for the year."),
]
INSTRUCTION = "You MUST output valid JSON that matches the output_schema."


def _fill(text: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def materialize_items(slots: DataFrame, seed: int) -> DataFrame:
    """One item per slot (slot, task_type, difficulty, domain_tags, blueprint_id, repetition_index,
    scenario_subtype). Everything random is a hash of seed, blueprint and repetition, so a task that
    runs again writes the same item."""
    key = [F.lit(seed), F.coalesce("blueprint_id", F.lit("default")), F.col("repetition_index")]

    def pick(label: str, n: int) -> Column:
        return F.pmod(F.xxhash64(*key, F.lit(label)), F.lit(n))

    sentiment = F.array(*map(F.lit, rules.SENTIMENT_LABELS))
    choices = {}
    for task, scenario, text, instruction in TEMPLATES:
        choices.setdefault(task, []).append((scenario, text, instruction))
    label_tasks = F.col("task_type").isin("json_classify_sentiment", "json_classify_canonical")

    def template(field: int) -> Column:
        out = F.lit(None).cast("string")
        for task, options in choices.items():
            texts = F.array(*[F.lit(o[field]) for o in options])
            any_of = F.get(texts, pick("template", len(options)).cast("int"))
            exact = F.coalesce(
                *[F.when(F.col("scenario_subtype") == o[0], F.lit(o[field])) for o in options], any_of
            )
            out = F.when(F.col("task_type") == task, exact).otherwise(out)
        return out

    values = {
        "email": F.concat(F.lit("alex"), pick("user", 10_000), F.lit("@example.com")),
        "name": F.concat(F.lit("Alice"), F.translate(pick("name", 10_000).cast("string"), "0123456789", "abcdefghij")),
        "decoy": F.concat(F.lit("bob"), pick("decoy", 100), F.lit("@other.com")),
        "a": pick("a", 900) + 100,
        "b": pick("b", 900) + 100,
        "c": pick("c", 50) + 1,
    }
    filled = slots.select(
        "*",
        F.when(label_tasks, F.get(sentiment, pick("sentiment", len(rules.SENTIMENT_LABELS)).cast("int")))
        .otherwise(_fill(template(1), values)).alias("_text"),
        F.when(label_tasks, "Classify sentiment into one of: positive, neutral, negative.").otherwise(template(2)).alias("_task"),
        *[v.alias(f"_{n}") for n, v in values.items()],
    )
    math = F.when(
        F.col("scenario_subtype") == "multi_step", F.to_json(F.struct(*[F.col(f"_{n}").alias(n) for n in "abc"]))
    ).otherwise(F.to_json(F.struct(*[F.col(f"_{n}").alias(n) for n in "ab"])))
    given = (
        F.when(F.col("task_type") == "json_math_add", math)
        .when(F.col("task_type") == "factual_grounded_qa", F.to_json(F.struct(F.col("_text").alias("context"), F.col("_task").alias("question"))))
        .otherwise(F.to_json(F.struct(F.col("_text").alias("text"))))
    )
    fields = {
        "json_math_add": {"answer": "integer"},
        "json_extract_email": {"email": "string"},
        "json_extract_structured": {"email": "string", "name": "string"},
        "trajectory_email_then_answer": {"email": "string"},
        "factual_grounded_qa": {"answer": "string"},
        "json_classify_sentiment": {"label": "string"},
        "json_classify_canonical": {"label": "string"},
    }
    schema = F.coalesce(*[F.when(F.col("task_type") == t, F.lit(closed_schema(f))) for t, f in fields.items()])
    return filled.select(
        F.concat(F.lit("item_"), F.lower(F.hex(F.xxhash64(*key, F.lit("id"), "slot")))).alias("item_id"),
        *slots.columns,
        F.concat_ws("\n", F.lit(INSTRUCTION), F.concat(F.lit("Task: "), "_task"), F.concat(F.lit("Input JSON: "), given)).alias("prompt"),
        given.alias("input"),
        schema.alias("output_schema"),
        F.lit("synthetic").alias("source"),
    )


def closed_schema(fields: dict[str, str]) -> str:
    return json.dumps({
        "type": "object",
        "additionalProperties": False,
        "required": list(fields),
        "properties": {k: {"type": v} for k, v in fields.items()},
    })


def expected_answers(items: DataFrame) -> DataFrame:
    """Oracle of every generated item, from its input: method, checker and expected JSON."""
    v = F.try_parse_json("input")
    text = F.try_variant_get(v, "$.text", "string")
    total = F.try_variant_get(v, "$.a", "bigint") + F.try_variant_get(v, "$.b", "bigint") + F.coalesce(
        F.try_variant_get(v, "$.c", "bigint"), F.lit(0)
    )
    task = F.col("task_type")
    expected = (
        F.when(task == "json_math_add", F.to_json(F.struct(total.alias("answer"))))
        .when(task.isin("json_extract_email", "trajectory_email_then_answer"), F.to_json(F.struct(extract_email(text).alias("email"))))
        .when(task == "json_extract_structured", F.to_json(F.struct(extract_email(text).alias("email"), extract_name(text).alias("name"))))
        .when(task.isin("json_classify_sentiment", "json_classify_canonical"),
              F.to_json(F.struct(lookup(text, rules.SENTIMENT_LABELS, rules.DEFAULT_LABEL).alias("label"))))
        .otherwise(F.to_json(F.struct(F.coalesce(F.try_variant_get(v, "$.context", "string"), F.lit("")).alias("answer"))))
    )
    return items.select(
        "*",
        pick_by_priority(applicable_methods("task_type"))["selected"].alias("eval_method"),
        lookup("task_type", {k: c for k, (_, c) in rules.TASKS.items() if c}).alias("checker_name"),
        expected.alias("expected"),
    )


def ground_items(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Complete items by their source policy: a page's text, an image description, or as they are.

    ``items`` has its id first, then source_policy, page_id and prompt; ``pages`` page_id, url and content, one row per page.
    """
    used = items.groupBy("page_id").agg(F.count("*").alias("_used"))
    key = items.columns[0]
    # one page may ground a third of all items
    known = attach(items, pages.join(used, "page_id"), ["page_id"], key, "_used", hot_rows=100_000)
    policy = F.col("source_policy")
    content = F.coalesce("content", F.lit(""))
    web = F.concat_ws("\n", F.lit(INSTRUCTION), F.concat(F.lit("Context: "), content), F.concat(F.lit("Question: "), "prompt"))
    image = F.concat_ws("\n", F.lit(INSTRUCTION), F.concat(F.lit("Image description: "), content))
    return known.select(
        *items.columns[: items.columns.index("prompt")],
        F.when(policy == "web_grounded", web).when(policy == "image_grounded", image).otherwise(F.col("prompt")).alias("prompt"),
        F.when(policy.isin("web_grounded", "image_grounded"), policy).otherwise("synthetic").alias("source"),
        F.when(policy == "web_grounded", F.col("url")).otherwise("").alias("source_ref"),
    )
