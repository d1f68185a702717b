"""Decision lists as column expressions: owners, root causes, blast radius, statuses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdictframe.functions import rules
from verdictframe.functions.text import col, strip_lower


def lookup(key: Column | str, table: Mapping[str, object], default: object = None) -> Column:
    """Value of a small constant mapping."""
    return F.coalesce(*[F.when(col(key) == k, F.lit(v)) for k, v in table.items()], F.lit(default))


def evidence_code(evidence: Column | str) -> Column:
    """First non-empty code of an evidence array, else an empty string."""
    coded = F.filter(col(evidence), lambda e: F.coalesce(e["code"], F.lit("")) != "")
    return F.coalesce(F.get(coded, 0)["code"], F.lit(""))


def normalize_owner(owner: Column | str, fallback: Column | str) -> Column:
    o = strip_lower(owner)
    return (
        F.when(o.isin("data", "model", "tooling", "product", "eval"), o)
        .when(o.contains("model") | o.contains("training"), "model")
        .when(o.contains("data"), "data")
        .when(o.contains("product") | o.contains("ux"), "product")
        .when(o.contains("tool"), "tooling")
        .otherwise(col(fallback))
    )


def blast_tier(count: Column | str, total: Column | str) -> Column:
    n, t = col(count), col(total)
    return (
        F.when(t <= 0, "unknown")
        .when((n / t >= 0.3) | (n >= 10), "high")
        .when((n / t >= 0.1) | (n >= 3), "medium")
        .otherwise("low")
    )


def blast_priority(tier: Column | str) -> Column:
    return F.when(col(tier) == "high", 1).when(col(tier) == "medium", 2).otherwise(3).cast("int")


def cluster_id(error: Column | str, code: Column | str, task: Column | str, method: Column | str) -> Column:
    head = F.when(col(code) != "", F.concat_ws("/", col(error), col(code))).otherwise(col(error))
    return F.when((col(task) != "") | (col(method) != ""), F.concat_ws("|", head, col(task), col(method))).otherwise(head)


def _holds(condition: Mapping[str, object], error: Column, code: Column, task: Column, message: Column) -> Column:
    test = F.lit(True)
    for kind, value in condition.items():
        if kind == "task":
            test = test & (task == value)
        elif kind == "error":
            test = test & error.isin(*value)
        elif kind == "error_has":
            test = test & _any([error.contains(v) for v in value])
        elif kind == "code":
            test = test & code.isin(*value)
        elif kind == "code_prefix":
            test = test & code.startswith(value)
        elif kind == "has_code":
            test = test & (code != "")
        elif kind == "message":
            test = test & message.contains(value)
    return test


def _any(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def root_cause(error: Column | str, code: Column | str, task: Column | str) -> Column:
    """Struct of root cause, owner and next action: the first rule that holds."""
    picks = [
        F.when(
            _holds(condition, col(error), col(code), col(task), F.lit("")),
            F.struct(
                F.lit(cause).alias("root_cause"), F.lit(owner).alias("owner"), F.lit(action).alias("next_action")
            ),
        )
        for condition, cause, owner, action in rules.ROOT_CAUSES
    ]
    return F.coalesce(*picks)


def data_request(error: Column | str, code: Column | str, task: Column | str, message: Column | str) -> Column:
    """Struct of the data request for a failure, null when none is made."""
    picks = [
        F.when(
            _holds(condition, col(error), F.coalesce(col(code), F.lit("")), col(task), F.coalesce(col(message), F.lit(""))),
            F.struct(
                F.lit(issue).alias("issue_type"),
                F.lit(priority).alias("priority"),
                F.lit(owner).alias("owner_type"),
                F.lit(what).alias("what_to_collect"),
                F.lit(hint).alias("template_hint"),
                F.lit(check).alias("verification_eval"),
            ),
        )
        for condition, (issue, priority, owner, what, hint, check) in rules.DATA_REQUESTS
    ]
    return F.coalesce(*picks)


def default_owner(error: Column | str) -> Column:
    return lookup(error, {k: v[0] for k, v in rules.OWNER_BY_ERROR.items()}, rules.DEFAULT_OWNER[0])


def default_action(error: Column | str) -> Column:
    return lookup(error, {k: v[1] for k, v in rules.OWNER_BY_ERROR.items()}, rules.DEFAULT_OWNER[1])


def run_status(items: Column | str, passed: Column | str, failures: Column | str, blocked: Column | str) -> Column:
    return (
        F.when(col(blocked), "BLOCKED")
        .when(col(items) <= 0, "FAIL")
        .when(col(failures) == 0, "PASS")
        .when((col(passed) == 0) & (col(failures) > 0), "FAIL")
        .otherwise("PARTIAL")
    )


def canonical_family(family: Column | str) -> Column:
    """Struct of the catalogue family (null when unsupported) and the reason it changed."""
    f = col(family)
    known = f.isin(*rules.FAMILIES)
    mapped = lookup(f, rules.FAMILY_ALIASES)
    return F.struct(
        F.when(known, f).otherwise(mapped).alias("family_id"),
        F.when(known, F.lit("")).when(mapped.isNotNull(), "alias_map").otherwise("unsupported").alias("reason"),
    )


def pick_by_priority(candidates: Column | str, priority: Sequence[str] = rules.METHOD_PRIORITY) -> Column:
    """Struct: candidates in priority order, the one selected and the ones rejected."""
    known = F.array(*map(F.lit, priority))
    ordered = F.filter(known, lambda m: F.array_contains(col(candidates), m))
    chosen = F.coalesce(F.get(ordered, 0), F.lit(priority[-1]))
    return F.struct(
        ordered.alias("candidates"),
        chosen.alias("selected"),
        F.slice(ordered, 2, len(priority)).alias("rejected"),
        lookup(chosen, rules.METHOD_REASONS, "").alias("rationale"),
    )


def applicable_methods(task_type: Column | str) -> Column:
    """Methods that can score a task: its own one, schema check and rubric judge."""
    own = lookup(task_type, {k: v[0] for k, v in rules.TASKS.items()})
    return F.array_compact(F.array(own, F.lit("schema_check"), F.lit("rubric_judge")))


def leak_check(prompt: Column | str, expected: Column | str) -> Column:
    """Struct(passed, notes) for an expected answer (VARIANT) that the prompt spells out."""
    text = F.lower(col(prompt))
    canon = F.lower(F.to_json(col(expected)))
    pairs = F.map_entries(F.try_variant_get(col(expected), "$", "map<string,variant>"))

    def quoted(entry: Column) -> tuple[Column, Column]:
        return F.lower(F.to_json(F.struct(entry["key"].alias("k")))), F.lower(
            F.to_json(entry["value"])
        )

    def leaked(entry: Column) -> Column:
        wrapped, value = quoted(entry)
        key = F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)  # the text between {"k": and }
        return text.contains(F.concat(key, F.lit(":"), value)) | text.contains(F.concat(key, F.lit(" : "), value))

    whole = F.when(text.contains(canon), F.array(F.lit("canonical expected JSON appears in prompt")))
    each = F.transform(
        F.filter(pairs, leaked), lambda e: F.concat(F.lit("completed key/value pair leaked for key="), e["key"])
    )
    empty = F.array().cast("array<string>")
    notes = F.concat(F.coalesce(whole, empty), F.coalesce(each, empty))
    return F.struct((F.size(notes) == 0).alias("passed"), F.array_join(notes, "; ").alias("notes"))


def context_oracle(context: str, image_description: str) -> Column:
    """``field`` and ``expected`` of an item that is grounded in a text: a description only where there is no context."""
    described = F.col(context).isNull() & F.col(image_description).isNotNull()
    return F.struct(
        F.when(described, "description").otherwise("answer").alias("field"),
        F.coalesce(context, image_description, F.lit("")).alias("expected"),
    )
