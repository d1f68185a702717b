"""Deterministic scorers over parsed responses. Each scorer is a struct column (ok, code, message)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.schema import violations_by_schema
from verdictframe.functions.text import NORMALIZERS, bound, col

PROGRAMMATIC_FAILED = "PROGRAMMATIC_CHECK_FAILED"


def outcome(ok: Column, code: Column, message: Column, field: Column | None = None) -> Column:
    return F.struct(
        ok.alias("ok"),
        F.when(ok, "").otherwise(code).alias("code"),
        message.alias("message"),
        (field if field is not None else F.lit(None).cast("string")).alias("field"),
    )


def parse(raw: Column | str) -> Column:
    return F.try_parse_json(col(raw))


def schema_check(df: DataFrame, raw: str = "raw_output", schema: str = "output_schema") -> DataFrame:
    """Add ``parsed`` and ``schema_error``: empty, MODEL_OUTPUT_NOT_JSON or MODEL_OUTPUT_SCHEMA_VIOLATION."""
    parsed = df.withColumn("parsed", parse(raw))
    broken = parsed.withColumn("schema_messages", violations_by_schema(schema, F.col("parsed")))
    # JSON null that violates its schema counts as no JSON at all
    return broken.withColumn(
        "schema_error",
        F.when(F.col("parsed").isNull(), "MODEL_OUTPUT_NOT_JSON")
        .when(F.size("schema_messages") == 0, "")
        .when(F.is_variant_null("parsed"), "MODEL_OUTPUT_NOT_JSON")
        .otherwise("MODEL_OUTPUT_SCHEMA_VIOLATION"),
    )


def exact_match(parsed: Column | str, expected: Column | str) -> Column:
    """Deep equality by canonical JSON text."""
    ok = F.to_json(col(parsed)).eqNullSafe(F.to_json(col(expected)))
    return outcome(ok, F.lit("EXACT_MATCH_FAILED"), F.when(ok, "exact_match passed").otherwise("exact_match failed"))


def math_sum(a: Column, b: Column, c: Column, answer: Column) -> Column:
    """a + b, or a + b + c when c is given; a part that is not a number fails the row."""
    total = a + b + F.coalesce(c, F.lit(0))
    ok = F.coalesce(answer == total, F.lit(False))
    message = (
        F.when(total.isNull() | answer.isNull(), "programmatic_check parse error")
        .when(ok, F.when(c.isNull(), "programmatic_check passed (answer == a+b)").otherwise(
            "programmatic_check passed (answer == (a+b)+c)"))
        .otherwise(F.concat(F.lit("programmatic_check failed: expected "), total, F.lit(", got "), answer))
    )
    return outcome(ok, F.lit(PROGRAMMATIC_FAILED), message)


def math_numbers(given: Column, parsed: Column) -> dict[str, Column]:
    """What the checker of sums reads; as columns of a step before (``numbers`` of a checker's row) each is read once."""
    sources = {"a": given, "b": given, "c": given, "answer": parsed}
    return {n: F.try_variant_get(source, f"$.{n}", "bigint") for n, source in sources.items()} | {
        "has_c": F.try_variant_get(given, "$.c", "variant").isNotNull()
    }


def _math_checker(row: dict[str, Column]) -> Column:
    numbers = row.get("numbers") or math_numbers(row["input"], row["parsed"])
    has_c, c = numbers["has_c"], numbers["c"]
    checked = math_sum(numbers["a"], numbers["b"], c, numbers["answer"])
    bad_c = outcome(F.lit(False), F.lit(PROGRAMMATIC_FAILED), F.lit("programmatic_check parse error"))
    return F.when(has_c & c.isNull(), bad_c).otherwise(checked)


def structured_fields(expected: Column, observed: Column, required: Column, normalize: Column) -> Column:
    """Compare extracted fields: missing, then extra, then wrong value; the first hit wins.

    ``expected`` and ``observed`` are MAP<STRING,VARIANT>, ``normalize`` MAP<STRING,STRING> names a
    normaliser per field.
    """
    given = F.struct(
        expected.alias("expected"), observed.alias("observed"),
        F.coalesce(required, F.map_keys(expected)).alias("fields"),
        F.coalesce(normalize, F.create_map().cast("map<string,string>")).alias("normalize"),
    )
    return bound(given, lambda g: bound(_field_faults(g), _field_outcome))


def _field_faults(given: Column) -> Column:
    """Names of the fields that are missing, too many or of another value."""
    expected, observed, fields, normalize = (given[n] for n in ("expected", "observed", "fields", "normalize"))

    def compared(source: Column, f: Column, norm: Column) -> Column:
        def one(value: Column) -> Column:
            text = F.when(F.is_variant_null(value), F.lit(None)).otherwise(F.try_variant_get(value, "$", "string"))
            out = F.to_json(value)
            for name, fn in NORMALIZERS.items():
                out = F.when(norm == name, fn(text)).otherwise(out)
            return out

        return bound(F.try_element_at(source, f), one)

    def differs(f: Column) -> Column:
        norm = F.try_element_at(normalize, f)
        return ~compared(expected, f, norm).eqNullSafe(compared(observed, f, norm))

    return F.struct(
        expected.isNull().alias("no_dict"),
        F.filter(fields, lambda f: ~F.map_contains_key(observed, f)).alias("missing"),
        F.array_except(F.map_keys(observed), fields).alias("extra"),
        F.filter(fields, differs).alias("wrong"),
    )


def _field_outcome(faults: Column) -> Column:
    missing, extra, wrong = faults["missing"], faults["extra"], faults["wrong"]
    code = (
        F.when(faults["no_dict"], "STRUCTURED_CHECK_CONFIG_ERROR")
        .when(F.size(missing) > 0, "STRUCTURED_FIELD_MISSING")
        .when(F.size(extra) > 0, "STRUCTURED_EXTRA_FIELD_PRESENT")
        .when(F.size(wrong) > 0, "STRUCTURED_FIELD_VALUE_MISMATCH")
        .otherwise("")
    )

    def told(code: Column) -> Column:
        field = F.when(code == "STRUCTURED_FIELD_MISSING", F.get(missing, 0)).when(
            code == "STRUCTURED_FIELD_VALUE_MISMATCH", F.get(wrong, 0)
        )
        message = (
            F.when(code == "", "structured extraction check passed")
            .when(code == "STRUCTURED_CHECK_CONFIG_ERROR", "structured_extraction expected must be a dict")
            .when(code == "STRUCTURED_FIELD_MISSING", F.concat(F.lit("missing required field: "), field))
            .when(code == "STRUCTURED_EXTRA_FIELD_PRESENT", F.concat(F.lit("unexpected extra field(s): "), F.array_join(extra, ", ")))
            .otherwise(F.concat(F.lit("value mismatch for field '"), field, F.lit("'")))
        )
        return outcome(code == "", code, message, field)

    return bound(code, told)


def _structured_checker(row: dict[str, Column]) -> Column:
    return structured_fields(
        F.try_variant_get(row["expected"], "$", "map<string,variant>"),
        F.try_variant_get(row["parsed"], "$", "map<string,variant>"),
        F.try_variant_get(row["config"], "$.required_fields", "array<string>"),
        F.try_variant_get(row["config"], "$.field_normalize", "map<string,string>"),
    )


def canonical_label(
    label: Column, expected: Column, rules: Column, label_map: Column, allowed: Column
) -> Column:
    """Rewrite the label (first rule whose ``from`` is equal, then the map; trimmed lower case only when
    there is neither), test it against the allowed set and compare it with the expected label."""
    has_rules = F.coalesce(F.size(rules) > 0, F.lit(False))
    has_map = F.coalesce(F.size(label_map) > 0, F.lit(False))
    ruled = F.coalesce(F.get(F.filter(rules, lambda r: r["from"] == label), 0)["to"], label)
    mapped = F.coalesce(F.try_element_at(label_map, ruled), ruled)
    canon = F.when(has_rules | has_map, mapped).otherwise(NORMALIZERS["strip_lower"](label))
    target = NORMALIZERS["strip_lower"](expected)
    outside = F.coalesce(~F.array_contains(allowed, canon), F.lit(False))
    ok = F.coalesce((canon == target) & ~outside & label.isNotNull() & expected.isNotNull(), F.lit(False))
    message = (
        F.when(expected.isNull(), "classification_canonical expected must have 'label'")
        .when(label.isNull(), "classification_canonical output missing 'label'")
        .when(outside, "classification_canonical label not in allowed set")
        .when(ok, "programmatic_check passed (classification_canonical: label matches)")
        .otherwise("classification_canonical label mismatch")
    )
    return outcome(ok, F.lit(PROGRAMMATIC_FAILED), message)


def _canonical_checker(row: dict[str, Column]) -> Column:
    return canonical_label(
        F.try_variant_get(row["parsed"], "$.label", "string"),
        F.try_variant_get(row["expected"], "$.label", "string"),
        row["rules"],
        F.try_variant_get(row["config"], "$.label_map", "map<string,string>"),
        F.try_variant_get(row["config"], "$.allowed_labels", "array<string>"),
    )


Checker = Callable[[dict[str, Column]], Column]

CHECKERS: dict[str, Checker] = {
    "math_add_v1": _math_checker,
    "structured_extraction_v1": _structured_checker,
    "classification_canonical_v1": _canonical_checker,
}
DEFAULT_CHECKER = "math_add_v1"


def register_checker(name: str, checker: Checker) -> None:
    """Add a programmatic checker: columns input, parsed, expected, config and rules in, outcome out.

    A Pandas UDF that returns struct<ok,code,message,field> can be wrapped the same way.
    """
    CHECKERS[name] = checker


def programmatic_check(checker: Column | str, row: dict[str, Column]) -> Column:
    """Run the checker named in each row; an unknown name yields code UNKNOWN_CHECKER."""
    name = F.when(F.coalesce(col(checker), F.lit("")) == "", DEFAULT_CHECKER).otherwise(col(checker))
    out = outcome(
        F.lit(False), F.lit("UNKNOWN_CHECKER"), F.concat(F.lit("unknown checker_name="), name)
    )
    for known, fn in CHECKERS.items():
        out = F.when(name == known, fn(row)).otherwise(out)
    return out
