"""JSON-lines and run folders as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from verdictframe.functions.schema import violations


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """Rows of a JSON-lines file or folder; blank lines are skipped, a missing path is an empty table."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    try:
        return reader.json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return spark.createDataFrame([], wanted)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def load_suite(
    lines: DataFrame,
    schemas: Mapping[str, dict],
    line: str = "value",
    strict: bool = True,
    keys: Sequence[str] = ("item", "oracle"),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Suite rows from JSON text lines. Every row needs ``keys``, and each key named in ``schemas`` must
    conform. Strict loading fails the job at the first bad row; otherwise ``problem`` tells what is wrong."""
    row = F.try_parse_json(F.col(line))
    parsed = lines.where(F.trim(F.col(line)) != "").select(
        *keep, line, row.isNull().alias("_bad"), *[F.try_variant_get(row, f"$.{k}", "variant").alias(k) for k in keys]
    )
    problem: Column = F.when(F.col("_bad"), "not_json")
    for key in keys:
        problem = problem.when(F.col(key).isNull(), f"missing_{key}")
    for key, schema in schemas.items():
        problem = problem.when(F.size(violations(schema, F.col(key))) > 0, f"invalid_{key}")
    checked = parsed.withColumn("problem", F.coalesce(problem, F.lit(""))).drop("_bad")
    if not strict:
        return checked
    guard = F.when(F.col("problem") != "", F.raise_error(F.concat(F.lit("suite row: "), F.col("problem")))).otherwise("")
    return checked.withColumn("problem", guard)


RUN_RECORD = """
    run_id STRING, dataset_name STRING, dataset_spec_version STRING, model_version STRING, model_versions ARRAY<STRING>,
    tool_snapshot_hash STRING, seed BIGINT, started_at STRING, ended_at STRING,
    metrics STRUCT<items_total: BIGINT, qa_passed: BIGINT, eval_passed: BIGINT, failures_total: BIGINT>"""


def backfill_runs(spark: SparkSession, folder: str, name: str = "run_record.json") -> DataFrame:
    """Run rows from the record of every run folder; unreadable records are skipped."""
    return run_rows(spark.read.schema(RUN_RECORD).option("mode", "DROPMALFORMED").json(f"{folder}/*/{name}"))


def run_rows(records: DataFrame) -> DataFrame:
    m = F.col("metrics")
    return records.where(F.col("run_id").isNotNull()).select(
        "run_id",
        "dataset_name",
        "model_version",
        "ended_at",
        F.coalesce(m["items_total"], F.lit(0)).alias("items_total"),
        F.coalesce(m["eval_passed"], F.lit(0)).alias("eval_passed"),
    )


def list_runs(runs: DataFrame) -> DataFrame:
    """Runs worth listing: with metadata and at least one item."""
    return runs.where(F.col("dataset_name").isNotNull() & (F.col("items_total") != 0))


def version_bundle(
    spec_version: Column, model_version: Column, snapshot_hash: Column, seed: int,
    rubric: str = "v1", script: str = "v1", judge_prompt: str = "", judges: list[str] | None = None,
) -> Column:
    """Struct stamped on every record."""
    return F.struct(
        spec_version.alias("dataset_spec_version"),
        F.lit(rubric).alias("rubric_schema_version"),
        F.lit(script).alias("eval_script_version"),
        model_version.alias("model_version"),
        snapshot_hash.alias("tool_snapshot_hash"),
        F.lit(seed).alias("seed"),
        F.lit(judge_prompt).alias("judge_prompt_version"),
        F.array(*map(F.lit, judges or [])).cast("array<string>").alias("judge_models"),
    )




def prefer(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """All rows of ``first``, and rows of ``second`` for keys that ``first`` does not have."""
    return first.unionByName(second.join(first.select(*key).distinct(), list(key), "left_anti"))
