"""Queries over sources and sinks: files, suites, releases, envelopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.functions.hashing import artifact_ref, snapshot_fingerprint as fingerprint
from verdictframe.operators import clusters, metrics
from verdictframe.operators.gates import ITEM_RECORD, ORACLE_RECORD, record_violations
from verdictframe.plans.analytics import REQUESTS_SQL
from verdictframe.plans.registry import query
from verdictframe.plans.views import table, view
from verdictframe.session import materialize, scratch_path
from verdictframe.sources import envelope, files, stored


@query("scan_jsonl", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def scan_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    files.append_jsonl(table(spark, sf, "events").select("event_id", "event_type", "props"), path)
    rows = files.read_jsonl(spark, path, "event_id BIGINT, event_type STRING, props STRING")
    missing = files.read_jsonl(spark, path + "-missing", "event_id BIGINT, event_type STRING, props STRING")
    return rows.unionByName(missing).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("write_roundtrip", "SELECT idx, item_id, verdict, error_type, latency_ms FROM v_results", ("v_results",))
def write_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends of JSON lines read back as one table."""
    path = scratch_path(spark, "append")
    rows = view(spark, sf, "v_results").select("idx", "item_id", "verdict", "error_type", "latency_ms")
    files.append_jsonl(rows.where("verdict = 'pass'"), path)
    files.append_jsonl(rows.where("verdict <> 'pass'"), path)
    return files.read_jsonl(spark, path, rows.schema)


_BAD_ITEM = r"(NOT regexp_matches(item_id, '^[a-z0-9_\-]{8,64}$') OR length(prompt) NOT BETWEEN 1 AND 20000 OR idx % 41 = 0 OR idx % 43 = 0)"


def suite_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Whole item and oracle records as JSON lines, some broken in one way or another."""
    idx = F.col("idx")
    every = lambda n: idx % n == 0
    made = F.lit("2024-01-01T00:00:00Z")
    item = F.struct(
        "item_id", F.lit("1.0.0").alias("dataset_spec_version"), F.array("domain_tag").alias("domain_tags"), "difficulty", "task_type", "prompt",
        F.struct("family_id").alias("input"), F.struct(F.lit("object").alias("type")).alias("input_schema"),
        F.struct(F.lit("object").alias("type")).alias("output_schema"),
        F.struct(~every(41), F.lit("").alias("safety_notes"), F.array(F.lit("prompt")).alias("locked_fields")).cast(
            "struct<no_subjective_judgement:boolean,safety_notes:string,locked_fields:array<string>>").alias("constraints"),
        F.struct(made.alias("created_at"), F.lit("builder").alias("created_by"), F.lit("synthetic").alias("source"), "blueprint_id").alias("provenance"),
        F.when(every(43), "unknown field").alias("remark"),  # a null is left out of the JSON text
    )
    oracle = F.struct(
        "item_id", "eval_method", F.struct("domain_tag").alias("expected"), F.when(~every(47), "fixed answer").alias("method_justification"),
        F.struct(F.lit("reasoning").alias("evidence")).alias("evidence_requirements"),
        F.struct(F.col("leak_passed").alias("passed"), F.lit("").alias("notes")).alias("leak_check"), made.alias("created_at"),
    )
    row = F.to_json(F.struct("idx", item.alias("item"), F.when(~every(37), oracle).alias("oracle")))
    return view(spark, sf, "v_items").select("idx", F.when(every(31), "{broken").otherwise(row).alias("value"))


@query("suite_strict_load", f"""
    SELECT idx, CASE WHEN idx % 31 = 0 THEN 'not_json' WHEN idx % 37 = 0 THEN 'missing_oracle' WHEN {_BAD_ITEM} THEN 'invalid_item'
           WHEN idx % 47 = 0 THEN 'invalid_oracle' ELSE '' END AS problem FROM v_items""", ("v_items",))
def suite_strict_load(spark: SparkSession, sf: str) -> DataFrame:
    schemas = {"item": ITEM_RECORD, "oracle": ORACLE_RECORD}
    checked = files.load_suite(suite_lines(spark, sf), schemas, strict=False, keep=["idx"])
    return checked.select("idx", "problem")


@query("gate_schema_records", f"SELECT idx, idx % 31 = 0 OR idx % 37 = 0 OR idx % 47 = 0 OR {_BAD_ITEM} AS failed FROM v_items", ("v_items",))
def gate_schema_records(spark: SparkSession, sf: str) -> DataFrame:
    row = F.try_parse_json("value")
    part = lambda key: F.try_variant_get(row, f"$.{key}", "variant")
    return suite_lines(spark, sf).select("idx", record_violations(part("item"), part("oracle")).alias("failed"))


@query("artifact_refs", "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes, 'text/plain' AS mime, doc_id || '_raw.txt' AS uri FROM documents")
def artifact_refs(spark: SparkSession, sf: str) -> DataFrame:
    ref = artifact_ref("text", F.concat("doc_id", F.lit("_raw.txt")))
    return table(spark, sf, "documents").select("doc_id", ref.alias("r")).select("doc_id", "r.sha256", "r.bytes", "r.mime", "r.uri")


@query("version_stamp", """
    SELECT idx, '1.0.0' AS dataset_spec_version, 'v1' AS rubric_schema_version, model_version, sha256(run_id) AS tool_snapshot_hash, 42 AS seed
    FROM v_results""", ("v_results",))
def version_stamp(spark: SparkSession, sf: str) -> DataFrame:
    bundle = files.version_bundle(F.lit("1.0.0"), F.col("model_version"), F.sha2("run_id", 256), 42)
    stamped = view(spark, sf, "v_results").withColumn("version_bundle", bundle)
    b = "version_bundle."
    return stamped.select("idx", *[b + c for c in ("dataset_spec_version", "rubric_schema_version", "model_version", "tool_snapshot_hash", "seed")])


@query("snapshot_fingerprint", """
    WITH d AS (SELECT ('0x' || substr(sha256(concat_ws('|', coalesce(length(event_id::VARCHAR) || ':' || event_id, 'n'), coalesce(length(user_id::VARCHAR) || ':' || user_id, 'n'),
        coalesce(length(k) || ':' || k, 'n'), coalesce(length(props) || ':' || props, 'n'))), 1, 15))::BIGINT AS d FROM (SELECT *, nullif(event_type, 'view') AS k FROM events))
    SELECT count(*) AS n_rows, bit_xor(d) AS xor_digest, CAST(sum(d % 1000003) AS BIGINT) AS sum_digest FROM d""")
def snapshot_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """With nulls in one column, which must count."""
    kinds = F.nullif("event_type", F.lit("view")).alias("event_type")
    return fingerprint(table(spark, sf, "events").select("event_id", "user_id", kinds, "props"), "event_id", "user_id", "event_type", "props")


@query("runs_upsert", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ended_at DESC, seq DESC) AS rn FROM v_run_log)
    SELECT run_id, model_version, items_total, eval_passed,
           CASE WHEN items_total > 0 THEN round(eval_passed / items_total, 6) ELSE 0.0::DOUBLE END AS pass_rate FROM r WHERE rn = 1""", ("v_run_log",))
def runs_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Two arrivals of records merged into a stored table by run id; the last record wins."""
    log, folder = view(spark, sf, "v_run_log"), scratch_path(spark, "run-index")
    for arrived in (log.where("seq % 3 = 0"), log.where("seq % 3 <> 0")):
        stored.upsert(folder, arrived, ["run_id"], ["ended_at", "seq"])
    merged = stored.read_upserted(spark, folder, log.schema)
    rate = F.when(F.col("items_total") > 0, F.round(F.col("eval_passed") / F.col("items_total"), 6)).otherwise(F.lit(0.0))
    return merged.select("run_id", "model_version", "items_total", "eval_passed", rate.alias("pass_rate"))


@query("runs_backfill", """
    SELECT run_id, 'set_' || run_id AS dataset_name, count(*) AS items_total, count(*) FILTER (WHERE verdict = 'pass') AS eval_passed
    FROM v_results GROUP BY run_id""", ("v_results",))
def runs_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """One folder per run with its record as JSON, and broken records beside them."""
    folder = scratch_path(spark, "runs")
    per_run = metrics.run_metrics(view(spark, sf, "v_results"), ["run_id"]).select(
        "run_id",
        F.to_json(F.struct(
            "run_id", F.concat(F.lit("set_"), "run_id").alias("dataset_name"),
            F.struct("items_total", "eval_passed", "failures_total").alias("metrics"),
        )).alias("value"),
    )
    broken = per_run.select(F.concat("run_id", F.lit("_bad")).alias("run_id"), F.lit('{"run_id": ').alias("value"))
    both = per_run.unionByName(broken).withColumn("dir", F.col("run_id"))
    both.select("value", "dir").repartition("dir").write.partitionBy("dir").text(folder)
    return files.backfill_runs(spark, folder, "*.txt").select("run_id", "dataset_name", "items_total", "eval_passed")


@query("package_run", f"""
    WITH {REQUESTS_SQL}
    SELECT 'eval_results' AS table_name, run_id, count(*) AS n FROM v_results GROUP BY run_id
    UNION ALL SELECT 'released_items', run_id, count(*) FROM v_results r JOIN v_result_items i ON r.item_id = i.item_id GROUP BY run_id
    UNION ALL SELECT 'released_oracles', run_id, count(*) FROM v_results r JOIN v_result_oracles o ON r.item_id = o.item_id GROUP BY run_id
    UNION ALL SELECT 'clusters', run_id, count(*) FROM n GROUP BY run_id
    UNION ALL SELECT 'action_plans', run_id, count(*) FROM n GROUP BY run_id
    UNION ALL SELECT 'data_requests', run_id, count(*) FROM q GROUP BY run_id
    UNION ALL SELECT 'release_manifest', run_id, count(*) FROM v_results r JOIN v_result_items i ON r.item_id = i.item_id
              JOIN v_result_oracles o ON r.item_id = o.item_id GROUP BY run_id
    UNION ALL SELECT 'run_summary', run_id, 1 FROM v_results GROUP BY run_id
    UNION ALL SELECT 'data_card', run_id, 1 FROM v_results GROUP BY run_id""", ("v_results", "v_result_items", "v_result_oracles"))
def package_run(spark: SparkSession, sf: str) -> DataFrame:
    """All tables of a release, checked, written and read back."""
    folder = scratch_path(spark, "release")
    results = view(spark, sf, "v_results")
    place = results.select("run_id", "item_id")
    items, oracles = (view(spark, sf, f"v_result_{n}").join(place, "item_id") for n in ("items", "oracles"))
    found = materialize(clusters.failure_clusters(results, ["run_id"], carry=["message"]), "clusters")
    summary = metrics.run_metrics(results, ["run_id"])
    card = place.groupBy("run_id").agg(F.concat(F.count("*"), F.lit(" items")).alias("composition"))
    tables = {
        "eval_results": results.select("run_id", "item_id", "verdict", "error_type"),
        "released_items": items,
        "released_oracles": oracles,
        "clusters": found.drop("owner", "next_action", "priority"),
        "action_plans": found.select("run_id", "cluster_id", "owner", "next_action", "priority"),
        "data_requests": clusters.data_requests(found, ["run_id"]),
        "release_manifest": manifest(spark, sf).join(place, "item_id"),
        "run_summary": summary,
        "data_card": card,
    }
    needed = {"eval_results": ["item_id", "verdict"], "clusters": ["cluster_id"], "action_plans": ["owner", "next_action"], "released_oracles": ["eval_method"]}
    one = ["run_id", "item_id"]
    # results whose item or oracle is gone are told, but not in the manifest, which points at released records only
    references = [
        ("release_manifest", "eval_results", one), ("release_manifest", "released_items", one), ("release_manifest", "released_oracles", one),
        ("released_items", "eval_results", one), ("released_oracles", "eval_results", one), ("action_plans", "clusters", ["run_id", "cluster_id"]),
        ("clusters", "action_plans", ["run_id", "cluster_id"]), ("eval_results", "run_summary", ["run_id"]), ("eval_results", "data_card", ["run_id"]),
    ]
    stored.package_release(tables, folder, required=needed, references=references)
    counted = [
        stored.read_release(spark, folder, name, stored.release_schema(df, "run_id"))
        .groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "run_id", "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


@query("release_manifest", """
    SELECT r.item_id, sha256(i.task_type || '|' || i.difficulty) AS item_sha, sha256(o.eval_method) AS oracle_sha,
           sha256(r.verdict || '|' || r.error_type) AS eval_sha, r.model_version
    FROM v_results r JOIN v_result_items i ON r.item_id = i.item_id JOIN v_result_oracles o ON r.item_id = o.item_id""",
       ("v_results", "v_result_items", "v_result_oracles"))
def release_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(spark, sf)


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    def ref(name: str, *columns: str):
        return artifact_ref(F.concat_ws("|", *columns), F.concat("item_id", F.lit(f"_{name}.json")), "application/json").alias(name)

    items = view(spark, sf, "v_result_items").select("item_id", ref("item", "task_type", "difficulty"))
    oracles = view(spark, sf, "v_result_oracles").select("item_id", ref("oracle", "eval_method"))
    results = view(spark, sf, "v_results").select("item_id", "model_version", ref("result", "verdict", "error_type"))
    manifest = results.join(items, "item_id").join(oracles, "item_id")
    return manifest.select(
        "item_id", F.col("item.sha256").alias("item_sha"), F.col("oracle.sha256").alias("oracle_sha"),
        F.col("result.sha256").alias("eval_sha"), "model_version",
    )


@query("decode_envelope", """
    WITH o AS (SELECT *, status_code = 200 AND json_valid(body) AS j FROM v_envelope)
    SELECT idx, CASE WHEN NOT j THEN body WHEN json_type(body, '$.output') = 'OBJECT' THEN CAST(json_extract(body, '$.output') AS VARCHAR)
                ELSE json_extract_string(body, '$.output') END AS raw_output,
           CASE WHEN j THEN json_extract_string(body, '$.model_version') ELSE '' END AS model_version,
           CASE WHEN j THEN CAST(json_extract_string(body, '$.latency_ms') AS BIGINT) END AS latency_ms FROM o""", ("v_envelope",))
def decode_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return envelope.decode_envelope(view(spark, sf, "v_envelope")).select("idx", "raw_output", "model_version", "latency_ms")


@query("transport_failures", """
    SELECT idx, 'fail' AS verdict, 0.0::DOUBLE AS score, 'SUT_HTTP_ERROR' AS error_type, 'status_code=500' AS message
    FROM v_envelope WHERE status_code <> 200""", ("v_envelope",))
def transport_failures(spark: SparkSession, sf: str) -> DataFrame:
    return envelope.transport_failures(view(spark, sf, "v_envelope")).select(
        "idx", "verdict", "score", "error_type", F.get("evidence", 0)["message"].alias("message")
    )


@query("source_fallback", """
    WITH runs AS (SELECT DISTINCT run_id FROM v_results),
    c AS (SELECT run_id, 'cluster' AS source, error_type, count(*) AS n FROM v_results WHERE error_type <> '' AND idx % 2 = 0
             AND run_id NOT IN ('run_3', 'run_7', 'run_11') GROUP BY ALL),
    p AS (SELECT run_id, 'plan' AS source, error_type, count(*) AS n FROM v_results WHERE error_type <> '' AND run_id <> 'run_7' GROUP BY ALL)
    SELECT * FROM c UNION ALL SELECT * FROM p WHERE run_id NOT IN (SELECT run_id FROM c)""", ("v_results",))
def source_fallback(spark: SparkSession, sf: str) -> DataFrame:
    failed = view(spark, sf, "v_results").where("error_type <> ''")

    def counted(df: DataFrame, source: str) -> DataFrame:
        return df.groupBy("run_id", "error_type").agg(F.count("*").alias("n")).withColumn("source", F.lit(source))

    found = counted(failed.where("idx % 2 = 0 AND run_id NOT IN ('run_3', 'run_7', 'run_11')"), "cluster")
    plans = counted(failed.where("run_id <> 'run_7'"), "plan")
    return files.prefer(found, plans, ["run_id"])
