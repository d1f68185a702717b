"""Failure clusters, action plans and data requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.functions import rules
from verdictframe.functions.decide import (
    blast_priority,
    blast_tier,
    cluster_id,
    data_request,
    default_action,
    default_owner,
    normalize_owner,
    root_cause,
)
from verdictframe.operators.ordered import attach

KEYS = ("error_type", "evidence_code", "task_type", "eval_method")


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every group. Spark cuts each group to ``k`` rows before it shuffles."""
    window = Window.partitionBy(*by).orderBy(*order)
    top = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
    return top.withColumn(rank, F.col(rank).cast("bigint"))


def ranked_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], rank: str = "rank") -> DataFrame:
    """All rows with their place in their group. For clusters: their number follows the vocabularies of codes, tasks
    and methods, not the number of results, so a window over all of them is small."""
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("bigint"))


def cluster_counts(
    results: DataFrame, by: Sequence[str] = (), keys: Sequence[str] = KEYS, idx: str = "idx", carry: Sequence[str] = ()
) -> DataFrame:
    """Count, first id and last id of every failure cluster, and ``carry`` of its first result as ``rep_`` columns.

    Error types other than PASS are failures."""
    failed = (F.col("error_type") != "") & (F.col("error_type") != "PASS")
    # filtered on the count: a filter on the key would move below and score every response twice
    return results.groupBy(*by, *keys).agg(
        F.count_if(failed).alias("n"), F.min(idx).alias("first_idx"), F.max(idx).alias("last_idx"),
        *[F.min_by(c, idx).alias(f"rep_{c}") for c in carry],
    ).where(F.col("n") > 0)


def failure_clusters(
    results: DataFrame, by: Sequence[str] = (), limit: int | None = None, idx: str = "idx", carry: Sequence[str] = ()
) -> DataFrame:
    """Clusters by size (ties: first seen) with root cause, owner, action, priority and blast radius.

    All of them, unless ``limit`` asks for the largest of each group. Item ids are not gathered; see ``cluster_members`` and ``top_examples``.
    """
    counts = cluster_counts(results, by, idx=idx, carry=carry)
    order = [-F.col("n"), "first_idx"]
    ranked = ranked_rows(counts, by, order) if limit is None else top_rows(counts, by, order, limit)
    if by:
        totals = results.groupBy(*by).agg(F.count("*").alias("total"))
        ranked = ranked.join(totals, list(by))
    else:
        ranked = ranked.withColumn("total", results.select(F.count("*")).scalar())
    cause = root_cause("error_type", "evidence_code", "task_type")
    tier = blast_tier("n", "total")
    return ranked.withColumn("_cause", cause).select(
        *by,
        "rank",
        cluster_id(*KEYS).alias("cluster_id"),
        *KEYS,
        "n",
        "first_idx",
        F.col("_cause.root_cause").alias("hypothesis"),
        F.col("_cause.owner").alias("owner"),
        F.col("_cause.next_action").alias("next_action"),
        blast_priority(tier).alias("priority"),
        F.concat(tier, F.lit(" ("), F.col("n"), F.lit(" items in run)")).alias("blast_radius"),
        *[f"rep_{c}" for c in carry],
    )


def cluster_members(results: DataFrame, clusters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long table (cluster, item): the members of the given clusters, however many they are."""
    names = clusters.select(*by, *KEYS, "cluster_id", "n")
    failed = results.where((F.col("error_type") != "") & (F.col("error_type") != "PASS"))
    named = attach(failed.select(*by, *KEYS, "idx", "item_id"), names, [*by, *KEYS], spread_by="idx", copies="n")
    return named.where(F.col("cluster_id").isNotNull()).select(*by, "cluster_id", "idx", "item_id")


def top_examples(
    results: DataFrame, by: Sequence[str] = KEYS, k: int = 5, idx: str = "idx", item: str = "item_id"
) -> DataFrame:
    """First ``k`` items of every cluster in arrival order, one row per example."""
    failed = results.where((F.col("error_type") != "") & (F.col("error_type") != "PASS"))
    columns = list(dict.fromkeys([*by, item, idx]))
    return top_rows(failed.select(*columns), by, [idx], k, "example")


def with_pass_cluster(clusters: DataFrame, runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per cluster, and a PASS row for every run that has none."""
    have = clusters.select(*by).distinct()
    blank = {
        "rank": F.lit(1),
        "cluster_id": F.lit("PASS"),
        "n": F.lit(0).cast("bigint"),
        "hypothesis": F.lit(rules.PASS_HYPOTHESIS),
        "owner": F.lit("eval"),
        "next_action": F.lit(rules.PASS_ACTION),
        "priority": F.lit(4),
        "blast_radius": F.lit("none"),
    }
    kinds = dict(clusters.dtypes)
    clean = runs.select(*by).distinct().join(have, list(by), "left_anti").select(
        *by,
        *[
            blank.get(c, F.lit("") if kinds[c] == "string" else F.lit(None)).cast(kinds[c]).alias(c)
            for c in clusters.columns
            if c not in by
        ],
    )
    return clusters.unionByName(clean)


def clusters_by_error(results: DataFrame, by: Sequence[str] = (), samples: int = 10) -> DataFrame:
    """Clusters of every result that is not a pass, by error type, with up to ten sample ids."""
    failed = results.where(F.coalesce(F.col("verdict"), F.lit("")) != "pass").withColumn(
        "error_type", F.when(F.coalesce("error_type", F.lit("")) == "", "UNKNOWN_FAILURE").otherwise(F.col("error_type"))
    )
    return _listing(failed, by, samples, failed)


def clusters_from_events(events: DataFrame, by: Sequence[str] = ("run_id",), samples: int = 10) -> DataFrame:
    """Clusters of QA gate failures in the event log, for runs that never produced results."""
    failed = events.where((F.col("stage") == "QA_GATE") & (F.col("status") == "fail")).withColumn(
        "error_type", F.when(F.coalesce("failure_code", F.lit("")) == "", "UNKNOWN_FAILURE").otherwise(F.col("failure_code"))
    )
    return _listing(failed, by, samples, failed.where(F.coalesce("item_id", F.lit("")) != ""))


def _listing(failed: DataFrame, by: Sequence[str], samples: int, sampled: DataFrame) -> DataFrame:
    key = [*by, "error_type"]
    counts = failed.groupBy(*key).agg(F.count("*").alias("n"))
    shown = (
        top_rows(sampled.select(*key, "idx", "item_id"), key, ["idx"], samples)
        .groupBy(*key)
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda s: s["item_id"]), ",").alias("sample_item_ids"))
    )
    return counts.join(shown, key, "left").select(
        *key,
        "n",
        F.coalesce("sample_item_ids", F.lit("")).alias("sample_item_ids"),
        default_owner("error_type").alias("owner"),
        default_action("error_type").alias("recommended_action"),
    )


def enrich_clusters(clusters: DataFrame, analyst: DataFrame, key: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Overlay an analyst's title, cause and owner where there is one."""
    notes = analyst.select(*key, "title", F.col("likely_root_cause").alias("_cause"), F.col("owner").alias("_owner"))
    return clusters.join(notes, list(key), "left").withColumns(
        {
            "hypothesis": F.coalesce("_cause", "hypothesis"),
            "owner": F.when(F.col("_owner").isNull(), F.col("owner")).otherwise(normalize_owner("_owner", "owner")),
        }
    ).drop("_cause", "_owner")


def data_requests(clusters: DataFrame, by: Sequence[str] = (), message: str = "rep_message") -> DataFrame:
    """One request per issue type: position of its first cluster, content of its last."""
    routed = (
        clusters.where(~F.col("cluster_id").isin("PASS", ""))
        .withColumn("_r", data_request("error_type", "evidence_code", "task_type", message))
        .where(F.col("_r").isNotNull())
        .select(*by, "rank", "cluster_id", "_r.*")
    )
    content = F.struct("cluster_id", "priority", "owner_type", "what_to_collect", "template_hint", "verification_eval")
    return routed.groupBy(*by, "issue_type").agg(
        F.min("rank").alias("position"), F.max_by(content, "rank").alias("_c")
    ).select(*by, "position", "issue_type", "_c.*")


def duplicate_counts(reports: DataFrame) -> DataFrame:
    """Duplicates by family, by blueprint and by materializer, in one pass."""
    dims = ("family_id", "blueprint_id", "materializer_type")
    dup = reports.where(F.col("failure_code") == "DUPLICATE_ITEM").select(
        *[F.when(F.coalesce(d, F.lit("")) == "", "(unknown)").otherwise(F.col(d)).alias(d) for d in dims]
    )
    counted = dup.groupingSets([[d] for d in dims], *dims).agg(F.count("*").alias("n"))
    return counted.select(
        F.coalesce(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in dims]).alias("dimension"),
        F.coalesce(*dims).alias("value"),
        "n",
    )
