"""Fingerprints and content references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.text import col, normalize_prompt


def canonical_json(c: Column | str) -> Column:
    """JSON text with sorted keys and no white space; null when the text is not JSON."""
    return F.to_json(F.try_parse_json(col(c)))


def canonical_json_hash(c: Column | str) -> Column:
    return F.sha2(canonical_json(c), 256)


def dedup_fingerprint(
    prompt: Column | str,
    task_type: Column | str,
    difficulty: Column | str,
    blueprint_id: Column | str | None = None,
    family_id: Column | str | None = None,
    materializer_type: Column | str | None = None,
) -> Column:
    """Equal for items with the same normalised prompt, task and difficulty, and the same structural
    ids where these are given and not empty."""
    parts = [normalize_prompt(prompt), F.coalesce(col(task_type), F.lit("")), F.coalesce(col(difficulty), F.lit(""))]
    for label, value in (("b", blueprint_id), ("f", family_id), ("m", materializer_type)):
        if value is not None:
            parts.append(F.when(col(value) != "", F.concat(F.lit(label + "="), col(value))))
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def artifact_ref(content: Column | str, uri: Column, mime: str = "text/plain") -> Column:
    text = col(content)
    return F.struct(
        F.sha2(text, 256).alias("sha256"),
        uri.alias("uri"),
        F.lit(mime).alias("mime"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )


def row_digest(*columns: Column | str) -> Column:
    """60 bits of the SHA-256 of a row, as a non-negative BIGINT.

    Each value goes in with its length, a null as ``n``, so no two different rows are the same text.
    """
    texts = [col(c).cast("string") for c in columns]
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("n")) for t in texts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def snapshot_fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row that changes when any row of the table changes, in whatever order rows are read."""
    digest = row_digest(*columns)
    return df.select(digest.alias("d")).agg(
        F.count("*").alias("n_rows"),
        F.bit_xor("d").alias("xor_digest"),
        F.sum(F.pmod(F.col("d"), F.lit(1_000_003))).alias("sum_digest"),
    )
