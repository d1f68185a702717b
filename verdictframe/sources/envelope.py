"""Model responses as they come over the wire."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decode_envelope(df: DataFrame, body: str = "body", model_version: str = "") -> DataFrame:
    """Add raw_output, model_version, latency_ms and tool_trace.

    A JSON object with ``output`` is unpacked: an object output as JSON text, any other as plain text.
    Everything else passes through unchanged. Only responses with status 200 are unpacked.
    """
    v = F.try_parse_json(F.col(body))
    out = F.try_variant_get(v, "$.output", "variant")
    unpack = (F.col("status_code") == 200) & F.coalesce(
        F.map_contains_key(F.try_variant_get(v, "$", "map<string,variant>"), "output"), F.lit(False)
    )
    is_object = F.try_variant_get(out, "$", "map<string,variant>").isNotNull()
    text = F.when(is_object, F.to_json(out)).otherwise(F.try_variant_get(out, "$", "string"))
    return df.select(
        "*",
        F.when(unpack, text).otherwise(F.col(body)).alias("raw_output"),
        F.when(unpack, F.coalesce(F.try_variant_get(v, "$.model_version", "string"), F.lit(model_version)))
        .otherwise(model_version).alias("model_version"),
        F.when(unpack, F.try_variant_get(v, "$.latency_ms", "bigint")).alias("latency_ms"),
        F.when(unpack, F.try_variant_get(v, "$.tool_trace", "array<struct<name:string,args:variant,result:variant>>")).alias("tool_trace"),
    )


def transport_failures(df: DataFrame) -> DataFrame:
    """Result rows for responses that never arrived."""
    failed = df.where(F.col("status_code") != 200)
    message = F.when(F.col("status_code") == 0, "SUT unreachable (network/timeout error)").otherwise(
        F.concat(F.lit("status_code="), F.col("status_code"))
    )
    return failed.select(
        "*",
        F.lit("fail").alias("verdict"),
        F.lit(0.0).alias("score"),
        F.lit("SUT_HTTP_ERROR").alias("error_type"),
        F.array(F.struct(F.lit("sut_http").alias("kind"), message.alias("message"))).alias("evidence"),
    )
