"""From documents to packed training sequences: language, near duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.llm import langid, neardup, packing, secrets
from verdictframe.llm.common import table
from verdictframe.session import scratch_path


#: Languages to keep (None: all that the labelled documents have) and the least score. Clean documents of any learned language stay.
WANTED: tuple[str, ...] | None = None
LEAST_SCORE = 0.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: tuple[str, ...] | None = WANTED, least: float = LEAST_SCORE) -> DataFrame:
    """Documents of the ``wanted`` languages that score ``least``; those without a label get the language that was told.

    Rejected are null texts, empty texts and texts without a letter, whatever is wanted. Repeated rows stay, as do columns
    of any name.
    """
    names = "_predicted_language", "_language_score"
    found = langid.identify(docs, langid.learn(docs), names)
    told, score = (found[n] for n in names)
    good = (told != langid.UNKNOWN) & (score >= least)
    kept = found.where(good & told.isin(*wanted) if wanted is not None else good)
    return kept.withColumn("lang", F.coalesce("lang", told)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, with the least id; null and empty texts are one class, rows without an id stay."""
    return neardup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in any encoding replaced by a mark; null texts count as empty, repeated rows stay."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: where each piece of each document lies, and its ids; an empty text is its end mark alone."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("packing", packed)]

#: No stage can be said in SQL: profiles, signatures, nested decoding and tokens are not relational.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes its result to the shared folder and the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
