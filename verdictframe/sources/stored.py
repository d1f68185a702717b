"""Stored tables that change all or nothing: releases of several tables, and a keyed table that is merged into.

Data are written first, under names that nobody reads yet; one small list of what counts is written last, as one file in
a folder of its own. Readers go by the newest list, so a job that is broken off, or a check that fails, leaves what
they see as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verdictframe.operators.metrics import latest_by_key

#: Files that a run's rows of one table are written to at most.
FILES_PER_RUN = 8
LIST = "version bigint, part string, place string"


def _listed(spark: SparkSession, folder: str) -> tuple[int, dict[str, str]]:
    """Number of the newest list, and the place of each part; 0 and nothing before the first. Lists hold one row for each part."""
    try:
        rows = spark.read.schema(LIST).json(f"{folder}/lists/*")
        newest = rows.agg(F.max("version")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None
    if newest is None:
        return 0, {}
    return newest, {r["part"]: r["place"] for r in rows.where(F.col("version") == newest).collect()}


def _list(spark: SparkSession, folder: str, version: int, places: Mapping[str, str]) -> None:
    """One file, moved into place by the commit of its write; a second writer of the same version fails."""
    rows = spark.createDataFrame([(version, part, place) for part, place in places.items()], LIST)
    rows.coalesce(1).write.mode("error").json(f"{folder}/lists/{version}")


class BrokenRelease(ValueError):
    """Records that lack a value or point at none; nothing of the release can be seen."""


def package_release(
    tables: Mapping[str, DataFrame],
    folder: str,
    by: str = "run_id",
    required: Mapping[str, Sequence[str]] | None = None,
    references: Sequence[tuple[str, str, Sequence[str]]] = (),
) -> None:
    """Write the tables of a release, one partition per run, check what was written, and only then make it visible.

    ``required`` names columns that may not be null; ``references`` are ``(table, other, columns)``: each row of the table needs
    a row of the other with the same values. Rows are dealt out by run and a salt of the row, so a run has few files and a
    very large run is not one task. Releases add up: readers see the rows of all of them.
    """
    spark = next(iter(tables.values())).sparkSession
    place = f"{folder}/data/{uuid.uuid4().hex}"
    for name, df in tables.items():
        salt = F.pmod(F.xxhash64(F.to_json(F.struct(*df.columns))), F.lit(FILES_PER_RUN))
        df.repartition(F.col(by), salt).write.partitionBy(by).parquet(f"{place}/{name}")
    staged = {name: spark.read.schema(release_schema(df, by)).parquet(f"{place}/{name}") for name, df in tables.items()}

    none = F.lit(False)
    faults = [
        df.where(F.greatest(*[F.col(c).isNull() for c in [by, *(required or {}).get(name, [])]], none)).select(F.lit(f"{name}: incomplete").alias("fault"))
        for name, df in staged.items()
    ]
    for name, other, columns in references:
        lost = staged[name].join(staged[other].select(*columns).distinct(), list(columns), "left_anti")
        faults.append(lost.select(F.lit(f"{name}: not in {other}").alias("fault")))
    found = reduce(DataFrame.unionByName, faults).groupBy("fault").agg(F.count("*").alias("n")).orderBy("fault").collect()
    if found:
        raise BrokenRelease("; ".join(f"{r['fault']} ({r['n']} rows)" for r in found))
    version, places = _listed(spark, folder)
    _list(spark, folder, version + 1, places | {place: ",".join(tables)})


def release_schema(df: DataFrame, by: str) -> StructType:
    """Columns as a partitioned table gives them back: the partition comes last."""
    return df.select(*[c for c in df.columns if c != by], by).schema


def read_release(spark: SparkSession, folder: str, name: str, schema: StructType, by: str = "run_id") -> DataFrame:
    """Rows of one table over all releases that are visible."""
    places = [place for place, names in _listed(spark, folder)[1].items() if name in names.split(",")]
    frames = [spark.read.schema(schema).parquet(f"{place}/{name}") for place in places]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


def upsert(folder: str, arrived: DataFrame, key: Sequence[str], order: Sequence[str], buckets: int = 64) -> list[str]:
    """Merge ``arrived`` into the table of ``folder``: the last row of each key by ``order`` counts. Gives the buckets that were rewritten.

    Keys are dealt to a fixed number of buckets by a hash. Only buckets that a key has arrived for are read and written anew,
    beside the old ones; files of others stay as they are. A bucket's rows are combined map-side and shuffled by key.
    """
    spark = arrived.sparkSession
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    rows = latest_by_key(arrived, key, order).select(arrived.columns).withColumn("_bucket", bucket)
    version, places = _listed(spark, folder)
    staged = f"{folder}/data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{staged}/arrived")
    rows = spark.read.schema(rows.schema).parquet(f"{staged}/arrived")
    touched = sorted(str(r["_bucket"]) for r in rows.select("_bucket").distinct().collect())  # at most ``buckets``
    if not touched:
        return []
    old = [places[b] for b in touched if b in places]
    if old:
        rows = rows.unionByName(spark.read.schema(arrived.schema).parquet(*old).withColumn("_bucket", bucket))
    merged = latest_by_key(rows, key, order).select(arrived.columns).withColumn("_bucket", bucket)
    merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{staged}/merged")
    _list(spark, folder, version + 1, places | {b: f"{staged}/merged/_bucket={b}" for b in touched})
    return touched


def read_upserted(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    places = list(_listed(spark, folder)[1].values())
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)
