"""What the operators share: reading tables, per-batch tasks, bounded caches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and the whole text, null read as empty; other columns stay behind."""
    return docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))


#: Bytes of input that a task turns into Python objects at a time (one row at least).
SLICE = 2 << 20


def slices(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of about ``size`` bytes, so that memory does not follow the length of texts."""
    rows = max(1, int(size * batch.num_rows / max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def by_batch(df: DataFrame, columns: Callable[..., Iterable], schema: str, owner: str = "") -> DataFrame:
    """Apply ``columns`` to the Arrow columns of parts of batches; it gives the output columns in order of ``schema``.

    ``owner`` names the operator whose memos it uses; those that others left in the worker are emptied first.
    """
    names = [f.name for f in _fields(df, schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.begin(owner)
        for whole in batches:
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns(*batch.columns)], names=names)

    return df.mapInArrow(run, schema)


def _fields(df: DataFrame, schema: str) -> list:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def lists(values: list, kind: pa.DataType) -> pa.Array:
    """Numpy arrays as one list column, without a Python object for each element."""
    import numpy as np

    ends = np.cumsum([0, *map(len, values)], dtype=np.int64)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, type=kind))


def pieces(text, gap: re.Pattern, size: int = 1 << 20) -> Iterator:
    """Parts of a str or bytes ``text`` of about ``size``, cut where ``gap`` matches, so that its lists of words stay small."""
    start = 0
    while len(text) - start > size and (cut := gap.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class Memo(dict):
    """Results of ``fn`` for short keys; the older half goes when it holds ``limit`` of them, so memory stays bounded.

    Workers serve one operator after the other; ``begin`` empties what operators other than ``owner`` have kept.
    """

    all: ClassVar[list[Memo]] = []

    def __init__(self, fn: Callable, limit: int = 200_000, longest: int = 48, owner: str = "") -> None:
        super().__init__()
        self.fn, self.limit, self.longest, self.owner = fn, limit, longest, owner
        Memo.all.append(self)

    @classmethod
    def begin(cls, owner: str) -> None:
        for memo in cls.all:
            if memo.owner != owner:
                memo.clear()

    def __missing__(self, key):
        return self.keep(key, self.fn(key))

    def keep(self, key, value):
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                for old in list(islice(self, self.limit // 2)):
                    del self[old]
            self[key] = value
        return value
