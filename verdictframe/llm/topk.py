"""Exact search by inner product, a term at a time.

Vectors are integer rows. Queries are dealt into parts and candidates into groups, and each part meets each
group in a task of its own: all pairs meet once, rows are copied to tasks a number of times that is chosen from
counts, and nothing passes through the driver. In a task a component's postings (the candidates that have it, with
their weights) are scattered into dense arrays of scores, one for each query; then a partition selects the highest
of the block, as far as they reach what the query has by then, and the selections of all tasks are merged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
QUERY_ROWS, CANDIDATE_ROWS = 1024, 4096
#: Queries whose score arrays are filled at a time; with a block of candidates they fit a core's cache.
AT_ONCE = 64
#: Bytes that the queries of a task may take, and components of a task's candidates.
PART_BYTES, GROUP_SIZE = 64 << 20, 1 << 24
#: Products of components that are worth a task.
TASK_WORK = 1 << 27
#: A term is scattered posting by posting if so many times fewer scores change than there are.
SPARSE = 32


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id`` and ``vector`` as double; rows without an id, and vectors null or holding null or non-finite components, go."""
    whole = F.col(vector_column).cast("array<double>")
    fine = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(id_column).isNotNull() & whole.isNotNull() & fine).select(F.col(id_column).cast("long").alias("id"), whole.alias("vector"))


def blocks(vectors: DataFrame, rows: int, scale: int) -> DataFrame:
    """``dealt``, ``ids``, ``width`` and ``matrix`` (row by row, of the narrowest whole numbers; short vectors end in zeros).

    Rows of one ``dealt`` that come together make a block, of at most ``rows`` vectors, by id.
    """

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                flat, ends = part.column("vector").flatten(), np.diff(part.column("vector").offsets.to_numpy())
                width = int(ends.max(initial=0))
                matrix = np.zeros((part.num_rows, width), np.int64)
                matrix[np.arange(width) < ends[:, None]] = np.floor(scale * flat.to_numpy(zero_copy_only=False)).astype(np.int64)
                matrix = matrix.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= matrix.min(initial=0) and matrix.max(initial=0) <= np.iinfo(t).max))
                ids, dealt = part.column("id").to_numpy(), part.column("dealt").to_numpy()
                order = np.lexsort((ids, dealt))
                pieces = np.split(order, np.flatnonzero(np.diff(dealt[order])) + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([dealt[at[0]] for at in pieces], type=pa.int32()),
                        pa.array([ids[at].tobytes() for at in pieces], type=pa.binary()),
                        pa.array([width] * len(pieces), type=pa.int64()),
                        pa.array([matrix[at].tobytes() for at in pieces], type=pa.binary()),
                    ],
                    names=["dealt", "ids", "width", "matrix"],
                )

    return vectors.mapInArrow(run, "dealt int, ids binary, width long, matrix binary")


def read_block(ids: bytes, width: int, matrix: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    size = len(matrix) // max(1, len(names) * width) or 1
    return names, np.frombuffer(matrix, np.dtype(f"i{size}")).reshape(len(names), width)


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks as one, by id."""
    names = np.concatenate([n for n, _ in parts])
    matrix = np.zeros((len(names), max(m.shape[1] for _, m in parts)), np.result_type(*(m.dtype for _, m in parts)))
    start = 0
    for _, m in parts:
        matrix[start : start + len(m), : m.shape[1]] = m
        start += len(m)
    order = np.argsort(names, kind="stable")
    return names[order], matrix[order]


def exact_kind(queries: np.ndarray, candidates: np.ndarray) -> type:
    """Numbers of the narrowest kind in which every partial sum of the inner products is exact."""
    most = [float(max(int(m.max(initial=0)), -int(m.min(initial=0)))) for m in (queries, candidates)]
    bound = most[0] * most[1] * min(queries.shape[1], candidates.shape[1])
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


def scattered(weights: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Scores of all pairs, term by term; both arguments have a row for each term, those that only one has count nothing."""
    out = np.zeros((weights.shape[1], postings.shape[1]), postings.dtype)
    products = np.empty_like(out)
    changed = np.count_nonzero(weights[: len(postings)], axis=1) * np.count_nonzero(postings[: len(weights)], axis=1)
    for asking, having, change in zip(weights, postings, changed.tolist(), strict=False):
        if change * SPARSE > out.size:  # what has no posting gets a product of zero
            out += np.multiply(asking[:, None], having, out=products)
        elif change:
            asked, there = np.flatnonzero(asking), np.flatnonzero(having)
            out[np.ix_(asked, there)] += asking[asked, None] * having[there]
    return out


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all rows."""
    kind = exact_kind(queries, candidates)
    return scattered(queries.T.astype(kind, order="C"), candidates.T.astype(kind, order="C"))


def highest(values: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` highest values of each row, ties to the first column; order within a row is free."""
    n = values.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(values), 1))
    if np.abs(values).max(initial=0) < 1 << 48:
        joint = values.astype(np.int64) * n + np.arange(n - 1, -1, -1)  # no two alike
        return np.argpartition(joint, n - k, axis=1)[:, n - k :]
    return np.argsort(-values, axis=1, kind="stable")[:, :k]


class Asked:
    """A block of queries, and the ``k`` best candidates that each has met: ``row``, ``name`` and ``score``, at least ``least``."""

    def __init__(self, names: np.ndarray, matrix: np.ndarray, k: int) -> None:
        self.names, self.matrix, self.k = names, matrix, k
        self.row = self.name = self.score = np.empty(0, np.int64)
        self.least = np.full(len(names), np.iinfo(np.int64).min)

    def meet(self, others: np.ndarray, matrix: np.ndarray) -> None:
        """``others`` are in order."""
        kind = exact_kind(self.matrix, matrix)
        postings = matrix.T.astype(kind, order="C")
        found = [(self.row, self.name, self.score)]
        for start in range(0, len(self.names), AT_ONCE):
            name = self.names[start : start + AT_ONCE]
            value = scattered(self.matrix[start : start + AT_ONCE].T.astype(kind, order="C"), postings)
            able = value >= self.least[start : start + AT_ONCE, None].astype(kind)
            # a query's own rows are left out by asking for as many more and dropping them
            first, last = np.searchsorted(others, name), np.searchsorted(others, name, "right")
            for own in np.flatnonzero(first < last):
                able[own, first[own] : last[own]] = False
            count = np.count_nonzero(able)
            if count > 4 * self.k * len(name):
                at = highest(value, self.k + int((last - first).max(initial=0)))
                row, at = np.repeat(np.arange(len(name)), at.shape[1]), at.ravel()
                row, at = row[able[row, at]], at[able[row, at]]
            elif count:
                row, at = np.nonzero(able)
            else:
                continue
            found.append((start + row, others[at], value[row, at].astype(np.int64)))
        if len(found) > 1:
            self._keep(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def _keep(self, row: np.ndarray, name: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((name, ~score, row))  # ~ turns the order of whole numbers round
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, rank = order[rank < self.k], row[rank < self.k], rank[rank < self.k]
        self.row, self.name, self.score = row, name[order], score[order]
        self.least[row[rank == self.k - 1]] = self.score[rank == self.k - 1]


def search(pieces: Iterable[tuple[bool, np.ndarray, np.ndarray]], k: int) -> Iterator[Asked]:
    """Blocks of a task, its queries (the first of the triple is false) before its candidates; gives the queries that met all."""
    asking, asked, waiting, rows = [], [], [], 0

    def meet(last: bool) -> int:
        """Full blocks of the candidates that wait, at last all; gives how many still wait."""
        names, matrix = joined(waiting)
        end = len(names) if last else len(names) - len(names) % CANDIDATE_ROWS
        for start in range(0, end, CANDIDATE_ROWS):
            for block in asked:
                block.meet(names[start : start + CANDIDATE_ROWS], matrix[start : start + CANDIDATE_ROWS])
        waiting[:] = [(names[end:], matrix[end:])]
        return len(names) - end

    for candidate, names, matrix in pieces:
        if not candidate:
            asking.append((names, matrix))
            continue
        if asking:
            whole = joined(asking)
            asked = [Asked(*(x[start : start + QUERY_ROWS] for x in whole), k) for start in range(0, len(whole[0]), QUERY_ROWS)]
            asking = []
        waiting.append((names, matrix))
        rows += len(names)
        if rows >= CANDIDATE_ROWS:
            rows = meet(False)
    if rows:
        meet(True)
    yield from asked


def shares(asked: int, there: int, width: int, k: int, cores: int) -> tuple[int, int]:
    """Into how many parts queries are dealt, and into how many groups candidates.

    A part fits ``PART_BYTES``. More groups copy queries more often, so they are as many as make both kinds of copies alike
    (or enough for all ``cores``), unless the work is too little for that or ``GROUP_SIZE`` asks for more.
    """
    parts = max(1, -(-asked * (4 * width + 24 * k + 16) // PART_BYTES))
    alike = there * parts // max(1, asked)
    groups = min(asked * there * width // TASK_WORK, max(alike * parts, 4 * cores)) // parts
    return parts, max(1, groups, -(-there * width // GROUP_SIZE))


def top_k(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the ``k`` best candidates of each query (all, if fewer).

    Components are ``floor(scale * x)``, the score is their integer inner product, ties go to the smaller id.
    Every row with another id than the query's is a candidate; repeated rows are candidates as often as they
    come, repeated query rows ask once. Vectors of different lengths are compared over the shorter one.
    Null ids and vectors that are null or hold null or non-finite components take no part.
    """
    there, asking, width = vectors.agg(F.count(F.lit(1)), F.count_if(is_query), F.coalesce(F.max(F.size(F.col(vector_column))), F.lit(0))).first()
    parts, groups = shares(asking, there, max(1, width), k, vectors.sparkSession.sparkContext.defaultParallelism)

    def dealt(rows: DataFrame, n: int) -> DataFrame:
        # by what the row holds, so that a task that runs again deals alike
        return rows.withColumn("dealt", F.pmod(F.xxhash64("id", "vector"), F.lit(n)).cast("int"))

    def copies(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    queries = blocks(dealt(usable(vectors.where(is_query), id_column, vector_column).distinct(), parts), QUERY_ROWS, scale)
    queries = queries.select("dealt", copies(groups).alias("other"), "ids", "width", "matrix").withColumn("cell", F.col("dealt") * groups + F.col("other"))
    candidates = blocks(dealt(usable(vectors, id_column, vector_column), groups), CANDIDATE_ROWS, scale)
    candidates = candidates.select("dealt", copies(parts).alias("other"), "ids", "width", "matrix").withColumn("cell", F.col("other") * groups + F.col("dealt"))
    rows = [x.select("cell", F.lit(kind).alias("candidate"), "ids", "width", "matrix") for x, kind in ((queries, False), (candidates, True))]
    # one task for each meeting, however few its bytes are
    meetings = rows[0].union(rows[1]).repartitionById(parts * groups, "cell").sortWithinPartitions("candidate").drop("cell")

    def run(batches):
        def pieces():
            for batch in batches:
                for at in range(batch.num_rows):
                    candidate, *block = (column[at].as_py() for column in batch.columns)
                    yield candidate, *read_block(*block)

        for block in search(pieces(), k):
            yield pa.RecordBatch.from_arrays([block.names[block.row], block.name, block.score], names=["query_id", "vec_id", "score"])

    best = meetings.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
