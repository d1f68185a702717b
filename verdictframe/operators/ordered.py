"""Running totals, ranks and previous values over ordered rows, without one task per group.

A plain window holds a whole group in one task. Here each group is cut into ordered blocks: the
window runs inside a block, block totals are scanned (a few rows per group), and the total before
a block is added to its rows. A group that holds a third of the table is spread over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.session import materialize

BLOCK = "_block"
ROWS_PER_BLOCK = 1 << 20


#: Quantiles that one sketch gives, and the sketch's precision: a rank is off by a 16th of a quantile's rows at most.
CUTS, PRECISION = 1024, 16 * 1024


def _place(cuts: Sequence[int], value: Column) -> Column:
    """How many of the sorted ``cuts`` are not above ``value``; each row looks at a part of them only."""
    step = max(1, math.isqrt(len(cuts)))
    below = lambda bounds: F.size(F.filter(bounds, lambda cut: cut <= value))
    literal = lambda values: F.expr(f"array({', '.join(f'{v}L' for v in values)})") if values else F.array().cast("array<bigint>")
    parts = [list(cuts[i : i + step]) for i in range(0, len(cuts), step)]
    part = F.greatest(below(literal([p[0] for p in parts])) - 1, F.lit(0))
    inside = F.get(F.array(*[literal(p) for p in parts]), part) if parts else literal([])
    return F.when(value.isNull() | F.lit(not parts), F.lit(0)).otherwise(part * step + below(inside)).cast("bigint")


def _cuts(quantiles: Sequence[int] | None, parts: int) -> list[int]:
    """Bounds of ``parts`` equal shares, out of the bounds of more of them."""
    given = quantiles or []
    return sorted({given[i * (len(given) + 1) // parts - 1] for i in range(1, parts)})


def id_blocks(df: DataFrame, id_col: str, rows: int = ROWS_PER_BLOCK) -> DataFrame:
    """Blocks of a unique integer order column, of about ``rows`` rows each, however the ids lie.

    A sketch of quantiles gives splitters of equal depth: one pass counts the rows and finds the splitters. Where the table
    asks for more blocks than a sketch has quantiles, a second pass finds splitters inside each of the first ones, so a
    block stays near ``rows`` rows. The driver gets splitters only, one for each block. Null ids go to block 0.
    """
    id_ = F.col(id_col).cast("bigint")
    shares = lambda n: [i / n for i in range(1, n)]
    found = df.agg(F.count("*").alias("n"), F.percentile_approx(id_, shares(CUTS), PRECISION).alias("cuts")).first()
    wanted = -(-found["n"] // rows)
    if wanted <= CUTS:
        return df.withColumn(BLOCK, _place(_cuts(found["cuts"], wanted), id_) if wanted > 1 else F.lit(0).cast("bigint"))
    first = sorted(set(found["cuts"] or []))
    inner = -(-wanted // (len(first) + 1))
    fine = df.groupBy(_place(first, id_).alias("part")).agg(F.percentile_approx(id_, shares(inner), 16 * inner).alias("cuts"))
    cuts = set(first).union(*(r["cuts"] or [] for r in fine.toLocalIterator())) if inner > 1 else first
    return df.withColumn(BLOCK, _place(sorted(cuts), id_))


def range_blocks(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], blocks: int | None = None
) -> DataFrame:
    """Blocks of equal depth for any order. Range bounds come from a sample, so the result is
    written once; both the block totals and the rows then read the same block numbers."""
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *group, *order).withColumn(BLOCK, F.spark_partition_id())
    return materialize(ranged, "blocks")


def _join_carry(rows: DataFrame, carry: DataFrame, group: Sequence[str]) -> DataFrame:
    keys = [*group, BLOCK]
    renamed = carry
    condition = F.lit(True)
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_c_{key}")
        condition = condition & F.col(key).eqNullSafe(F.col(f"_c_{key}"))
    return rows.join(renamed, condition, "left").drop(*[f"_c_{k}" for k in keys])


def running_sums(
    blocked: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
    maxes: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``sums``.

    ``maxes`` maps a name to a pair of sums ``(a, b)`` and adds the maximum of ``a - b`` over the rows
    before the current one (null for the first row of a group).
    """
    maxes = maxes or {}
    keys = [*group, BLOCK]
    sorted_block = Window.partitionBy(*keys).orderBy(*order)
    inside = sorted_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = sorted_block.rowsBetween(Window.unboundedPreceding, -1)
    rows = blocked.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in sums.items()])
    for name, (a, b) in maxes.items():
        rows = rows.withColumn(f"_d_{name}", F.col(f"_in_{a}") - F.col(f"_in_{b}"))
        rows = rows.withColumn(f"_in_{name}", F.max(f"_d_{name}").over(earlier))

    source = rows if maxes else blocked
    totals = source.groupBy(*keys).agg(
        *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()],
        *[F.max(f"_d_{n}").alias(f"_t_{n}") for n in maxes],
    )
    ordered = Window.partitionBy(*(group or [F.lit(0)])).orderBy(BLOCK)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_pre_{n}") for n in sums],
        *[f"_t_{n}" for n in maxes],
    )
    for name, (a, b) in maxes.items():
        top = F.col(f"_pre_{a}") - F.col(f"_pre_{b}") + F.col(f"_t_{name}")
        carry = carry.withColumn(f"_pre_{name}", F.max(top).over(before))
    joined = _join_carry(rows, carry.drop(*[f"_t_{n}" for n in maxes]), group)

    added = {n: (F.col(f"_in_{n}") + F.col(f"_pre_{n}")) for n in sums}
    for name, (a, b) in maxes.items():
        here = F.col(f"_in_{name}") + F.col(f"_pre_{a}") - F.col(f"_pre_{b}")
        added[name] = F.greatest(here, F.col(f"_pre_{name}"))
    return joined.select(*[c for c in blocked.columns if c != BLOCK], BLOCK, *[c.alias(n) for n, c in added.items()])


def running_rank(
    blocked: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "rank"
) -> DataFrame:
    """Row number inside each group, from 1."""
    return running_sums(blocked, group, order, {name: F.lit(1).cast("bigint")})


def previous_row(
    blocked: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    name: str = "previous",
) -> DataFrame:
    """Add a struct of ``columns`` taken from the row before, or null for the first row of a group."""
    keys = [*group, BLOCK]
    inside = Window.partitionBy(*keys).orderBy(*order)
    value = F.struct(*columns)
    rows = blocked.select("*", F.lag(value).over(inside).alias("_in_prev"), F.row_number().over(inside).alias("_rn"))
    last = blocked.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    by_block = Window.partitionBy(*(group or [F.lit(0)])).orderBy(BLOCK)
    carry = last.select(*keys, F.lag("_last").over(by_block).alias("_pre_prev"))
    joined = _join_carry(rows, carry, group)
    picked = F.when(F.col("_rn") == 1, F.col("_pre_prev")).otherwise(F.col("_in_prev"))
    return joined.select(*blocked.columns, picked.alias(name))


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: str,
    copies: str,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Left-join ``lookup`` (one row per key) to ``rows`` when a few keys may own most rows.

    ``lookup[copies]`` tells how many rows share a key. Every key with more than ``hot_rows`` is salted: its
    rows are spread by ``spread_by`` over ``copies / hot_rows`` tasks and its lookup row is repeated for each.
    Only such keys and their salt counts are broadcast: at most one for each ``hot_rows`` rows of the table.
    The lookup is written once, since it is read three times.
    """
    lookup = materialize(lookup, "lookup")
    hot = lookup.where(F.col(copies) > hot_rows).select(*keys, F.ceil(F.col(copies) / hot_rows).cast("int").alias("_salts"))
    salts = F.coalesce("_salts", F.lit(1))
    salted_rows = rows.join(F.broadcast(hot), list(keys), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), salts.cast("bigint")).cast("int")
    )
    salted_lookup = lookup.join(F.broadcast(hot), list(keys), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    values = [c for c in lookup.columns if c not in keys]
    joined = salted_rows.join(salted_lookup.drop("_salts"), [*keys, "_salt"], "left")
    return joined.select(*rows.columns, *values)
