"""Keep the rows of a large table whose key is wanted, before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 16 MB whatever the number of keys.
FILTER_BITS = 1 << 27


def only(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``rows`` whose ``key`` is among those of ``wanted``.

    A bitmap of fixed size goes to the scan first; what passes it by chance is dropped by an exact join. So
    only rows that are wanted, and a few more, are shuffled, however wide they are.
    """
    bit = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(FILTER_BITS))
    # at most FILTER_BITS / 32768 rows of 4 kB
    marks = wanted.select(bit.alias("_bit")).groupBy(F.expr("bitmap_bucket_number(_bit)").alias("_block")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(_bit))").alias("_map")
    )
    marked = rows.withColumn("_bit", bit).withColumns({"_block": F.expr("bitmap_bucket_number(_bit)"), "_at": F.expr("bitmap_bit_position(_bit)")})
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_at div 8 + 1 as int), 1)")), 16, 10).cast("int")
    passed = marked.join(F.broadcast(marks), "_block").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0)
    return passed.select(rows.columns).join(wanted.select(key).distinct(), key, "left_semi").select(rows.columns)
