"""Winnowing fingerprints in built-in columns only.

A text is read as words (runs of letters and digits, in lower case; the whole text where there are none).
Each run of ``RUN`` words is hashed. In each window of ``WINDOW`` runs the least hash is kept, the rightmost
on ties, with its word position. Any passage of ``RUN + WINDOW - 1`` words that two texts share leaves a
common fingerprint in both.

Hash and position are chosen together as one long: the 33 high bits of the hash, then 30 bits that fall
with the position, so that the least long is the least hash and, among equals, the rightmost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = 5
WINDOW = 4
LAST = (1 << 30) - 1
#: Ranges of ids for each shuffle partition, so that partitions fill evenly.
RANGES = 4


def fingerprints(df: DataFrame, text: str, prefix: str, run: int = RUN, window: int = WINDOW) -> DataFrame:
    """Add ``{prefix}fingerprint`` (position:hash, comma-joined) and ``{prefix}hashes`` (distinct 64-bit hashes).

    Null and empty texts have an empty fingerprint; texts of fewer words than ``run`` are one run; texts of
    fewer runs than ``window`` are one window. Equal texts have equal fingerprints.
    """
    words, grams, keys, chosen = (f"_{prefix}{x}" for x in ("words", "grams", "keys", "chosen"))
    own = df.withColumn(words, F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), ""))
    own = own.withColumn(words, F.when((F.size(words) == 0) & (F.col(text) != ""), F.array(F.lower(text))).otherwise(F.col(words)))
    from_word = ", ".join(f"get({words}, i + {k})" for k in range(run))
    own = own.withColumn(grams, F.expr(f"if(size({words}) = 0, array(), transform(sequence(0, greatest(size({words}) - {run}, 0)), i -> xxhash64({from_word})))"))
    own = own.withColumn(keys, F.expr(f"transform({grams}, (x, i) -> shiftleft(shiftrightunsigned(x, 31), 30) + ({LAST} - i))"))
    in_window = ", ".join(f"get({keys}, i + {k})" for k in range(window))
    least = f"least({in_window})" if window > 1 else in_window
    own = own.withColumn(chosen, F.expr(f"if(size({keys}) = 0, array(), array_distinct(transform(sequence(0, greatest(size({keys}) - {window}, 0)), i -> {least})))"))
    at = f"cast({LAST} - (key & {LAST}) as int)"
    return own.withColumns({
        f"{prefix}fingerprint": F.expr(f"array_join(transform({chosen}, key -> concat({at}, ':', lower(hex(get({grams}, {at}))))), ',')"),
        f"{prefix}hashes": F.expr(f"array_distinct(transform({chosen}, key -> get({grams}, {at})))"),
    }).drop(words, grams, keys, chosen)


def likeness(a: str, b: str) -> Column:
    """Shared hashes by all hashes; 1 if both have none, 0 if one has none or is missing."""
    union = F.size(F.array_union(a, b))
    return F.when(F.col(a).isNull() | F.col(b).isNull(), 0.0).when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (``doc_id``, ``text``) beside the text and hashes of the document that follows by id.

    Ids are cut into ranges that begin at ids of the table; the first document of each range is also dealt to
    the range before, the very first to the last one. So no order runs through one task and the text is
    shuffled once. The driver gets the bounds only.
    """
    spark = docs.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000).alias("cuts")).first()
    first = cuts["low"]
    starts = sorted({x for x in cuts["cuts"] or [] if x > first})
    bounds = F.array(*map(F.lit, starts)).cast("array<bigint>")
    own = F.size(F.filter(bounds, lambda b: b <= F.col("doc_id")))
    part = lambda number, turn: F.struct(number.alias("range"), F.lit(turn).alias("turn"))  # noqa: E731  turn 0: own, 1: follows, 2: follows the last
    places = F.array(part(own, 0))
    before = F.when(F.array_contains(bounds, F.col("doc_id").cast("bigint")), F.array(part(own - 1, 1))).otherwise(F.array().cast("array<struct<range:int,turn:int>>"))
    around = F.when(F.col("doc_id") == F.lit(first), F.array(part(F.lit(len(starts)), 2))).otherwise(F.array().cast("array<struct<range:int,turn:int>>"))
    dealt = docs.select("doc_id", "text", F.explode(F.concat(places, before, around)).alias("place")).select("doc_id", "text", "place.range", "place.turn")
    marked = fingerprints(dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "range"), "text", "")
    order = Window.partitionBy("range").orderBy("turn", "doc_id", "text")
    return marked.withColumns({"next_text": F.lead("text").over(order), "next_hashes": F.lead("hashes").over(order)}).where("turn = 0").drop("range", "turn")


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last quarter of its code points (rounded down)
    replaced by as many of the next document's first ones, in ascending order of ``doc_id``; after the last
    comes the first.

    Null texts count as empty. Of rows with one id, the order is that of their texts. Rows without an id have
    no next document: their last quarter is dropped and ``near_next`` is 0. An empty table gives no rows.
    """
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    there = with_next(source.where(F.col("doc_id").isNotNull()))
    lone = fingerprints(source.where(F.col("doc_id").isNull()), "text", "").withColumns({"next_text": F.lit(""), "next_hashes": F.lit(None).cast("array<bigint>")})
    both = there.unionByName(lone.select(there.columns)).withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), substring(next_text, 1, cast(n_chars div 4 as int)))"))
    return fingerprints(both.drop("next_text"), "edited", "edited_").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("hashes", "edited_hashes").alias("near_edited"),
        likeness("hashes", "next_hashes").alias("near_next"),
    )
