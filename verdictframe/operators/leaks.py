"""Which texts contain which benchmark texts, over whole tables and whole texts, without a cross join."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.operators.ordered import attach
from verdictframe.operators.prefilter import only
from verdictframe.session import materialize

WORDS = 3
CHARS = 3  # needles without inner words: runs of 3, 2 or 1 characters
MAX_BROADCAST = 200_000  # anchors and needles, both counted first
SALTS = 32


def _tokens(text: Column) -> Column:
    return F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+")


#: Kinds of runs, the most telling first: runs of words and runs of characters, and their length.
WORD_RUNS = {0: WORDS, 1: 1}
CHAR_RUNS = {2 + CHARS - n: n for n in range(CHARS, 0, -1)}


def _grams(tokens: Column, kinds: Mapping[int, int]) -> Column:
    """Hashes of all runs of tokens of the given kinds and lengths. The array is bound once; inside the inner lambda it would be
    split again for every position."""

    def runs(words: Column, kind: int, n: int) -> Column:
        last = F.size(words) - n
        spots = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.xxhash64(F.lit(kind), *[F.get(words, i + k) for k in range(n)]))

    each = lambda words: F.array_distinct(F.concat(*[runs(words, kind, n) for kind, n in kinds.items()]))
    return F.flatten(F.transform(F.array(tokens), each))


def _chars(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), ""), lambda c: c != "")


def _inner(text: Column) -> Column:
    """The tokens between the first and the last one: these two may be cut inside a word of the
    containing text, all others must appear there as whole tokens, in a row."""
    between = F.transform(F.array(_tokens(text)), lambda t: F.slice(t, F.lit(2), F.greatest(F.size(t) - 2, F.lit(0))))
    return F.get(between, 0)


def contained_texts(
    docs: DataFrame,
    needles: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    needle_id: str = "item_id",
    needle_text: str = "text",
) -> DataFrame:
    """Pairs (doc, needle) where the case-folded doc contains the case-folded needle.

    Every needle is known by one anchor: the run of inner words that is rarest in the docs (a run of
    characters for needles with too few words). Docs that hold an anchor are candidates, and only
    those are compared as text.
    """
    source = needles.select(F.col(needle_id), F.col(needle_text).alias("_needle")).where(F.length("_needle") > 0)
    texts = docs.select(doc_id, F.col(doc_text).alias("_text"))

    needle = F.col("_needle")
    grams = {kind: _grams(_inner(needle), {kind: n}) for kind, n in WORD_RUNS.items()}
    grams |= {kind: _grams(_chars(needle), {kind: n}) for kind, n in CHAR_RUNS.items()}
    kind = F.coalesce(*[F.when(F.size(g) > 0, k) for k, g in grams.items()])
    anchors = F.coalesce(*[F.when(F.size(g) > 0, g) for g in grams.values()])
    anchored = materialize(source.select(needle_id, kind.alias("_kind"), F.explode(anchors).alias("_anchor")), "anchors")

    # a scan gives the runs of all kinds that are asked for; words are told apart once for runs of any length
    asked = {r[0] for r in anchored.select("_kind").distinct().collect()}
    given = [(_tokens(F.col("_text")), WORD_RUNS), (_chars(F.col("_text")), CHAR_RUNS)]
    wanted = [(tokens, {k: n for k, n in kinds.items() if k in asked}) for tokens, kinds in given]
    runs = [_grams(tokens, kinds) for tokens, kinds in wanted if kinds]
    if not runs:
        return docs.select(doc_id).limit(0).join(needles.select(needle_id).limit(0), F.lit(False))
    outer = texts.where(F.col("_text").isNotNull()).select(doc_id, F.explode(F.concat(*runs)).alias("_anchor"))
    candidates = materialize(_candidates(outer, anchored.drop("_kind"), doc_id, needle_id), "candidates")
    per_needle = candidates.groupBy(needle_id).agg(F.count("*").alias("_copies"))
    named = attach(candidates, source.join(per_needle, needle_id), [needle_id], doc_id, "_copies")
    # texts of candidates only: the others are left out where they are scanned
    checked = named.join(only(texts, candidates.select(doc_id), doc_id), doc_id)
    return checked.where(F.contains(F.lower("_text"), F.lower("_needle"))).select(doc_id, needle_id)


def _candidates(grams: DataFrame, anchored: DataFrame, doc_id: str, needle_id: str) -> DataFrame:
    """Docs holding the rarest anchor of a needle. Only hashes and ids are shuffled."""
    sizes = anchored.agg(F.count_distinct("_anchor").alias("a"), F.count_distinct(needle_id).alias("n")).first()
    small = max(sizes["a"], sizes["n"]) <= MAX_BROADCAST
    wanted = anchored.select("_anchor").distinct()
    if small:
        hits = grams.join(F.broadcast(wanted), "_anchor")
    else:
        # a gram that a third of all docs share is spread over SALTS tasks
        hits = _salted(grams, wanted, doc_id)
    found = materialize(hits, "hits")
    counts = found.groupBy("_anchor").agg(F.count("*").alias("_n"))
    rarest = (
        anchored.join(counts, "_anchor", "left")
        .groupBy(needle_id)
        .agg(F.min_by("_anchor", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_anchor")).alias("_anchor"))
    )
    chosen = found.join(F.broadcast(rarest), "_anchor") if small else _salted(found, rarest, doc_id)
    return chosen.select(doc_id, needle_id)


def _salted(rows: DataFrame, lookup: DataFrame, spread_by: str) -> DataFrame:
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    return salted.join(repeated, ["_anchor", "_salt"]).drop("_salt")
