"""Language by rank order: how far the most frequent n-grams of a text are out of place in each profile.

Letter n-grams of lower-case words, padded with one space on each side, are counted in a table of hashed
buckets. A profile is the list of the most frequent buckets; a text gets the language whose profile has
the least sum of rank differences, where a bucket that the profile lacks counts as the profile's length.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.llm.common import Memo, by_batch

LONGEST = 3
PROFILE = 300
BUCKETS = 1 << 16
#: Labelled rows that a profile is learned from are about this many at most, chosen by a hash of the id.
ROWS_PER_LANGUAGE = 5_000
UNKNOWN = "und"

_letters = re.compile(r"[^\W\d_]+").findall
#: The words above also hold numerals that are no digits; a text of such alone has no letter.
_letter = regex.compile(r"\p{L}").search


def _grams(word: str) -> bytes:
    padded = f" {word} "
    return np.array([zlib.crc32(padded[i : i + n].encode()) % BUCKETS for n in range(1, LONGEST + 1) for i in range(len(padded) - n + 1)], dtype="<i4").tobytes()


_words = Memo(_grams, owner="langid")


def counts(text: str) -> np.ndarray:
    """How often each bucket occurs in the whole text; all zero without a letter."""
    return np.bincount(np.frombuffer(b"".join(map(_words.__getitem__, _letters(text.lower()))), "<i4"), minlength=BUCKETS)


def ranked(count: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """Buckets by falling count, ties by bucket."""
    there = np.flatnonzero(count)
    value = count[there]
    if len(there) > most:
        least = np.partition(value, len(value) - most)[len(value) - most]
        there, value = there[value >= least], value[value >= least]
    return there[np.argsort(-value, kind="stable")][:most]


@dataclass
class Model:
    """Languages in order of name, and the rank of each bucket in the profile of each (its length if it lacks it)."""

    languages: list[str]
    ranks: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and 1 less the distance as a share of the largest possible; ties go to the first name."""
        if not text or not self.languages or not _letter(text):
            return UNKNOWN, 0.0
        own = ranked(counts(text))
        if not len(own):
            return UNKNOWN, 0.0
        distance = np.abs(self.ranks[:, own] - np.arange(len(own))).sum(axis=1)
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (len(own) * PROFILE))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Profiles from rows with a language that are not held out, on a sample bounded by ``rows_per_language``.

    The driver gets one count for each language and the ``PROFILE`` most frequent buckets of each.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS), np.int32))
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows_per_language / n))))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000

    def run(lang, text):
        total: dict[str, np.ndarray] = {}
        for key, value in zip(lang.to_pylist(), text.to_pylist(), strict=True):
            total[key] = total.get(key, 0) + counts(value)
        there = {k: np.flatnonzero(v) for k, v in total.items()}
        return (
            pa.array([k for k, at in there.items() for _ in at], type=pa.string()),
            pa.array(np.concatenate(list(there.values())), type=pa.int32()),
            pa.array(np.concatenate([total[k][at] for k, at in there.items()]), type=pa.int64()),
        )

    grams = by_batch(labelled.where(drawn).select("lang", "text"), run, "lang string, bucket int, n long", "langid").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "bucket")
    top = grams.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PROFILE).collect()
    languages = sorted(sizes)
    ranks = np.full((len(languages), BUCKETS), PROFILE, np.int32)
    for r in top:
        ranks[languages.index(r["lang"]), r["bucket"]] = r["place"] - 1
    return Model(languages, ranks)


def identify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1) under ``names``, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, as are all where nothing was learned.
    All columns are kept; those of ``names`` are replaced where they exist.
    """
    kept = docs.drop(*names)
    at = kept.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.ranks.astype(np.int16)))

    def run(*columns):
        own = Model(shared.value[0], shared.value[1])
        pairs = [own.predict(x) for x in columns[at].to_pylist()]
        return *columns, pa.array([x for x, _ in pairs], type=pa.string()), pa.array([x for _, x in pairs], type=pa.float64())

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return by_batch(kept, run, f"{schema}, `{names[0]}` string, `{names[1]}` double", "langid")
