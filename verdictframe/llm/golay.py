"""Near duplicates by SimHash, found with the binary Golay code.

A fingerprint of 64 bits is cut into two segments of 23 bits and one of 18. The Golay code is perfect: each
word of 23 bits lies within three bits of one codeword of its 4,096. A segment's keys are the index of that
codeword and, if it lies three bits away, those of the five codewords that lie four bits away. Any two words
of 23 bits that differ in at most two bits share such a key (a test tries all patterns).

Two fingerprints that differ in at most three bits either agree in the last segment, and then one of the two others
differs in at most one bit, or they differ there, and then the two others in at most two bits together. So
they meet under (last segment, key of one other) or under (key of the first, key of the second). What meets is verified.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.common import by_batch, pieces, texts
from verdictframe.llm.neardup import components
from verdictframe.llm.spelling import groups, tiled
from verdictframe.operators.ordered import attach
from verdictframe.session import materialize

WORDS, SEED, BITS = 3, 42, 3
#: Generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the code, and the widths of its words and messages.
GENERATOR, WIDTH, MESSAGE = 0b110001110101, 23, 12
CHECK = WIDTH - MESSAGE
#: Fingerprints of a tile, rows read at a time, fingerprints of a group whose pairs are all listed.
TILE, AT_ONCE, FEW = 8192, 1 << 16, 8
#: Links of a group form a tree in which a member has so many others below it.
FAN = 256
#: Shingles whose bits are unpacked at a time.
SHINGLES = 1 << 15
_gap = re.compile(rb"[\x20\x09-\x0d]")
U = np.uint64


def fingerprint(text: str) -> int:
    """Bits that are set in more than half of the hashes of all runs of three words; fewer words are one run, none give 0.

    Words are what white space of ASCII parts, with A-Z in lower case.
    """
    ones, n, before, word = np.zeros(64, np.int64), 0, [], []
    for part in pieces(text.encode().lower(), _gap):
        word = before + part.split()
        for start in range(0, max(0, len(word) - WORDS + 1), SHINGLES):
            own = word[start : start + SHINGLES + WORDS - 1]
            runs = map(b" ".join, zip(*(own[k:] for k in range(WORDS))))
            hashes = np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), U, len(own) - WORDS + 1)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)
        before = word[-(WORDS - 1) :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(word), SEED) if word else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view(U)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed number, of each row."""

    def run(doc_id, text):
        return doc_id, pa.array(np.array([fingerprint(x) for x in text.to_pylist()], dtype=U).view(np.int64))

    source = texts(docs)
    return by_batch(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long", "golay")


def _rest(value: int) -> int:
    """Remainder of a polynomial by the generator."""
    while value.bit_length() > CHECK:
        value ^= GENERATOR << (value.bit_length() - CHECK - 1)
    return value


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of messages; the error that each remainder stands for; the indices of codewords near an error, -1 where there are no more."""
    high = np.array([_rest(m << CHECK) for m in range(1 << MESSAGE)], dtype=np.int64)
    error = np.zeros(1 << CHECK, np.int64)
    for weight in range(1, BITS + 1):
        for bits in itertools.combinations(range(WIDTH), weight):
            e = sum(1 << b for b in bits)
            error[(e & ((1 << CHECK) - 1)) ^ high[e >> CHECK]] = e
    codewords = (np.arange(1 << MESSAGE) << CHECK) | high
    near = np.full((1 << CHECK, 6), -1, np.int64)
    near[:, 0] = 0
    for rest in np.flatnonzero(np.bitwise_count(error) == BITS):
        near[rest, 1:] = codewords[np.bitwise_count(codewords ^ error[rest]) == BITS + 1] >> CHECK
    return high, error, near


_known: list = []


def keys(segment: np.ndarray) -> np.ndarray:
    """Up to six indices of codewords near each word of 23 bits, -1 where there are fewer."""
    if not _known:
        _known.append(_tables())
    high, error, near = _known[0]
    rest = (segment & ((1 << CHECK) - 1)) ^ high[segment >> CHECK]
    index = (segment ^ error[rest]) >> CHECK
    return np.where(near[rest] < 0, -1, index[:, None] ^ near[rest])


def keyed(prints: DataFrame) -> DataFrame:
    """``key`` and ``fp``: each fingerprint under all of its keys."""

    def run(fp):
        value = fp.to_numpy().view(U)
        a, b, c = ((value >> U(k)).astype(np.int64) & ((1 << w) - 1) for k, w in ((0, WIDTH), (WIDTH, WIDTH), (2 * WIDTH, 64 - 2 * WIDTH)))
        at_a, at_b = keys(a), keys(b)
        both = np.where((at_a[:, :, None] < 0) | (at_b[:, None, :] < 0), -1, (at_a[:, :, None] << MESSAGE) | at_b[:, None, :]).reshape(len(value), -1)
        one = [np.where(at < 0, -1, (kind << 40) | (c[:, None] << MESSAGE) | at) for kind, at in ((1, at_a), (2, at_b))]
        table = np.concatenate([both, *one], axis=1)
        row, column = np.nonzero(table >= 0)
        return pa.array(table[row, column]), fp.take(pa.array(row))

    return by_batch(prints.select("fp"), run, "key long, fp long", "golay")


def parted(values: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Fingerprints as groups that links of at most ``bits`` bits join. What a group has taken is not compared again."""
    out, rest = [], np.unique(values)
    while len(rest):
        front, rest, taken = rest[:1], rest[1:], [rest[:1]]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for x in front[:64]:
                near |= np.bitwise_count(rest ^ x) <= bits
            new, rest = rest[near], rest[~near]
            taken.append(new)
            front = np.concatenate([front[64:], new])
        out.append(np.concatenate(taken))
    return out


def links(prints: DataFrame) -> DataFrame:
    """``a``, ``b``: links that join the same fingerprints as all pairs of at most three differing bits do.

    Pairs of small groups are listed as they are. Larger ones (two tiles at most) give a tree for each part that links join,
    so what is listed follows the number of fingerprints and not of pairs.
    """
    spread = tiled(keyed(prints), ("key",), "fp", TILE)
    ready = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, number in groups(batches, ("key", "i", "j"), AT_ONCE):
            fp = batch.column("fp").to_numpy().view(U)
            size = np.bincount(number)[number]
            a, b = [], []
            small = np.flatnonzero((size > 1) & (size <= FEW))
            for lag in range(1, FEW):
                x = small[small + lag < len(fp)]
                x = x[number[x] == number[x + lag]]
                x = x[np.bitwise_count(fp[x] ^ fp[x + lag]) <= BITS]
                a.append(fp[x])
                b.append(fp[x + lag])
            starts = np.flatnonzero(np.diff(number, prepend=-1))
            for start in starts[size[starts] > FEW]:
                for part in parted(fp[start : start + size[start]]):
                    a.append(part[(np.arange(1, len(part)) - 1) // FAN])
                    b.append(part[1:])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    found = ready.select("key", "i", "j", "fp").mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def clusters(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id``, the least id that links of at most three differing bits lead to.

    Null texts count as empty; texts without a word have the fingerprint zero, which is linked like any other. Each row,
    repeated ones and rows of one id with several texts as well, is judged by its own text. Rows without an id take part
    and get the component's least id (null if no row of it has one). Texts are read whole, long ones piece by piece.
    Other columns are not read. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "prints")
    joined = components(materialize(links(prints), "links"))
    named = materialize(prints.join(joined.select(F.col("id").alias("fp"), F.col("class").alias("root")), "fp", "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    lookup = named.join(least, "root").select("fp", "copies", "component_id")
    marked = rows.withColumn("row", F.monotonically_increasing_id())
    out = attach(marked, lookup, ["fp"], spread_by="row", copies="copies", hot_rows=100_000)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
