"""Packing along a space-filling curve, so that a sequence holds documents that resemble each other.

A document's token counts are hashed into a vector, projected to a few dimensions and placed on a Hilbert
curve. Documents are dealt out by ranges of the curve; each range lays its documents end to end in the
order of the curve and cuts the stream into sequences. What is left at the end of a range is cut into
powers of two, which need no padding.

The position on the curve ends with bits of a hash of the document id: copies share a place on the curve,
and ranges can still divide them.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verdictframe.llm.common import Memo, by_batch, texts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LENGTH = 2048
END = 1
#: Size of the hashed vector, dimensions and bits of the curve. Dimensions times bits is at most 32.
FEATURES, DIMENSIONS, BITS = 256, 4, 8
#: Documents that the bounds of the ranges are drawn from, for each range. They affect balance, not completeness.
SAMPLE_PER_RANGE = 40
RANGE_BYTES = 64 << 20

#: A word of these characters can be cut by the tokenizer's own pattern and put in lower case before it is tokenized.
_simple = re.compile("[\x20-\x7e\xa1-įĲ-ɏ]*").fullmatch
_word_parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
_STOPS = ",.;:!?"
#: Bytes of Latin-1 text as letters and digits, stops, white space (of Unicode, which has no separators from U+001C on) and all else.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"
_classes = bytes(
    ord("a" if regex.match(r"[\p{L}\p{N}]", chr(b)) else "." if chr(b) in _STOPS else " " if chr(b) in _SPACES else "x") for b in range(256)
)
#: How byte-level vocabularies write bytes that are not printable: characters from 256 on, in order.
_byte_names = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


class _Words(Memo):
    """Ids of words; one of letters only, as most are, goes straight to the model."""

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            if word.isascii():
                return self.keep(word, array("I", [t.id for t in self.tokenize(word.lower())]).tobytes())
            if _simple(word):
                written = word.lower().encode().decode("latin-1").translate(_byte_names)
                return self.keep(word, array("I", [t.id for t in self.tokenize(written)]).tobytes())
        return self.keep(word, self.fn(word))


class Words:
    """Ids of texts, kept for words that come again. Cutting at spaces changes no id: no token holds white space."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.parts = Memo(self._part, 40_000, owner="packing")
        self.words = _Words(self._word, 300_000, owner="packing")
        self.words.tokenize = self.tokenize

    def _part(self, part: str) -> bytes:
        """Ids of one match of the pattern, in lower case: the model reads its bytes as characters."""
        written = part if part.isascii() else part.encode().decode("latin-1").translate(_byte_names)
        return array("I", [t.id for t in self.tokenize(written)]).tobytes()

    def _word(self, word: str) -> bytes:
        if not _simple(word) or any(x in word for x in self.special):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.parts.__getitem__, _word_parts(word.lower())))

    def encode(self, text: str) -> bytes:
        text = text.replace("\n", " ")
        try:
            marked = text.encode("latin-1").translate(_classes) + b" "
        except UnicodeEncodeError:
            marked = None
        # Latin-1 can be put in lower case at once, and a stop between a letter or digit and a space can be
        # cut off, as the pattern does. Neither is done where special tokens may be meant.
        if marked and "<|" not in text:
            text = text.lower() + " "
            if b".. " not in marked and b"x. " not in marked:
                for stop in _STOPS:
                    text = text.replace(f"{stop} ", f" {stop} ")
        return b"".join(map(self.words.__getitem__, text.split(" ")))


@lru_cache(maxsize=2)
def words(path: str = VOCABULARY) -> Words:
    return Words(path)


def hashed(values: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit integers."""
    x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def projection(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The feature of each token id, and signs for each feature and dimension."""
    feature = (hashed(np.arange(size)) % np.uint64(FEATURES)).astype(np.int64)
    signs = (hashed(np.arange(FEATURES * DIMENSIONS) + (1 << 40)) & np.uint64(1)).astype(np.float64) * 2 - 1
    return feature, signs.reshape(FEATURES, DIMENSIONS)


def place(ids: np.ndarray, size: int) -> np.ndarray:
    """Grid coordinates of a document: root counts of features, scaled to length 1, projected, cut into equal steps."""
    feature, signs = projection(size)
    vector = np.sqrt(np.bincount(feature[ids], minlength=FEATURES))
    point = vector @ signs / max(1e-12, float(np.linalg.norm(vector)))
    return np.clip((point / 6 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of rows of grid coordinates (Skilling's transform)."""
    x = points.T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] >> bit & 1)
    return index


def tokens(docs: DataFrame, path: str = VOCABULARY, bounds: list[int] | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (unsigned 32-bit, little endian, with the end id), ``n``, ``position`` on the curve and
    ``part``, the number of ``bounds`` that the position reaches."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(bounds or [], dtype=np.int64))

    def run(doc_id, text):
        own = words(path)
        end = np.array([END], dtype="<u4").tobytes()
        ids = [own.encode(x) + end for x in text.to_pylist()]
        curve = hilbert(np.stack([place(np.frombuffer(x, "<u4"), own.size) for x in ids]))
        low = np.array([zlib.crc32(str(x).encode()) >> 1 for x in doc_id.to_pylist()], dtype=np.int64)
        position = curve << 31 | low
        part = np.searchsorted(shared.value, position, side="right").astype(np.int64)
        return doc_id, pa.array(ids, type=pa.binary()), pa.array([len(x) // 4 for x in ids], type=pa.int64()), pa.array(position), pa.array(part)

    source = texts(docs)
    return by_batch(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary, n long, position long, part long", "packing")


def range_bounds(docs: DataFrame, path: str = VOCABULARY) -> list[int]:
    """Positions that divide the documents evenly, from a sample by a hash of the id, bounded by the number of ranges."""
    rows = docs.count()
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not rows:
        return []
    share = min(1.0, ranges * SAMPLE_PER_RANGE / rows)
    drawn = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    found = np.array([(r["position"], r["n"]) for r in tokens(drawn, path).select("position", "n").collect()], dtype=np.int64).reshape(-1, 2)
    if not len(found):
        return []
    ranges = max(ranges, math.ceil(found[:, 1].mean() * 4 * rows / RANGE_BYTES))
    order = found[np.argsort(found[:, 0])]
    filled = np.cumsum(order[:, 1])
    at = np.searchsorted(filled, filled[-1] * np.arange(1, ranges) / ranges)
    return sorted(set(order[at, 0].tolist()))


def pack(docs: DataFrame, path: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """Pieces of documents in sequences: ``doc_id``, ``start`` and ``length`` in the document, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset`` there, ``ids`` (binary).

    Every sequence is full or a power of two long, so none needs padding. Null and empty texts are the end id
    alone. Repeated rows are packed as often as they come. An empty table gives no pieces.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    bounds = range_bounds(docs, path)
    laid = tokens(docs, path, bounds).repartition(len(bounds) + 1, "part")
    stream = Window.partitionBy("part")
    ordered = stream.orderBy("position", "doc_id", "n", "ids").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = laid.select("doc_id", "ids", "n", "part", F.sum("n").over(ordered).alias("stop"), F.sum("n").over(stream).alias("total"))
    laid = laid.withColumns({"first": F.expr("stop - n"), "full": F.expr(f"total div {length}"), "rest": F.expr(f"total % {length}")})
    bits = int(math.log2(length)) - 1
    cuts = laid.withColumn(
        "cut",
        F.expr(f"""
            concat(
                if(full > first div {length},
                   transform(sequence(first div {length}, least(full - 1, (stop - 1) div {length})),
                             k -> named_struct('number', k, 'begin', k * {length}, 'size', {length}L)),
                   array()),
                filter(transform(filter(sequence({bits}, 0, -1), b -> shiftright(rest, b) % 2 = 1),
                                 (b, i) -> named_struct('number', full + i, 'begin', full * {length} + shiftleft(shiftright(rest, b + 1), b + 1),
                                                        'size', shiftleft(1L, b))),
                       c -> c.begin < stop and c.begin + c.size > first))
        """)
        if bits >= 0
        else F.expr("transform(sequence(first, stop - 1), k -> named_struct('number', k, 'begin', k, 'size', 1L))"),
    )
    pieces = cuts.select("doc_id", "ids", "n", "part", "first", "stop", F.explode("cut").alias("cut"))
    pieces = pieces.withColumns({"a": F.greatest("cut.begin", "first"), "b": F.least(F.expr("cut.begin + cut.size"), "stop")})
    return pieces.select(
        "doc_id",
        F.expr("a - first").alias("start"),
        F.expr("b - a").alias("length"),
        F.expr("crc32(substring(ids, cast((a - first) * 4 + 1 as int), cast((b - a) * 4 as int)))").alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        F.expr("part * 4294967296 + cut.number").alias("sequence_id"),
        F.expr("a - cut.begin").alias("offset"),
        F.expr("substring(ids, cast((a - first) * 4 + 1 as int), cast((b - a) * 4 as int))").alias("ids"),
    )
