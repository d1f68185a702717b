"""Byte-level BPE as a monoid: encode halves, join neighbours, concatenate on the way back.

The ids of a byte string under "merge the pair of lowest rank, leftmost first" have a local test: a
sequence of tokens is the encoding of its bytes exactly if each two neighbours are stable, that is if
encoding the bytes of the two alone gives the two back. Merges inside two neighbours never depend on
what stands outside them until the first merge across their border, and that merge would show up in
the two alone as well.

So two encoded halves can be joined: bytes around the border are encoded anew, and the window grows
until the tokens at both its ends are stable with the tokens outside. All other neighbours lie inside
an encoding and are stable already.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.common import Memo, by_batch, lists, texts

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
NEVER = 1 << 60
#: Bytes that are merged directly, without halving.
LEAF = 48


SHIFT = 32


class PairCosts(dict):
    """The rank of two neighbouring ids together, ``NEVER`` if there is none; kept for pairs that come again."""

    def __init__(self, ranks: dict[bytes, int], pieces: list[bytes], limit: int = 500_000) -> None:
        super().__init__()
        self.ranks, self.pieces, self.limit = ranks, pieces, limit

    def __missing__(self, pair: int) -> int:
        value = self.ranks.get(self.pieces[pair >> SHIFT] + self.pieces[pair & ((1 << SHIFT) - 1)], NEVER)
        if len(self) >= self.limit:
            self.clear()
        self[pair] = value
        return value


class Codec:
    def __init__(self, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.match = regex.compile(pattern).findall
        self.leaf = leaf
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.costs = PairCosts(self.ranks, self.pieces)
        self.words = Memo(self._word, 400_000, owner="bpe")
        self.pairs = Memo(lambda pair: self.merge(self.pieces[pair[0]] + self.pieces[pair[1]]) == list(pair), owner="bpe")

    def merge(self, data: bytes) -> list[int]:
        """All merges of ``data``, lowest rank first, leftmost on ties."""
        if len(data) > 128:
            return self._merge_long(data)
        single, cost = self.single, self.costs
        parts = [single[b] for b in data]
        costs = [cost[a << SHIFT | b] for a, b in zip(parts, parts[1:])]
        while costs:
            lowest = min(costs)
            if lowest == NEVER:
                break
            i = costs.index(lowest)
            parts[i] = lowest  # what a merge costs is the id it gives
            del parts[i + 1], costs[i]
            if i < len(costs):
                costs[i] = cost[lowest << SHIFT | parts[i + 1]]
            if i:
                costs[i - 1] = cost[parts[i - 1] << SHIFT | lowest]
        return parts

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap: n log n for the wide windows that long runs need."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # where the part that begins here ends; 0 if none begins here
        before = list(range(-1, n - 1))
        heap = [(ranks[data[i : i + 2]], i, i + 2) for i in range(n - 1) if data[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop or not end[middle]:
                continue  # one of the two has grown since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (cost := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (cost, i, end[stop]))
            if (left := before[i]) >= 0 and (cost := ranks.get(data[left:stop])) is not None:
                heapq.heappush(heap, (cost, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.pairs[left[-1], right[0]]:
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            middle = self.merge(b"".join(map(self.pieces.__getitem__, left[a:] + right[:b])))
            if (not a or self.pairs[left[a - 1], middle[0]]) and (b == len(right) or self.pairs[middle[-1], right[b]]):
                return left[:a] + middle + right[b:]
            width *= 2

    def reduce(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def _word(self, word: str) -> bytes:
        data = word.encode()
        rank = self.ranks.get(data)  # a whole match in the vocabulary is taken as it is
        return array("i", [rank] if rank is not None else self.reduce(data)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text``. No merge crosses the border of a match, so there a join is a concatenation."""
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.match(text))), dtype="<i4")

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.pieces.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def codec(path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of each whole text.

    Null and empty texts give an empty array. Repeated rows stay repeated. Special tokens are ordinary text.
    Columns other than ``doc_id`` and ``text`` are not carried, so their names cannot clash.
    """

    def run(doc_id, text):
        own = codec(path, pattern)
        return doc_id, lists([own.encode(x) for x in text.to_pylist()], pa.int32())

    source = texts(docs)
    return by_batch(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>", "bpe")


def decode(encoded: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id``, ``ids`` and their bytes as ``decoded``; bytes, since ids need not end between characters.

    Null ids stay null, no ids give no bytes.
    """

    def run(doc_id, ids):
        own = codec(path, pattern)
        flat, ends, there = ids.values.to_numpy(), ids.offsets.to_numpy(), ids.is_valid().to_pylist()
        found = [own.decode(flat[a:b].tolist()) if valid else None for a, b, valid in zip(ends, ends[1:], there, strict=False)]
        return doc_id, ids, pa.array(found, type=pa.binary())

    source = encoded.select("doc_id", "ids")
    return by_batch(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary", "bpe")


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Digests of ids and decoded bytes."""
    return decode(encode(docs, path), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
