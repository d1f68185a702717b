"""Groups of spelling variants by blocked Gram matrices of letter counts.

Words are counted over all texts. Words that differ by one inserted, deleted or replaced code point have
letter counts at a squared distance of 1 or 2, so NumPy products of blocks of letter-count rows leave few
pairs, which are then verified letter by letter. Blocks are of words of one length against words of that
length and the next. A length is cut further without a loss: of two near words either the first half of the
shorter one, or its second half, is also the start, or the end, of the other. Halves that many words share
are dealt out as pairs of tiles of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.common import Memo, pieces, slices, texts
from verdictframe.session import materialize

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One in so many pairs of document and word loses a code point.
ONE_IN = 97
#: A form must be so many times as frequent as the word.
RATIO = 2
#: Words that a task counts before it passes the counts on.
KEPT = 300_000
#: Words of a tile; words of a block, whose groups share one product; pairs verified at a time.
TILE, BLOCK, AT_ONCE = 2048, 512, 1 << 17
#: Longer words are verified one pair at a time.
WIDE = 64
_runs = re.compile("[A-Za-zÀ-ÿ]+").findall
_gap = re.compile("[^A-Za-zÀ-ÿ]")
KEY = ("size", "side", "affix")


def words(doc_id: int | None, text: str, one_in: int = ONE_IN) -> Counter:
    """The words of a document and how often each comes, with the deletions that its id asks for."""
    found: Counter = Counter()
    for part in pieces(text.encode().lower().decode(), _gap):
        found.update(_runs(part))
    seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for word, n in found.items():
        if len(word) >= LEAST_LENGTH:
            h = crc32(word.encode(), seed)
            if not h % one_in:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < LEAST_LENGTH:
                    continue
            out[word] += n
    return out


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` of all words that come ``least`` times. Tasks add up before the shuffle, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.begin("spelling")
        total: dict[str, int] = {}

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.string()), pa.array(list(total.values()), type=pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for whole in batches:
            for batch in slices(whole):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for word, n in words(doc_id, text).items():
                        total[word] = total.get(word, 0) + n
                    if len(total) > KEPT:
                        yield passed()
        yield passed()

    counted = texts(docs).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def halves(vocabulary: DataFrame) -> DataFrame:
    """The words, each under the two halves that words of its length are met by, and those that shorter words by one are."""
    own = "length(word)"
    keys = []
    for size in (own, f"({own} - 1)"):
        keys.append(f"struct({size} as size, 0 as side, left(word, {size} div 2) as affix)")
        keys.append(f"struct({size} as size, 1 as side, right(word, cast({size} - {size} div 2 as int)) as affix)")
    return vocabulary.select("word", "n", F.explode(F.expr(f"array({', '.join(keys)})")).alias("key")).select("word", "n", "key.*")


def tiled(rows: DataFrame, keys: tuple[str, ...], member: str, tile: int) -> DataFrame:
    """Add ``i`` and ``j``, the pair of tiles a row takes part in, and ``own``, its own tile.

    Keys of at most ``tile`` rows are one tile. Rows of larger ones are dealt to tiles by a hash of ``member`` and
    repeated for each pair, so every two rows of a key meet once and no group is larger than two tiles.
    """
    hot = materialize(rows.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > tile), "hot")
    if hot.isEmpty():
        return rows.select("*", *[F.lit(0).alias(c) for c in ("own", "i", "j")])
    tiles = F.coalesce(F.ceil(F.col("rows") / tile), F.lit(1)).cast("int")
    dealt = rows.join(hot, list(keys), "left").withColumn("tiles", tiles)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(member), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select(*rows.columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a sorted stream of at least ``rows`` rows (but the last) that end where a group ends, and the number of each row's group."""
    held: list[pa.RecordBatch] = []

    def numbered(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            codes = batch.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        whole = pa.concat_batches(held)
        number = numbered(whole)
        end = int(np.searchsorted(number, number[-1]))
        held = [whole.slice(end)]
        if end:
            yield whole.slice(0, end), number[:end]
    if held and (whole := pa.concat_batches(held)).num_rows:
        yield whole, numbered(whole)


def _counts(codes: list[bytes]) -> np.ndarray:
    """How often each letter that comes at all is in each word, a row for each."""
    flat = np.frombuffer(b"".join(codes), np.uint8)
    at = np.repeat(np.arange(len(codes)), [len(c) for c in codes]) * 256 + flat
    table = np.bincount(at, minlength=256 * len(codes)).reshape(-1, 256)
    return table[:, np.unique(flat)].astype(np.float32 if max(map(len, codes)) < 2000 else np.float64)


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether one inserted or replaced letter makes ``b`` of ``a``, which is not longer."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    at = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return len(b) == len(a) + 1 and a[at:] == b[at + 1 :]


def verified(codes: list[bytes], length: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs ``a``, ``b`` are one edit apart; lengths differ by at most one, ``a`` is not longer."""
    out = np.zeros(len(a), bool)
    long = length[b] > WIDE
    for k in np.flatnonzero(long):
        out[k] = one_edit(codes[a[k]], codes[b[k]])
    table = np.array([c if len(c) <= WIDE else b"" for c in codes], dtype=f"S{WIDE + 2}").view(np.uint8).reshape(len(codes), WIDE + 2)
    short = np.flatnonzero(~long)
    for start in range(0, len(short), AT_ONCE):
        part = short[start : start + AT_ONCE]
        x, y = table[a[part]], table[b[part]]
        differ = x != y
        same = length[a[part]] == length[b[part]]
        moved = x[:, :-1] != y[:, 1:]
        moved &= np.arange(WIDE + 1) >= differ.argmax(axis=1)[:, None]
        out[part] = np.where(same, differ.sum(axis=1) == 1, ~moved.any(axis=1))
    return out


def near_pairs(codes: list[bytes], size: np.ndarray, side: np.ndarray, group: np.ndarray, own: np.ndarray, crossing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block that are near words of one group: those of length ``size`` with those of that length or the next.

    ``crossing`` groups are pairs of two tiles, of which only rows of different tiles are compared here. Pairs that
    share the first half as well are left to it.
    """
    length = np.array([len(c) for c in codes])
    counts = _counts(codes)
    norm = (counts * counts).sum(axis=1)
    short = np.flatnonzero(length == size)
    found_a, found_b = [], []
    for start in range(0, len(short), 1024):
        left = short[start : start + 1024]
        squared = norm[left][:, None] + norm[None, :] - 2 * (counts[left] @ counts.T)
        a, b = np.nonzero(squared <= 2)
        a, apart = left[a], squared[a, b]
        keep = (group[a] == group[b]) & (length[b] - length[a] == 2 - apart) & ((length[b] > length[a]) | (a < b)) & (~crossing[a] | (own[a] != own[b]))
        found_a.append(a[keep])
        found_b.append(b[keep])
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    good = verified(codes, length, a, b)
    a, b = a[good], b[good]
    ends = np.flatnonzero((side[a] == 1) & (length[a] != length[b]))
    drop = [k for k in ends if codes[a[k]][: size[a[k]] // 2] == codes[b[k]][: size[a[k]] // 2]]
    return np.delete(a, drop), np.delete(b, drop)


def near(vocabulary: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n``: each word with each of its near words, once each."""
    rows = tiled(halves(vocabulary).where(F.col("size") >= LEAST_LENGTH), KEY, "word", TILE)
    keys = (*KEY, "i", "j")
    ready = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, number in groups(batches, keys, BLOCK):
            column = {name: batch.column(name) for name in batch.schema.names}
            size, side, own, i, j = (column[k].to_numpy() for k in ("size", "side", "own", "i", "j"))
            starts = np.flatnonzero(np.diff(number, prepend=-1))
            first = 0
            for end in [*starts[1:], len(number)]:  # whole groups, about ``BLOCK`` rows of them
                if end - first < BLOCK and end < len(number):
                    continue
                part = slice(first, int(end))
                codes = [w.encode("latin-1") for w in column["word"][part].to_pylist()]
                a, b = near_pairs(codes, size[part], side[part], number[part], own[part], (i != j)[part])
                a, b = a + first, b + first
                first = int(end)
                if len(a):
                    x, y = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
                    yield pa.RecordBatch.from_arrays([column["word"].take(x), column["word"].take(y), column["n"].take(y)], names=["word", "near", "near_n"])

    return ready.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, where following ``form`` ends, by pointer doubling.

    A form is at least ``RATIO`` times as frequent, so chains are as short as the logarithm of the largest count, and
    turns as few as the logarithm of that.
    """
    held = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(held.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        held = step.select("word", "root")
        if step.where("moved").isEmpty():
            return held


def variants(docs: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of each word of at least five letters that comes three times.

    Words are runs of letters A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case only. One in 97 pairs of document and
    word loses a code point. The form is the most frequent near word (ties: the least), if at least twice as frequent as the
    word. Null texts count as empty; a null id is written as nothing (``:word``). Rows are documents, repeated ones
    as well: each counts. Texts are read whole, long ones piece by piece; a word may have any length. Columns other than
    ``doc_id`` and ``text`` are not read. An empty table gives no rows.
    """
    known = materialize(vocabulary(docs), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    beside = near(known).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form_n = -F.col("best.less")
    taken = form_n >= RATIO * F.col("n")
    rows = materialize(
        known.join(beside, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.form")).alias("form"), F.when(taken, form_n).alias("form_n")
        ),
        "forms",
    )
    ends = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
