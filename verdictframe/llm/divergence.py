"""How the sources of a language differ in the words they use, on terms found by iceberg prefix refinement.

Terms are refined by prefixes of 8, 16, 32, ... bytes. Texts are read once; the terms of each
document are written as numbers (postings). At each level the documents that hold a prefix are counted,
once each; prefixes in fewer documents than asked for are discarded with all that begins with them, complete
terms that reach it are kept. A bitmap of fixed size tells the next pass over the postings which prefixes were
kept; what it lets through by chance is counted like all else and falls at its own level. From the second level
on what is left is refined from a table of the terms that still go on.

The divergence of two sources is a sum over all kept terms, most of which neither has. Terms that a source lacks all
have one share there, so the sum is taken from the number of kept terms, from each source's shares by how many terms have
them, and from the terms that both have; no row is made of a term that is not there.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.llm.common import Memo, pieces, slices
from verdictframe.llm.neardup import mixed
from verdictframe.session import materialize, scratch_path

LEAST, SCALE, TOP = 3, 1_000_000_000, 200
#: Bytes of the prefixes of the passes over all postings; later levels double.
LEVELS = (8, 16)
#: Bits of the map of kept prefixes: 16 MB whatever their number.
BITS = 1 << 27
#: Rows that a task adds up before it passes them on; bytes of texts in a row of postings; rows passed on at a time.
KEPT, SLICE, ROWS = 1 << 18, 2 << 20, 1 << 14
#: Terms times sources of a block whose pairs of sources are summed together; copies of a language's sources, for its rows to meet.
BLOCK, SALTS = 1 << 17, 16
#: Bytes as terms have them: A-Z in lower case, what no term holds as a blank.
_LETTERS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_gap = re.compile(b"[\x00-\x40\x5b-\x60\x7b-\x7f]")
GROUP = ("lang", "source")
U = np.uint64


def terms(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """The different terms of all texts; of each text and each of its terms, once and by text: which text, which term, how often.

    Terms are found as bytes between blanks, ``SLICE`` bytes of texts at a time, so no term is a Python object.
    """
    found, docs, often = [], [], []

    def add(parts: list[bytes], of: list[int]) -> None:
        data = np.frombuffer(b" ".join([*parts, b""]).translate(_LETTERS), np.uint8)
        inside = data != 0x20
        edges = np.flatnonzero(np.diff(inside, prepend=False))  # a blank ends the last term as well
        start = np.concatenate(([0], np.cumsum(edges[1::2] - edges[::2]))).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(start) - 1, [None, pa.py_buffer(start), pa.py_buffer(data[inside])]).dictionary_encode()
        part = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), edges[::2], side="right")
        width = max(1, len(coded.dictionary))
        pair, n = np.unique(np.array(of, dtype=np.int64)[part] * width + coded.indices.to_numpy(), return_counts=True)
        found.append(pa.DictionaryArray.from_arrays(pa.array(pair % width, type=pa.int32()), coded.dictionary))
        docs.append(pair // width)
        often.append(n)

    parts: list[bytes] = []
    of: list[int] = []
    size = 0
    for doc, text in enumerate(texts):
        for part in pieces(text, _gap):
            parts.append(part)
            of.append(doc)
            size += len(part)
            if size >= SLICE:
                add(parts, of)
                parts, of, size = [], [], 0
    if parts or not found:
        add(parts, of)
    same = pa.chunked_array(found).unify_dictionaries()
    values = same.chunk(0).dictionary
    at = np.concatenate([c.indices.to_numpy() for c in same.chunks])
    doc, n = np.concatenate(docs), np.concatenate(often)
    if len(found) > 1:  # a text of several parts has terms of its own in each
        pair, back = np.unique(doc * max(1, len(values)) + at, return_inverse=True)
        doc, at = pair // max(1, len(values)), pair % max(1, len(values))
        n = np.bincount(back, weights=n, minlength=len(pair)).astype(np.int64)
    return values, doc, at, n


def postings(docs: DataFrame) -> DataFrame:
    """The terms of all texts, two rows for each few documents, so that each level reads numbers and not texts.

    Terms of more than ``LEVELS[0]`` bytes are in rows of their own (``long``), since later levels read no others. ``lang``
    and ``source`` of the documents; ``bytes`` of the terms one after the other, the ``size`` of each; ``ends``, ``at`` and ``n``: where the
    terms of each document end, which terms they are, once each, and how often each comes (32-bit numbers). ``row``
    numbers the rows.
    """
    spark = docs.sparkSession
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", *GROUP)])
    names = [*GROUP, "long", "bytes", "size", "ends", "at", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.begin("divergence")
        for whole in batches:
            for batch in slices(whole, SLICE):
                values, doc, at, n = terms(batch.column("text").cast(pa.binary()).to_pylist())
                size = pc.binary_length(values).to_numpy(zero_copy_only=False)
                groups_ = [pa.array([batch.column(c).to_pylist()], type=pa.list_(pa.string())) for c in GROUP]
                for long in (False, True):
                    own = (size > LEVELS[0]) == long
                    there = own[at]
                    numbers = (size[own], np.bincount(doc[there], minlength=batch.num_rows).cumsum(), (np.cumsum(own) - 1)[at[there]], n[there])
                    own_terms = values.filter(pa.array(own))
                    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(own_terms)], own_terms), b"")
                    yield pa.RecordBatch.from_arrays(
                        [*groups_, pa.array([long]), joined, *(pa.array([x.astype("<i4").tobytes()], type=pa.binary()) for x in numbers)], names=names
                    )

    found = read.mapInArrow(run, "lang array<string>, source array<string>, long boolean, bytes binary, size binary, ends binary, at binary, n binary")
    found = found.withColumn("row", F.monotonically_increasing_id())
    path = scratch_path(spark, "postings")
    found.write.partitionBy("long").parquet(path)
    return spark.read.schema(found.schema).parquet(path)


class Postings:
    """One row of ``postings``: of each pair of document and term, the term, the document and how often."""

    def __init__(self, batch: pa.RecordBatch, row: int) -> None:
        self.names, self.source = (batch.column(c)[row].values for c in GROUP)
        self.length = np.frombuffer(batch.column("size")[row].as_py(), "<i4")
        start = np.zeros(len(self.length) + 1, np.int32)
        np.cumsum(self.length, out=start[1:])
        self.terms = pa.BinaryArray.from_buffers(pa.binary(), len(self.length), [None, pa.py_buffer(start), pa.py_buffer(batch.column("bytes")[row].as_py())])
        ends, self.at, self.n = (np.frombuffer(batch.column(c)[row].as_py(), "<i4") for c in ("ends", "at", "n"))
        self.row = batch.column("row")[row].as_py()
        self.doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        code = self.names.dictionary_encode()
        self.langs, self.lang = code.dictionary.to_pylist(), code.indices.to_numpy()

    @staticmethod
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[Postings]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield Postings(batch, row)


def summed(parts: Iterator[pa.Table], by: list[str], sums: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of the same ``by`` added up, as far as ``KEPT`` rows go."""
    pa.default_memory_pool().release_unused()  # what earlier tasks of the worker have left
    held: list[pa.Table] = []
    size = last = 0

    def added() -> pa.Table:
        whole = pa.concat_tables(held).group_by(by).aggregate([(s, "sum") for s in sums])
        return whole.select([*by, *(f"{s}_sum" for s in sums)]).rename_columns([*by, *sums])

    for part in parts:
        held.append(part)
        size += part.num_rows
        if size >= last + KEPT:
            held = [added()]
            size = last = held[0].num_rows
            if size > KEPT:
                yield from held[0].to_batches(ROWS)
                held, size, last = [], 0, 0
    if held:
        yield from added().to_batches(ROWS)


def slots(keys: pa.Array) -> np.ndarray:
    """A hash of each key, of its length and first 64 bytes."""
    size = np.minimum(pc.binary_length(keys).to_numpy(zero_copy_only=False).astype(np.int64), 64)
    width = -(-int(size.max(initial=1)) // 8) * 8
    cut = pc.binary_slice(keys, 0, 64)
    table = np.zeros((len(keys), width), np.uint8)
    table[np.arange(width) < size[:, None]] = np.frombuffer(b"" if not len(cut) else cut.buffers()[2] or b"", np.uint8)[: size.sum()]
    table = table.view(U)
    out = mixed(pc.binary_length(keys).to_numpy(zero_copy_only=False).astype(U))
    for k in range(width // 8):  # words beyond a key's end leave the hash as it is
        out = np.where(8 * k < size, mixed(out * U(0x9E3779B97F4A7C15) + table[:, k]), out)
    return out


def slot_of(hashes: np.ndarray, lang: np.ndarray, langs: list[str]) -> np.ndarray:
    seed = np.array([xxhash.xxh64_intdigest(name.encode()) for name in langs], dtype=U)
    return (mixed(hashes ^ seed[lang]) & U(BITS - 1)).astype(np.int64)


def marked(bitmap: np.ndarray, hashes: np.ndarray, lang: np.ndarray, langs: list[str]) -> np.ndarray:
    """Whether each key of a language may be among those that the bitmap was made of."""
    slot = slot_of(hashes, lang, langs)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """Bits of ``lang`` and ``key``: at most ``BITS / 32768`` rows of 4 kB on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("lang").dictionary_encode()
            slot = slot_of(slots(batch.column("key")), code.indices.to_numpy(), code.dictionary.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(slot + 1)], names=["bit"])  # Spark's functions count bits from 1

    maps = keys.select("lang", "key").mapInArrow(run, "bit long").groupBy(F.expr("bitmap_bucket_number(bit)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("map"))
    out = np.zeros(BITS // 8, np.uint8)
    for row in maps.toLocalIterator():
        out[(row["block"] - 1) * 4096 :][: len(row["map"])] = np.frombuffer(bytes(row["map"]), np.uint8)
    return out


def tally(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``size`` numbers there are, and how often each."""
    if size > 8 * len(codes) + 1000:
        return np.unique(codes, return_counts=True)
    n = np.bincount(codes, minlength=size)
    there = np.flatnonzero(n)
    return there, n[there]


def prefixes(held: DataFrame, level: int, before: int, kept: DataFrame | None) -> DataFrame:
    """``lang``, ``key``, ``complete``, ``docs``: the documents of each prefix of ``level`` bytes, and of each term that ends by then.

    ``held`` are postings, ``level`` is ``LEVELS[0]`` at least. Only terms of more than ``before`` bytes are counted, whose first ``before`` bytes are among ``kept``.
    """
    sent = held.sparkSession.sparkContext.broadcast(bitmap_of(kept)) if kept is not None else None
    held = held.where("long") if before >= LEVELS[0] else held

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for own in Postings.each(batches):
            at, doc = own.at, own.doc
            if sent is not None:
                there = own.length[at] > before
                at, doc = at[there], doc[there]
                fine = marked(sent.value, slots(pc.binary_slice(own.terms, 0, before))[at], own.lang[doc], own.langs)
                at, doc = at[fine], doc[fine]
            whole = own.length[at] <= level  # terms come once for each document, prefixes may come again
            prefix = pc.binary_slice(own.terms, 0, level).dictionary_encode()
            width = max(1, len(prefix.dictionary))
            key = prefix.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            once = np.unique(doc[~whole] * width + key[at[~whole]])
            for complete, names, of, code in ((True, own.terms, doc[whole], at[whole]), (False, prefix.dictionary, once // width, once % width)):
                width = max(1, len(names))
                group, n = tally(own.lang[of].astype(np.int64) * width + code, len(own.langs) * width)
                yield pa.table({
                    "lang": pa.array(own.langs, type=pa.string()).take(pa.array(group // width)),
                    "key": names.take(pa.array(group % width)),
                    "complete": pa.array(np.full(len(group), complete)),
                    "docs": pa.array(n, type=pa.int64()),
                })

    found = held.mapInArrow(lambda batches: summed(tables(batches), ["lang", "key", "complete"], ["docs"]), "lang string, key binary, complete boolean, docs long")
    return found.groupBy("lang", "key", "complete").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST)


def going_on(held: DataFrame, level: int, kept: DataFrame) -> DataFrame:
    """``lang``, ``row`` and ``doc`` (the document), ``term``: the terms of more than ``level`` bytes whose first ``level`` bytes may be among ``kept``."""
    sent = held.sparkSession.sparkContext.broadcast(bitmap_of(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in Postings.each(batches):
            there = own.length[own.at] > level
            at, doc = own.at[there], own.doc[there]
            fine = marked(sent.value, slots(pc.binary_slice(own.terms, 0, level))[at], own.lang[doc], own.langs)
            at, doc = at[fine], doc[fine]
            yield pa.RecordBatch.from_arrays([own.names.take(pa.array(doc)), pa.array(np.full(len(doc), own.row)), pa.array(doc), own.terms.take(pa.array(at))], names=["lang", "row", "doc", "term"])

    return held.where("long").mapInArrow(run, "lang string, row long, doc long, term binary")


def kept_terms(held: DataFrame) -> DataFrame:
    """``lang`` and ``term`` (bytes) of all terms that at least ``LEAST`` documents of the language hold."""
    whole, kept, before = [], None, 0
    for level in LEVELS:
        found = materialize(prefixes(held, level, before, kept), f"prefixes-{level}")
        whole.append(found.where("complete").select("lang", F.col("key").alias("term")))
        kept, before = found.where(~F.col("complete")).select("lang", "key"), level
    if not kept.isEmpty():
        rest = materialize(going_on(held, before, kept), "long-terms")
        for doubled in itertools.count(1):
            level = before << doubled
            key, complete = F.substring("term", 1, level), F.octet_length("term") <= level
            there = rest.groupBy("lang", key.alias("key"), complete.alias("complete"), "row", "doc").agg(F.lit(1).alias("one"))
            found = materialize(there.groupBy("lang", "key", "complete").agg(F.count("*").alias("docs")).where(F.col("docs") >= LEAST), f"prefixes-{level}")
            whole.append(found.where("complete").select("lang", F.col("key").alias("term")))
            more = found.where(~F.col("complete")).select("lang", "key")
            if more.isEmpty():
                break
            rest = materialize(rest.withColumn("key", key).where(~complete).join(more, ["lang", "key"], "left_semi").select("lang", "row", "doc", "term"), "long-terms")
    out = whole[0]
    for part in whole[1:]:
        out = out.unionByName(part)
    return materialize(out, "terms")


def occurrences(held: DataFrame, kept: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n``, ``lang_n``: how often each kept term comes in each group that holds it, and in the language."""
    sent = held.sparkSession.sparkContext.broadcast(bitmap_of(kept.select("lang", F.col("term").alias("key"))))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for own in Postings.each(batches):
            code = own.source.dictionary_encode()
            group = own.lang.astype(np.int64) * max(1, len(code.dictionary)) + code.indices.to_numpy()
            fine = marked(sent.value, slots(own.terms)[own.at], own.lang[own.doc], own.langs)
            at, doc, often = own.at[fine], own.doc[fine], own.n[fine]
            width = max(1, len(own.terms))
            pair = group[doc] * width + at
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            n = np.add.reduceat(often[order], first, dtype=np.int64) if len(first) else np.empty(0, np.int64)
            of = pa.array(doc[order][first])
            yield pa.table({"lang": own.names.take(of), "source": own.source.take(of), "term": own.terms.take(pa.array(pair[first] % width)), "n": pa.array(n)})

    found = held.mapInArrow(lambda batches: summed(tables(batches), ["lang", "source", "term"], ["n"]), "lang string, source string, term binary, n long")
    # dealt by language and term, so that sums, the check and the language's counts need no further shuffle
    dealt = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    return dealt.join(kept, ["lang", "term"], "left_semi").withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "term")))


def share(count: Column, total: Column, terms_: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + terms))``, exact: in decimals where 64 bits do not hold the product."""
    long = "decimal(20,0)"
    wide = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast(long), (total + terms_).cast(long))
    return 1 + F.when(count < (1 << 63) // SCALE - 1, F.call_function("div", F.lit(SCALE).cast("long") * (count + 1), total + terms_)).otherwise(wide)


def divergence(docs: DataFrame, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Parts ``pair``: each other source of the language, by how far the group's shares of all kept terms are from it; ``term``:
    the ``top`` terms that the group uses more than its language. Shares and sums are exact whole numbers (64 bits; shares are
    at most a billion and one). Null texts, languages and sources are read as empty texts, an empty language is one like any
    other. Each row is a document, repeated ones as well. A language without a kept term has values 0 in ``pair`` and no
    ``term``. Texts are read whole, long ones piece by piece. Other columns are not read. An empty table gives no rows.
    """
    held = postings(docs)
    groups = held.where("not long").select(F.explode(F.arrays_zip(*GROUP)).alias("group")).select("group.*").groupBy(*GROUP).agg(F.lit(1).alias("one")).select(*GROUP)
    kept = kept_terms(held)
    found = materialize(occurrences(held, kept), "occurrences")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = found.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    each = groups.join(totals, list(GROUP), "left").join(sizes, "lang", "left").select(*GROUP, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))
    lang = Window.partitionBy("lang")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") * F.count("*").over(lang) / F.lit(BLOCK))).cast("int")
    each = materialize(each.withColumns({"zero": zero, "lang_total": F.sum("total").over(lang), "blocks": blocks}), "sources")
    shared = materialize(
        found.join(each, list(GROUP)).select(
            *GROUP, "term", "zero", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")
        ),
        "shares",
    )
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order).alias("rank")
    special = shared.where("p > q").select(*GROUP, F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    special = special.select("*", rank).where(F.col("rank") <= top)
    apart = pairs(shared, each).select(*GROUP, F.lit("pair").alias("part"), "item", "value").select("*", rank)
    return apart.unionByName(special).select(*GROUP, "part", "item", "value", "rank")


def pairs(shared: DataFrame, each: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value``: the sum over all kept terms of ``f(p, q) = (p - q)^2 div q`` for each two sources.

    With z the share of a term that a source lacks, the sum is that of f(z, z') for all terms, of what p in place of z and
    q in place of z' adds, each for itself, and for terms that both have of what is then still missing.
    """
    f = lambda p, q: f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"
    other = each.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    many = shared.groupBy(*GROUP, "zero", "p").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)).cast("int"))
    met = many.join(other, ["lang", "salt"]).where("source <> item")
    base = f("zero", "item_zero")
    back = f("item_zero", "zero")
    singles = met.select("lang", "source", "item", F.expr(f"n * ({f('p', 'item_zero')} - {base})").alias("value")).unionByName(
        met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"n * ({f('item_zero', 'p')} - {back})").alias("value"))
    )
    alone = each.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int")).join(other, ["lang", "salt"]).where("source <> item")
    alone = alone.select("lang", "source", "item", F.expr(f"coalesce(terms * ({base}), 0)").alias("value"))
    return alone.unionByName(singles).unionByName(both(shared)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def both(shared: DataFrame) -> DataFrame:
    """What the terms that two sources both have add to their sum: blocks of terms, each summed for all pairs of sources at once."""
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        source, term = (block.column(c).combine_chunks().dictionary_encode() for c in ("source", "term"))
        names, at, row = source.dictionary, source.indices.to_numpy(zero_copy_only=False), term.indices.to_numpy(zero_copy_only=False)
        p, z = block.column("p").to_numpy(), block.column("zero").to_numpy()
        order = np.lexsort((row, at))
        at, row, p, z = at[order], row[order], p[order], z[order]
        starts = np.searchsorted(at, np.arange(len(names) + 1))
        place = np.full(len(term.dictionary), -1)
        a, b, value = [], [], []
        for s in range(len(names)):
            own = slice(starts[s], starts[s + 1])
            place[row[own]] = np.arange(own.start, own.stop)
            here = place[row]
            y = np.flatnonzero((here >= 0) & (at != s))
            x = here[y]
            g = lambda u, v: (u - v) * (u - v) // v
            more = g(p[x], p[y]) - g(p[x], z[y]) - g(z[x], p[y]) + g(z[x], z[y])
            place[row[own]] = -1
            if not len(y):
                continue
            cuts = np.flatnonzero(np.diff(at[y], prepend=-1))
            a += [s] * len(cuts)
            b += at[y][cuts].tolist()
            value += np.add.reduceat(more, cuts).tolist()
        lang = pa.array([block.column("lang")[0].as_py()] * len(a), type=pa.string())
        return pa.table({"lang": lang, "source": names.take(pa.array(a, type=pa.int64())), "item": names.take(pa.array(b, type=pa.int64())), "value": pa.array(value, type=pa.int64())})

    return shared.select("lang", "block", "term", "source", "p", "zero").groupBy("lang", "block").applyInArrow(run, "lang string, source string, item string, value long")
