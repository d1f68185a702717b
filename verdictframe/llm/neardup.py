"""Near duplicates by BagMinHash: signatures whose agreement estimates the weighted Jaccard likeness of bags.

A text is the bag of its runs of five words. Each element of the bag carries Poisson processes over the
levels of its weight: levels are grouped in blocks [0,1), [1,2), [2,4), [4,8), ... that are independent
processes of rates 1, 1, 2, 4, ...; a point has a time, a level in its block and one of the signature's
components. Points at a level not below the weight are passed over. The component takes its earliest
point, so two bags agree there with probability sum of minima by sum of maxima. Processes run until their
time passes the latest component, so a large weight costs its logarithm.

Bands take their components from the whole signature by a fixed draw, so a component serves in several. Texts
of one bucket are compared with its leader first: the text that meets most others over all bands, which an
original does whose copies differ from each other more than from it. Where buckets still hold texts of
several classes after that, all their texts are compared across classes, in pairs of blocks of bounded size:
one product of matrices gives all overlaps of two blocks, so pairs are never rows. Likeness is always
computed on the whole bags.
"""

from __future__ import annotations

import itertools
import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm.common import by_batch, texts
from verdictframe.operators.prefilter import only
from verdictframe.session import materialize

WORDS = 5
LIKENESS = 0.8
#: Two bags of likeness 0.8 miss all bands about once in 30,000 times; two that share a tenth meet once in 20,000.
COMPONENTS, BANDS, ROWS = 128, 48, 6
#: Rounds with one leader for each bucket before all texts of open buckets are compared in blocks.
ROUNDS = 2
#: Texts and bytes of bags in a block; elements that two blocks are compared by at a time.
BLOCK_ROWS, BLOCK_BYTES, COLUMNS = 256, 8 << 20, 4096
#: Elements of bags that are drawn at a time, whatever the number and length of texts.
AT_ONCE = 1 << 18
_words = re.compile(r"\w+").findall
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of five words, sorted, and how often each comes. Shorter texts are one run.

    Words are letters and digits in lower case; a text without any is read by its white space.
    """
    lower = text.lower()
    found = _words(lower) or lower.split()
    if not found:
        return np.empty(0, U), np.empty(0, np.int64)
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=U, count=len(found))
    size = min(WORDS, len(word))
    run = np.zeros(len(word) - size + 1, U)
    for i in range(size):
        run = mixed(run * U(0x9E3779B97F4A7C15) + word[i : len(word) - size + 1 + i])
    return np.unique(run, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Earliest time in each component, a row for each bag; bags without elements stay infinite."""
    out = np.full((len(bags), COMPONENTS), np.inf)
    owner, element, weight, size = [], [], [], 0
    for i, (hashes, counts) in enumerate(bags):
        for a in range(0, len(hashes), AT_ONCE):
            part = hashes[a : a + AT_ONCE]
            owner.append(np.full(len(part), i))
            element.append(part)
            weight.append(counts[a : a + AT_ONCE])
            size += len(part)
            if size >= AT_ONCE:
                _draw(out, np.concatenate(owner), np.concatenate(element), np.concatenate(weight))
                owner, element, weight, size = [], [], [], 0
    if size:
        _draw(out, np.concatenate(owner), np.concatenate(element), np.concatenate(weight))
    return out


def _draw(out: np.ndarray, owner: np.ndarray, element: np.ndarray, weight: np.ndarray) -> None:
    flat = out.reshape(-1)
    low, high = 0, 1  # levels of the block
    while len(element):
        own, key, limit = owner, mixed(element + U(low * 0xD6E8FEB86659FD93 % (1 << 64))), weight
        time, step = np.zeros(len(own)), 0
        while len(own):
            step += 1
            draw = mixed(key + U(step * 0x9E3779B97F4A7C15 % (1 << 64)))
            time = time - np.log(((draw >> U(11)) + U(1)) * 2.0**-53) / (high - low)
            other = mixed(draw + U(0xA0761D6478BD642F))
            part = (other % U(COMPONENTS)).astype(np.int64)
            at = own * COMPONENTS + part
            if high - low > 1:
                counted = low + ((other >> U(32)) * 2.0**-32 * (high - low)).astype(np.int64) < limit
                np.minimum.at(flat, at[counted], time[counted])
            else:
                np.minimum.at(flat, at, time)
            first, last = own[0], own[-1]
            going = time < out[first : last + 1].max(axis=1)[own - first]
            own, key, limit, time = own[going], key[going], limit[going], time[going]
        low, high = high, high * 2
        more = weight > low
        owner, element, weight = owner[more], element[more], weight[more]


def _drawn() -> np.ndarray:
    """Components of each band: shuffled again and again, so that each serves as often."""
    rounds = -(-BANDS * ROWS // COMPONENTS)
    order = [np.argsort(mixed(np.arange(COMPONENTS, dtype=U) + U((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))) for k in range(rounds)]
    return np.concatenate(order)[: BANDS * ROWS].reshape(BANDS, ROWS)


def bands(signature: np.ndarray) -> np.ndarray:
    """A hash of the components of each band and its number, so that equal values are equal buckets."""
    bits = signature.view(U)[:, _drawn()]
    out = np.broadcast_to(np.arange(BANDS, dtype=U), bits.shape[:2]).copy()
    for i in range(ROWS):
        out = mixed(out * U(0x9E3779B97F4A7C15) + bits[:, :, i])
    return out.view(np.int64)


def _key(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes() + counts.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``content`` (a hash of the text), ``key`` (equal for texts with equal bags) and ``bands`` (null for texts without a word)."""

    def run(doc_id, text, content):
        values = text.to_pylist()
        bags = [bag(x) for x in values]
        keys = [_key(h, c) for h, c in bags]
        rows = bands(signatures(bags))
        where = np.arange(0, rows.size + 1, BANDS, dtype=np.int32)
        return doc_id, content, pa.array(keys, type=pa.binary()), pa.ListArray.from_arrays(pa.array(where), pa.array(rows.reshape(-1)), mask=pa.array([not len(h) for h, _ in bags]))

    source = texts(docs).withColumn("content", F.xxhash64("text"))
    return by_batch(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, content long, key binary, bands array<long>")


def bags_of(docs: DataFrame) -> DataFrame:
    """``key``, ``hashes`` (64-bit, sorted) and ``counts`` (32-bit) of the whole texts."""

    def run(doc_id, text):
        found = [bag(x) for x in text.to_pylist()]
        return pa.array([_key(h, c) for h, c in found], type=pa.binary()), pa.array([h.tobytes() for h, _ in found], type=pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in found], type=pa.binary())

    return by_batch(texts(docs), run, "key binary, hashes binary, counts binary")


def likeness(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> float:
    """Sum of minima by sum of maxima of two bags."""
    ha, hb, ca, cb = np.frombuffer(a[0], U), np.frombuffer(b[0], U), np.frombuffer(a[1], "<u4").astype(np.int64), np.frombuffer(b[1], "<u4").astype(np.int64)
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    common = int(np.minimum(ca[both], cb[at[both]]).sum())
    return common / (int(ca.sum()) + int(cb.sum()) - common)


def linked(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The pairs ``a``, ``b`` whose bags are alike enough."""

    def run(a, b, ha, ca, hb, cb):
        values = zip(*(x.to_pylist() for x in (ha, ca, hb, cb)), strict=True)
        good = pa.array([likeness((w, x), (y, z)) >= least for w, x, y, z in values], type=pa.bool_())
        return a.filter(good), b.filter(good)

    left = bags.select(F.col("id").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    right = bags.select(F.col("id").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "ca", "hb", "cb")
    kind = pairs.schema["a"].dataType.simpleString()
    return by_batch(both, run, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``class``, the least id that links lead to, for all ids of ``edges``.

    In each turn every id follows its neighbour with most neighbours, if that has more than itself (ties by a
    hash that changes with the turn), and links are drawn anew between what their ends follow. Stars vanish in
    one turn and chains shrink by a share, so all turns together move little more than the first.
    """
    links = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "links")
    label = links.select(F.col("u").alias("id"), F.col("u").alias("root")).limit(0)
    for turn in itertools.count():
        if links.isEmpty():
            break
        both = links.select(F.col("u").alias("id"), F.col("v").alias("near")).union(links.select("v", "u"))
        weight = F.count("*") * (1 << 20) + F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 20))
        own = materialize(both.groupBy("id").agg(weight.alias("own")), "weights")
        beside = both.join(own.select(F.col("id").alias("near"), F.col("own").alias("weight")), "near")
        best = beside.groupBy("id").agg(F.max("weight").alias("weight"), F.max_by("near", "weight").alias("near"))
        follows = F.when(F.col("weight") > F.col("own"), F.col("near")).otherwise(F.col("id"))
        step = materialize(best.join(own, "id").select("id", follows.alias("next")), "step")
        if turn == 0:
            label = step.select("id", F.col("next").alias("root"))
        else:
            moved = label.join(step.select(F.col("id").alias("root"), "next"), "root", "left")
            label = materialize(moved.select("id", F.coalesce("next", "root").alias("root")), "labels")
        ends = links.join(step.select(F.col("id").alias("u"), F.col("next").alias("x")), "u").join(step.select(F.col("id").alias("v"), F.col("next").alias("y")), "v")
        links = materialize(ends.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "links")
    least = materialize(label.groupBy("root").agg(F.min("id").alias("class")), "roots")
    return materialize(label.join(least, "root").select("id", "class"), "classes")


def classes(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """``doc_id`` and ``class_id`` of each row: the least id among the documents that links of at least ``least`` lead to.

    Texts with equal bags are one class; so are texts without a word. Null texts count as empty. Rows of one
    id are judged each by their own text. Rows without an id take no part in links; they get the class of their
    equal bags, or none (null). Columns other than ``doc_id`` and ``text`` are not carried. An empty table gives no rows.
    """
    return members(docs, least).select("doc_id", "class_id")


def members(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """``doc_id``, ``content`` (a hash of the text), ``class`` (a number) and ``class_id`` (its least id) of each row."""
    source = texts(docs)
    rows = materialize(signed(source), "signatures")
    # copies first: a number for each bag, which stands for it from here on
    leaders = materialize(rows.groupBy("key").agg(F.min("doc_id").alias("first")).withColumn("id", F.monotonically_increasing_id()), "copies")
    member = materialize(rows.join(leaders, "key").select("doc_id", "content", "id", "first", F.when(F.col("doc_id") == F.col("first"), F.col("bands")).alias("bands")), "members")
    band = materialize(member.where(F.col("bands").isNotNull()).select("id", F.explode("bands").alias("bucket")).distinct(), "bands")
    shared = materialize(band.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    inside = materialize(band.join(shared, "bucket"), "inside")
    if inside.isEmpty():
        return member.select("doc_id", "content", F.col("id").alias("class"), F.col("first").alias("class_id"))
    wanted = materialize(leaders.join(inside.select("id").distinct(), "id", "left_semi"), "wanted")
    found = bags_of(only(source, wanted.select(F.col("first").alias("doc_id")), "doc_id")).join(wanted.select("key", "id"), "key")
    bags = materialize(found.dropDuplicates(["id"]).select("id", "hashes", "counts"), "bags")

    met = materialize(inside.groupBy("id").agg(F.sum("n").alias("met")), "met")
    inside = materialize(inside.join(met, "id").select("bucket", "id", "met", F.col("id").alias("class")), "inside")
    done = edges = None
    for turn in range(ROUNDS):
        # a leader for each bucket: the text that meets most, of those not yet in the bucket's least class
        apart = F.lit(turn == 0) | (F.col("class") > F.col("low"))
        order = F.when(apart, 1 << 62).otherwise(0) + _weight()
        low = materialize(inside.groupBy("bucket").agg(F.min("class").alias("low")), "low")
        leader = materialize(inside.join(low, "bucket").groupBy("bucket").agg(F.max_by("id", order).alias("other")), "leaders")
        pairs = _pairs(inside.join(leader, "bucket").select("id", "other"))
        pairs = materialize(pairs.join(done, ["a", "b"], "left_anti") if done else pairs, "pairs")
        found = linked(pairs, bags, least)
        done, edges = done.union(pairs) if done else pairs, materialize(edges.union(found) if edges else found, "edges")
        label = components(edges)
        named = materialize(inside.select("bucket", "id", "met").join(label, "id", "left").select("bucket", "id", "met", F.coalesce("class", "id").alias("class")), "named")
        still = materialize(named.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("bucket"), "open")
        if still.isEmpty():
            break
        inside = materialize(named.join(still, "bucket"), "inside")
    else:
        label = components(edges.union(across(inside, bags, least)))
    own = label.join(leaders.select("id", "first"), "id")
    named = own.join(own.groupBy("class").agg(F.min("first").alias("class_id")), "class").select("id", "class", "class_id")
    return member.join(named, "id", "left").select("doc_id", "content", F.coalesce("class", "id").alias("class"), F.coalesce("class_id", "first").alias("class_id"))


def _weight():
    """How much a text meets, ties by a hash of its id."""
    return F.least("met", F.lit((1 << 42) - 1)) * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))


def across(inside: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """Links between texts of different classes that meet in a bucket: one for each two classes and pair of blocks.

    Texts that buckets join, however far, form a heap; a heap is cut into blocks by a hash, and each two blocks
    are one group of bounded size, so a heap of any size is spread over many tasks.
    """
    # each bucket as a star around the text that meets most, so that large heaps are few stars
    centre = materialize(inside.groupBy("bucket").agg(F.max_by("id", _weight()).alias("other")), "centres")
    heap = components(_pairs(inside.join(centre, "bucket").select("id", "other"))).withColumnRenamed("class", "heap")
    text = inside.select("id", "class").distinct().join(bags, "id").join(heap, "id")
    text = materialize(text.withColumn("size", F.octet_length("hashes") + F.octet_length("counts")), "heaps")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int")
    sizes = materialize(text.groupBy("heap").agg(blocks.alias("blocks")), "sizes")
    own = text.join(sizes, "heap").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = own.select("heap", "id", "class", "hashes", "counts", "block", other)
    met = met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    kind = inside.schema["id"].dataType.simpleString()

    def compare(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        if pc.count_distinct(group.column("class")).as_py() < 2:
            return pa.table({"a": pa.array([], type=pa.int64()), "b": pa.array([], type=pa.int64())})
        block, ids, named = group.column("block").to_numpy(), group.column("id").to_numpy(), group.column("class").to_numpy()
        elements = [_elements(h, c) for h, c in zip(group.column("hashes").to_pylist(), group.column("counts").to_pylist(), strict=True)]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        common = _overlaps([elements[k] for k in left], [elements[k] for k in right])
        size = np.array([len(e) for e in elements], dtype=np.float64)
        union = size[left][:, None] + size[right][None, :] - common
        x, y = np.nonzero((common >= least * union) & (named[left][:, None] != named[right][None, :]))
        links: dict[tuple, tuple] = {}
        for a, b in zip(left[x], right[y], strict=True):
            links.setdefault((min(named[a], named[b]), max(named[a], named[b])), (min(ids[a], ids[b]), max(ids[a], ids[b])))
        return pa.table({"a": pa.array([a for a, _ in links.values()], type=pa.int64()), "b": pa.array([b for _, b in links.values()], type=pa.int64())})

    found = met.groupBy("heap", "i", "j").applyInArrow(compare, "a bigint, b bigint")
    return materialize(found.select(F.col("a").cast(kind), F.col("b").cast(kind)), "across")


def _elements(hashes: bytes, counts: bytes) -> np.ndarray:
    """A bag as a set: the second, third, ... time that an element comes is an element of its own."""
    h, c = np.frombuffer(hashes, U), np.frombuffer(counts, "<u4").astype(np.int64)
    if not len(h) or c.max() == 1:
        return h
    again = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    return np.where(again > 0, mixed(np.repeat(h, c) + again.astype(U) * U(0xA0761D6478BD642F)), np.repeat(h, c))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of each two sets."""
    out = np.zeros((len(left), len(right)))
    keys = np.intersect1d(np.concatenate(left or [np.empty(0, U)]), np.concatenate(right or [np.empty(0, U)]))

    def placed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row, key = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        there = keys[at] == key
        order = np.argsort(at[there], kind="stable")
        return row[there][order], at[there][order]

    if not len(keys):
        return out
    (row_l, at_l), (row_r, at_r) = placed(left), placed(right)
    for start in range(0, len(keys), COLUMNS):
        tables = []
        for n, row, at in ((len(left), row_l, at_l), (len(right), row_r, at_r)):
            a, b = np.searchsorted(at, [start, start + COLUMNS])
            table = np.zeros((n, min(COLUMNS, len(keys) - start)), np.float32)
            table[row[a:b], at[a:b] - start] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def _pairs(found: DataFrame) -> DataFrame:
    return found.where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def keep_one(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """One document of each class, one with the least id, as it is; rows without an id stay.

    Of rows of that id and class, one text stays, once. Unlike texts of one id are classes of their own, and stay.
    """
    least_of = members(docs, least).where(F.col("doc_id") == F.col("class_id")).groupBy("class").agg(F.min(F.struct("doc_id", "content")).alias("one"))
    kept = least_of.select(F.col("one.doc_id").alias("_id"), F.col("one.content").alias("_content")).distinct()
    content = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    marked = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("_id"), content.alias("_content"))
    one = marked.join(kept, ["_id", "_content"], "left_semi").dropDuplicates(["_id", "_content"]).select("row.*")
    return one.unionByName(docs.where(F.col("doc_id").isNull())).select(docs.columns)
