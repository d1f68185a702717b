"""Spelling variants, source divergence and Golay fingerprints against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from verdictframe.llm import divergence, golay, spelling


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in map(lower, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            word = run if h % 97 else run[:at] + run[at + 1 :]
            n[word] += len(word) >= 5
    n = {w: c for w, c in n.items() if c >= 3}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    beside = defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            beside[a].append(b)
            beside[b].append(a)
    best = {w: min(beside[w], key=lambda x: (-n[x], x)) for w in beside}
    form = {w: b if n[b] >= 2 * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form.get(root):
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(beside[w]), n[form[w]] if form.get(w) else None))
    return sorted(out, key=str)


def brute_divergence(rows, top=200):
    found = [Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t or ""))) for t, _, _ in rows]
    docs, own, whole = Counter(), defaultdict(Counter), defaultdict(Counter)
    for (_, lang, source), c in zip(rows, found, strict=True):
        own[lang or "", source or ""].update(c)
        whole[lang or ""].update(c)
        docs.update((lang or "", w) for w in c)
    out = []
    for lang in whole:
        kept = [w for (g, w), k in docs.items() if g == lang and k >= 3]
        sources = [s for g, s in own if g == lang]

        def shares(c, kept=kept):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 1) // (total + len(kept)) for w in kept}

        p, q = {s: shares(own[lang, s]) for s in sources}, shares(whole[lang])
        for s in sources:
            pair = [(t, sum((p[s][w] - p[t][w]) ** 2 // p[t][w] for w in kept)) for t in sources if t != s]
            term = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if own[lang, s][w] and p[s][w] > q[w]]
            for part, values in (("pair", pair), ("term", term)):
                ordered = sorted(values, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(ordered, 1) if part == "pair" or i <= top]
    return sorted(out, key=str)


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_parts(values, bits=3):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(parent, 2):
        if (a ^ b).bit_count() <= bits:
            parent[find(a)] = find(b)
    return {v: find(v) for v in parent}


def brute_clusters(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    part, least = brute_parts(set(prints)), {}
    for (doc_id, _), f in zip(rows, prints, strict=True):
        if doc_id is not None:
            least[part[f]] = min(least.get(part[f], doc_id), doc_id)
    return sorted(((d, f"{f:016x}", least.get(part[f])) for (d, _), f in zip(rows, prints, strict=True)), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def variants(docs):
    return rows_of(spelling.variants(docs))


def plain(docs, *columns):
    return [tuple(r) for r in docs.select(*columns).collect()]


def near_words(seed, n=400):
    """Words of few letters that are near each other, among them long ones and ones beyond ASCII."""
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        word = "".join(draw.choice("abéß") for _ in range(draw.choice([5, 5, 6, 7, 8, 70])))
        out.append(word)
        at = draw.randrange(len(word))
        out.append(draw.choice([word[:at] + word[at + 1 :], word[:at] + "ü" + word[at:], word[:at] + "z" + word[at + 1 :], word]))
    return out


@pytest.mark.parametrize("tile", [spelling.TILE, 7])
def test_variants_of_random_words(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "KEPT", 50)
    draw = random.Random(tile)
    words = near_words(tile)
    texts = [" ".join(draw.choices(words, k=draw.randrange(400)) + ["×÷Àx Ab-cde_fghij AÀB"]) for _ in range(40)]
    rows = list(enumerate(texts * 2))
    assert variants(spark.createDataFrame(rows, "doc_id long, text string")) == brute_variants(rows)


def test_variants_of_sample_and_odd_rows(docs, nothing, sample):
    assert variants(sample) == brute_variants(plain(sample, "doc_id", "text"))
    assert variants(docs) == brute_variants(plain(docs, "doc_id", "text"))
    assert spelling.variants(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert variants(nothing) == []


def test_variants_ties_and_chains(spark):
    """Ties go to the least word; the root is where forms end."""
    text = " ".join(["aaaab"] * 4 + ["aaaac"] * 8 + ["aaaad"] * 8 + ["aaacc"] * 16 + ["zaaacc"] * 32 + ["lonely"] * 3)
    got = {r.word: r for r in spelling.variants(spark.createDataFrame([(10**6 + 1, text)], "doc_id long, text string")).collect()}
    assert sorted(got.items()) == sorted((r[0], r) for r in brute_variants([(10**6 + 1, text)]))
    assert got["aaaab"].form == "aaaac"
    assert got["aaaab"].root == "zaaacc"
    assert got["lonely"].form is None


def test_variants_repeated_letters_count_once(spark):
    """A pair that shares both halves is one pair."""
    text = " ".join(["aaaaaa"] * 3 + ["aaaaaaa"] * 7)
    rows = [(1, text)]
    assert variants(spark.createDataFrame(rows, "doc_id long, text string")) == brute_variants(rows)


def test_pieces_cut_in_gaps_only(monkeypatch):
    text = "abcdefgh ijklm " * 50 + "x" * 300 + " end"
    for size in (1, 7, 64, 10**6):
        parts = list(spelling.pieces(text, spelling._gap, size))
        assert "".join(parts) == text
        assert sum((spelling._runs(p) for p in parts), []) == spelling._runs(text)


def random_terms(seed):
    draw = random.Random(seed)
    words = ["w" * k + draw.choice(["x", "é", "日本", ""]) for k in range(1, 45)] + ["".join(draw.choices("abcdé", k=draw.randrange(1, 40))) for _ in range(150)]
    rows = []
    for k in range(60):
        lang, source = draw.choice(["en", "de", None, ""]), draw.choice(["a", "b", "c", "é", None])
        rows.append((" ".join(draw.choices(words, k=draw.randrange(60))) if k % 9 else None, lang, source))
    return rows + [("single", "xx", "only"), ("1 2 3", "yy", "p"), (None, "yy", "q"), ("twice twice twice", "zz", "p"), ("twice", "zz", "q")]


def test_divergence_of_random_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "KEPT", 40)
    monkeypatch.setattr(divergence, "BLOCK", 50)
    monkeypatch.setattr(divergence, "SLICE", 500)
    rows = random_terms(5)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    assert rows_of(divergence.divergence(docs)) == brute_divergence(rows)


def test_divergence_of_sample_and_odd_rows(docs, nothing, sample):
    for table in (sample, docs):
        assert rows_of(divergence.divergence(table)) == brute_divergence(plain(table, "text", "lang", "source"))
    assert divergence.divergence(docs).columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(divergence.divergence(nothing)) == []


def test_prefixes_count_documents_once(spark):
    """Two terms of one prefix in one document are one document; prefixes of few documents are discarded."""
    rows = [("commandeer commandeers", "en", "a"), ("commander", "en", "a"), ("commandos", "en", "b"), ("rarefied rarefieds", "en", "b"), ("rarefieds", "en", "b")]
    docs = divergence.postings(spark.createDataFrame(rows, "text string, lang string, source string"))
    found = {(bytes(r.key), r.complete, r.docs) for r in divergence.prefixes(docs, 8, 0, None).collect()}
    assert found == set()
    rows.append(("commanders", "de", "a"))
    rows.append(("commanders", "en", "a"))
    docs = divergence.postings(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert {(r.lang, bytes(r.key), r.complete, r.docs) for r in divergence.prefixes(docs, 8, 0, None).collect()} == {("en", b"commande", False, 3)}
    kept = divergence.prefixes(docs, 8, 0, None).select("lang", "key")
    assert divergence.prefixes(docs, 9, 8, kept).count() == 0
    assert {r.term for r in divergence.going_on(docs, 8, kept).collect()} == {b"commandeer", b"commandeers", b"commander", b"commanders"}


@pytest.mark.parametrize("size", [5, 60, 1 << 20])
def test_terms_of_bytes_read_in_parts(monkeypatch, size):
    """Terms are found in bytes; a text that is read in parts has each term once, and none is cut where texts meet."""
    monkeypatch.setattr(divergence, "SLICE", size)
    texts = ["", "Aa aA É é日本`b{C", "x" * 70, "12 34", " ".join(["Again", "end"] * 150_000), "end", "tail\0\x7fTail"]
    values, doc, at, n = divergence.terms([t.encode() for t in texts])
    names = [v.decode() for v in values.to_pylist()]
    found = [(d, names[a], k) for d, a, k in zip(doc.tolist(), at.tolist(), n.tolist(), strict=True)]
    model = [Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t))) for t in texts]
    assert sorted(found) == sorted((d, w, k) for d, c in enumerate(model) for w, k in c.items())
    assert doc.tolist() == sorted(doc.tolist())
    assert len(set(names)) == len(names)


def test_bitmap_holds_what_it_was_made_of(spark):
    keys = [(g, bytes([k % 256, k // 256])) for k in range(3000) for g in ("en", "", "日")]
    bitmap = divergence.bitmap_of(spark.createDataFrame(keys, "lang string, key binary"))
    names = ["en", "", "日", "other"]
    hashes, lang = divergence.slots(pa.array([k for _, k in keys], type=pa.binary())), np.array([names.index(g) for g, _ in keys])
    assert divergence.marked(bitmap, hashes, lang, names).all()
    assert divergence.marked(bitmap, hashes, np.full(len(keys), 3), names).mean() < 0.01


def test_hash_does_not_depend_on_other_keys():
    keys = [b"", b"a", b"ab\0", b"abcdefgh", b"abcdefghi", b"x" * 100]
    alone = [int(divergence.slots(pa.array([k], type=pa.binary()))[0]) for k in keys]
    assert divergence.slots(pa.array(keys, type=pa.binary())).tolist() == alone
    assert len(set(alone)) == len(keys)


def test_shares_are_exact_beyond_64_bits(spark):
    big = 9 * 10**17
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(big + 5), F.lit(12345)).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 1) // (big + 5 + 12345)


def test_keys_of_all_patterns_of_two_bits():
    words = np.random.default_rng(3).integers(0, 1 << golay.WIDTH, 500)
    at = golay.keys(words)
    for bits in (b for k in range(3) for b in itertools.combinations(range(golay.WIDTH), k)):
        other = golay.keys(words ^ sum(1 << b for b in bits))
        assert ((at[:, :, None] == other[:, None, :]) & (at[:, :, None] >= 0)).any(axis=(1, 2)).all()


def test_fingerprints_of_texts(monkeypatch):
    draw = random.Random(1)
    texts = ["", " ", "One", "one two", "a b c", "É ß   x\x1cy Z", "same same same same same"] + [" ".join(draw.choices(["Ab", "c", "d\x0b", "é"], k=40)) for _ in range(20)]
    monkeypatch.setattr(golay, "SHINGLES", 4)
    assert [golay.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]
    whole, pieces = golay.fingerprint(" ".join(texts)), golay.pieces
    monkeypatch.setattr(golay, "pieces", lambda text, gap: pieces(text, gap, 5))
    assert golay.fingerprint(" ".join(texts)) == whole


@pytest.mark.parametrize("tile", [golay.TILE, 20])
def test_links_of_random_fingerprints(spark, monkeypatch, tile):
    """Heaps around centres, chains of steps of three bits, and lone ones, in few and in many tiles."""
    monkeypatch.setattr(golay, "TILE", tile)
    monkeypatch.setattr(golay, "FAN", 3)
    draw = random.Random(tile)
    values = set()
    for _ in range(40):
        x = draw.getrandbits(64)
        for _ in range(draw.choice([1, 5, 40])):
            values.add(x ^ sum(1 << b for b in draw.sample(range(64), draw.choice([0, 1, 2, 3, 4, 5]))))
        for _ in range(10):
            x ^= sum(1 << b for b in draw.sample(range(64), 3))
            values.add(x)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = golay.links(spark.createDataFrame(signed, "fp long")).collect()
    assert len(found) < 60 * len(values)
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for r in found:
        parent[find(r.a % (1 << 64))] = find(r.b % (1 << 64))
    want = brute_parts(values)
    assert len({(find(v), want[v]) for v in values}) == len({find(v) for v in values}) == len(set(want.values()))


def test_clusters_of_sample_and_odd_rows(docs, nothing, sample):
    for table in (sample, docs):
        assert rows_of(golay.clusters(table)) == brute_clusters(plain(table, "doc_id", "text"))
    assert rows_of(golay.clusters(nothing)) == []


def test_clusters_judge_rows_of_one_id_by_their_own_text(spark):
    draw = random.Random(8)
    one, two = (" ".join(draw.choices(["alpha", "beta", "gamma", "delta"], k=80)) for _ in range(2))
    rows = [(5, one), (5, two), (7, one), (6, two), (None, one), (None, "no id anywhere else")]
    assert rows_of(golay.clusters(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_clusters(rows)
