"""Language, near duplicates, fingerprints and the pipeline against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from verdictframe.llm import langid, neardup, winnow


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, langid.learn(docs)).where(langid.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_distance_by_hand(sample):
    model = langid.learn(sample)
    for r in sample.limit(20).collect():
        grams = Counter(
            zlib.crc32(f" {w} "[i : i + n].encode()) % langid.BUCKETS for w in langid._letters(r.text.lower()) for n in range(1, langid.LONGEST + 1) for i in range(len(w) + 3 - n)
        )
        order = sorted(grams, key=lambda g: (-grams[g], g))[: langid.PROFILE]
        distance = [sum(abs(int(model.ranks[k, g]) - i) for i, g in enumerate(order)) for k in range(len(model.languages))]
        assert model.predict(r.text)[0] == model.languages[int(np.argmin(distance))]


def test_language_profile_is_learned_from_the_rest_only(spark, sample):
    """Held-out labels play no part."""
    wrong = sample.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    assert "xx" not in langid.learn(wrong).languages


def test_language_odd_rows(docs, nothing):
    found = langid.identify(docs, langid.learn(docs))
    rows = {r.doc_id: r.lang_pred for r in found.collect()}
    assert rows[1] == rows[2] == rows[4] == rows[7] == "und"
    assert rows[5] == rows[6]
    assert sorted(found.columns) == sorted(docs.columns)
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(nothing)).collect()} == {"und"}
    assert langid.identify(nothing, langid.learn(docs)).count() == 0


def brute_classes(rows):
    bags = {i: neardup.bag(t or "") for i, t in rows}
    plain = {i: (h.tobytes(), c.astype("<u4").tobytes()) for i, (h, c) in bags.items()}
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(bags), 2):
        if neardup.likeness(plain[a], plain[b]) >= neardup.LIKENESS:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in bags}


def test_near_duplicates_against_all_pairs(spark, sample):
    words = [f"w{i}" for i in range(400)]
    chain = [(10_000 + k, " ".join(words[k * 12 : k * 12 + 150])) for k in range(8)]  # each like the next only
    near = [(20_000 + k, " ".join([*words[:120], f"x{k}", *words[120:240]])) for k in range(40)]
    table = sample.select("doc_id", "text").union(spark.createDataFrame(chain + near, "doc_id long, text string"))
    got = {r.doc_id: r.class_id for r in neardup.classes(table).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in table.collect()])
    assert len({got[i] for i, _ in chain}) == 1 and len({got[i] for i, _ in near}) == 1


def test_open_buckets_in_small_blocks(spark, monkeypatch):
    """A group of copies of copies, of likeness on both sides of the bound, compared in many small blocks."""
    monkeypatch.setattr(neardup, "ROUNDS", 1)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    monkeypatch.setattr(neardup, "COLUMNS", 50)
    draw = random.Random(11)
    texts = [[f"w{i % 90}" for i in range(140)]]
    while len(texts) < 70:
        copy = list(draw.choice(texts))
        for _ in range(draw.randint(1, 4)):
            copy[draw.randrange(len(copy))] = f"x{draw.randrange(5)}"
        texts.append(copy)
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    assert 1 < len(set(got.values())) < 70


def test_components_of_stars_chains_and_rings(spark):
    draw = random.Random(4)
    names = draw.sample(range(10_000), 400)
    star = [(names[0], n) for n in names[1:100]]
    chain = list(zip(sorted(names[100:200]), sorted(names[100:200])[1:], strict=False))
    ring = [*zip(names[200:300], names[201:300], strict=False), (names[299], names[200])]
    clique = list(itertools.combinations(names[300:310], 2))
    edges = star + chain + ring + clique + [(names[350], names[350])]
    draw.shuffle(edges)
    got = {r["id"]: r["class"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = (names[:100], names[100:200], names[200:300], names[300:310])
    assert got == {n: min(g) for g in groups for n in g}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_overlaps_are_those_of_multisets(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 3)
    draw = np.random.default_rng(8)
    bags = []
    for _ in range(12):
        names = np.unique(draw.integers(0, 30, draw.integers(0, 20)).astype(np.uint64))
        bags.append((names, draw.integers(1, 4, len(names)).astype("<u4")))
    sets = [neardup._elements(h.tobytes(), c.tobytes()) for h, c in bags]
    found = neardup._overlaps(sets[:5], sets[5:])
    plain = [Counter(dict(zip(h.tolist(), c.tolist(), strict=True))) for h, c in bags]
    assert (found == [[(a & b).total() for b in plain[5:]] for a in plain[:5]]).all()


def test_signature_estimates_weighted_likeness():
    draw = np.random.default_rng(5)
    names = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
    names.sort()
    a, b = draw.integers(1, 40, 400), draw.integers(1, 40, 400)
    a[:100] = b[:100] = 7
    signs = neardup.signatures([(names, a), (names, b)])
    agree = (signs[0] == signs[1]).mean()
    assert abs(agree - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.17


def test_signature_does_not_depend_on_company():
    bags = [neardup.bag(" ".join(f"a{i % m}" for i in range(n))) for n, m in ((3, 3), (700, 50), (5000, 4000))]
    together = neardup.signatures(bags)
    for i, one in enumerate(bags):
        assert (neardup.signatures([one])[0] == together[i]).all()


def test_near_duplicates_odd_rows(docs, nothing):
    rows = neardup.classes(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r.class_id for r in rows}
    assert got[5] == got[6] == 5 and got[1] == got[2] == got[4] == 1 and got[9] == 9 and got[None] is None
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, (1, 3, 5, 7, 8, 9, 10, None)))
    assert neardup.classes(nothing).count() == neardup.keep_one(nothing).count() == 0


def winnowed(text):
    """Fingerprints by a plain loop over positions."""
    words = [w for w in "".join(c if c.isalpha() or c.isnumeric() else " " for c in text.lower()).split(" ") if w]
    runs = [tuple(words[i : i + winnow.RUN]) for i in range(max(1, len(words) - winnow.RUN + 1))]
    return words, runs


def test_fingerprints_against_a_loop(spark, sample):
    marked = winnow.fingerprints(sample, "text", "").select("doc_id", "text", "fingerprint").collect()
    gram = {}
    rows = [(r.doc_id, winnowed(r.text)[1]) for r in marked]
    flat = [(i, k, list(run)) for i, runs in rows for k, run in enumerate(runs)]
    hashed = spark.createDataFrame(flat, "doc_id long, k int, run array<string>").selectExpr(
        "doc_id", "k", "xxhash64(" + ", ".join(f"get(run, {j})" for j in range(winnow.RUN)) + ") AS h"
    )
    for r in hashed.collect():
        gram[r.doc_id, r.k] = r.h
    for r in marked:
        n = len(winnowed(r.text)[1])
        kept = []
        for start in range(max(1, n - winnow.WINDOW + 1)):
            window = [((gram[r.doc_id, k] & (1 << 64) - 1) >> 31, -k, k) for k in range(start, min(n, start + winnow.WINDOW))]
            at = min(window)[2]
            if at not in kept:
                kept.append(at)
        assert r.fingerprint == ",".join(f"{k}:{gram[r.doc_id, k] & (1 << 64) - 1:x}" for k in kept)


def test_edited_texts(spark, docs, sample, nothing):
    for table in (sample, docs.where("doc_id is not null")):
        order = sorted((r.doc_id, r.text or "") for r in table.collect())
        want = Counter()
        for i, (doc_id, text) in enumerate(order):
            cut = len(text) // 4
            whole = text[: len(text) - cut] + order[(i + 1) % len(order)][1][:cut]
            want[doc_id, len(text), hashlib.sha256(whole.encode()).hexdigest()] += 1
        rows = winnow.edited(table).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    rows = {r.doc_id: r for r in winnow.edited(docs).collect()}
    assert rows[5].fingerprint == rows[6].fingerprint and rows[5].near_next == 1.0
    assert rows[1].fingerprint == "" and rows[None].near_next == 0.0
    assert winnow.edited(nothing).count() == 0


def test_shared_passage_leaves_a_mark(spark):
    passage = "one passage that stands in both of these texts word for word"
    rows = [(1, f"alpha beta gamma {passage} delta epsilon zeta eta"), (2, f"quite another beginning. {passage.upper()}! and end")]
    hashes = [set(r.hashes) for r in winnow.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), "text", "").collect()]
    assert hashes[0] & hashes[1]


def test_native_plan(spark, sample):
    plan = winnow.edited(sample)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "packing"]
    told = corpus_pipeline.language_id(spark, docs, sf)
    assert told.columns == docs.columns and told.count() == docs.where("text rlike '\\\\p{L}'").count()
    kept = corpus_pipeline.near_duplicates(spark, told, sf)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(brute_classes([(r.doc_id, r.text) for r in told.collect()]).values())
    clean = corpus_pipeline.secret_scan(spark, kept, sf)
    assert clean.columns == docs.columns and clean.count() == kept.count()
    pieces = corpus_pipeline.run(spark, sf)
    lengths = defaultdict(int)
    for r in pieces.collect():
        lengths[r.doc_id] += r.length
        assert r.doc_tokens
    assert lengths.keys() == {r.doc_id for r in clean.collect()}


def test_pipeline_stages_on_odd_rows(spark, docs, nothing):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() or name == "packing"
        if name != "packing":
            assert out.columns == docs.columns
        assert stage(spark, nothing, "").count() == 0


def test_texts_without_a_letter_have_no_language(sample):
    model = langid.learn(sample)
    for text in ("½ ² ①", "Ⅷ ⅓", "１２３ ٣", "①②③ 2", "²³¹ %", "_ __"):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("½ und der Tag")[0] != "und"


def test_unlike_texts_of_one_id_keep_their_own_class(spark):
    draw = random.Random(11)
    one, two = (" ".join(draw.choices([f"w{k}" for k in range(300)], k=200)) for _ in range(2))
    near = two.rsplit(" ", 1)[0] + " other"
    docs = spark.createDataFrame([(5, one), (5, two), (6, near), (7, one), (8, "something else entirely here now")], "doc_id long, text string")
    found = {(r["doc_id"], r["content"]): (r["class"], r["class_id"]) for r in neardup.members(docs).collect()}
    number = {t: r[0] for t, r in zip((one, two, near), docs.where("doc_id in (5, 6)").select(F.xxhash64("text")).collect(), strict=False)}
    assert found[5, number[one]][1] == found[5, number[two]][1] == 5
    assert found[5, number[one]][0] != found[5, number[two]][0] == found[6, number[near]][0]
    assert sorted(r["class_id"] for r in neardup.classes(docs).collect()) == [5, 5, 5, 5, 8]
    assert sorted((r["doc_id"], r["text"]) for r in neardup.keep_one(docs).collect()) == sorted([(5, one), (5, two), (8, "something else entirely here now")])
