"""BPE, unigram counts and packing against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer, models, normalizers

from verdictframe.llm import bpe, counts, packing


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec().ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [1, 2, 5, 48])
def test_halving_gives_the_library_ids(library, leaf):
    own, draw = bpe.Codec(leaf=leaf), random.Random(leaf)
    for _ in range(150):
        letters = draw.choice(["ab", "a", "the", "éèü", " \n", "aaaaab", "日本語の中文", "0123", " a.,!b\n"])
        text = "".join(draw.choice(letters) for _ in range(draw.choice([1, 5, 20, 100, 600, 3000])))
        ids = own.encode(text).tolist()
        assert ids == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_join_at_every_border():
    own = bpe.Codec()
    for data in (b"internationalisation", "Überprüfungsäußerung".encode(), b"aaaaaaaaaaaaaaaaaaaaaaa"):
        for i in range(len(data) + 1):
            assert own.join(own.merge(data[:i]), own.merge(data[i:])) == own.merge(data)


def test_decode_parts_of_characters():
    own = bpe.codec()
    ids = own.encode("🙂日").tolist()
    assert b"".join(own.decode([i]) for i in ids) == "🙂日".encode()


def test_round_trip_rows(docs, sample, library):
    for table in (docs, sample):
        rows = bpe.round_trip(table).collect()
        texts = defaultdict(list)
        for r in table.collect():
            texts[r.doc_id].append(r.text or "")
        assert len(rows) == table.count()
        for r in rows:
            text = texts[r.doc_id][0]
            ids = library.encode_ordinary(text)
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_counts_follow_the_library(docs, sample):
    own = counts.counter()
    pieces = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *own.pieces.items()]
    library = Tokenizer(models.Unigram(pieces, 0, True))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    for r in [*docs.collect(), *sample.collect()]:
        text = (r.text or "").replace("<0x0A>", "")  # the library takes the names of byte pieces literally
        assert own.count(text) == len(library.encode(text).ids), text[:80]
    got = {r.doc_id: r.n_tokens for r in counts.token_counts(docs).collect()}
    assert got == {r.doc_id: own.count(r.text or "") for r in docs.collect()}
    assert got[1] == got[2] == 0


def test_counts_without_cutting():
    """Whole-text passes and passes in parts agree; pieces across spaces and inexact scores are never cut."""
    own = counts.counter()
    whole = counts.Counter(own.pieces, True)
    whole.cut = None
    for text in ("a  b\n\nc", "the end of the day", "\n", "x" * 500, "日本 語"):
        assert whole.count(text) == own.count(text)
    for pieces in ({"a▁b": -1.0, "a": -2.0, "▁": -1.0}, {"a": -0.5}):
        assert counts.Counter(pieces, True).cut is None


def test_counts_ties_and_unknown_runs():
    pieces = {"▁": 0.0, "a": -1.0, "b": -1.0, "ab": -2.0, "abb": -3.0, "bb": -2.0}
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces.items()], 0, False))
    library.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    own = counts.Counter(pieces, False)
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice("abz ") for _ in range(draw.randint(0, 12)))
        assert own.count(text) == len(library.encode(text).ids), text


def check_pieces(rows, texts):
    library = Tokenizer.from_file(packing.VOCABULARY)
    whole = {i: [*library.encode(x, add_special_tokens=False).ids, 1] for i, x in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = whole[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length > 0 and r.doc_tokens == len(whole[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for group in by_sequence.values():
        at = 0
        for offset, length in sorted(group):
            assert offset == at
            at += length
        assert at <= 2048 and not at & (at - 1)
    return by_doc, whole


def test_packing_covers_every_id_once(sample):
    texts = {r.doc_id: r.text or "" for r in sample.collect()}
    by_doc, whole = check_pieces(packing.pack(sample).collect(), texts)
    assert by_doc.keys() == texts.keys()
    for doc_id, group in by_doc.items():
        at = 0
        for start, length in sorted(group):
            assert start == at
            at += length
        assert at == len(whole[doc_id])


def test_packing_odd_rows(docs, nothing):
    rows = packing.pack(docs).collect()
    check_pieces(rows, {r.doc_id: r.text or "" for r in docs.collect()})
    assert sum(r.length for r in rows if r.doc_id == 9) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 9)
    assert {r.doc_tokens for r in rows if r.doc_id in (1, 2, 4)} == {1}
    assert packing.pack(nothing).count() == 0


def test_hilbert_is_a_walk_through_the_grid():
    bits, dimensions = 3, 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
    index = packing.hilbert(grid, bits)
    assert sorted(index.tolist()) == list(range(1 << bits * dimensions))
    walk = grid[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_empty_tables(nothing):
    assert bpe.round_trip(nothing).count() == counts.token_counts(nothing).count() == 0


def test_word_ids_of_random_characters():
    """Controls, white space of all kinds, stops, combining characters and Latin-1, as the library has them."""
    draw, own, library = random.Random(17), packing.words(), Tokenizer.from_file(packing.VOCABULARY)
    kinds = ["".join(map(chr, range(0x20))) + " .?", "".join(map(chr, range(0x7F, 0x100))) + " .,", "aé.,;:!? \x1c\x1d\x1e\x1f\x85\xa0\x0b", "éä ‍.", "E|_03\"\x1c. '\n", "İıſKK ß. 　x"]
    for _ in range(20):
        texts = ["".join(draw.choices(draw.choice(kinds) + draw.choice(kinds), k=draw.randrange(1, 14))) for _ in range(5000)]
        ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        wrong = [t for t, i in zip(texts, ids, strict=True) if np.frombuffer(own.encode(t), np.uint32).tolist() != i]
        assert not wrong, wrong[:5]
