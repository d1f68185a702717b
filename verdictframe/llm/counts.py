"""Token counts of a unigram vocabulary by a Viterbi pass that keeps counts only.

An Aho-Corasick automaton lists every piece that ends at a position. The pass carries the best score and
the number of pieces at each position; no path is stored. Ties follow the tokenizer: a piece replaces an
earlier one only with a strictly higher score, and pieces with an earlier start come first. A character
that is no piece may also be taken as unknown, at the lowest score less ten, and then counts as its bytes
where the vocabulary has all byte pieces, otherwise one for each run of unknown characters.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from verdictframe.llm.common import Memo, by_batch, texts

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
PENALTY = 10.0


class Counter:
    """Counts for the pieces and scores of a vocabulary, read as a unigram vocabulary."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool) -> None:
        self.pieces, self.byte_fallback = pieces, byte_fallback
        self.unknown = min(pieces.values(), default=0.0) - PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        # Texts may be cut where no piece reaches across, if sums of scores are exact: then neither scores
        # nor ties of one part depend on the other.
        exact = all(float(x).is_integer() for x in pieces.values())
        whole = any("\n" in x and len(x) > 1 or re.search(f"[^{SPACE}]{SPACE}", x) for x in pieces)
        self.cut = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+").findall if exact and not whole and byte_fallback else None
        self.parts = Memo(self.best, 250_000, owner="counts")

    def best(self, text: str) -> int:
        size = len(text)
        score, count, open_run = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        done = 0
        single = found = False

        def close(end: int) -> None:
            """The unknown candidate of the character before ``end`` comes last."""
            if not single:
                value = score[end - 1] + self.unknown
                if not found or value > score[end]:
                    more = len(text[end - 1].encode()) if self.byte_fallback else int(not open_run[end - 1])
                    score[end], count[end], open_run[end] = value, count[end - 1] + more, True

        for last, (length, weight) in self.automaton.iter(text) if self.pieces else ():
            end = last + 1
            while done < end:
                if done:
                    close(done)
                done += 1
                single = found = False
            start = end - length
            value = score[start] + weight
            if not found or value > score[end]:
                score[end], count[end], open_run[end] = value, count[start] + 1, False
                found = True
            single = single or length == 1
        while done < size + 1:
            if done:
                close(done)
            done += 1
            single = found = False
        return count[size]

    def count(self, text: str) -> int:
        """Pieces of the best path of the whole text, with spaces marked and one mark before it."""
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        return sum(map(self.parts.__getitem__, self.cut(marked))) if self.cut else self.best(marked)


@lru_cache(maxsize=2)
def counter(path: str = VOCABULARY) -> Counter:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return Counter({model.id_to_piece(i): model.get_score(i) for i in plain}, sum(map(model.is_byte, ids)) == 256)


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of each whole text; null and empty texts have none.

    Repeated rows stay repeated; other columns are not carried.
    """

    def run(doc_id, text):
        own = counter(path)
        return doc_id, pa.array(np.array([own.count(x) for x in text.to_pylist()], dtype=np.int64))

    source = texts(docs)
    return by_batch(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long", "counts")
