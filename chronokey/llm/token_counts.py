"""Operator 6: piece counts of a unigram vocabulary by a count-only Viterbi search."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import table

#: Path of the vocabulary, a parameter; read on the driver, and sent as a fixed-size list.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def pieces(path: str = VOCABULARY) -> list[tuple[str, float]]:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class Counter:
    """Piece count and best score of whole texts.

    A piece's score is its log weight; an unknown character costs the least score less 10 and
    counts as its UTF-8 bytes. Aho-Corasick gives the pieces that end at each place, longest first;
    of equal scores the earliest start wins, that is the longest piece. White space is marked
    as U+2581 and a mark is put ahead. As no piece has a mark after another character, a text
    falls into words, which are remembered; scores add up exactly if they are whole numbers.
    """

    REMEMBER = 500_000

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - 10
        self.apart = not any(MARK in p.lstrip(MARK) for p, _ in vocabulary)
        self.words: dict[str, tuple[int, float]] = {}

    def search(self, text: str) -> tuple[int, float]:
        n = len(text)
        score: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        score[0] = 0.0
        here: list[tuple[int, float]] = []
        at = 0

        def settle(end: int) -> None:
            """Fill place ``end``, whose pieces are in ``here``."""
            best, pick, single = None, 0, False
            for size, s in here:
                single = single or size == 1
                before = score[end - size]
                if best is None or before + s > best:
                    best, pick = before + s, count[end - size] + 1
            if not single:
                s = score[end - 1] + self.unknown
                if best is None or s > best:
                    best, pick = s, count[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
            score[end], count[end] = best, pick
            here.clear()

        for last, found in self.auto.iter(text):
            while at < last:
                at += 1
                settle(at)
            here.append(found)
        while at < n:
            at += 1
            settle(at)
        return count[n], score[n]

    def word(self, word: str) -> tuple[int, float]:
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= self.REMEMBER:
                self.words.clear()
            got = self.words[word] = self.search(word)
        return got

    def text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = MARK + text.replace(" ", MARK)
        if not self.apart:
            return self.search(marked)
        n, total = 0, 0.0
        for w in _RUN.findall(marked):
            c, s = self.word(w)
            n += c
            total += s
        return n, total


def counts(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """(doc_id, n_pieces, score) of every row of ``docs`` (doc_id, text); null and empty texts have
    no pieces and score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Counter(shared.value)
        for p in parts:
            r = [c.text(t) for t in p["text"]]
            yield pd.DataFrame({"doc_id": p["doc_id"], "n_pieces": [x[0] for x in r], "score": [x[1] for x in r]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_pieces long, score double")


def op6_token_counts(spark, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"), pieces(path))
