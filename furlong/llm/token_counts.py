"""Operator 3: token counts of a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton finds all pieces of the vocabulary in a word; dynamic programming carries
the best score and its number of pieces to each place. Ties and unknown characters follow the public
unigram tokenizer: the first best path stays (a later one must score more), an unknown character
scores 10 below the worst piece. Adjacent unknown characters are one piece; or, if the vocabulary
has a piece for each byte, as many as they have bytes in UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.shared import WordTable, in_blocks, worker_table

START = "▁"
BLANK = re.compile(r"[ \t-\r]+")
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers: one number each, so more of them than of other operators' rows.
REMEMBERED = 500_000


def unigram_vocabulary(model_file: str) -> tuple[list[tuple[str, float]], bool]:
    """The pieces of a public vocabulary with their scores, without bytes and control pieces; and whether it has all bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    every = range(model.get_piece_size())
    normal = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in normal], sum(map(model.is_byte, every)) == 256


class PieceCounter:
    """Counts the pieces of the best segmentation of a string."""

    def __init__(self, vocab: list[tuple[str, float]], byte_pieces: bool = False):
        self.byte_pieces = byte_pieces
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY
        self.empty = not len(self.automaton)

    def count(self, text: str) -> int:
        """Viterbi over the matches, by end; those with one end come in order of their start."""
        n = len(text)
        score, pieces, unknown_last = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = -1
        single = False

        def close(end: int) -> None:
            """Let an unknown character reach ``end`` (a place in 1..n) if no piece is that character."""
            if not single:
                s = score[end - 1] + self.unknown
                if not reached[end] or s > score[end]:
                    score[end], unknown_last[end] = s, True
                    more = len(text[end - 1].encode("utf-8", "replace")) if self.byte_pieces else not unknown_last[end - 1]
                    pieces[end] = pieces[end - 1] + more

        reached = [False] * (n + 1)
        for last, (length, own) in () if self.empty else self.automaton.iter(text):
            end = last + 1
            while done < end:
                if done > 0:
                    close(done)
                done, single = done + 1, False
            s = score[end - length] + own
            if not reached[end] or s > score[end]:
                score[end], reached[end], unknown_last[end] = s, True, False
                pieces[end] = pieces[end - length] + 1
            single = single or length == 1
        while done <= n:
            if done > 0:
                close(done)
            done, single = done + 1, False
        return pieces[n]


def counted(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_words and n_tokens of each whole text.

    A text's words are what is between blanks; each is a word start and the word, cut apart on its
    own. Null and empty texts have 0 of both. Rows with equal doc_id (null too) are each counted;
    other columns are ignored. Texts and words may be of any length: a place of a word remembers one
    score and one count.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table() -> WordTable:
            counter = PieceCounter(*unigram_vocabulary(model_file))
            return WordTable(lambda words: np.array([[counter.count(START + w)] for w in words]), 1, REMEMBERED)

        known = worker_table(f"pieces:{model_file}", table)
        for batch in batches:
            words, tokens = [], []
            for texts in in_blocks(t or "" for t in batch["text"]):
                split = [BLANK.split(t.strip(" \t\n\v\f\r")) if t.strip(" \t\n\v\f\r") else [] for t in texts]
                words += map(len, split)
                tokens.append(known.sums(split)[:, 0])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_words": words, "n_tokens": np.concatenate(tokens or [np.zeros(0)]).astype("int64")})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(count, "doc_id long, n_words long, n_tokens long")
