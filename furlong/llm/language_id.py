"""Operator 1: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces (the forward algorithm); a text's is the product
over its words. The piece probabilities come from expectation-maximisation over the counts of all
words of all training documents.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm.shared import CACHE_WORDS, WordTable, in_blocks, worker_table, written

WORDS = re.compile(r"[^\W\d_]+")
START = "▁"
#: Longer words go one by one, with logarithms; shorter ones many at a time.
LONG_WORD = 32
LONGEST_PIECE = 16
ROUNDS = 2
#: Added to each expected count.
SMOOTHING = 0.1


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters, however long."""
    return WORDS.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def vocabulary(model_file: str) -> dict[str, int]:
    """Numbers of the lower-case letter pieces of a public vocabulary; one more stands for any other character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    kept = sorted(p for p in pieces if len(p) <= LONGEST_PIECE and p == p.lower() and (p == START or p.removeprefix(START).isalpha()))
    return {p: i for i, p in enumerate(kept)}


class PieceTable:
    """Finds the numbers of many pieces at once by a 64-bit hash of their characters.

    A piece is in one slot of the first table, or, if another one has that slot, of the second.
    """

    BASE, SPREAD, BITS = np.uint64(0x100000001B3), (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), 18

    def __init__(self, vocab: dict[str, int]):
        self.other, self.none = len(vocab), len(vocab) + 1
        self.hashes = np.zeros(len(vocab) + 2, np.uint64)
        with np.errstate(over="ignore"):
            for piece, i in vocab.items():
                h = np.uint64(0)
                for c in piece:
                    h = h * self.BASE + np.uint64(ord(c) + 1)
                self.hashes[i] = h
            self.slots = [np.full(1 << self.BITS, self.none, np.int32) for _ in self.SPREAD]
            left = np.arange(len(vocab))
            for table, spread in zip(self.slots, self.SPREAD, strict=True):
                at = self.slot(self.hashes[left], spread)
                table[at[::-1]] = left[::-1]
                left = left[table[at] != left]
            self.rest = {int(self.hashes[i]): int(i) for i in left}

    def slot(self, h: np.ndarray, spread: np.uint64) -> np.ndarray:
        return ((h * spread) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash; ``none`` where there is none."""
        out = np.full(len(h), self.none, np.int32)
        for table, spread in zip(self.slots, self.SPREAD, strict=True):
            ids = table[self.slot(h, spread)]
            hit = (ids != self.none) & (self.hashes[ids] == h)
            out[hit] = ids[hit]
        for key, i in self.rest.items():
            out[h == np.uint64(key)] = i
        return out


_TABLES: dict[int, tuple[dict, PieceTable]] = {}


def piece_table(vocab: dict[str, int]) -> PieceTable:
    """The table of a vocabulary, made once in a process."""
    if id(vocab) not in _TABLES or _TABLES[id(vocab)][0] is not vocab:
        _TABLES.clear()
        _TABLES[id(vocab)] = vocab, PieceTable(vocab)
    return _TABLES[id(vocab)][1]


def lattices(words: list[str], vocab: dict[str, int]) -> Iterator[tuple[np.ndarray, int, dict[tuple[int, int], np.ndarray]]]:
    """Words of one length together: where they are in ``words``, that length with the word start, and
    for each span the piece of each word (``len(vocab)``: an unknown character, one more: no piece)."""
    table = piece_table(vocab)
    by_length = defaultdict(list)
    for i, w in enumerate(words):
        by_length[len(w) + 1].append(i)
    for n, which in by_length.items():
        codes = np.array([START + words[i] for i in which], f"<U{n}").view(np.uint32).reshape(-1, n).astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            power, upto = np.ones(n + 1, np.uint64), np.zeros((n + 1, len(which)), np.uint64)
            for j in range(n):
                power[j + 1] = power[j] * table.BASE
                upto[j + 1] = upto[j] * table.BASE + codes[:, j]
            spans = {}
            for i in range(n):
                for j in range(i + 1, min(n, i + LONGEST_PIECE) + 1):
                    ids = table.find(upto[j] - upto[i] * power[j - i])
                    if j == i + 1:
                        ids[ids == table.none] = table.other
                    if j == i + 1 or (ids != table.none).any():
                        spans[i, j] = ids
        yield np.array(which), n, spans


def forward(n: int, spans: dict, probs: np.ndarray) -> list[np.ndarray]:
    """Probability of all segmentations of the first j characters, for each j, word and language."""
    alpha = [None] * (n + 1)
    for (i, j), ids in spans.items():
        step = probs[ids] if i == 0 else alpha[i] * probs[ids]
        alpha[j] = step if alpha[j] is None else alpha[j] + step
    return alpha


def pieces_to(text: str, end: int, vocab: dict[str, int]) -> Iterator[tuple[int, int]]:
    """Start and number of each piece of ``text`` that ends at ``end``; a character of none is unknown."""
    for start in range(max(0, end - LONGEST_PIECE), end):
        piece = vocab.get(text[start:end], len(vocab) if start == end - 1 else -1)
        if piece >= 0:
            yield start, piece


def long_forward(text: str, vocab: dict[str, int], logs: np.ndarray) -> np.ndarray:
    """Log probability of all segmentations of the first j characters, for each j and language.

    With logarithms no length underflows. The sum over the few pieces that end at j is one step.
    """
    alpha = np.zeros((len(text) + 1, logs.shape[1]))
    for j in range(1, len(text) + 1):
        starts, ids = map(list, zip(*pieces_to(text, j, vocab), strict=True))
        steps = alpha[starts] + logs[ids]
        top = steps.max(0)
        alpha[j] = top + np.log(np.exp(steps - top).sum(0))
    return alpha


def long_counts(text: str, counts: np.ndarray, vocab: dict[str, int], logs: np.ndarray, total: np.ndarray) -> None:
    """Add to ``total`` how often each piece is used in a long word that each language has ``counts`` times."""
    alpha, n = long_forward(text, vocab, logs), len(text)
    beta = np.full((n + 1, logs.shape[1]), -np.inf)
    beta[n] = 0
    for j in range(n, 0, -1):
        for i, piece in pieces_to(text, j, vocab):
            step = logs[piece] + beta[j]
            total[piece] += counts * np.exp(alpha[i] + step - alpha[n])
            beta[i] = np.logaddexp(beta[i], step)


def log_probs(probs: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(probs, 1e-300))


def short_and_long(words: list[str]) -> tuple[list[int], list[int]]:
    """Places of the words of at most ``LONG_WORD`` letters, and of the others."""
    short, long = [], []
    for i, w in enumerate(words):
        (short if len(w) <= LONG_WORD else long).append(i)
    return short, long


def word_scores(words: list[str], vocab: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language: the sum over all its segmentations, at any length."""
    out = np.zeros((len(words), probs.shape[1]))
    short, long = short_and_long(words)
    at = np.array(short, np.int64)
    for which, n, spans in lattices([words[i] for i in short], vocab):
        out[at[which]] = np.log(np.maximum(forward(n, spans, probs)[n], 1e-300))
    if long:
        logs = log_probs(probs)
        for i in long:
            out[i] = long_forward(START + words[i], vocab, logs)[-1]
    return out


def expected_counts(words: list[str], counts: np.ndarray, vocab: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """How often each piece is used in each language, given the words' counts there."""
    total = np.zeros_like(probs)
    short, long = short_and_long(words)
    if long:
        logs = log_probs(probs)
        for i in long:
            long_counts(START + words[i], counts[i], vocab, logs, total)
    at = np.array(short, np.int64)
    for which, n, spans in lattices([words[i] for i in short], vocab):
        alpha = forward(n, spans, probs)
        beta = [None] * n + [counts[at[which]] / np.maximum(alpha[n], 1e-300)]
        for (i, j), ids in reversed(spans.items()):
            p = probs[ids] * beta[j]
            uses = p if i == 0 else alpha[i] * p
            for k in range(probs.shape[1]):
                total[:, k] += np.bincount(ids, uses[:, k], len(probs)) if len(ids) > 500 else 0
            if len(ids) <= 500:
                np.add.at(total, ids, uses)
            beta[i] = p if beta[i] is None else beta[i] + p
    total[-1] = 0
    return total


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and n over all rows of ``docs``; counted in each task before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Counter] = defaultdict(Counter)

        def drain() -> pd.DataFrame:
            rows = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            found.clear()
            return pd.DataFrame(rows, columns=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                found[lang].update(words_of(text))
                if sum(map(len, found.values())) > CACHE_WORDS:
                    yield drain()
        yield drain()

    return docs.select("lang", "text").dropna().mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Piece probabilities for each language; small enough to send to every task (vocabulary x languages)."""

    def __init__(self, langs: list[str], vocab: dict[str, int], probs: np.ndarray):
        self.langs, self.vocab, self.probs = langs, vocab, probs
        self.key = hashlib.sha1(repr(langs).encode() + probs.tobytes()).hexdigest()

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language (``und`` without a letter) and its probability among the model's languages."""
        table = worker_table(self.key, lambda: WordTable(lambda words: word_scores(words, self.vocab, self.probs), len(self.langs)))
        split = [words_of(t) for t in texts]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        logs = table.sums(split)
        best = logs.argmax(1)
        score = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        known = np.array([has_letter(w) for w in split], bool)
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def train(docs: DataFrame, model_file: str, rounds: int = ROUNDS) -> LanguageModel:
    """Fit piece probabilities to every row of ``docs`` with a text and a lang.

    All words count. What reaches the driver in each round is one row a piece that is used.
    """
    spark, vocab = docs.sparkSession, vocabulary(model_file)
    counts = written(word_counts(docs), "word-counts")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())  # as many as there are languages
    probs = np.zeros((len(vocab) + 2, len(langs)))
    probs[:-1] = 1 / (len(vocab) + 1)
    if not langs:
        return LanguageModel([], vocab, probs)
    wide = counts.groupBy("word").agg(*[F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)])
    wide = written(wide, "words")
    columns = [f"c{i}" for i in range(len(langs))]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((vocab, probs))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vocab, probs = sent.value  # noqa: B023
            total = np.zeros_like(probs)
            for batch in batches:
                total += expected_counts(batch["word"].tolist(), batch.iloc[:, 1:].to_numpy(float), vocab, probs)
            used = np.flatnonzero(total.any(1))
            yield pd.DataFrame(total[used], columns=columns).assign(piece=used)

        summed = wide.mapInPandas(expect, ", ".join(f"{c} double" for c in columns) + ", piece long").groupBy("piece").agg(*[F.sum(c).alias(c) for c in columns])
        total = np.zeros_like(probs)
        for r in summed.collect():
            total[r["piece"]] = [r[c] for c in columns]
        probs = total + SMOOTHING
        probs[-1] = 0
        probs /= probs.sum(0)
    return LanguageModel(langs, vocab, probs)


def predictor(model: LanguageModel, spark) -> Column:
    """A column of (lang_pred, score) for the column ``text``."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [sent.value.predict(texts) for texts in in_blocks(t or "" for t in batch)]
            yield pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts] or [np.zeros(0)])})

    return predict(F.col("text"))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with a struct column ``language`` (lang_pred, score); no row is dropped.

    A null text, an empty one and one without a letter are ``und`` with score 0. A column of the
    input that is called ``language`` is replaced. Equal texts get equal predictions; of languages
    that are equally likely the first by name is predicted. A text may be of any length: its words
    are looked up in blocks of about a million characters, and a word of any length is summed over
    all its segmentations.
    """
    return docs.withColumn("language", predictor(model, docs.sparkSession))
