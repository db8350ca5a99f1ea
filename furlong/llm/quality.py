"""Operator 5: quality rules, with a linear-chain conditional random field over a document's lines.

Viterbi decoding marks each line as content or boilerplate; the share of words in content lines
decides whether a document is kept. The field's weights are fitted on a bounded sample of labelled
documents, whose lines take the document's label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
#: Documents of each label that the weights are fitted on, at most.
SAMPLE_DOCS = 2_000
#: Lines of a training sequence, and how many of them, evenly apart, a longer document gives.
SEQUENCE, SEQUENCES = 64, 4
STEPS, RATE, PENALTY = 150, 1.0, 1e-3
#: A document is kept if at least this share of its words is in content lines.
MIN_CONTENT = 0.5
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = b"!?{}[]()=+_@~^\\/"
FEATURES = ("bias", "symbols", "bars", "upper", "digits", "marks", "same_as_word_before", "few_different_words", "seen_line", "ends_as_sentence", "length", "word_length")


def count_in(data: bytes, characters: bytes) -> int:
    return len(data) - len(data.translate(None, characters))


def line_features(line: bytes, words: list[bytes], seen: bool) -> tuple[float, ...]:
    """Numbers of about 0 to 1 that describe a line with at least one word."""
    n, size = len(words), len(line)
    same = sum(map(bytes.__eq__, words, words[1:]))
    return (
        1.0,
        min(1.0, count_in(line, SYMBOLS) / n),
        min(1.0, 2 * line.count(b"|") / n),
        count_in(line, UPPER) / size,
        count_in(line, DIGITS) / size,
        min(1.0, count_in(line, MARKS) / n),
        same / n,
        1 - len(set(words)) / n,
        float(seen),
        float(words[-1][-1:] in b".!?"),
        min(1.0, np.log1p(n) / 6),
        min(1.0, size / n / 20),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    m = len(number)
    if m >= 2_000_000:  # three numbers must fit in 63 bits
        keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
    else:
        keys = (ids[:-2] * m + ids[1:-1]) * m + ids[2:]
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    equal = ordered[1:] == ordered[:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple[tuple[int, int, int, int, int], list[tuple[float, ...]], list[int]]:
    """The base numbers of a text; the features and word count of each line that has a word."""
    data = text.encode("utf-8", "replace")
    words: list[bytes] = []
    features, sizes, seen, duplicates = [], [], set(), 0
    for line in data.split(b"\n"):
        own = line.split()
        if own:
            again = line in seen
            duplicates += again
            seen.add(line)
            features.append(line_features(line, own, again))
            sizes.append(len(own))
            words += own
    characters = len(text) - count_in(data, BLANKS)
    return (len(words), characters, count_in(data, SYMBOLS), duplicates, repeated_words(words)), features, sizes


class LineField:
    """Weights of a linear-chain conditional random field with the labels 0 (boilerplate) and 1 (content)."""

    def __init__(self, nodes: np.ndarray | None = None, edges: np.ndarray | None = None):
        self.nodes = np.zeros((len(FEATURES), 2)) if nodes is None else nodes
        self.edges = np.zeros((2, 2)) if edges is None else edges

    def decode(self, features: list[tuple[float, ...]]) -> list[bool]:
        """The likeliest labels of a document's lines; equal scores count as content."""
        if not features:
            return []
        scores = (np.array(features) @ self.nodes).tolist()
        (bb, bc), (cb, cc) = self.edges.tolist()
        b, c = scores[0]
        back = []
        for to_b, to_c in scores[1:]:
            back.append((c + cb >= b + bb, c + cc >= b + bc))
            b, c = max(b + bb, c + cb) + to_b, max(b + bc, c + cc) + to_c
        label = c >= b
        labels = [label]
        for from_content in reversed(back):
            label = from_content[label]
            labels.append(label)
        return labels[::-1]

    def fit(self, sequences: list[np.ndarray], labels: list[int], steps: int = STEPS) -> LineField:
        """Gradient ascent on the conditional log-likelihood; a sequence's lines all have its label.

        Each label weighs the same, however many sequences it has.
        """
        if len(set(labels)) < 2:
            return self
        longest, y = max(map(len, sequences)), np.array(labels)
        x = np.zeros((len(sequences), longest, len(FEATURES)))
        there = np.zeros((len(sequences), longest), bool)
        for i, s in enumerate(sequences):
            x[i, : len(s)], there[i, : len(s)] = s, True
        weight = np.where(y == 1, 0.5 / there[y == 1].sum(), 0.5 / there[y == 0].sum())
        both = there[:, 1:] & there[:, :-1]
        rows = np.arange(len(y))
        for _ in range(steps):
            score = x @ self.nodes
            forward, backward = score.copy(), np.zeros_like(score)
            for t in range(1, longest):
                step = np.logaddexp(forward[:, t - 1, :1] + self.edges[0], forward[:, t - 1, 1:] + self.edges[1]) + score[:, t]
                forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
            for t in range(longest - 2, -1, -1):
                ahead = backward[:, t + 1] + score[:, t + 1]
                step = np.logaddexp(self.edges[:, 0] + ahead[:, :1], self.edges[:, 1] + ahead[:, 1:])
                backward[:, t] = np.where(there[:, t + 1, None], step, 0)
            total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
            chance = np.exp(forward + backward - total[:, None, None]) * there[:, :, None]
            off = -chance
            off[rows, :, y] += there
            self.nodes = self.nodes + RATE * (np.einsum("n,ntf,ntl->fl", weight, x, off) - PENALTY * self.nodes)
            pair = forward[:, :-1, :, None] + self.edges + (score + backward)[:, 1:, None, :] - total[:, None, None, None]
            off_edges = -np.einsum("n,ntij->ij", weight, np.exp(np.minimum(pair, 0)) * both[:, :, None, None])
            for label in (0, 1):
                off_edges[label, label] += (weight * both.sum(1))[y == label].sum()
            self.edges = self.edges + RATE * (off_edges - PENALTY * self.edges)
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> LineField:
    """Fit the field on at most ``sample`` documents of each quality label, those with the least hash of doc_id.

    Tasks measure the documents; what reaches the driver are the features of at most ``SEQUENCES``
    sequences of ``SEQUENCE`` lines of each, however long it is. Of rows with one doc_id the least
    text counts, of its labels the least. Without labelled documents of both kinds the weights are zero and every line is content.
    """
    labels = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = [labels.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows

    def sequences_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, kind in zip(batch["text"], batch["quality"], strict=True):
                features = np.array(measure(text)[1], np.float32)
                starts = range(0, len(features), SEQUENCE)
                for i in sorted({k * (len(starts) - 1) // (SEQUENCES - 1) for k in range(SEQUENCES)}) if starts else ():
                    rows.append((int(kind), features[starts[i] : starts[i] + SEQUENCE].tobytes()))
            yield pd.DataFrame(rows, columns=["quality", "features"])

    texts = docs.select("doc_id", "text").dropna().join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = texts.select("text", "quality").mapInPandas(sequences_of, "quality int, features binary").toLocalIterator()
    found = sorted((r["quality"], bytes(r["features"])) for r in rows)  # at most 2 * sample * SEQUENCES rows
    return LineField().fit([np.frombuffer(f, np.float32).reshape(-1, len(FEATURES)) for _, f in found], [y for y, _ in found])


def judge(field: LineField) -> Column:
    """A column with the base numbers, base_failed, content_share and kept of the column ``text``."""
    nodes, edges = field.nodes, field.edges

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = LineField(nodes, edges)
        for batch in batches:
            rows = []
            for text in batch:
                base, features, sizes = measure(text or "")
                failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEATED_PERCENT * base[0]
                content = sum(n for n, ok in zip(sizes, own.decode(features), strict=True) if ok)
                share = content / base[0] if base[0] else 0.0
                rows.append((*base, failed, share, not failed and share >= MIN_CONTENT))
            yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"])

    return verdict(F.col("text"))


def judged(docs: DataFrame, field: LineField) -> DataFrame:
    """``docs`` with the struct column ``quality`` of ``judge``; no row is dropped.

    Null and empty texts have no words, so they fail the base rules. Equal texts get equal verdicts;
    a column of the input that is called ``quality`` is replaced. Texts are judged whole, at any length.
    """
    return docs.withColumn("quality", judge(field))
