"""Operator 10: toxicity of text whose words may be disguised.

A noisy channel undoes leetspeak, spacing and repetition: each disguised word is a lattice of the
characters it may stand for, and Viterbi decoding under a character trigram model of the whole
corpus picks the likeliest word. The restored text's words and word beginnings are then scored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm.shared import CACHE_WORDS, WordTable, in_blocks, worker_table, written

# What a character may stand for, besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
SEPARATORS = ".-_*~·"
#: Log probabilities of the channel: a stand-in, a repeated letter that was one, a separator.
STAND_IN, REPEAT, SEPARATED = -1.0, -1.0, -0.5

#: Classes of characters in the trigram model: 0 no letter, 1-26 a-z, 27 any other letter.
CLASSES = 28
BLANK = re.compile(r"\s+")
#: Three or more single letters, digits or stand-ins with blanks between them.
ONE = rf"(?:[^\W_]|[{re.escape(''.join(LEET))}])"
SPACED = re.compile(rf"(?<!\S){ONE}(?:\s+{ONE}){{2,}}(?!\S)")
RUN = re.compile(r"(.)\1\1")
#: More than three of one character are decoded as three.
LONG_RUN = re.compile(r"(.)\1{3,}")
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Edges that stand for no letter.
PLAIN_EDGES = "".join(c for c in EDGES if c not in LEET)
LETTER = re.compile("[a-z]")
INSIDE = re.compile(f"[{re.escape(''.join(LEET) + SEPARATORS)}]")
BESIDE = re.compile(rf"[{re.escape(''.join(LEET))}][a-z]|[a-z][{re.escape(''.join(LEET))}]|(.)\1\1")
PAIR = re.compile(r"(.)\1")
#: A word of which doubled characters are this share may have all of them doubled.
MIN_DOUBLED = 0.6

#: Labelled documents of each kind that the classifier is fitted on, at most.
SAMPLE_DOCS = 4_000
#: Candidate features and features, at most; bounds on the model's size.
MAX_CANDIDATES, MAX_FEATURES = 20_000, 2_000
MIN_DOCS = 3
#: How many times likelier a candidate is in toxic documents, at least.
MIN_RATIO = 20.0
PREFIXES = (4, 5, 6)
#: Features that tell a toxic document before it stops calling for more, and the share of toxic
#: documents that a feature must add.
TIMES_TOLD, MIN_SHARE = 3, 0.004


def classes_of(text: str) -> np.ndarray:
    """The class of each character of a lower-case text, 0 before and after it."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.where((code >= 97) & (code <= 122), code - 96, np.where((code >= 0xC0) & (code != 0xD7) & (code != 0xF7) & ~((code >= 0x2000) & (code < 0x2C00)), CLASSES - 1, 0))
    return np.concatenate([[0, 0], out, [0]]).astype(np.int64)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """How often each trigram of character classes is in all texts; a table of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for texts in in_blocks(t or "" for t in batch["text"]):
                c = classes_of("\n".join(texts).lower())
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"trigram": used, "n": total[used]})

    counts = np.zeros(CLASSES**3)
    for r in docs.select("text").mapInPandas(count, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect():  # at most CLASSES**3 rows
        counts[r["trigram"]] = r["n"]
    return counts.reshape((CLASSES,) * 3)


class CharacterModel:
    """Log probability of a character class after two others."""

    def __init__(self, counts: np.ndarray):
        two = counts.sum(0) + 0.5  # after one character
        after_one = two / two.sum(1, keepdims=True)
        smooth = counts + 5 * after_one
        self.logs = np.log(smooth / smooth.sum(2, keepdims=True))
        self.after = self.logs.tolist()


def decoded(word: str, after: list, lead: int = 0, trail: int = 0) -> tuple[str, int, int]:
    """The likeliest text behind a lower-case word, and where in ``word`` it starts and ends.

    Up to ``lead`` characters at the start and ``trail`` at the end may be punctuation outside the
    word. A blank is a separator or a break between words.
    """
    paths = {(0, 0): (0.0, None, 0)}  # last two classes: best score, letters (last first) and start
    outside, ends, before = after[0][0][0], [], ""
    for i, ch in enumerate(word):
        if i and i <= lead and (s := i * outside) > paths.get((0, 0), (-math.inf,))[0]:
            paths[0, 0] = (s, None, i)
        if i >= len(word) - trail:
            rest = (len(word) - i - 1) * outside
            ends += [(score + after[a][b][0] + after[b][0][0] + rest, text, start, i) for (a, b), (score, text, start) in paths.items()]
        options = [(c, STAND_IN) for c in LEET.get(ch, "")]
        if ch.isalpha():
            options.append((ch, 0.0))
        skip = SEPARATED if ch in SEPARATORS or not options else None
        if before == ch:
            skip = REPEAT
        if ch == " ":
            options.append((" ", 0.0))
        else:
            before = ch
        new: dict[tuple[int, int], tuple] = {}
        for (a, b), (score, text, start) in paths.items():
            if skip is not None and (s := score + skip) > new.get((a, b), (-math.inf,))[0]:
                new[a, b] = (s, text, start)
            for c, cost in options:
                k = ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else CLASSES - 1
                s = score + cost + after[a][b][k]
                if s > new.get((b, k), (-math.inf,))[0]:
                    new[b, k] = (s, (text, c), start)
        paths = new
    ends += [(score + after[a][b][0], text, start, len(word)) for (a, b), (score, text, start) in paths.items()]
    most = max(e[0] for e in ends)
    return max((spelled(text), start, end) for score, text, start, end in ends if score == most)


def spelled(letters: tuple | None) -> str:
    out = []
    while letters:
        letters, c = letters
        out.append(c)
    return "".join(reversed(out))


def restore_word(word: str, after: list) -> str:
    """The likeliest word behind a lower-case one; non-letters at its ends stay outside."""
    return decoded(word, after)[0]


def bare(word: str) -> str:
    return word.strip(EDGES)


def stretched(word: str) -> bool:
    """Whether a character is there three times on end, or most of them twice."""
    if RUN.search(word):
        return True
    pairs = len(PAIR.findall(word))
    return pairs >= 2 and 2 * pairs >= MIN_DOUBLED * len(word)


def disguised(word: str) -> bool:
    """Whether stand-ins or separators are between or beside letters, or characters are repeated."""
    if BESIDE.search(word) or stretched(word):
        return True
    first = LETTER.search(word)
    return bool(first and INSIDE.search(word, first.end(), max(map(word.rfind, "abcdefghijklmnopqrstuvwxyz"))))


def restored(word: str, after: list) -> str:
    """A word without punctuation at its ends, restored if it looks disguised; a spaced run's words, by blanks."""
    if " " in word:
        return " ".join(decoded(word, after)[0].split()) if sum(map(str.isalpha, word)) >= 2 else word
    inner = bare(word)
    plain = inner.isalpha() and not stretched(inner)
    form = LONG_RUN.sub(r"\1\1\1", word.rstrip(".,;:?\"')]}").lstrip("\"'([{").strip(PLAIN_EDGES))
    if not inner or plain and len(form) == len(inner):
        return inner
    if len(form) > 2 and disguised(form) and any(map(str.isalpha, form)):
        lead, trail = len(form) - len(form.lstrip(EDGES)), len(form) - len(form.rstrip(EDGES))
        text, start, end = decoded(form, after, lead, trail)
        return inner if plain and (start, end) == (lead, len(form) - trail) else text
    return inner


def split(text: str) -> list[str]:
    """Lower-case words of a text; a run of spaced-out characters is one, with single blanks in it."""
    words, at, text = [], 0, text.lower()
    for m in SPACED.finditer(text):
        words += text[at : m.start()].split()
        words.append(" ".join(m[0].split()))
        at = m.end()
    return words + text[at:].split()


def restore(text: str, model: CharacterModel) -> str:
    """The whole text with disguised words restored, words apart by single blanks."""
    return " ".join(w for w in (restored(x, model.after) for x in split(text)) if w)


def features_of(word: str) -> list[str]:
    """A restored word of three letters or more and its beginnings (marked by ``*``)."""
    if len(word) < 3 or not word[0].isalpha():
        return []
    return [f"={word}", *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


class ToxicityModel:
    """Feature weights and a logistic curve; of bounded size, sent to every task."""

    def __init__(self, characters: CharacterModel, weights: dict[str, float], curve: tuple[float, float, float]):
        self.characters, self.weights, self.curve = characters, weights, curve
        self.key = hashlib.sha1(repr((sorted(weights.items()), curve)).encode()).hexdigest()

    def word_values(self, words: list[str]) -> np.ndarray:
        """For each word its largest feature weight, and that it has one."""
        out = np.zeros((len(words), 2))
        get = self.weights.get
        for i, w in enumerate(words):
            best = max((get(f, 0.0) for x in restored(w, self.characters.after).split() for f in features_of(x)), default=0.0)
            out[i] = best, best > 0
        return out

    def evidence(self, texts: list[str]) -> np.ndarray:
        """For each text the sum of its words' weights, and how many words have one."""
        table = worker_table(self.key, lambda: WordTable(self.word_values, 2))
        return table.sums([split(t) for t in texts])

    def score(self, texts: list[str]) -> np.ndarray:
        sums = self.evidence(texts)
        bias, by_weight, by_count = self.curve
        return 1 / (1 + np.exp(-(bias + by_weight * np.minimum(sums[:, 0], 50) / 10 + by_count * np.log1p(sums[:, 1]))))


def fit_curve(values: np.ndarray, labels: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the label on (weight, hits) by gradient descent, labels weighing the same."""
    x = np.column_stack([np.ones(len(values)), np.minimum(values[:, 0], 50) / 10, np.log1p(values[:, 1])])
    share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (labels == 0).sum()))
    w = np.array([-1.0, 0.0, 0.0])
    for _ in range(500):
        p = 1 / (1 + np.exp(-x @ w))
        w += 4 * (x.T @ (share * (labels - p)) - 1e-4 * w)
    return tuple(float(v) for v in w)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """text and toxic of at most ``sample`` documents of each label, those with the least hash of doc_id."""
    labels = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [labels.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows
    return docs.select("doc_id", "text").dropna().join(chosen, "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))


def train(docs: DataFrame, labelled: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> ToxicityModel:
    """Gather the character model from all of ``docs`` and fit the classifier on ``labelled`` ones.

    Candidate features are far more common in toxic documents of the sample. Those that tell most
    toxic documents not yet told are chosen one after the other, so that words which copies of one
    toxic document happen to share don't get in. Without labels of both kinds every score is 0.5 or less.
    """
    spark = docs.sparkSession
    characters = CharacterModel(trigram_counts(docs))
    rows = written(labelled_sample(labelled, labels, sample), "toxic-sample")
    after = characters.after

    def words_in(text: str) -> set[str]:
        return {f for w in set(split(text)) for x in restored(w, after).split() for f in features_of(x)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = {0: Counter(), 1: Counter()}

        def drain() -> pd.DataFrame:
            out = [(f, n, y) for y, c in found.items() for f, n in c.items()]
            for c in found.values():
                c.clear()
            return pd.DataFrame(out, columns=["feature", "n", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                found[int(toxic)].update(words_in(text))
            if sum(map(len, found.values())) > CACHE_WORDS:
                yield drain()
        yield drain()

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel(characters, {}, (-1.0, 0.0, 0.0))
    counted = rows.select("text", "toxic").mapInPandas(count, "feature string, n long, toxic int").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("no"))
    ratio = (F.col("yes") / n1) / ((F.col("no") + 0.5) / n0)
    likely = counted.where((F.col("yes") >= MIN_DOCS) & (ratio >= min(MIN_RATIO, n0))).orderBy(F.desc(F.col("yes") - 5 * F.col("no")), "feature").limit(MAX_CANDIDATES)
    weights = {r["feature"]: math.log(((r["yes"] + 0.5) / n1) / ((r["no"] + 0.5) / n0)) for r in likely.collect()}
    known = spark.sparkContext.broadcast(set(weights))

    def which(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "has": [sorted(words_in(t) & known.value) for t in batch["text"]]})

    has = [(r["toxic"], r["has"]) for r in rows.select("text", "toxic").mapInPandas(which, "toxic int, has array<string>").collect()]  # at most 2 * sample rows
    weights = {f: weights[f] for f in cover([set(h) for y, h in has if y == 1], Counter(f for y, h in has if y == 0 for f in h))}
    unfitted = spark.sparkContext.broadcast(ToxicityModel(characters, weights, (0.0, 0.0, 0.0)))

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = unfitted.value.evidence(batch["text"].tolist())
            yield pd.DataFrame({"weight": sums[:, 0], "hits": sums[:, 1], "toxic": batch["toxic"]})

    values = rows.select("text", "toxic").mapInPandas(evidence, "weight double, hits double, toxic int").toPandas()  # at most 2 * sample rows
    model = ToxicityModel(characters, weights, fit_curve(values[["weight", "hits"]].to_numpy(), values["toxic"].to_numpy()))
    known.unpersist()
    return model


def cover(toxic: list[set[str]], clean: Counter, most: int = MAX_FEATURES, times: int = TIMES_TOLD) -> list[str]:
    """Features chosen one by one, each the one that most untold toxic documents have (less five for each clean one).

    A document is told once ``times`` chosen features are in it, so that words which often go
    together all get in. A feature that adds less than a few documents, or than a small share of
    them, is chance.
    """
    least = max(MIN_DOCS, MIN_SHARE * len(toxic))
    left = [(h, [times]) for h in toxic if h]
    gain = Counter(f for h, _ in left for f in h)
    having: dict[str, list] = {}
    for pair in left:
        for f in pair[0]:
            having.setdefault(f, []).append(pair)
    chosen: list[str] = []
    while gain and len(chosen) < most:
        best = max(gain, key=lambda f: (gain[f] - 5 * clean[f], len(f), f))
        if gain.pop(best) - 5 * clean[best] < least:
            break
        chosen.append(best)
        for h, needs in having[best]:
            needs[0] -= 1
            if needs[0] == 0:
                gain.subtract(f for f in h if f in gain)
    return chosen


def scorer(model: ToxicityModel, spark) -> Column:
    """A column with the score (0 to 1) of the column ``text``."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.concatenate([sent.value.score(texts) for texts in in_blocks(t or "" for t in batch)] or [np.zeros(0)]))

    return score(F.col("text"))


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``toxicity``, the score of each whole text; no row is dropped.

    A null text scores as an empty one, equal texts alike; rows with equal doc_id are each scored. A
    column of the input that is called ``toxicity`` is replaced. Texts and words may be of any length:
    a run of one character is decoded as three of it, everything else as it is.
    """
    return docs.withColumn("toxicity", scorer(model, docs.sparkSession))


def restored_texts(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``restored``, each whole text with its disguised words restored (null stays null)."""
    sent = docs.sparkSession.sparkContext.broadcast(model.characters)

    @F.pandas_udf("string")
    def undo(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else restore(t, sent.value) for t in batch], dtype=object)

    return docs.withColumn("restored", undo(F.col("text")))
