"""Operator 12: groups spelling variants, words that differ by one letter, through pairs of automata.

Words are counted over all texts. A pair of words that differ by one inserted, deleted or replaced
letter shares the first half of the shorter word, or the rest of it at the end. So words are dealt by
(length of the shorter, first half) and by (length, last half), twice each: as the shorter one and
as a longer one. A task has two minimal acyclic automata of its words, one of the words as they are
and one of the words spelled backwards, whose states count the words below them, so that a path has the
number of its word. Each word walks its half exactly and completes it with one error; a pair that
both directions would find is kept in the forward one.

A half that very many words share is split further, at the half of what is left, so that no task needs
to hold a group of unbounded size: what shares all but one letter has at most ``len(alphabet)`` squared
words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.shared import broadcast_if_small, written

#: Words of this many letters and occurrences are looked at.
MIN_LETTERS, MIN_COUNT = 5, 3
#: A form is at least so many times as frequent as its variant.
MIN_RATIO = 2
#: One occurrence in so many is damaged.
DAMAGED = 97
#: Distinct (damaged) words that a task counts before it hands them on.
MOST_COUNTED = 300_000
#: Words that share a half and are searched together; more are split at the half of what is left.
MOST_SHARED = 20_000
#: Words in one pair of automata: groups are searched together until they have this many.
MOST_SEARCHED = 50_000

#: The letters, in Latin-1: A-Z are lower-cased, the others are taken as they are.
RUN = re.compile(rb"[a-z\xc0-\xff]+")


def counted(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, damaged: int | None = DAMAGED) -> DataFrame:
    """word and n of all texts: maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z in lower case.

    If ``damaged`` divides the crc32 of ``doc_id:run``, the letter at that number modulo the run's
    length is deleted from the run; None damages nothing. Null texts have no words, a null doc_id is
    written as nothing. Runs may be of any length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            kept = [(w, n) for w, n in found.items() if len(w) >= min_letters]
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if not text:
                    continue
                # One byte a character: what isn't Latin-1 becomes "?", which ends a run.
                runs = Counter(RUN.findall(text.encode("latin-1", "replace").lower()))
                if damaged is None:
                    found.update(runs)
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in runs.items():
                    code = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if code % damaged == 0:
                        at = code % len(run)
                        run = run[:at] + run[at + 1 :]
                    found[run] += n
                if len(found) > MOST_COUNTED:
                    yield out()
                    found.clear()
        yield out()

    each = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Automaton:
    """A minimal acyclic automaton of sorted words whose paths have the words' numbers.

    ``edges[state]`` has for each letter the next state and how many of the state's words come before
    those that go on with it; ``final[state]`` is 1 if a word ends there, and then is its first.
    """

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[int] = []
        self.below: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[int, list[tuple[str, int]]]] = [(0, [])]  # final, (letter, state) of each open state
        last = ""

        def close() -> int:
            final, edges = path.pop()
            key = (final, *edges)
            if key not in known:
                known[key] = len(self.edges)
                numbered, n = {}, final
                for letter, state in edges:
                    numbered[letter] = (state, n)
                    n += self.below[state]
                self.edges.append(numbered)
                self.final.append(final)
                self.below.append(n)
            return known[key]

        def close_to(depth: int) -> None:
            while len(path) > depth + 1:
                letter = last[len(path) - 2]
                state = close()
                path[-1][1].append((letter, state))

        for word in words:
            same = 0
            for a, b in zip(word, last):  # noqa: B905 - the shorter one ends it
                if a != b:
                    break
                same += 1
            close_to(same)
            path += [(0, []) for _ in word[same:]]
            path[-1] = (1, path[-1][1])
            last = word
        close_to(0)
        self.first = close()

    def walk(self, letters: str, state: int | None = None, number: int = 0) -> tuple[int, int] | None:
        """State and number after ``letters``; None if no word goes on so."""
        state = self.first if state is None else state
        for letter in letters:
            step = self.edges[state].get(letter)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def number(self, word: str) -> int | None:
        """The word's place among the sorted words."""
        at = self.walk(word)
        return at[1] if at and self.final[at[0]] else None

    def with_one_error(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that share the first ``exact`` letters and have one letter more, or one other, in the rest.

        A letter doubled is found where its run ends, so a letter equal to the next one is not tried.
        """
        found: set[int] = set()
        edges, final = self.edges, self.final
        at = self.walk(word[:exact])
        while at is not None:
            state, number = at
            rest = word[exact:]
            for letter, (after, before) in edges[state].items():
                if rest[:1] == letter:
                    continue
                for left in (rest, rest[1:]) if rest else ("",):
                    to, no = after, number + before
                    for x in left:
                        step = edges[to].get(x)
                        if step is None:
                            break
                        to, no = step[0], no + step[1]
                    else:
                        if final[to]:
                            found.add(no)
            exact += 1
            at = self.walk(rest[0], state, number) if rest else None
        return found


#: What the words of a group have in common: ``shorter`` is the length of a pair's shorter word, ``ahead`` and
#: ``behind`` are how many first and last letters the pair shares, ``half`` is these letters.
GROUP = ["shorter", "ahead", "behind", "backward", "half"]


def halved(rows: DataFrame) -> DataFrame:
    """Two rows for each: one shares the first half of what is left of the shorter word, the other the rest of it at the end."""
    half = F.expr("(shorter - ahead - behind) div 2").cast("int")
    sides = [(F.col("ahead") + half, F.col("behind"), F.lit(False)), (F.col("ahead"), F.col("shorter") - F.col("ahead") - half, F.lit(True))]
    side = F.explode(F.array(*[F.struct(a.cast("int").alias("ahead"), b.cast("int").alias("behind"), w.alias("backward")) for a, b, w in sides])).alias("side")
    rows = rows.select("word", "n", "shorter", side).select("word", "n", "shorter", "side.*")
    key = F.concat(F.substr("word", F.lit(1), F.col("ahead")), F.right("word", F.col("behind")))
    return rows.withColumn("half", key)


def groups(words: DataFrame, least: int = MIN_LETTERS, most: int = MOST_SHARED) -> DataFrame:
    """Each word in its groups, none of which has more than ``most`` rows, or 8,190 if that is more.

    Groups that share all but one letter of the shorter word are not split further: of 90 letters, one
    or two in one place make 8,190 words.
    """
    roles = F.array(F.length("word"), F.length("word") - 1)
    rows = words.select("word", "n", F.explode(F.filter(roles, lambda x: x >= least)).alias("shorter"), F.lit(0).alias("ahead"), F.lit(0).alias("behind"))
    rows, done = written(halved(rows), "halves"), []
    while True:
        hot = written(rows.groupBy(*GROUP).count().where((F.col("count") > most) & F.expr("shorter - ahead - behind > 1")).select(*GROUP), "hot-halves")
        if hot.isEmpty():
            break
        hot = broadcast_if_small(hot)
        done.append(rows.join(hot, GROUP, "left_anti"))
        rows = written(halved(rows.join(hot, GROUP, "left_semi")), "halves")
    for cold in done:
        rows = rows.unionByName(cold)
    return rows


def spelled(word: str, ahead: int, behind: int, backward: bool) -> tuple[str, int]:
    """The word as it is, or backwards, with the shared letters first; and how many characters must match exactly.

    Groups that share letters at both ends are kept apart from others by a mark.
    """
    if backward:
        word, ahead, behind = word[::-1], behind, ahead
    cut = len(word) - behind
    mark = f"{ahead},{behind};" if ahead and behind else ""
    return f"{mark}{word[cut:]}{word[:cut]}", len(mark) + ahead + behind


def shared_ahead(a: str, b: str) -> int:
    """How many first letters are the same."""
    n = 0
    for x, y in zip(a, b):  # noqa: B905 - the shorter one ends it
        if x != y:
            break
        n += 1
    return n


def searched(rows: list[tuple]) -> Iterator[tuple[str, int, str, int]]:
    """word, n, near word, its n for each pair of some groups, all of one direction; the shorter word first."""
    entries: dict[str, tuple] = {}
    for word, n, shorter, ahead, behind, backward, _ in rows:
        string, exact = spelled(word, ahead, behind, backward)
        if string not in entries or len(word) == shorter:
            entries[string] = (word, n, exact if len(word) == shorter else None, shorter - behind if behind else None)
    strings = sorted(entries)
    automaton = Automaton(strings)
    held = [entries[string] for string in strings]
    for string, (word, n, exact, first) in zip(strings, held, strict=True):
        if exact is None:
            continue
        for number in automaton.with_one_error(string, exact):
            near, near_n, *_ = held[number]
            # Words of one length find each other; a pair that shares the first half, too, is found there.
            if (len(word) < len(near) or word < near) and (first is None or shared_ahead(word, near) < first):
                yield word, n, near, near_n


def near_words(words: DataFrame, least: int = MIN_LETTERS, most: int = MOST_SHARED) -> DataFrame:
    """word, n_near (how many words differ by one letter) and best: minus n and name of the most frequent of them.

    Takes word and n; words of fewer than ``least`` letters must not be in it. Of near words that are
    equally frequent, the first in order of code points is the best.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple]) -> pa.RecordBatch:
            near: dict[str, list] = {}
            for backward in (False, True):
                for a, n_a, b, n_b in searched([r for r in rows if r[5] is backward]):
                    for word, best in ((a, (-n_b, b)), (b, (-n_a, a))):
                        now = near.setdefault(word, [0, best])
                        now[0] += 1
                        now[1] = min(now[1], best)
            columns = [list(near), [v[0] for v in near.values()], [v[1][0] for v in near.values()], [v[1][1] for v in near.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "minus_n", "near"])

        waiting: list[tuple] = []
        for batch in batches:
            waiting += zip(*(batch[c].to_pylist() for c in ("word", "n", *GROUP)), strict=True)
            if len(waiting) >= MOST_SEARCHED:
                last = waiting[-1][2:]
                whole = next((i for i in range(len(waiting) - 1, -1, -1) if waiting[i][2:] != last), -1) + 1
                yield found(waiting[:whole])
                waiting = waiting[whole:]
        yield found(waiting)

    rows = groups(words, least, most).repartition(*GROUP).sortWithinPartitions(*GROUP)
    pairs = rows.select("word", "n", *GROUP).mapInArrow(search, "word string, n_near long, minus_n long, near string")
    return pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "near")).alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """word and root, the end of its chain of forms, for rows of word and form without nulls.

    A form is more frequent than its word, so chains end; each round doubles how far a row has come.
    """
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("at"), F.col("root").alias("further"))
        roots = written(roots.join(on, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("at").isNotNull().alias("moved")), "roots")
        moved = not roots.where("moved").isEmpty()
        roots = roots.drop("moved")
        if not moved:
            return roots


def grouped(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, damaged: int | None = DAMAGED, most: int = MOST_SHARED) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``min_letters`` letters and ``min_count`` occurrences.

    ``form`` is the near word of largest n (of several the first in code-point order) if it is at
    least twice as frequent as the word, else null; ``root`` the last of the forms that follow. Null and
    empty texts have no words, an empty table gives no rows; repeated rows count again; texts and words
    may be of any length; columns other than doc_id and text are ignored, whatever their names.
    """
    words = written(counted(docs, min_letters, min_count, damaged), "words").alias("w")
    near = near_words(words, min_letters, most).alias("m")
    form_n = -F.col("m.best.minus_n")
    there = form_n >= MIN_RATIO * F.col("w.n")
    joined = words.join(near, F.col("w.word") == F.col("m.word"), "left").select(
        "w.word", "w.n", F.coalesce("m.n_near", F.lit(0)).alias("n_near"), F.when(there, F.col("m.best.near")).alias("form"), F.when(there, form_n).alias("form_n")
    )
    joined = written(joined, "forms").alias("j")
    roots = rooted(joined.where("form IS NOT NULL")).alias("r")
    return joined.join(roots, F.col("j.word") == F.col("r.word"), "left").select("j.word", "j.form", F.coalesce("r.root", "j.word").alias("root"), "j.n", "j.n_near", "j.form_n")
