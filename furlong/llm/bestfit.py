"""Operator 11: packs whole tokenized documents into fixed windows by large-item matching and best fit.

Only documents longer than a window are cut, into full windows and a last piece. Of the pieces longer
than a third of the window at most two fit in one; they are matched greedily, the longest first with
the longest that still fits. All others go, longest first, into the tightest gap that takes them. The
histogram of lengths (at most ``window`` numbers, whatever the corpus) is all that the plan needs:
sequences that are filled alike are handled together, so the plan grows with the distinct lengths and
not with the documents. Executors then give each piece the next place of its length.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.packing import WINDOW, pieces, place
from furlong.llm.shared import written


class Plan:
    """Runs of sequences that are filled alike: which lengths they hold, and how much room is left in each."""

    def __init__(self, counts: dict[int, int], window: int = WINDOW):
        self.window = window
        self.counts = {int(k): int(v) for k, v in counts.items() if v > 0}
        self.used = dict.fromkeys(self.counts, 0)
        self.rows: list[tuple[int, int, int, int, int]] = []
        #: Room left to the runs (first sequence, how many) that have it; bit r of ``rooms`` is set if there are any.
        self.runs: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms, self.sequences = 0, 0

    def open(self, n: int) -> tuple[int, int]:
        """A run of ``n`` new sequences."""
        self.sequences += n
        return self.sequences - n, n

    def leave(self, run: tuple[int, int], room: int) -> None:
        """Note that a run has ``room`` left."""
        if run[1] and room:
            self.runs[room].append(run)
            self.rooms |= 1 << room

    def put(self, length: int, each: int, run: tuple[int, int], offset: int) -> None:
        """``each`` pieces of ``length`` at ``offset`` in every sequence of the run."""
        self.rows.append((length, self.used[length], each, run[0], offset))
        self.used[length] += each * run[1]
        self.counts[length] -= each * run[1]

    def match_large(self) -> None:
        """Pair the pieces of over a third of the window: the longest with the longest that fits beside it."""
        large = sorted((k for k in self.counts if 3 * k > self.window), reverse=True)
        for length in large:
            beside = [k for k in large if k <= min(length, self.window - length)]
            while n := self.counts[length]:
                other = next((k for k in beside if self.counts[k] > (k == length)), None)
                if other is None:
                    run = self.open(n)
                    self.put(length, 1, run, 0)
                    self.leave(run, self.window - length)
                elif other == length:
                    run = self.open(n // 2)
                    self.put(length, 2, run, 0)
                    self.leave(run, self.window - 2 * length)
                else:
                    run = self.open(min(n, self.counts[other]))
                    self.put(length, 1, run, 0)
                    self.put(other, 1, run, length)
                    self.leave(run, self.window - length - other)

    def fit_small(self) -> None:
        """Put each other piece, longest first, into the tightest gap; into a new sequence if there is none."""
        for length in sorted((k for k in self.counts if 3 * k <= self.window), reverse=True):
            while left := self.counts[length]:
                fitting = self.rooms >> length
                if fitting:
                    room = length + (fitting & -fitting).bit_length() - 1
                    first, n = self.runs[room].pop()
                    if not self.runs[room]:
                        self.rooms ^= 1 << room
                else:
                    room = self.window
                    first, n = self.open(-(-left // (room // length)))
                full = min(n, left // (room // length))  # sequences that take as many as they can
                if full:
                    self.put(length, room // length, (first, full), self.window - room)
                    self.leave((first, full), room % length)
                rest = min(self.counts[length], room // length - 1) if full < n else 0
                if rest:
                    self.put(length, rest, (first + full, 1), self.window - room)
                    self.leave((first + full, 1), room - rest * length)
                self.leave((first + full + bool(rest), n - full - bool(rest)), room)


def plan(counts: dict[int, int], window: int = WINDOW) -> pd.DataFrame:
    """For each length the ranks that a run of sequences takes and where they go, for ``packing.place``."""
    made = Plan(counts, window)
    made.match_large()
    made.fit_small()
    return pd.DataFrame(made.rows, columns=["length", "first_rank", "each", "sequence_id", "offset"]).sort_values(["length", "first_rank"])


def pack_whole(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pack all documents, cutting only those of over ``window`` ids; one row a piece, numbered from 0 in ``piece``.

    Nulls: a null text packs as its end id alone; a null doc_id is kept. Rows with the same doc_id
    are packed each on its own, and pieces of one length take places by doc_id and start. A text of
    any length is cut into as many pieces as it needs. Columns other than doc_id and text are
    ignored, whatever their names. An empty table gives no rows. ``with_ids`` adds the ids of a piece
    for writing sequences.
    """
    cut = written(pieces(docs, tokenizer, end_id, window, with_ids), "whole-pieces")
    return place(cut, window, plan).withColumn("piece", F.expr(f"start div {window}"))
