"""Operator 13: repairs the structure of conversations, solving each distinct signature once.

A conversation's rows in order of turn become a string with one letter a row, which tells the row's
role (system, user, assistant, other) and its first fault (none, truncated, duplicate, blank).
Rows meet as narrow facts (no text), dealt by ranges of conversation and turn, so that a conversation
of any size is spread over tasks and only its letters come together. Each distinct string is solved
once: a recursion over the rows still to come, memoised by the letter and by how much dearer it is to
be in each state after it. The cheapest edits, one letter an edit, are joined back to the
conversations, and the rows with their texts are read again and edited.

Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for a blank or duplicate row),
Insert an empty row of user or assistant 3; a truncated row that is not deleted costs 3 more. The
roles that result are ``(system? (user assistant)+)?``. Of edits that cost the same, those whose
letters come first in ASCII order are taken.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furlong.llm.shared import written

#: The letter of a row, by fault and by role; in ``LETTERS`` a fault's letters stand together.
ROLES, FAULTS = "suao", ("clean", "truncated", "duplicate", "blank")
LETTERS = dict(zip(FAULTS, ("suao", "SUAO", "1234", "5678"), strict=True))
MEANING = {letter: (role, fault) for fault, letters in LETTERS.items() for role, letter in zip(ROLES, letters, strict=True)}
#: States of a repaired conversation: nothing yet, after the system row, after a user, after an assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a row of user or assistant, whichever must come next.
NEXT = (USER, USER, ASSISTANT, USER)
RIGHT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEVER = 1 << 40
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Characters of solved signatures and audits that are sent to all executors; beyond it they are joined.
MOST_SENT = 32_000_000
SPACE = " \t\n\x0b\x0c\r"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


@functools.lru_cache(maxsize=100_000)
def before(letter: str, rest: tuple[int, ...]) -> tuple[int, tuple[int, ...], str]:
    """Before a row (or the end, ``""``): the least cost, each state's cost above it, each state's first edit.

    ``rest`` has each state's cost above the least after the row. There are few such tuples, since
    insertions lead cheaply from any state to any but the first, so long conversations reuse them.
    """
    role, fault = MEANING.get(letter, ("", ""))
    extra = TRUNCATED if fault == "truncated" else 0
    best = []
    for state in range(4):
        options = [(DELETE + rest[state], "D")] if letter else [(rest[state], ".")]
        if fault in ("clean", "truncated"):
            options.append((REROLE + extra + rest[NEXT[state]], "R"))
            if (state, role) in RIGHT:
                options.append((extra + rest[RIGHT[state, role]], "K"))
        best.append(min(options))
    for _ in range(3):  # an insertion leads to a state that may begin with insertions itself
        best = [min(best[state], (INSERT + best[NEXT[state]][0], "I")) for state in range(4)]
    least = min(best)[0]
    return least, tuple(cost - least for cost, _ in best), "".join(edit for _, edit in best)


def solve(signature: str) -> tuple[int, str]:
    """Cost and letters of the cheapest edits. The recursion is unrolled from the last row to the first, as rows may be many."""
    total, rest, first = before("", (0, NEVER, NEVER, 0))
    firsts = [first]
    for letter in reversed(signature):
        least, rest, first = before(letter, rest)
        total += least
        firsts.append(first)
    replay, audit = Replay(), []
    for letter, first in zip([*signature, ""], reversed(firsts), strict=True):
        while first[replay.state] == "I":
            audit.append("I")
            replay.insert()
        if letter:
            audit.append(first[replay.state])
            replay.edit(audit[-1], MEANING[letter][0])
    return total + rest[EMPTY], "".join(audit)


def summed_up(signature: str) -> tuple[int, int, int, int, int, str]:
    """blank, duplicate, truncated, illegal (neighbours other than su, ua, au), cost, audit."""
    counts = [sum(map(signature.count, LETTERS[f])) for f in ("blank", "duplicate", "truncated")]
    roles = "".join(MEANING[letter][0] for letter in signature)
    legal = sum(roles.count(pair) for pair in ("su", "ua", "au"))
    return (*counts, max(0, len(roles) - 1) - legal, *solve(signature))


class Replay:
    """Follows edits through a conversation: each edit gives the row that it leaves, if any."""

    def __init__(self, audit: str = ""):
        self.audit, self.at, self.state = audit, 0, EMPTY

    def insert(self) -> tuple[str, str]:
        self.state = NEXT[self.state]
        return ("user" if self.state == USER else "assistant"), ""

    def edit(self, edit: str, role: str, text: str = "") -> tuple[str, str] | None:
        if edit == "D":
            return None
        if edit == "R":
            return self.insert()[0], text
        self.state = RIGHT[self.state, role[:1]]
        return role, text

    def inserted(self) -> Iterator[tuple[str, str]]:
        """The rows inserted at this place."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self.insert()

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """What becomes of the next row, after what is inserted before it."""
        yield from self.inserted()
        left = self.edit(self.audit[self.at], role, text)
        self.at += 1
        if left:
            yield left


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20; a null counts as one space.

    0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 makes ``times`` 2, 4 makes the role
    user. Only conv_id, turn, role, text and ``times`` remain.
    """
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    return given.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"),
    )


def told(rows: DataFrame) -> DataFrame:
    """The rows as this module takes them: conv_id, turn, role, key (the text's hash), text, times (1 if not given)."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    times = F.col("times") if "times" in rows.columns else F.lit(1)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.md5(text)).alias("key"), text.alias("text"), times.cast("int").alias("times"))


def first_letter(role: Column, text: Column) -> Column:
    """The letter of a row that is no duplicate."""
    inside = F.rtrim(text, F.lit(SPACE))
    letters = F.when(inside == "", LETTERS["blank"]).when(F.right(inside, F.lit(1)).isin(".", "!", "?"), LETTERS["clean"]).otherwise(LETTERS["truncated"])
    return F.substr(letters, F.when(role.startswith("s"), 1).when(role.startswith("u"), 2).when(role.startswith("a"), 3).otherwise(4), F.lit(1))


def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a sorted range: its letters, its least and greatest turn, its distinct turns."""
    part, made = TaskContext.get().partitionId(), []

    def out() -> pa.RecordBatch:
        rows = [{"conv_id": m["conv_id"], "part": part, "letters": "".join(m["letters"]), "least": m["least"], "greatest": m["greatest"], "turns": m["turns"]} for m in made]
        return pa.RecordBatch.from_pylist(rows, schema=PARTS)

    for batch in batches:
        for conv_id, turn, letters in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "letters")), strict=True):
            if not made or made[-1]["conv_id"] != conv_id:
                made.append({"conv_id": conv_id, "letters": [], "least": None, "greatest": None, "turns": 0})
            now = made[-1]
            now["letters"].append(letters)
            if turn is not None and turn != now["greatest"]:
                now["least"] = turn if now["least"] is None else now["least"]
                now["greatest"], now["turns"] = turn, now["turns"] + 1
        last = made.pop()
        yield out()
        made = [last]
    if made:
        yield out()


PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("letters", pa.string()), ("least", pa.int64()), ("greatest", pa.int64()), ("turns", pa.int64())])


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature and gaps (numbers missing between the least and the greatest turn).

    Equal rows are counted before they are shuffled, so a conversation, or one row of it, may be a
    third of the table. A row is a duplicate if its role and text are in an earlier turn, or if it
    repeats a row of its turn. Each range of rows gives one string for a conversation.
    """
    facts = told(rows).select("conv_id", "turn", "role", "key", first_letter(F.col("role"), F.col("text")).alias("letter"), "times")
    facts = written(facts.groupBy("conv_id", "turn", "role", "key", "letter").agg(F.sum("times").alias("times")), "turn-facts")
    order = F.struct(F.col("turn").isNotNull().alias("there"), F.coalesce("turn", F.lit(0)).alias("turn"))
    again = facts.groupBy("conv_id", "role", "key").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    f, a = facts.withColumn("order", order).alias("f"), again.alias("a")
    same = F.col("f.conv_id").eqNullSafe(F.col("a.conv_id")) & (F.col("f.role") == F.col("a.role")) & (F.col("f.key") == F.col("a.key"))
    other = F.translate("f.letter", LETTERS["clean"] + LETTERS["truncated"], LETTERS["duplicate"] * 2)
    own = F.when(F.col("a.first") < F.col("f.order"), other).otherwise(F.col("f.letter"))
    lettered = f.join(a, same, "left").select("f.conv_id", "f.turn", "f.role", "f.key", F.concat(own, F.repeat(other, (F.col("f.times") - 1).cast("int"))).alias("letters"))
    ranges = lettered.repartitionByRange("conv_id", "turn", "role", "key").sortWithinPartitions("conv_id", "turn", "role", "key").select("conv_id", "turn", "letters")
    parts = ranges.mapInArrow(strings, "conv_id long, part long, letters string, least long, greatest long, turns long")
    # A turn that ends one range and begins the next is one turn.
    met = F.coalesce(F.lag("greatest").over(Window.partitionBy("conv_id").orderBy("part")) == F.col("least"), F.lit(False))
    whole = parts.withColumn("turns", F.col("turns") - met.cast("int")).groupBy("conv_id")
    whole = whole.agg(F.array_sort(F.collect_list(F.struct("part", "letters"))).alias("parts"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("turns").alias("turns"))
    return whole.select("conv_id", F.array_join("parts.letters", "").alias("signature"), F.coalesce(F.col("greatest") - F.col("least") + 1 - F.col("turns"), F.lit(0)).alias("gaps"))


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit; each distinct signature is solved once."""
    signed = written(signatures(rows), "signatures")

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s, *summed_up(s)) for s in batch["signature"].to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in found], schema=schema)

    names = ["signature", *COUNTS[1:], "audit"]
    schema = pa.schema([(c, pa.string() if c in ("signature", "audit") else pa.int64()) for c in names])
    each = written(signed.select("signature").distinct().mapInArrow(solved, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "solved")
    size = each.agg(F.sum(F.length("signature") + F.length("audit") + 64)).first()[0] or 0
    return signed.join(F.broadcast(each) if size <= MOST_SENT else each, "signature").select("conv_id", *COUNTS, "audit")


def in_order(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Each conversation's head (its audit and the columns of ``heads``), then its rows by turn (null first), role and hash of text."""
    columns = [c for c in heads.columns if c != "conv_id"]
    nothing = [F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in columns]
    texts = told(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "key", "text", "times", *nothing)
    missing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("key", "binary"), ("text", "string"), ("times", "int"))]
    first = heads.select("conv_id", F.lit(0).alias("kind"), *missing, *columns)
    return texts.unionByName(first).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "key").drop("key", "turn")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text.

    Takes conv_id, turn, role, text and, where a row stands for several equal ones, ``times``; other
    columns are ignored, whatever their names. A null role or text is one space, a null turn comes
    before all others, null conv_ids are one conversation. Rows of the same turn are taken by role,
    then by the hash of their text. A conversation of blank rows only gives no rows; an empty table
    gives none. Rows stream through a task in their order, so no conversation is held in memory.
    """

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, conv_id, place = Replay(), None, 0
        for batch in batches:
            out = []

            def put(left: Iterator[tuple[str, str]], to: list = out) -> None:
                nonlocal place
                for role, text in left:
                    to.append({"conv_id": conv_id, "place": place, "role": role, "text": text})
                    place += 1

            for row in batch.to_pylist():
                if row["kind"] == 0:
                    put(replay.inserted())
                    replay, conv_id, place = Replay(row["audit"]), row["conv_id"], 0
                for _ in range(row["times"] or 0):
                    put(replay.row(row["role"], row["text"]))
            yield pa.RecordBatch.from_pylist(out, schema=REPAIRED)
        rest = [{"conv_id": conv_id, "place": place + i, "role": role, "text": text} for i, (role, text) in enumerate(replay.inserted())]
        yield pa.RecordBatch.from_pylist(rest, schema=REPAIRED)

    return in_order(rows, audits(rows).select("conv_id", "audit")).mapInArrow(edited, "conv_id long, place long, role string, text string")


REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def audited(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """For each distinct conv_id of ``ids``: gaps, faults, cost and audit of its rows, and the SHA-256 of the repaired ``role:text`` lines.

    A conversation without rows has zeros, an empty audit and the digest of nothing. See ``repaired``
    for nulls, ties and order. A digest is of one whole conversation in order, so one task reads all
    its rows; they stream through it and are hashed one by one.
    """
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    schema = pa.schema([(c, pa.string() if c in names[-2:] else pa.int64()) for c in names])
    found = audits(rows).alias("a")
    heads = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("i").join(found, F.col("i.conv_id").eqNullSafe(F.col("a.conv_id")), "left")
    heads = heads.select("i.conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, replay, digest, empty = None, Replay(), hashlib.sha256(), True

        def put(left: Iterator[tuple[str, str]]) -> None:
            nonlocal empty
            for role, text in left:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False

        def ended() -> list[dict]:
            put(replay.inserted())
            return [{c: head[c] for c in names[:-1]} | {"repaired_sha256": digest.hexdigest()}] if head else []

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    out += ended()
                    head, replay, digest, empty = row, Replay(row["audit"]), hashlib.sha256(), True
                for _ in range(row["times"] or 0):
                    put(replay.row(row["role"], row["text"]))
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        yield pa.RecordBatch.from_pylist(ended(), schema=schema)

    return in_order(rows, heads).mapInArrow(hashed, ", ".join(f"{c} {'string' if c in names[-2:] else 'long'}" for c in names))
