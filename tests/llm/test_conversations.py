"""Operator 13 against brute force: every edit sequence up to a length, and plain Python over whole conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

from furlong.llm import conversations
from furlong.llm.queries import QUERIES

TARGET = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string, key string, kind string, letters string, audit string"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(roles, faults):
    """(cost, audit) over all edit sequences, by enumeration; at most two insertions in one place."""
    best = None
    per_row = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]
    inserts = ["", "u", "a", "ua", "au"]
    for edits in itertools.product(*per_row):
        kept = [r if e == "K" else e[1:] for r, e in zip(roles, edits, strict=True)]
        cost = sum({"D": 4, "K": 0}.get(e, 3) + (3 if f == "truncated" and e != "D" else 0) for e, f in zip(edits, faults, strict=True))
        for put in itertools.product(inserts, repeat=len(roles) + 1):
            total = cost + 3 * sum(map(len, put))
            if best and total > best[0]:
                continue
            if TARGET.match("".join(p + k for p, k in zip(put, [*kept, ""], strict=True))):
                audit = "".join("I" * len(p) + e for p, e in zip(put, [e[:1] for e in edits] + [""], strict=True))
                best = min(best, (total, audit)) if best else (total, audit)
    return best


def test_signatures_are_solved_as_by_enumeration():
    rng = random.Random(4)
    for n in range(5):
        for _ in range({0: 1, 1: 16, 2: 60, 3: 60, 4: 25}[n]):
            signature = "".join(rng.choice("suaosuaoSUAO15") for _ in range(n))
            meant = [conversations.MEANING[c] for c in signature]
            assert conversations.solve(signature) == cheapest([r for r, _ in meant], [f for _, f in meant]), signature
    for letter in conversations.MEANING:
        role, fault = conversations.MEANING[letter]
        assert conversations.solve(letter) == cheapest([role], [fault])


def test_long_signatures():
    assert conversations.solve("ua" * 200_000) == (0, "K" * 400_000)
    assert conversations.solve("u" * 50_001)[0] == 3 * 25_000 + 3
    before = conversations.before.cache_info().currsize
    rng = random.Random(8)
    conversations.solve("".join(rng.choice(list(conversations.MEANING)) for _ in range(100_000)))
    assert conversations.before.cache_info().currsize - before < 2_000


def expected(rows, damage=True):
    """conv_id to the row of op13, by plain Python."""
    text_of = lambda v: " " if v is None else v
    held = defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        here, role, text = held[conv_id], text_of(role), text_of(text)
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        here += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv_id, here in held.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, signature, counts = set(), "", Counter()
        for _, role, text in here:
            bare = text.rstrip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "clean"
            seen.add((role, text))
            counts[fault] += 1
            signature += conversations.LETTERS[fault][max(0, "suao".find(role[:1] or "o") if role[:1] in ("s", "u", "a") else 3)]
        roles = [r[1][:1] for r in here]
        cost, audit = conversations.solve(signature)
        left, at, last = [], 0, ""
        for edit in audit:
            following = "assistant" if last == "u" else "user"
            row = here[at] if edit != "I" else None
            at += edit != "I"
            if edit != "D":
                left.append((row[1] if edit == "K" else following, row[2] if row else ""))
                last = left[-1][0][:1]
        assert TARGET.match("".join(r[:1] for r, _ in left)) and at == len(here)
        turns = [t for t, _, _ in here if t is not None]
        out[conv_id] = {
            "conv_id": conv_id,
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{f: counts[f] for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles)),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(),
        }, left
    return out


def some_rows(n=400):
    rng = random.Random(11)
    texts = ["Hi.", "Hi.", "how are you?", "no end", "", " \n", None, "a\x0b", "same! ", "é?\r\n", "x" * 50_000 + ".", " "]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "Sys", "usher"]
    rows = [(rng.choice([*range(60), None]), rng.choice([*range(9), None, 2**53 + 1]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]
    rows += rows[:40]  # repeated rows
    rows += [(2**60 + 1, t, "user" if t % 2 else "assistant", f"turn {t}.") for t in range(700)] + [(2**60 + 3, 5, "user", "Hi.")] * 300
    return [(*r, "k", "v", "l", "a") for r in rows]


def test_audits_and_digests_equal_plain_python(spark):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    want = expected(rows)
    got = [r.asDict() for r in conversations.audited(conversations.damaged(df), df).collect()]
    assert sorted(got, key=str) == sorted((w for w, _ in want.values()), key=str)
    assert len({r["audit"] for r in got}) > 20


def test_repaired_rows(spark):
    rows = some_rows()
    want = expected(rows, damage=False)
    got = defaultdict(list)
    for r in conversations.repaired(spark.createDataFrame(rows, SCHEMA)).collect():
        got[r["conv_id"]].append((r["place"], r["role"], r["text"]))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == {k: left for k, (_, left) in want.items() if left}
    assert all([x[0] for x in sorted(v)] == list(range(len(v))) for v in got.values())


def test_ranges_meet_within_a_conversation(spark):
    """A turn that falls into two ranges is one turn, and the letters keep their order."""
    rows = [(1, t // 3, "user", f"{t}.", "", "", "", "") for t in range(3_000)]
    got = conversations.audits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 1 and got[0]["gaps"] == 0 and got[0]["illegal"] == 2_999
    assert got[0]["cost"] == 3 * 1_500


def test_empty_table_and_dropped_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.audited(conversations.damaged(none), none).count() == 0
    assert conversations.repaired(none).count() == 0
    ids = spark.createDataFrame([(7,), (7,), (None,)], "conv_id long")
    got = conversations.audited(none, ids).collect()
    assert sorted((str(r["conv_id"]), r["gaps"], r["cost"], r["audit"], r["repaired_sha256"]) for r in got) == [(i, 0, 0, "", hashlib.sha256(b"").hexdigest()) for i in ("7", "None")]


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [r.asDict() for r in QUERIES["op13_conversation_repair"](spark, folder).collect()]
    assert sorted(got, key=lambda r: r["conv_id"]) == sorted((w for w, _ in expected(rows).values()), key=lambda r: r["conv_id"])
