"""Operator 12 against brute force: all pairs of words, plain counting, chains followed one by one."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from furlong.llm import variants
from furlong.llm.queries import QUERIES


def deletions(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def differ_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return b in deletions(a) if len(a) == len(b) + 1 else a in deletions(b) if len(b) == len(a) + 1 else False


def near_by_all_pairs(words):
    return {w: {v for v in words if differ_by_one(w, v)} for w in words}


def near_by_deletions(words):
    """As all pairs, for larger sets: words meet in a word without one letter, or with a gap in its place."""
    by = {}
    for w in words:
        for key in {w} | {("gap", w[:i], w[i + 1 :]) for i in range(len(w))} | deletions(w):
            by.setdefault(key, set()).add(w)
    out = {w: set() for w in words}
    for met in by.values():
        for w in met:
            out[w] |= {v for v in met if v != w and differ_by_one(w, v)}
    return out


def expected(counts, near):
    rows = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        rows[word] = {"word": word, "form": form, "n": n, "n_near": len(near[word]), "form_n": counts[form] if form else None}
    for row in rows.values():
        root = row["word"]
        while rows[root]["form"]:
            root = rows[root]["form"]
        row["root"] = root
    return rows


def counted(docs):
    found = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if code % 97 == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def some_words(n, letters="abé", longest=11, seed=2):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(5, longest))) for _ in range(n)}


def test_automaton_numbers_the_sorted_words():
    words = sorted(some_words(500))
    automaton = variants.Automaton(words)
    assert [automaton.number(w) for w in words] == list(range(len(words)))
    assert all(automaton.number(w) is None for w in some_words(300, "abz", 7, 9) - set(words))
    # Minimal: no two states have the same words below them.
    assert len({(f, *sorted(e.items())) for f, e in zip(automaton.final, automaton.edges, strict=True)}) == len(automaton.edges)
    assert variants.Automaton([]).number("a") is None


def test_one_error_after_an_exact_half():
    words = sorted(some_words(400))
    automaton = variants.Automaton(words)
    for word in words[::7]:
        for exact in (0, len(word) // 2, len(word)):
            got = {words[i] for i in automaton.with_one_error(word, exact)}
            assert got == {v for v in words if len(v) >= len(word) and v[:exact] == word[:exact] and differ_by_one(word, v)}


@pytest.mark.parametrize("most", [10_000, 60])
def test_near_words_equal_all_pairs(spark, most, monkeypatch):
    """Also where groups are split again and again, and where automata have few groups."""
    monkeypatch.setattr(variants, "MOST_SEARCHED", 100)
    words = some_words(900) | {"a" * k for k in range(5, 30)} | {"x" * 400 + "b", "x" * 401, "x" * 400} | {f"hidden{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"}
    rng = random.Random(1)
    counts = {w: rng.randint(3, 9) for w in words}
    near = near_by_all_pairs(counts)
    got = {r["word"]: (r["n_near"], r["best"]["near"], -r["best"]["minus_n"]) for r in variants.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), 5, most).collect()}
    want = {w: (len(v), best := min(v, key=lambda x: (-counts[x], x)), counts[best]) for w, v in near.items() if v}
    assert got == want


def test_groups_share_their_halves_and_stay_small(spark):
    words = [(f"common{a}{b}{c}end", 3) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    sizes = variants.groups(spark.createDataFrame(words, "word string, n long"), 5, 80).groupBy(*variants.GROUP).count().collect()
    assert max(r["count"] for r in sizes if r["shorter"] - r["ahead"] - r["behind"] > 1) <= 80
    assert {r["half"] for r in sizes if r["backward"] and r["ahead"]} and all(len(r["half"]) == r["ahead"] + r["behind"] for r in sizes)


def test_words_and_forms_of_texts(spark):
    rng = random.Random(3)
    words = sorted(some_words(150)) + ["Straße", "STRASSE", "Étude", "étude", "na×ve", "abcd", "w" * 3_000]
    docs = [(i if i % 50 else None, " ".join(rng.choice(words) + rng.choice([" ", "1", "日", "\n", "?"]) for _ in range(120)), "k", 1, "h") for i in range(400)]
    docs += [(9, None, "k", 1, "h"), (10, "", "k", 1, "h"), (11, " 12 日本 ", "k", 1, "h"), docs[5], docs[5]]
    df = spark.createDataFrame(docs, "doc_id long, text string, word string, n long, half string").repartition(5)
    counts = counted(docs)
    want = expected(counts, near_by_all_pairs(counts))
    assert len({r["root"] for r in want.values()}) < len(want)
    got = [r.asDict() for r in variants.grouped(df).collect()]
    assert sorted(got, key=lambda r: r["word"]) == sorted(want.values(), key=lambda r: r["word"])


def test_long_chains_and_empty_tables(spark):
    chain = [("word" + "a" * i, 3 * 2**i) for i in range(1, 25)]
    forms = spark.createDataFrame([(a, b) for (a, _), (b, _) in zip(chain, chain[1:])], "word string, form string")  # noqa: B905
    assert {r["root"] for r in variants.rooted(forms).collect()} == {chain[-1][0]}
    assert variants.grouped(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    # Ties: the first in code-point order; equally frequent words are no forms.
    few = spark.createDataFrame([(1, "table tablé tablé tablé tabla " + "tablz tablb " * 6 + "table table tabla tabla")], "doc_id long, text string")
    got = {r["word"]: (r["form"], r["n_near"]) for r in variants.grouped(few, damaged=None).collect()}
    assert got == {"table": ("tablb", 4), "tablé": ("tablb", 4), "tabla": ("tablb", 4), "tablb": (None, 4), "tablz": (None, 4)}


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    counts = counted([tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()])
    want = expected(counts, near_by_deletions(counts))
    got = [r.asDict() for r in QUERIES["op12_spelling_variants"](spark, folder).collect()]
    assert sorted(got, key=lambda r: r["word"]) == sorted(want.values(), key=lambda r: r["word"])
    assert sum(r["form"] is not None for r in got) > 20
