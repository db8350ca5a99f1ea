"""Operator 11 against a packing of single pieces, and the registered query against the tokenizer."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from furlong.llm import bestfit
from furlong.llm.queries import QUERIES

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length long, start string, piece string, _salt long"


def one_by_one(counts, window):
    """What each sequence holds if the pieces are taken singly: large ones matched, others into the tightest gap."""
    large = sorted((k for k in Counter(counts).elements() if 3 * k > window), reverse=True)
    bins = []
    while large:
        longest = large.pop(0)
        other = next((k for k in large if k + longest <= window), None)
        if other is not None:
            large.remove(other)
        bins.append([longest] + ([other] if other else []))
    for k in sorted((k for k in Counter(counts).elements() if 3 * k <= window), reverse=True):
        fitting = [b for b in bins if sum(b) + k <= window]
        if fitting:
            max(fitting, key=sum).append(k)
        else:
            bins.append([k])
    return bins


def filled(counts, window):
    """Sequences that the plan makes, each with (offset, length) of its pieces."""
    out = defaultdict(list)
    for length, part in bestfit.plan(counts, window).groupby("length"):
        first = part["first_rank"].to_numpy()
        for rank in range(counts[length]):
            k = np.searchsorted(first, rank, "right") - 1
            n = rank - first[k]
            out[part["sequence_id"].iloc[k] + n // part["each"].iloc[k]].append((part["offset"].iloc[k] + n % part["each"].iloc[k] * length, length))
    return out


def test_plan_equals_packing_one_by_one():
    rng = random.Random(5)
    for _ in range(300):
        window = rng.randint(3, 50)
        counts = Counter(rng.randint(1, window) for _ in range(rng.randint(1, 80)))
        got = filled(counts, window)
        for pieces in got.values():
            ends = np.cumsum([0, *[k for _, k in sorted(pieces)]])
            assert [o for o, _ in sorted(pieces)] == ends[:-1].tolist() and ends[-1] <= window
        want = one_by_one(counts, window)
        assert len(got) == len(want)
        assert sorted(sum(k for _, k in p) for p in got.values()) == sorted(map(sum, want))
        assert all(sum(3 * k > window for _, k in p) <= 2 for p in got.values())


def test_plan_does_not_grow_with_the_documents():
    rng = random.Random(6)
    counts = {k: rng.randint(1, 50) for k in range(1, 4097)}
    small, large = (len(bestfit.plan({k: n * times for k, n in counts.items()})) for times in (1, 1_000))
    assert large < 4 * small
    assert len(bestfit.plan({})) == 0


def check(packed, docs, window):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in docs}
    fill, seen = Counter(), defaultdict(list)
    for p in packed:
        own = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["start"] == p["piece"] * window and len(own) == p["length"]
        assert p["length"] == min(window, len(ids[p["doc_id"]]) - p["start"])
        assert p["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        seen[p["doc_id"]].append(p["piece"])
    assert {i: sorted(v) for i, v in seen.items()} == {i: list(range(-(-len(x) // window))) for i, x in ids.items()}
    for p in sorted(packed, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == fill[p["sequence_id"]]
        fill[p["sequence_id"]] += p["length"]
    assert max(fill.values(), default=0) <= window
    assert len(fill) == len(one_by_one(Counter(p["length"] for p in packed), window))
    return fill


def test_whole_documents(spark):
    texts = [None, "", " \n ", "word", "é É. ﬁn", "the cat " * 3_000, *["same words here"] * 90, *[f"some {'more ' * (i % 40)}words" for i in range(150)]]
    docs = list(enumerate(texts, 1))
    df = spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in docs], SCHEMA)
    check([r.asDict() for r in bestfit.pack_whole(df, WORD_BPE, window=64).collect()], docs, 64)
    assert bestfit.pack_whole(df.where("false"), WORD_BPE).count() == 0
    twice = spark.createDataFrame([(5, "a"), (5, "b b"), (None, "c")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in bestfit.pack_whole(twice, WORD_BPE).collect()) == ["5", "5", "None"]
    with_ids = bestfit.pack_whole(twice, WORD_BPE, with_ids=True).collect()
    assert all(r["ids"][-1] == 1 and len(r["ids"]) == r["length"] for r in with_ids)


def test_query_packs_the_whole_table_tightly(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    fill = check([r.asDict() for r in QUERIES["op11_best_fit"](spark, folder).collect()], docs, 4096)
    assert len(fill) <= -(-sum(fill.values()) // 4096) + 1
