"""Operator 2 where the input's columns have the names that it uses inside."""

from __future__ import annotations

import pytest

from furlong.llm import decontaminate

NAMES = ["_w", "_h1", "_h2", "_h8", "_of13", "_of3", "_hits", "_n", "_at", "_covered", "_text", "_row", "_key", "doc", "window", "item_id", "k", "hits", "n_words"]
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"


@pytest.mark.parametrize("max_set", [200_000, 0])
@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_every_inner_name_may_be_a_column(spark, max_set, remove):
    texts = [f"before {PASSAGE} after", "clean words only", None, "", "short item here"]
    rows = [(i, t, *[f"{name}-{i}" for name in NAMES]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))
    bench = spark.createDataFrame([("a", PASSAGE), ("b", "item here")], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench, remove, max_set=max_set).collect()}
    assert set(got) == ({1, 2, 3} if remove == "documents" else {0, 1, 2, 3, 4})
    for i, r in got.items():
        assert [r[n] for n in NAMES] == [f"{n}-{i}" for n in NAMES]
        assert r["text"] == (texts[i] if remove == "documents" or i in (1, 2, 3) else {0: "before after", 4: "short"}[i])
    assert list(got[1].asDict()) == docs.columns
