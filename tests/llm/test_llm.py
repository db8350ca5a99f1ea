"""Text operators against brute force, round trips and held-out accuracy, with nulls, ties and empty tables."""

from __future__ import annotations

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import Unigram

import __spark_entry__ as entry
import corpus_pipeline
from furlong.llm import decontaminate, language_id, line_dedup, neardup, packing, quality, records, token_counts, toxicity, warc
from furlong.llm.shared import filesystem, new_folder
from furlong.llm.tokenize import ChunkEncoder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DATA = "/root/testdata/sf0.001"
ODD = [None, "", " \n ", "word", "é É. ﬁn İx", "a<|endoftext|>b", "tab\there\r\nend", "x" * 30_000, "the cat " * 9_000]
SCHEMA = "doc_id long, text string, lang string, source string, length long, start string, key string, at string"


def frame(spark, texts, first=1):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", 1, "x", "y", "z") for i, t in enumerate(texts, first)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- tokenizing, packing, records -------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aZé.,'!1 \n\tΣσ日İ<|endoftx>́")), max_size=30), max_size=5))
def test_chunks_encode_like_whole_texts(texts):
    plain = Tokenizer.from_file(WORD_BPE)
    encoder = _ENCODER.setdefault("e", ChunkEncoder(WORD_BPE, limit=300))
    assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


_ENCODER: dict = {}


def test_best_fill_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        window = rng.randint(5, 40)
        counts = dict(Counter(rng.randint(1, window) for _ in range(rng.randint(1, 12))))
        chosen = packing.best_fill(counts, window)
        longest = max(counts)
        sums = {longest}
        for length, n in counts.items():
            for _ in range(n - (length == longest)):
                sums |= {s + length for s in sums if s + length <= window}
        assert sum(k * n for k, n in chosen.items()) == max(sums)
        assert all(n <= counts[k] for k, n in chosen.items()) and chosen[longest] >= 1


def check_packed(packed, docs, window, end_id):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id] for i, t in docs}
    at, fill = Counter(), Counter()
    for p in sorted(packed, key=lambda p: (p["doc_id"], p["start"])):
        own = ids[p["doc_id"]]
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(own) and 0 < p["length"] <= window
        assert p["ids_crc32"] == zlib.crc32(np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
        at[p["doc_id"]] += p["length"]
    assert at == {i: len(x) for i, x in ids.items()}
    for p in sorted(packed, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == fill[p["sequence_id"]]
        fill[p["sequence_id"]] += p["length"]
    assert max(fill.values(), default=0) <= window and set(fill) == set(range(len(fill)))
    return fill


def test_packing(spark):
    docs = list(enumerate([*ODD, *["same words here"] * 70], 1))
    fill = check_packed(rows(packing.pack(frame(spark, [t for _, t in docs]), WORD_BPE, 2, window=64)), docs, 64, 2)
    assert sum(64 - n for n in fill.values()) < 64
    assert packing.pack(empty(spark), WORD_BPE).count() == 0
    with_ids = rows(packing.pack(frame(spark, ["one two"]), WORD_BPE, 2, with_ids=True))
    assert with_ids[0]["ids"][-1] == 2 and len(with_ids[0]["ids"]) == with_ids[0]["length"]


def test_records_round_trip(spark):
    docs = list(enumerate(ODD, 1))
    got = rows(records.write_and_read(frame(spark, ODD).orderBy(F.rand(1)), WORD_BPE))
    tokenizer, start = Tokenizer.from_file(WORD_BPE), 0
    for (i, text), r in zip(docs, sorted(got, key=lambda r: r["doc_id"]), strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert r == {"doc_id": i, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)
    assert records.write_and_read(empty(spark), WORD_BPE).count() == 0
    twice = spark.createDataFrame([(5, "a"), (5, "b b"), (None, "c")], "doc_id long, text string")
    assert [r["doc_id"] for r in sorted(rows(records.write_and_read(twice, WORD_BPE)), key=lambda r: r["start"])] == [None, 5, 5]


def test_records_are_read_by_offset_in_any_order(spark):
    folder = new_folder(spark, "records-test")
    index = records.write(frame(spark, ODD), WORD_BPE, 1, folder)
    got = rows(records.read_at(index.repartition(3, F.rand(5)), folder))
    tokenizer = Tokenizer.from_file(WORD_BPE)
    assert {r["doc_id"]: r["ids"] for r in got} == {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(ODD, 1)}
    assert [r["doc_id"] for r in rows(records.read_at(index.where("doc_id = 4"), folder))] == [4]
    assert records.width_of(WORD_BPE, 1) == 2 and records.width_of(WORD_BPE, 70_000) == 4
    wide = rows(records.read_at(records.write(frame(spark, ["a b"]), WORD_BPE, 70_000, f"{folder}-wide"), f"{folder}-wide"))
    assert wide[0]["ids"][-1] == 70_000


def test_damaged_records_are_noticed():
    data = records.frame(records.serialize(7, np.array([1, 2, 49_000]), 2))
    doc_id, ids = records.deserialize(records.unframe(data, 0)[0])
    assert (doc_id, ids.tolist()) == (7, [1, 2, 49_000])
    for at in (0, 9, 14, len(data) - 1):
        with pytest.raises((ValueError, MemoryError)):
            records.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :], 0)


# --- WARC --------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    pages = [(3, "u3", "same"), (1, "u1", "same"), (2, "u2", None), (4, None, "ü" * 50_000), (5, "u\r\n5", ""), (None, "u", "same"), (9, "u", "x" * 5), (9, "u", "x" * 5)]
    folder = new_folder(spark, "warc-test")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), folder)
    got = Counter(tuple(r.values()) for r in rows(warc.read(spark, folder)))
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", 10**9), i)
    want = Counter()
    for i, _, html in pages:
        payload = (html or "").encode()
        again = i != first[html or ""]
        want[i, len(payload), warc.digest(payload), "revisit" if again else "response", first[html or ""] if again else None] += 1
    assert got == want
    assert warc.write_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def payload_rows(pages):
    """What archives of (page_id, html) must hold, by brute force."""
    first = {}
    for i, html in pages:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    same = Counter(html or "" for _, html in pages)
    out = Counter()
    for i, html in pages:
        payload, one = (html or "").encode(), first.get(html or "")
        again = same[html or ""] > 1 and i != one
        out[i, len(payload), warc.digest(payload), "revisit" if again else "response", one if again else None] += 1
    return out


def test_warc_query_is_brute_force(spark):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    got = Counter(tuple(r.values()) for r in rows(warc.write_and_read(spark.read.parquet(f"{DATA}/pages.parquet"))))
    assert got == payload_rows(pages)


def test_warc_archives_have_dictionaries_of_their_own(spark):
    pages = spark.range(3_000).coalesce(1).selectExpr("id AS page_id", "'u' AS url", "concat(repeat(sha1(string(id div 1000)), 20), string(id)) AS html")
    folder = new_folder(spark, "warc-test")
    manifest = rows(warc.write(pages, folder, archive_bytes=400_000))
    assert len(manifest) > 5 and sum(r["records"] for r in manifest) == 3_000
    fs, path = filesystem(folder)
    heads = set()
    for r in manifest:
        with fs.open_input_stream(f"{path}/{r['archive']}", compression=None) as stream:
            magic, size = struct.unpack("<II", stream.read(8))
            heads.add(stream.read(size))
            assert magic == warc.SKIPPABLE and size <= 65_536
    assert len(heads) == len(manifest)
    got = Counter(tuple(r.values()) for r in rows(warc.read(spark, folder)))
    assert got == payload_rows([(r["page_id"], r["html"]) for r in pages.collect()])


def test_warc_deals_hot_payloads(spark):
    pages = spark.range(100_000).selectExpr("id AS page_id", "'u' AS url", "CASE WHEN id % 10 < 7 THEN NULL ELSE string(id div 20) END AS html")
    copied = spark.createDataFrame(pages.groupBy(F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("_copied")).agg(F.min("page_id").alias("first"), F.count("*").alias("_n")).where("_n > 1").collect())
    hashed = pages.withColumn("_sha1", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    each = ["page_id", "first", "has_copies"]
    plain = warc.with_first(hashed, copied).select(each)
    dealt = warc.with_first(hashed, copied, most_sent=10, hot=1_000)
    assert dealt.select(each).exceptAll(plain).count() == 0 and dealt.count() == 100_000
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * 100_000 / len(sizes) + 1_000


# --- language ----------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    vocab = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "▁ab"])}
    probs = np.vstack([np.linspace(0.1, 0.3, 7)[:, None] * [1.0, 0.5], [[0, 0]]])

    def total(word, k):
        if not word:
            return 1.0
        ends = [n for n in range(1, len(word) + 1) if word[:n] in vocab or n == 1]
        return sum(probs[vocab.get(word[:n], len(vocab)), k] * total(word[n:], k) for n in ends)

    words = ["ab", "a", "zb", "abab", ""]
    got = language_id.word_scores(words, vocab, probs)
    for i, w in enumerate(words):
        for k in range(2):
            assert math.isclose(got[i, k], math.log(total("▁" + w, k)), rel_tol=1e-9)
    counts = np.array([[1.0, 0], [0, 2], [1, 1], [3, 0], [0, 1]])
    expected = language_id.expected_counts(words, counts, vocab, probs)
    step = 1e-6  # d log p / d log prob of a piece is its expected count
    for piece in range(7):
        moved = probs.copy()
        moved[piece] *= 1 + step
        slope = (language_id.word_scores(words, vocab, moved) - got) / math.log1p(step)
        assert np.allclose((slope * counts).sum(0), expected[piece], atol=1e-4)


def test_long_words_are_summed_whole():
    vocab = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "▁ab"])}
    probs = np.vstack([np.linspace(0.1, 0.3, 7)[:, None] * [1.0, 0.5], [[0, 0]]])
    logs = language_id.log_probs(probs)
    word = "abzab" * 6
    short = language_id.word_scores([word], vocab, probs)
    assert np.allclose(language_id.long_forward("▁" + word, vocab, logs)[-1], short[0], rtol=1e-9)
    total = np.zeros_like(probs)
    language_id.long_counts("▁" + word, np.array([2.0, 3.0]), vocab, logs, total)
    assert np.allclose(total, language_id.expected_counts([word], np.array([[2.0, 3.0]]), vocab, probs), rtol=1e-6)
    # A run of 10,000 letters: alpha[j] = alpha[j - 1] * (p(a) + p(b|a b) ...), by an exact recurrence.
    long = "ab" * 5_000
    pa, pb, pab, start, sa, sab = (probs[vocab[x]] for x in ("a", "b", "ab", "▁", "▁a", "▁ab"))
    step = np.log(pa * pb + pab)
    first = np.log((start * pa + sa) * pb + start * pab + sab)
    assert np.allclose(language_id.word_scores([long], vocab, probs)[0], first + 4_999 * step, rtol=1e-9)


def test_language_id(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.train(docs.where("crc32(cast(doc_id as string)) % 5 <> 0"), PIECES)
    out = language_id.identify(docs, model).select("lang", "language.*").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.97 and out["score"].between(0, 1).all()
    odd = rows(language_id.identify(frame(spark, [None, "", "12 % 3", "\n", "the of and the"]), model).select("language.*"))
    assert [r["lang_pred"] for r in odd] == ["und"] * 4 + ["en"] and odd[0]["score"] == 0
    none = language_id.train(docs.where("false"), PIECES)
    assert {r["lang_pred"] for r in rows(language_id.identify(docs.limit(3), none).select("language.*"))} == {"und"}
    assert language_id.identify(empty(spark), model).count() == 0


# --- decontamination ---------------------------------------------------------------------------


def brute_contamination(docs, items, size=13):
    def words(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]

    found = {}
    for i, text in items:
        w = words(text)
        k = min(size, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            found.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for k in {len(x) for x in found}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in found:
                    hit |= set(range(a, a + k))
                    names |= found[tuple(w[a : a + k])]
        out.append((i, len(w), len(hit), len(names), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("max_set", [200_000, 0])
def test_contamination(spark, max_set):
    passage = " ".join(f"w{i}" for i in range(20))
    items = [("a", passage), ("b", passage.upper() + " more"), ("c", "Été, short"), ("d", None), ("e", "... !"), ("c", "Été, short")]
    docs = [*ODD, passage, f"before {passage[:40]}", "x " * 500 + passage, "né Été short été SHORT Été-short", passage + " " + passage, "filler " * 1000 + "Été short"]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = rows(decontaminate.contamination(frame(spark, docs), benchmark, max_set=max_set).drop("hits"))
    want = brute_contamination(list(enumerate(docs, 1)), items)
    assert sorted(tuple(r[k] for k in ("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")) for r in got) == want
    kept = rows(decontaminate.decontaminate(frame(spark, docs), benchmark, max_set=max_set))
    assert sorted(r["doc_id"] for r in kept) == [w[0] for w in want if not w[-1]]
    assert decontaminate.contamination(empty(spark), benchmark, max_set=max_set).count() == 0
    assert decontaminate.contamination(frame(spark, docs), benchmark.where("false"), max_set=200_000).where("contaminated").count() == 0


def test_contamination_by_a_large_benchmark(spark):
    item = "array_join(transform(sequence(0, 112), x -> concat('w', string(id), 'x', string(x))), ' ')"
    items = spark.range(3_000).selectExpr("concat('i', id) AS item_id", f"{item} AS text")
    bench = decontaminate.Benchmark(items)
    assert bench.count == 303_000 and bench.texts is None
    part = "concat('start ', array_join(transform(sequence(10, 39), x -> concat('W', string(id), 'x', string(x))), '-'), ' end')"
    docs = spark.range(200).selectExpr("id AS doc_id", f"CASE WHEN id % 4 = 0 THEN {part} WHEN id % 4 = 1 THEN 'w1x10 w1x11 w1x12' WHEN id % 4 = 2 THEN '' END AS text")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows(decontaminate.contamination(docs, items))}
    want = {0: lambda i: (32, 30, [f"i{i}"], True), 1: lambda i: (3, 0, [], False), 2: lambda i: (0, 0, [], False), 3: lambda i: (0, 0, [], False)}
    assert got == {i: want[i % 4](i) for i in range(200)}
    assert decontaminate.decontaminate(docs, items).count() == 150


def test_spans_are_cut_out(spark):
    benchmark = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    got = rows(decontaminate.decontaminate(frame(spark, ["Zero, One TWO three. Four!", "zero one", None]), benchmark, remove="spans"))
    assert [r["text"] for r in sorted(got, key=lambda r: r["doc_id"])] == ["Zero. Four!", "zero one", None]


# --- token counts ------------------------------------------------------------------------------

SMALL = [("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("▁ab", -4.0), ("ba", -2.0), ("bb", -1.5)]


def test_joined_benchmark_removes_alike(spark):
    passage = " ".join(f"b{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"Own start, {passage}; own end."), (1, "clean row with the same id"), (None, passage), (None, "clean too"), (2, None), (3, "")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", passage)], "item_id string, text string")
    for remove, left in (("documents", 4), ("spans", 6)):
        small, joined = (sorted(map(repr, rows(decontaminate.decontaminate(docs, bench, remove, max_set=n)))) for n in (1000, 0))
        assert joined == small and len(joined) == left


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab▁☃日", max_size=14))
def test_piece_counts_with_ties_and_unknowns(text):
    model = Unigram([("<unk>", 0.0), *SMALL], 0, False)
    counter = token_counts.PieceCounter([("<none>", 0.0), *SMALL])
    assert counter.count(text) == len(model.tokenize(text))


def test_token_counts(spark):
    vocab, byte_pieces = token_counts.unigram_vocabulary(PIECES)
    assert byte_pieces
    model = Unigram([("<unk>", 0.0), *vocab, *((f"<0x{b:02X}>", 0.0) for b in range(256))], 0, True)
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(30).collect()] + ODD[:7] + ["日本☃☃ \v x"]
    for i, r in enumerate(sorted(rows(token_counts.counted(frame(spark, texts), PIECES)), key=lambda r: r["doc_id"])):
        words = [w for w in re.split(r"[ \t-\r]+", texts[i] or "") if w]
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(len(model.tokenize("▁" + w)) for w in words))
    assert token_counts.counted(empty(spark), PIECES).count() == 0


# --- quality -----------------------------------------------------------------------------------


def brute_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\x1c\xa0#é", max_size=60))
def test_measures(text):
    assert quality.measure(text)[0] == brute_measure(text)


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(1)
    field = quality.LineField(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=(2, 2)))
    for n in range(1, 7):
        x = rng.random((n, len(quality.FEATURES)))
        score = x @ field.nodes

        def total(labels, score=score):
            return sum(score[i, y] for i, y in enumerate(labels)) + sum(field.edges[a, b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(([int(b) for b in f"{i:0{n}b}"] for i in range(2**n)), key=total)
        assert [int(y) for y in field.decode([tuple(r) for r in x])] == best


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    field = quality.train(docs, labels)
    out = quality.judged(docs, field).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").select("quality.*", "label").where("not base_failed").toPandas()
    assert ((out["label"] == 1) == out["kept"]).mean() > 0.95
    odd = rows(quality.judged(frame(spark, ODD), field).select("quality.*"))
    assert odd[0]["n_words"] == 0 and odd[0]["base_failed"] and not odd[0]["kept"] and odd[-1]["n_repeat_words"] == 18_000
    assert quality.train(docs, labels.where("false")).decode([(1.0,) * len(quality.FEATURES)]) == [True]
    assert quality.judged(empty(spark), field).count() == 0


# --- near duplicates ---------------------------------------------------------------------------


def brute_classes(docs, threshold=0.8):
    """Class of each document from all pairs, with the operator's shingles and weights."""
    sets = neardup.shingles([t or "" for _, t in docs])
    df = np.zeros(neardup.BUCKETS, np.int64)
    for h, _ in sets:
        np.add.at(df, neardup.bucket(h), 1)
    idf = neardup.inverse_frequencies(df, sum(len(h) > 0 for h, _ in sets))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if len(sets[a][0]) and len(sets[b][0]) and neardup.similarity(sets[a], sets[b], idf) >= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {docs[i][0]: docs[find(i)][0] for i in range(len(docs))}


def test_similarity_is_weighted_jaccard():
    idf = np.ones(neardup.BUCKETS, np.float32)
    a, b = neardup.shingles(["a b c d e f g a b c d e", "a b c d e f g"])
    assert math.isclose(neardup.similarity(a, b, idf), 3 / 8)
    assert neardup.similarity(a, a, idf) == 1


def test_samples_agree_as_often_as_sets_are_similar():
    sampler = neardup.Sampler()
    rng = np.random.default_rng(5)
    agree, similar = [], []
    for _ in range(60):
        h = np.unique(neardup.mixed(rng.integers(1, 2**63, 300).astype(np.uint64)))
        wa, wb = rng.random(len(h)) + 0.2, rng.random(len(h)) + 0.2
        agree.append((sampler.samples(h, wa) == sampler.samples(h, wb)).mean())
        similar.append(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(agree) - np.mean(similar)) < 0.03


def test_near_duplicates(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        docs.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
    docs += ["two words", "two words", "Two  words.", *ODD]
    rng.shuffle(docs)
    got = {r["doc_id"]: r["class_id"] for r in rows(neardup.near_duplicates(frame(spark, docs)))}
    assert got == brute_classes(list(enumerate(docs, 1)))
    kept = rows(neardup.one_of_each(frame(spark, docs)))
    assert sorted(r["doc_id"] for r in kept) == sorted(set(got.values()))
    assert neardup.one_of_each(empty(spark)).count() == 0
    ids = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in rows(neardup.near_duplicates(ids))) == [(0, 0), (0, 4), (4, 4), (4, 4)]
    assert [r["doc_id"] for r in sorted(rows(neardup.one_of_each(ids)), key=str)] == [4, 4, None]


def test_two_texts_of_one_id_join_no_groups(spark):
    one, other = (" ".join(f"{x}{i}" for i in range(40)) for x in "pq")
    docs = spark.createDataFrame([(1, one), (1, other), (2, f"{one} more"), (3, f"{other} more"), (None, f"{other} too")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["class_id"]) for r in rows(neardup.near_duplicates(docs))) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1)]
    assert sorted((r["doc_id"], r["text"]) for r in rows(neardup.one_of_each(docs))) == [(1, one), (1, other)]
    docs = spark.createDataFrame([(1, "filler text"), (5, one), (5, other), (2, f"{one} more"), (3, f"{other} more")], "doc_id long, text string")
    got = {(r["doc_id"], r["class_id"]) for r in rows(neardup.near_duplicates(docs))}
    assert got == {(1, 1), (5, 2), (5, 3), (2, 2), (3, 3)}


def test_common_shingles_weigh_less(spark):
    """Two texts that share a frequent passage and differ otherwise are alike only if all shingles weigh the same."""
    common = " ".join(f"c{i}" for i in range(95))
    docs = [(i, f"{common} " + " ".join(f"u{i}x{j}" for j in range(4))) for i in range(60)] + [(100 + i, " ".join(f"o{i}x{j}" for j in range(60))) for i in range(60)]
    df, n = neardup.document_frequencies(spark.createDataFrame(docs, "doc_id long, text string"))
    idf = neardup.inverse_frequencies(df, n)
    a, b = neardup.shingles([docs[0][1], docs[1][1]])
    assert neardup.similarity(a, b, np.ones_like(idf)) > 0.9 > neardup.similarity(a, b, idf)
    assert neardup.inverse_frequencies(np.array([0, 1, 100]), 1000)[2] < 1


def test_rows_find_their_groups_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_ROWS", 3)
    df = spark.createDataFrame([(k, i) for k in range(5) for i in range(k + 1)], "k long, i long")
    got = rows(neardup.with_group(df, df.groupBy("k").agg(F.count("*").alias("n")), ["k"], 15))
    assert sorted((r["k"], r["i"], r["n"]) for r in got) == [(k, i, k + 1) for k in range(5) for i in range(k + 1)]


def test_first_shared_band_is_told_by_full_keys():
    """In band 0 one draw of four differs but for its top byte; the pair's only group is that of band 1."""
    sampler, rng = neardup.Sampler(), np.random.default_rng(6)
    text = " ".join(f"w{i}" for i in range(60))
    one = rng.integers(1, 2**63, neardup.BANDS * neardup.ROWS).astype(np.uint64)
    other = one.copy()
    other[0] ^= np.uint64(1)
    with np.errstate(over="ignore"):
        keys = [sampler.band_keys(d) for d in (one, other)]
    assert keys[0][0] != keys[1][0] and keys[0][1] == keys[1][1]
    draws = [(d >> np.uint64(56)).astype(np.uint8).tobytes() for d in (one, other)]
    group = pd.DataFrame({"band": 1, "doc": [1, 2], "root": [1, 2], "side": [0, 1], "bands": keys, "draws": draws, "text": [text, f"{text} more"]})
    idf = np.ones(neardup.BUCKETS, np.float32)
    assert neardup.links_in(group, idf, neardup.THRESHOLD) == [(1, 2)]
    assert neardup.links_in(group.assign(band=2), idf, neardup.THRESHOLD) == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in rows(neardup.components(spark.createDataFrame(chain, "a long, b long")))}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100}


# --- lines -------------------------------------------------------------------------------------


LINE_SCHEMA = "doc_id long, text string, source string, of string, at string, key string, gone string, left string, site string, `m.x` string"


def line_docs(spark, docs):
    """Documents with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*d, *"abcdefg") for d in docs], LINE_SCHEMA)


def test_lines_of_many_sites_go(spark):
    wide, near, narrow = "this line is on every site", "this line is on ten sites.", "this line is on nine sites"
    docs = []
    for i in range(40):
        own = f"text of document {i} which is long enough to stay " * 3
        docs.append((i, "\n".join([own, f"  {wide}\r", *([near] if i < 10 else []), *([narrow] if i < 9 else []), "ok", ""]), f"s{i}"))
    copied = "a copied document\nwith two lines"
    docs += [(50, wide, "s1"), (51, None, "s2"), (52, "", None), (None, f"{wide}\nand more of the text that stays here", "s3"), (1, f"x\n{wide}\nrepeated id with its own text to keep", "s4")]
    docs += [(60 + i, copied, f"s{i}") for i in range(12)] + [(80, "\n".join(["own", *[wide] * 5_000]), "s5")]
    out = rows(line_dedup.remove_spread_lines(line_docs(spark, docs)))
    assert len(out) == len(docs) and all((r["of"], r["m.x"]) == ("a", "g") for r in out)
    texts = {(r["doc_id"], r["source"]): r["text"] for r in out}
    assert all(wide not in texts[i, f"s{i}"] and near not in texts[i, f"s{i}"] and "ok" not in texts[i, f"s{i}"] and texts[i, f"s{i}"].endswith("\n") for i in range(40))
    assert all(narrow in texts[i, f"s{i}"] for i in range(9))
    assert texts[50, "s1"] == "" and texts[51, "s2"] is None and texts[52, None] == ""
    assert texts[None, "s3"] == "and more of the text that stays here" and texts[1, "s4"] == "x\nrepeated id with its own text to keep"
    assert all(texts[60 + i, f"s{i}"] == copied for i in range(12)) and texts[80, "s5"] == "own"
    spared = {(r["doc_id"], r["source"]): r["text"] for r in rows(line_dedup.remove_spread_lines(line_docs(spark, docs), max_share=0.5))}
    assert spared[50, "s1"] == wide and wide not in spared[3, "s3"]
    assert line_dedup.remove_spread_lines(empty(spark)).count() == 0


# --- toxicity ----------------------------------------------------------------------------------


def brute_restore(word, after):
    """Best of all paths by enumeration."""
    best = (-math.inf, "")

    def walk(i, a, b, score, text):
        nonlocal best
        if i == len(word):
            best = max(best, (score + after[a][b][0], text))
            return
        ch = word[i]
        options = [(c, toxicity.STAND_IN) for c in toxicity.LEET.get(ch, "")] + ([(ch, 0.0)] if ch.isalpha() else [])
        skip = toxicity.REPEAT if i and word[i - 1] == ch else toxicity.SEPARATED if ch in toxicity.SEPARATORS or not options else None
        if skip is not None:
            walk(i + 1, a, b, score + skip, text)
        for c, cost in options:
            k = ord(c) - 96 if "a" <= c <= "z" else toxicity.CLASSES - 1
            walk(i + 1, b, k, score + cost + after[a][b][k], text + c)

    walk(0, 0, 0, 0.0, "")
    return best


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab10.o@é", min_size=1, max_size=7))
def test_restoring_is_exact_viterbi(word):
    counts = np.random.default_rng(2).random((toxicity.CLASSES,) * 3) * 50
    after = toxicity.CharacterModel(counts).after
    assert toxicity.restore_word(word, after) == brute_restore(word, after)[1]


@pytest.fixture(scope="module")
def english():
    text = "you are a stupid moron and an idiot, what a loser. scum of the earth! a man is a moron; stupid idiot losers say a lot. " * 50
    c = toxicity.classes_of(text)
    counts = np.zeros((toxicity.CLASSES,) * 3)
    np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    return toxicity.CharacterModel(counts)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("$tupid !diot, |oser $cum", "stupid idiot loser scum"),
        ("idiot! (moron) scum!!! stupid!?", "idiot moron scum stupid"),
        ("you are a s t u p i d m o r o n", "you are a stupid moron"),
        ("a m o r o n", "a moron"),
        ("what s  t  u\tp !  d", "what stupid"),
        ("stu" + "p" * 60 + "id", "stupid"),
        (".".join("stupidmoron" * 4), "stupidmoron" * 4),
        ("1 2 3 4", "1 2 3 4"),
        ("iiddiioott mmoorroonn", "idiot moron"),
        ("m0r0n5 1d10t5", "morons idiots"),
        ("$ay a l0t", "say a lot"),
        ("s a y", "say"),
        (".".join("idiot" * 12), "idiot" * 12),
        ("m" * 10_000 + "oron", "moron"),
    ],
)
def test_disguises_at_ends_in_runs_and_in_long_words(english, text, want):
    assert toxicity.restore(text, english) == want


def test_toxicity(spark):
    rng = random.Random(4)
    clean = ["table", "garden", "window", "river", "stone", "light", "paper", "morning", "summer", "letter"]
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(clean) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["idiot", "moron", "worthless"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    hidden = ["1d10t", "m0r0n", "i.d.i.o.t", "mooooron", "w0rth1ess", "i d i o t"]
    docs += [(1000 + i, f"table garden {w} river") for i, w in enumerate(hidden)] + [(2000, None), (2001, ""), (2002, "table 10 river 2.5 garden")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([*labels, labels[0]], "doc_id long, toxic int")
    model = toxicity.train(df, df, known)
    score = {r["doc_id"]: r["toxicity"] for r in rows(toxicity.scored(df, model))}
    assert all((score[i] >= 0.5) == bool(y) for i, y in labels) and all(0 <= s <= 1 for s in score.values())
    assert all(score[1000 + i] >= 0.5 for i in range(len(hidden))) and max(score[2000], score[2001], score[2002]) < 0.5
    assert score[2000] == score[2001]
    restored = {r["doc_id"]: r["restored"] for r in rows(toxicity.restored_texts(df, model))}
    assert restored[1000] == "table garden idiot river" and restored[2000] is None
    untaught = toxicity.train(df, df, known.where("false"))
    assert all(r["toxicity"] < 0.5 for r in rows(toxicity.scored(df.limit(5), untaught)))
    assert toxicity.scored(empty(spark), model).count() == 0


# --- registered queries ------------------------------------------------------------------------

CONTRACTS = {
    "op1_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op2_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op3_token_counts": "doc_id bigint, n_words bigint, n_tokens bigint",
    "op4_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op5_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean",
    "op6_near_duplicates": "doc_id bigint, class_id bigint",
    "op7_records": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op8_line_dedup": "doc_id bigint, text string",
    "op9_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_registered_query_keeps_its_contract(spark, name):
    found = entry.queries()[name](spark, DATA)
    assert ", ".join(f"{c} {t}" for c, t in found.dtypes) == CONTRACTS[name]
    got = rows(found)
    table, key = ("pages", "page_id") if name == "op4_warc" else ("documents", "doc_id")
    texts = {r[key]: r for r in rows(spark.read.parquet(f"{DATA}/{table}.parquet"))}
    assert {r[key] for r in got} == set(texts) and (name == "op9_packing" or len(got) == len(texts))
    ids = {i: (r["text"] or "") for i, r in texts.items()} if table == "documents" else {}
    for r in got if "held_out" in CONTRACTS[name] else ():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    if name == "op1_language_id":
        fair = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
        assert sum(r["lang_pred"] == texts[r["doc_id"]]["lang"] for r in fair) >= 0.9 * len(fair)
    elif name == "op5_quality_rules":
        for r in got:
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_measure(ids[r["doc_id"]])
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    elif name == "op6_near_duplicates":
        assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(sorted(ids.items()))
    elif name == "op7_records":
        tokenizer, at = Tokenizer.from_file(WORD_BPE), 0
        for r in sorted(got, key=lambda r: r["doc_id"]):
            own = [*tokenizer.encode(ids[r["doc_id"]], add_special_tokens=False).ids, 1]
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
            at += len(own)
    elif name == "op9_packing":
        fill = check_packed(got, ids.items(), 4096, 2)
        assert sum(fill.values()) >= 0.95 * 4096 * (len(fill) - 1)
    elif name == "op10_toxicity":
        labels = {r["doc_id"]: r["toxic"] for r in rows(spark.read.parquet(f"{DATA}/labels.parquet"))}
        assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in got if r["doc_id"] in labels]) > 0.9


# --- pipeline ----------------------------------------------------------------------------------


def brute_lines(docs, min_sites=line_dedup.MIN_SITES, max_share=corpus_pipeline.MAX_SHARE):
    """Texts without the lines of many sites and texts, unless more than ``max_share`` of a text would go."""
    sites, texts = {}, {}
    for text, source in docs.values():
        for line in (text or "").split("\n"):
            sites.setdefault(line.strip(" \t\r"), set()).add(source)
            texts.setdefault(line.strip(" \t\r"), set()).add(text)
    gone = {x for x in sites if x and len(sites[x] - {None}) >= min_sites and len(texts[x]) >= min_sites}
    left = {i: None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in gone) for i, (t, _) in docs.items()}
    return {i: t if t is not None and len(left[i]) < (1 - max_share) * len(t) else left[i] for i, (t, _) in docs.items()}


def test_pipeline_stages_and_result(spark):
    """Each stage against brute force on its own input; the result is the last stage's."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns, result = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before_rows = rows(docs)
        before = {r["doc_id"]: r["text"] for r in before_rows}
        path = new_folder(spark, name)
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "packing":
            result = rows(docs)
            check_packed(result, list(before.items()), packing.WINDOW, 2)
            continue
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in rows(docs)}
        if name == "language_id":
            assert set(after) >= {i for i, t in before.items() if len(t) > 100 and any(c.isalpha() for c in t)}
            assert not any(i in after for i, t in before.items() if not any(c.isalpha() for c in t))
        elif name == "line_dedup":
            assert after == brute_lines({r["doc_id"]: (r["text"], r["source"]) for r in before_rows})
        elif name == "near_dedup":
            assert set(after) == set(brute_classes(sorted(before.items())).values())
        elif name == "decontamination":
            assert set(after) == {w[0] for w in brute_contamination(before.items(), benchmark) if not w[-1]}
    again = rows(corpus_pipeline.run(spark, DATA))
    key = lambda r: (r["doc_id"], r["start"])
    assert [(r["doc_id"], r["start"], r["ids_crc32"]) for r in sorted(again, key=key)] == [(r["doc_id"], r["start"], r["ids_crc32"]) for r in sorted(result, key=key)]
