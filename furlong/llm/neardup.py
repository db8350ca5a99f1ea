"""Operator 6: near-duplicates by improved consistent weighted sampling over TF-IDF word shingles.

A document is the weighted set of its five-word shingles: term frequency times smoothed inverse
document frequency. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples of it so
that two documents' samples agree as often as their weighted Jaccard similarity; documents that agree
on a whole band are candidates. Candidates are verified by their exact weighted Jaccard similarity,
and linked documents form classes.

Document frequencies are counted over all documents in 2**20 hashed buckets, so the table's size is
fixed; what the median bucket holds is taken off, so that chance collisions don't make rare shingles
look common. The inverse document frequency is damped, ln(1 + N / df) ** DAMPING: in a large group
of copies the shared shingles are common and the edits unique, and the undamped one would push
copies of similarity 0.8 and more far below it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm.shared import CACHE_WORDS, MAX_BROADCAST_ROWS, broadcast_if_small, in_blocks, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
BUCKETS = 1 << 20
DAMPING = 0.25
#: Rows of the table of random variates; a shingle's hash picks one.
POOL = 1 << 15
SEED = 20_240_607
#: Candidates of a group are compared by their draws in blocks of about this many; pairs with fewer
#: agreeing draws of ``BANDS * ROWS`` are below the threshold (at 0.8, but for one in 50,000).
BLOCK, LEAST_AGREEING = 512, 38
#: Rows of one key, or pairs of one leader, that a task gets, at least.
HOT_ROWS = 1_000
WORDS = re.compile(r"\w+")
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered in a worker."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, texts: list[list[str]]) -> np.ndarray:
        new = set().union(*texts).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {}
            new = set().union(*texts)
        self.known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.uint64, sum(map(len, texts)))


_HASHES = WordHashes()


def words_of(text: str) -> list[str]:
    """Lower-case runs of word characters."""
    return WORDS.findall(text.lower())


def shingled(split: list[list[str]], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingle hashes (sorted) and their counts for the words of each text.

    A text of fewer words than ``size`` is one shingle; one without words has none.
    """
    lengths = np.array([len(words) for words in split], np.int64)
    hashes = _HASHES.of(split)
    rolled = hashes.copy()
    for j in range(1, size):
        rolled[:-j or None] = rolled[:-j or None] * ODD + hashes[j:]
    ends = np.cumsum(lengths)
    first, parts = np.zeros(len(split), np.int64), []
    for i, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
        if n < size:  # its own hash, from its own words only
            value = np.uint64(0)
            for h in hashes[end - n : end]:
                value = value * ODD + h
            part = np.array([value] if n else [], np.uint64)
        else:
            part = rolled[end - n : end - size + 1]
        parts.append(part)
    sizes = np.array([len(x) for x in parts], np.int64)
    every = mixed(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    stops = np.cumsum(sizes)
    first = stops - sizes
    for a, b in zip(first.tolist(), stops.tolist(), strict=True):
        every[a:b].sort()
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    new[first[sizes > 0]] = True
    at = np.flatnonzero(new)
    counts = np.diff(at, append=len(every))
    distinct = every[at]
    cuts = np.searchsorted(at, stops)
    return [(distinct[a:b], counts[a:b]) for a, b in zip(np.concatenate([[0], cuts[:-1]]).tolist(), cuts.tolist(), strict=True)] if len(split) else []


def shingles(texts: list[str], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for texts."""
    with np.errstate(over="ignore"):
        return shingled([words_of(t) for t in texts], size)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents of each bucket of shingles, and documents with any shingle; over all rows of ``docs``.

    Each task sends its table as compressed blocks of 4096 buckets, which are added up by block.
    """
    block = 4096

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(BUCKETS, np.int32), 0
        for batch in batches:
            for texts in in_blocks(t or "" for t in batch["text"]):
                sets = [h for h, _ in shingles(texts) if len(h)]
                n += len(sets)
                if sets:
                    total += np.bincount(bucket(np.concatenate(sets)), minlength=BUCKETS).astype(np.int32)
        if n:
            parts = total.reshape(-1, block)
            yield pd.DataFrame({"block": np.arange(len(parts)), "counts": [p.tobytes() for p in parts], "n": np.where(np.arange(len(parts)) == 0, n, 0)})

    def add(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(block, np.int64), 0
        for batch in batches:
            n += int(batch["n"].sum())
            for counts in batch["counts"]:
                total += np.frombuffer(counts, np.int32)
        yield pd.DataFrame({"block": [key[0]], "counts": [total.tobytes()], "n": [n]})

    schema = "block long, counts binary, n long"
    summed = docs.select("text").mapInPandas(count, schema).groupBy("block").applyInPandas(add, schema)
    out, n = np.zeros(BUCKETS, np.int64), 0
    for r in summed.toLocalIterator():  # BUCKETS / block rows
        out[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["counts"], np.int64)
        n += r["n"]
    return out, n


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    """The damped inverse document frequency of each bucket, 1 for a shingle of one document."""
    if not n:
        return np.ones(BUCKETS, np.float32)
    own = np.maximum(df - np.median(df), 1)
    return ((np.log1p(n / own) / np.log1p(n)) ** DAMPING).astype(np.float32)


def parts(x: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """``x`` in pieces."""
    for start in range(0, len(x), size):
        yield x[start : start + size]


class Sampler:
    """Improved consistent weighted sampling with variates from a fixed pool."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        rng = np.random.default_rng(SEED)
        k = bands * rows
        r = rng.gamma(2, 1, (POOL, k))
        beta, c = rng.random((POOL, k)), rng.gamma(2, 1, (POOL, k))
        # t = floor(ln w / r + beta); ln a = ln c - r (t - beta) - r
        self.r, self.inverse, self.beta = (x.astype(np.float32) for x in (r, 1 / r, beta))
        self.base = (np.log(c) + r * beta - r).astype(np.float32)
        self.bands, self.rows = bands, rows
        self.salt = mixed(np.arange(1, k + 1, dtype=np.uint64) * ODD)

    def samples(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A 64-bit value for each of the draws; two sets agree on it if their draws do.

        ln a is ``base`` for a weight of 1 and at least that for a lesser one. So most shingles are only
        looked at more closely in the draws where ``base`` is not above the least ln a so far.
        """
        pool = (hashes >> np.uint64(64 - 15)).astype(np.int64)
        logs = np.log(weights).astype(np.float32)
        draws = np.arange(self.bands * self.rows)
        best, at, level = np.full(len(draws), np.inf, np.float32), np.zeros(len(draws), np.int64), np.zeros(len(draws), np.float32)

        def least(i: np.ndarray, a: np.ndarray, t: np.ndarray | None = None) -> None:
            """Take the least of all draws of the shingles ``i``; of equal ones the first stays."""
            low, first = a.min(0), np.empty(len(draws), np.int64)
            row, draw = np.divmod(np.flatnonzero(a == low), len(draws))
            first[draw[::-1]] = row[::-1]
            who = i[first]
            better = (low < best) | ((low == best) & (who < at))
            best[better], at[better] = low[better], who[better]
            level[better] = 0 if t is None else t[first, draws][better]

        def all_draws(i: np.ndarray) -> None:
            rows = pool[i]
            t = np.floor(self.inverse[rows] * logs[i, None] + self.beta[rows])
            least(i, self.base[rows] - self.r[rows] * t, t)

        one, more, less = np.flatnonzero(logs == 0), np.flatnonzero(logs > 0), np.flatnonzero(logs < 0)
        for i in parts(one, 1024):
            least(i, self.base.take(pool[i], 0))
        some = max(0, 16 - len(one) - len(more))
        for i in parts(np.concatenate([more, less[:some]]), 1024):
            all_draws(i)
        for i in parts(less[some:], 1024):
            near, draw = np.divmod(np.flatnonzero(self.base.take(pool[i], 0) <= best), len(draws))
            near = i[near]
            rows = pool[near]
            t = np.floor(self.inverse[rows, draw] * logs[near] + self.beta[rows, draw])
            a = self.base[rows, draw] - self.r[rows, draw] * t
            left = a <= best[draw]
            for x, j, y, z in zip(near[left].tolist(), draw[left].tolist(), a[left], t[left], strict=True):
                if y < best[j] or (y == best[j] and x < at[j]):
                    best[j], at[j], level[j] = y, x, z
        return mixed(hashes[at] ^ mixed(level.astype(np.int64).view(np.uint64) + self.salt))

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        """A hash for each band; equal if all draws of the band are."""
        keys = np.zeros(self.bands, np.uint64)
        for column in samples.reshape(self.bands, self.rows).T:
            keys = mixed(keys * ODD + column)
        return keys.view(np.int64)


_SAMPLER: list[Sampler] = []


def signatures(docs: DataFrame, idf: Broadcast) -> DataFrame:
    """One row for each row of ``docs``: doc_id, of, same, bands and draws.

    ``of`` is 128 bits of the text, ``same`` of its sequence of words (null without words); ``bands``
    are the band keys, and ``draws`` a byte of each draw.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not _SAMPLER:
            _SAMPLER.append(Sampler())
        sampler = _SAMPLER[0]
        for batch in batches:
            rows = []
            for texts in in_blocks(t or "" for t in batch["text"]):
                split = [words_of(t) for t in texts]
                with np.errstate(over="ignore"):
                    for words, (h, n) in zip(split, shingled(split), strict=True):
                        if words:
                            draws = sampler.samples(h, n * idf.value[bucket(h)])
                            rows.append((xxhash.xxh3_128_digest(" ".join(words)), sampler.band_keys(draws), (draws >> np.uint64(56)).astype(np.uint8).tobytes()))
                        else:
                            rows.append((None, np.zeros(0, np.int64), None))
            out = pd.DataFrame(rows, columns=["same", "bands", "draws"])
            yield out.assign(doc_id=batch["doc_id"].astype("Int64").to_numpy(), of=batch["of"].to_numpy())[["doc_id", "of", "same", "bands", "draws"]]

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("of"), "text")
    return keyed.mapInPandas(sign, "doc_id long, of binary, same binary, bands array<long>, draws binary")


def text_key(text: Column) -> Column:
    """128 bits of a text; null is as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Each row with the columns of its group, whose size is ``n``; ``total`` bounds the number of rows.

    Large groups are few, at most total / hot, so they are broadcast; rows of the others are shuffled.
    So no task gets more than ``hot`` rows of one key, however large a group is.
    """
    hot = max(HOT_ROWS, total // MAX_BROADCAST_ROWS)
    heavy, light = groups.where(F.col("n") > hot), groups.where(F.col("n") <= hot)
    columns = [*rows.columns, *(c for c in groups.columns if c not in keys)]
    spread = rows.join(F.broadcast(heavy), keys)  # at most MAX_BROADCAST_ROWS rows
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return spread.select(*columns).unionByName(rest.select(*columns))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two weighted shingle sets."""
    wa, wb = a[1] * idf[bucket(a[0])].astype(float), b[1] * idf[bucket(b[0])].astype(float)
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(wa[i], wb[j]).sum()
    total = wa.sum() + wb.sum() - common
    return common / total if total else 0.0


def verified(pairs: DataFrame, texts: DataFrame, idf: Broadcast, threshold: float) -> DataFrame:
    """The pairs (a, b), a leader and a member, whose texts (node, text) are similar enough.

    A member is in few pairs. A leader of many gets a copy of its text for each ``HOT_ROWS`` of them,
    and its members are dealt over the copies.
    """

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[int, tuple] = {}
            good = []
            for a, b, text_a, text_b in batch.itertuples(index=False):
                if a not in known:
                    known = {a: shingles([text_a])[0]}  # rows come by leader
                good.append(similarity(known[a], shingles([text_b])[0], idf.value) >= threshold)
            yield batch.loc[good, ["a", "b"]]

    leaders = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("copies", F.ceil(F.col("n") / HOT_ROWS).cast("int"))
    dealt = with_group(pairs, leaders, ["a"], pairs.count()).withColumn("copy", F.pmod(F.xxhash64("b"), "copies").cast("int"))
    of_members = dealt.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    of_leaders = texts.join(leaders, F.col("node") == F.col("a")).select("a", F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    joined = of_members.join(of_leaders, ["a", "copy"])
    return joined.select("a", "b", "text_a", "text_b").mapInPandas(keep, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of the edges (a, b).

    Rounds of large-star and small-star: each node hangs its greater neighbours, then its smaller
    ones, on its least neighbour. Each round is written to the shared folder, which cuts lineage; a
    count and a sum of hashes tell when nothing changes any more.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before, now = None, state(edges)
    while now != before and now[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = with_group(both.where("v > u"), least, ["u"], 2 * now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hung = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")  # a node has few lesser neighbours
        small = hung.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = written(small, "edges")
        before, now = now, state(edges)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def groups_of(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, when the batches are sorted by it."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        values = batch[keys].to_numpy()
        starts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1).tolist()]
        for start, end in zip(starts, starts[1:], strict=False):
            yield batch.iloc[start:end]
        held = batch.iloc[starts[-1] :]
    if held is not None and len(held):
        yield held


def links_in(group: pd.DataFrame, idf: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between classes in one block of a group of candidates: those of side 1 with those of side 0.

    Only pairs whose draws agree often enough are compared exactly, the likeliest first, and none
    whose classes are already linked here; so there are fewer links than classes. A pair that shares
    several bands is left to the block of the first; which it is, the full band keys tell, since the
    bytes of the draws may be equal in a band whose keys, and so groups, differ.
    """
    doc, root, side, texts = (group[c].to_numpy() for c in ("doc", "root", "side", "text"))
    draws = np.frombuffer(b"".join(group["draws"]), np.uint8).reshape(len(group), -1)
    keys = np.stack(group["bands"].to_numpy())
    band = int(group["band"].iloc[0])
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            x = y
        return x

    known: dict[int, tuple] = {}

    def set_of(i: int) -> tuple:
        if i not in known:
            known[i] = shingles([texts[i]])[0]
        return known[i]

    out, others = [], np.flatnonzero(side == 0)
    for j in np.flatnonzero(side == 1).tolist():
        agree = (draws[others] == draws[j]).sum(1)
        likely = np.flatnonzero((agree >= LEAST_AGREEING) & (root[others] != root[j]))
        for k in likely[np.argsort(-agree[likely], kind="stable")].tolist():
            i = int(others[k])
            x, y = top(int(root[i])), top(int(root[j]))
            if x != y and (keys[i] == keys[j]).argmax() == band and similarity(set_of(i), set_of(j), idf) >= threshold:
                up[max(x, y)] = min(x, y)
                out.append((int(doc[i]), int(doc[j])))
    return out


def remaining_links(members: DataFrame, stands: DataFrame, roots: DataFrame, texts: DataFrame, idf: Broadcast, threshold: float) -> DataFrame:
    """Links of candidates of one group that the leaders left in different classes.

    In each such group the members outside the class of its least root meet all members, in blocks of
    about ``BLOCK``; a group that is one class is not looked at. ``stands`` has the band keys and
    draws of each member.
    """
    rooted = written(members.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc")), "rooted")
    total, keys = rooted.count(), ["band", "key"]
    groups = rooted.groupBy(*keys).agg(F.min("root").alias("main"), F.max("root").alias("other"), F.count("*").alias("n")).where("main <> other")
    opened = written(with_group(rooted, groups, keys, total).drop("other"), "open-groups")
    open_groups = opened.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(F.col("root") != F.col("main"), 1)).alias("rest"))
    found = with_group(opened.drop("n"), open_groups, keys, total)
    found = found.join(stands.select(F.col("node").alias("doc"), "bands", "draws"), "doc").join(texts.withColumnRenamed("node", "doc"), "doc")
    blocks, rest_blocks = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("n", "rest"))
    spread = F.xxhash64("doc")
    side0 = F.transform(F.sequence(F.lit(0), rest_blocks - 1), lambda y: F.struct(F.pmod(spread, blocks).cast("int").alias("x"), y.alias("y"), F.lit(0).alias("side")))
    side1 = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(x.alias("x"), F.pmod(spread, rest_blocks).cast("int").alias("y"), F.lit(1).alias("side")))
    placed = found.withColumn("at", F.explode(F.when(F.col("root") != F.col("main"), F.concat(side0, side1)).otherwise(side0)))
    keys = ["band", "key", "x", "y"]
    dealt = placed.select("band", "key", "at.*", "doc", "root", "bands", "draws", "text").repartition(*keys).sortWithinPartitions(*keys)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups_of(batches, keys):
            if found := links_in(group, idf.value, threshold):
                yield pd.DataFrame(found, columns=["a", "b"])

    return dealt.mapInPandas(link, "a long, b long")


def classified(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, of (the text's key) and first, for every row of ``docs``.

    ``first`` (none, doc_id, of) tells the class's row with the least doc_id, of those the least
    ``of``; null ids come last. It is null for a text without words.
    """
    spark = docs.sparkSession
    df, n = document_frequencies(docs)
    idf = spark.sparkContext.broadcast(inverse_frequencies(df, n))
    signed = written(signatures(docs, idf), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "of"))
    stands = signed.where("same is not null").groupBy("same").agg(first.alias("first"), F.any_value("bands").alias("bands"), F.any_value("draws").alias("draws"), F.count("*").alias("n"))
    stands = written(stands.withColumn("node", F.monotonically_increasing_id()), "stand-ins")
    most = stands.count() * BANDS

    members = stands.select(F.col("node").alias("doc"), F.posexplode("bands").alias("band", "key"))
    sizes = members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = with_group(members, sizes, ["band", "key"], most)
    # Who shares bands with most others is nearest to what a group's copies were made from.
    known_by = members.groupBy("doc").agg(F.sum("n").alias("known_by"))
    members = written(members.drop("n").join(known_by, "doc"), "candidates")
    order = F.xxhash64("doc")
    heads = written(members.groupBy("band", "key").agg(F.max_by("doc", F.struct("known_by", order)).alias("l1"), F.min_by("doc", order).alias("l2"), F.count("*").alias("n")), "heads")
    wanted = members.select(F.col("doc").alias("node")).distinct().join(stands.select("node", "first.doc_id", "first.of"), "node")
    wanted = broadcast_if_small(written(wanted, "wanted"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("key"), "text")
    texts = keyed.join(wanted, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("of"))).select("node", "text").dropDuplicates(["node"])
    texts = written(texts, "texts")

    pairs = with_group(members, heads, ["band", "key"], most).select(F.explode(F.array("l1", "l2")).alias("a"), F.col("doc").alias("b")).where("a <> b").distinct()
    links = written(verified(written(pairs, "pairs"), texts, idf, threshold), "links")
    roots = written(components(links), "classes")
    more = remaining_links(members.select("band", "key", "doc"), stands, roots, texts, idf, threshold)
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
    joined = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    top = broadcast_if_small(written(components(joined).select(F.col("node").alias("root"), F.col("root").alias("top")), "top-classes"))

    # Nodes without a link are their own classes; those of `top` may have had none before.
    linked = roots.unionByName(top.join(roots, "root", "left_anti").select(F.col("root").alias("node"), "root")).join(top, "root", "left").select("node", F.coalesce("top", "root").alias("class"))
    linked = written(linked.join(stands.select("node", "first"), "node"), "linked")
    firsts = linked.groupBy("class").agg(F.min("first").alias("class_first"), F.count("*").alias("n"))
    of_linked = with_group(linked.select("node", "class"), firsts, ["class"], most).select("node", "class_first")
    told = written(stands.select("node", "same", "n", "first").join(of_linked, "node", "left").select("same", "n", F.coalesce("class_first", "first").alias("first")), "told")
    rows = signed.select("doc_id", "of", "same")
    known = with_group(rows.where("same is not null"), told, ["same"], most).select("doc_id", "of", "first")
    return known.unionByName(rows.where("same is null").select("doc_id", "of", F.lit(None).cast(known.schema["first"].dataType).alias("first")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) for every row of ``docs``.

    Rows with the same sequence of words are one class; one stand-in of each is compared. In each
    group of candidates all are compared with two leaders; members that this leaves in different
    classes are then compared in blocks by their draws and, where those agree and the classes are
    still apart, exactly. So no group of copies is expanded into all its pairs, and none is capped.
    Documents without words (null, empty) are each a class of their own. A row with a null doc_id is
    compared like any other; a class of only such rows has the class_id null. Rows with equal doc_id
    are each told by their own text. Texts may be of any length; other columns are ignored.
    """
    found = classified(docs, threshold)
    return found.select("doc_id", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, that with the least doc_id, of those the text with the least MD5; all columns stay.

    Rows with equal doc_id and equal text are one document and stay or go together; texts without
    words all stay. Columns of any other names may be there.
    """
    others = classified(docs, threshold).where(F.col("first").isNotNull() & ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("of") == F.col("first.of"))))
    others = broadcast_if_small(written(others.select("doc_id", "of").distinct(), "copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(others, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (text_key(F.col("row.text")) == F.col("of")), "left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
