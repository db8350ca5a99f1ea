"""Operator 2: finds and removes benchmark passages in documents, with built-in functions only.

Windows of 13 words of each benchmark item are hashed into a set. Each document's windows are hashed
by doubling (a hash of 2 words from two of 1, of 4 from two of 2, ...; 13 words are two overlapping
windows of 8), so a position costs five hashes and not thirteen. Positions whose hash is in the set
are verified by the window's words. The set is a literal of the plan, which Spark sends to each
executor, as long as the benchmark has at most ``max_set`` windows. Hashes of a larger one are a table of 8
bytes a row, sent to the executors up to ``MAX_BROADCAST_ROWS`` and joined beyond; only documents with a hit go on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm.shared import broadcast_if_small, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word and what is before it, in a text as it is.
WORD_AND_BEFORE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SIZE = 13
#: Most windows that are sent as a set: about 20 MB with their words.
MAX_SET = 200_000


def words_of(text: Column) -> Column:
    """The words of a text; none if it is null."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN, -1), ""), F.array().cast("array<string>"))


def windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """item_id (text), k (words of the window) and the window's words; a shorter item is one window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("k", F.least(F.size("w"), F.lit(size)))
    at = items.select("item_id", "w", "k", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1)).alias("i"))
    return at.select("item_id", "k", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("window")).distinct()


def _pairs(hashes: str, apart: int) -> Column:
    """Hashes of the elements that are ``apart`` places apart."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + apart), n), lambda a, b: F.xxhash64(a, b))


def with_window_hashes(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Add ``_w`` (the words of ``_text``) and, for each k of ``sizes``, ``_of{k}``: the hash of every window of k words."""
    out = docs.withColumn("_w", words_of(F.col("_text"))).withColumn("_h1", F.transform("_w", lambda x: F.xxhash64(x)))
    p = 1
    while p <= max(sizes, default=0):
        for k in (k for k in sizes if p <= k < 2 * p):
            out = out.withColumn(f"_of{k}", F.col(f"_h{p}") if k == p else _pairs(f"_h{p}", k - p))
        if 2 * p <= max(sizes):
            out = out.withColumn(f"_h{2 * p}", _pairs(f"_h{p}", p))
        p *= 2
    return out


class Benchmark:
    """The windows of a benchmark, ready to be looked for."""

    def __init__(self, benchmark: DataFrame, size: int = SIZE, max_set: int = MAX_SET):
        self.windows = windows(benchmark, size)
        counts = {r["k"]: r["n"] for r in self.windows.groupBy("k").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
        self.sizes, self.count = sorted(counts), sum(counts.values())
        self.texts: dict[int, list[str]] | None = None
        if self.count <= max_set:
            self.texts = {k: [] for k in self.sizes}
            for r in self.windows.select("k", "window").distinct().collect():
                self.texts[r["k"]].append(r["window"])
        self.hashes = {}
        if self.texts:
            for k in self.sizes:
                of_k = self.windows.where(F.col("k") == k).select(F.col("window").alias("_text"))
                self.hashes[k] = [r[0] for r in with_window_hashes(of_k, [k]).select(F.element_at(f"_of{k}", 1)).distinct().collect()]

    def hash_table(self) -> DataFrame:
        """(k, hash) of all windows, written."""
        texts = self.windows.select("k", F.col("window").alias("_text"))
        each = [with_window_hashes(texts.where(F.col("k") == k), [k]).select("k", F.element_at(f"_of{k}", 1).alias("hash")) for k in self.sizes]  # `size` at most
        return written(reduce(DataFrame.unionByName, each).distinct(), "window-hashes")


def _placed(k: int, wanted: list[int]) -> Column:
    """(place, k, words) of each window of k words; null where its hash is not wanted."""

    def window(x: Column, i: Column) -> Column:
        at = F.struct(i.alias("at"), F.lit(k).alias("k"), F.array_join(F.slice("_w", i + 1, F.lit(k)), " ").alias("window"))
        return F.when(x.isin(wanted), at)

    return F.transform(f"_of{k}", window)


def _hashed(k: int) -> Column:
    """(place, k, hash) of each window of k words."""
    return F.transform(f"_of{k}", lambda x, i: F.struct(i.alias("at"), F.lit(k).alias("k"), x.alias("hash")))


def _verified(k: int, benchmark: Benchmark) -> Column:
    """The windows of k words that the benchmark has, by hash and then by words."""
    return F.filter(_placed(k, benchmark.hashes[k]), lambda h: h.isNotNull() & h["window"].isin(benchmark.texts[k]))


def with_hits(docs: DataFrame, benchmark: Benchmark) -> DataFrame:
    """``docs`` with ``_n`` (words) and ``_hits``: (place from 0, k, window) of each verified window in ``text``.

    Needs no shuffle: it is for benchmarks that fit in the set. A filter on the hits must also name
    ``_at``, a row number: it keeps the optimizer from moving the filter below and there computing
    all hashes again for each place where it uses them.
    """
    hashed = with_window_hashes(docs.withColumn("_text", F.col("text")), benchmark.sizes)
    found = [_verified(k, benchmark) for k in benchmark.sizes]
    none = F.array().cast("array<struct<at:int,k:int,window:string>>")
    return hashed.select(*docs.columns, F.size("_w").alias("_n"), (F.concat(*found) if found else none).alias("_hits"), F.monotonically_increasing_id().alias("_at"))


def _n_hit(hits: Column) -> Column:
    """Words that a window covers."""
    return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["k"] - 1)))))


def _is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_set: int = MAX_SET) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted ids), hit places, contaminated.

    Null texts have no words, and neither they nor empty ones are contaminated. Rows with equal
    doc_id are judged each on its own. Items without words have no window. Extra columns are ignored.
    """
    bench = Benchmark(benchmark, size, max_set)
    docs = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    return _judged(docs if bench.texts is not None else written(docs, "numbered"), bench).drop("_row")


def _judged(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """The same with ``_row``, which numbers the rows of ``docs`` (doc_id, text, _row)."""
    if bench.texts is None:
        return _judged_by_join(docs, bench)
    rows = with_hits(docs, bench).select("_row", "doc_id", F.col("_n").alias("n_words"), F.explode_outer("_hits").alias("h")).select("_row", "doc_id", "n_words", "h.*")
    items = F.broadcast(bench.windows.groupBy("window").agg(F.collect_set("item_id").alias("ids")))  # at most max_set rows
    # Rows without a window get a key of their own, so that they don't meet in one task.
    rows = rows.withColumn("_key", F.coalesce("window", F.concat(F.lit("\0"), F.col("_row").cast("string"))))
    joined = rows.join(items.withColumnRenamed("window", "_key"), "_key", "left")
    hit = F.when(F.col("ids").isNotNull(), F.struct("at", "k"))
    return _counted(joined.groupBy("_row", "doc_id", "n_words").agg(_hits_of(hit), _items_of("ids")))


def _hits_of(hit: Column) -> Column:
    return F.sort_array(F.collect_set(hit)).alias("hits")


def _items_of(ids: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(ids)))).alias("items")


def _counted(grouped: DataFrame) -> DataFrame:
    """Counts and verdict of rows (_row, doc_id, n_words, hits, items)."""
    out = grouped.withColumn("n_hit", _n_hit(F.col("hits")).cast("long"))
    return out.select("_row", "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), "items", "hits", _is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def _judged_by_join(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """``_judged`` for a benchmark that doesn't fit in the set; ``docs`` must be a written table.

    Places whose hash the benchmark has are found by a semi-join of (k, hash, place); words are looked at
    for these places alone, and neither texts nor windows of documents without such a place are shuffled.
    """
    hashed = with_window_hashes(docs.select("_row", F.col("text").alias("_text")), bench.sizes)
    each = F.concat(*[_hashed(k) for k in bench.sizes])
    places = hashed.select("_row", F.explode(each).alias("h")).select("_row", "h.*").join(broadcast_if_small(bench.hash_table()), ["k", "hash"], "left_semi")
    found = written(places.groupBy("_row").agg(F.collect_list(F.struct("at", "k")).alias("found")), "found-windows")
    words = docs.select("_row", "text").join(broadcast_if_small(found.select("_row")), "_row", "left_semi").join(found, "_row").select("_row", words_of(F.col("text")).alias("_w"), "found")
    window = F.transform("found", lambda h: F.struct(h["at"].alias("at"), h["k"].alias("k"), F.array_join(F.slice("_w", h["at"] + 1, h["k"]), " ").alias("window")))
    items = bench.windows.groupBy("window").agg(F.collect_set("item_id").alias("ids"))
    hits = words.select("_row", F.explode(window).alias("h")).select("_row", "h.*").join(items, "window")
    of_row = hits.groupBy("_row").agg(_hits_of(F.struct("at", "k")), _items_of("ids"))
    all_rows = docs.select("_row", "doc_id", F.size(words_of(F.col("text"))).alias("n_words")).join(of_row, "_row", "left")
    none = {"hits": "array<struct<at:int,k:int>>", "items": "array<string>"}
    return _counted(all_rows.select("_row", "doc_id", "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = SIZE, max_set: int = MAX_SET) -> DataFrame:
    """``docs`` without contaminated rows (``remove="documents"``) or without the words that windows cover (``"spans"``).

    Clean rows and all columns stay as they are, null and empty texts too. Columns of any names may be there.
    """
    bench = Benchmark(benchmark, size, max_set)
    # The input as one struct, so that no name of its columns can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text"))
    if bench.texts is None:
        numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        judged = _judged(numbered.select("doc.doc_id", "text", "_row"), bench)
        if remove == "documents":
            return _unwrapped(numbered.join(judged.where("contaminated").select("_row"), "_row", "left_anti"), docs)
        hits = numbered.join(judged.select("_row", F.col("hits").alias("_hits")), "_row")
    else:
        hits = with_hits(rows, bench)
        if remove == "documents":
            return _unwrapped(hits.where(~_is_contaminated(_n_hit(F.col("_hits")), F.col("_n")) & (F.col("_at") >= 0)), docs)
    covered = F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(h["at"], h["at"] + h["k"] - 1))))
    left = F.array_join(F.filter(F.regexp_extract_all("text", F.lit(f"({WORD_AND_BEFORE})"), F.lit(1)), lambda x, i: ~F.array_contains(F.col("_covered"), i)), "")
    text = F.when(F.size("_covered") > 0, F.concat(left, F.regexp_extract("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0))).otherwise(F.col("text"))
    return _unwrapped(hits.withColumn("_covered", covered).withColumn("text", text), docs)


def _unwrapped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, of which ``text`` may have changed."""
    return rows.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


#: DuckDB SQL for the judged rows of {docs} against ``benchmark``: plain windows and joins.
JUDGED_SQL = rf"""
bench_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bench_windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(len(w), {SIZE}) - 1], ' ') AS win, least(len(w), {SIZE}) AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {SIZE}) + 2)) AS i FROM bench_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM {{docs}}),
doc_windows AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM bench_windows))),
found AS (SELECT d.doc_id, d.i, d.k, b.item_id FROM doc_windows d JOIN bench_windows b ON d.win = b.win AND d.k = b.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY doc_id),
judged AS (
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256,
    coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
  FROM doc_words d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id))
"""
