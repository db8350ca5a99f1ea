"""Operator 8: removes lines that many sites share (cross-site boilerplate), with built-in functions only.

HyperLogLog sketches of each line's sites and of the different texts it is in, merged by aggregation,
estimate how far it is spread. Estimates far from the threshold decide; lines near it get exact
distinct counts. The texts are counted too, so that the copies of one document on many sites don't
make all its lines boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm.shared import broadcast_if_small, written

#: A line on this many distinct sites, in as many different texts, is boilerplate.
MIN_SITES = 10
#: Estimates within this share of the threshold are counted exactly; 15 standard errors at LG_K = 12.
BAND = 0.25
LG_K = 12
BLANKS = " \t\r"


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def _key(text: Column) -> Column:
    """128 bits, so that different lines or texts don't meet."""
    return F.unhex(F.md5(text))


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, site, of (the text's key), at (the line's place) and key of every line that isn't blank.

    Lines are compared without outer blanks.
    """
    texts = docs.select("doc_id", F.col("source").alias("site"), _key(F.col("text")).alias("of"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return texts.where(_bare(F.col("line")) != "").select("doc_id", "site", "of", "at", _key(_bare(F.col("line"))).alias("key"))


def spread_lines(keys: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, lg_k: int = LG_K) -> DataFrame:
    """Keys of the lines on at least ``min_sites`` distinct sites in as many different texts. A null site is no site."""
    least, most = min_sites * (1 - band), min_sites * (1 + band)
    sketched = keys.groupBy("key").agg(*[F.hll_sketch_agg(c, F.lit(lg_k)).alias(c) for c in ("site", "of")], F.count("site").alias("n")).where(F.col("n") >= min_sites)
    spread = F.least(*[F.hll_sketch_estimate(c) for c in ("site", "of")])
    sketched = written(sketched.select("key", spread.alias("spread")).where(F.col("spread") >= least), "line-spread")
    near = broadcast_if_small(sketched.where(F.col("spread") <= most).select("key"))
    there = keys.join(near, "key", "left_semi")
    exact = [there.groupBy("key", c).count().groupBy("key").agg(F.count(c).alias("n")).where(F.col("n") >= min_sites).select("key") for c in ("site", "of")]
    return sketched.where(F.col("spread") > most).select("key").unionByName(exact[0].join(exact[1], "key", "left_semi"))


def remove_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, max_share: float | None = None) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of ``text``; all rows and other columns stay.

    Every line is judged by its spread alone, however short or long, and of texts of any length.
    Null texts stay null and empty ones empty; blank lines stay. Rows with equal doc_id (null too)
    each lose their own lines. With ``max_share`` a document that would lose more than that share of
    its characters is left as it is; that is for callers who remove copies of documents later.
    Columns of any other names may be there.
    """
    keys = written(line_keys(docs), "line-keys")
    spread = broadcast_if_small(written(spread_lines(keys, min_sites), "spread-lines"))
    marks = keys.join(spread, "key", "left_semi").groupBy("doc_id", "of").agg(F.collect_set("at").alias("gone"))
    # The input as one struct, so that no name of its columns can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).alias("d")
    joined = rows.join(marks.alias("m"), F.col("d.doc.doc_id").eqNullSafe(F.col("m.doc_id")) & (_key(F.col("d.doc.text")) == F.col("m.of")), "left")
    lines, text = F.split("doc.text", "\n"), F.col("doc.text")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    left = F.array_join(F.transform(places, lambda at: F.get(lines, at)), "\n")
    kept = F.when(F.col("gone").isNull(), text)
    if max_share is not None:
        kept = kept.when(F.length(left) < (1 - max_share) * F.length(text), text)
    return joined.withColumn("left", kept.otherwise(left)).select(*[F.col("left").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


#: DuckDB SQL for the cleaned texts of ``documents``: exact distinct counts, no sketches.
CLEANED_SQL = rf"""
lines AS (
  SELECT DISTINCT trim(line, E' \t\r') AS line, source, of
  FROM (SELECT source, md5(text) AS of, unnest(string_split(text, chr(10))) AS line FROM {{docs}})),
spread AS (
  SELECT line FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES} AND count(DISTINCT of) >= {MIN_SITES}),
cleaned AS (
  SELECT d.* REPLACE (CASE WHEN d.text IS NULL THEN NULL ELSE coalesce((SELECT string_agg(s.line, chr(10) ORDER BY s.i) FROM
      (SELECT unnest(string_split(d.text, chr(10))) AS line, unnest(range(len(string_split(d.text, chr(10))))) AS i) s
      WHERE trim(s.line, E' \t\r') NOT IN (SELECT line FROM spread)), '') END AS text)
  FROM {{docs}} d)
"""
