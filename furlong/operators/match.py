"""Linking rows of different sources: exact keys, times within a tolerance, likeness of names and cards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro-Winkler likeness; half transpositions count and a common beginning always adds."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    if not mine:
        return 0.0
    theirs = [ch for ch, t in zip(b, taken, strict=True) if t]
    m, half = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    start = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * start * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null where either name is."""
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Likeness of two sets given as arrays; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def _at_times(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The distinct keys and times (``_t``) of ``left``, and those of ``right`` with the row ``_r`` that is first in ``order`` and the count ``_n``."""
    rest = [c for c in right.columns if c not in keys]
    asked = left.select(*keys, F.col(left_time).alias("_t")).distinct()
    return asked, right.groupBy(*keys, F.col(right_time).alias("_t")).agg(F.min_by(F.struct(*rest), order).alias("_r"), F.count("*").alias("_n"))


def _rejoined(left: DataFrame, found: DataFrame, keys: list[str], left_time: str, *more: str) -> DataFrame:
    """``left`` with the columns of ``_r`` that were found for its keys and time, and ``more``."""
    found = found.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_t", "_r", *more)
    same = F.col(left_time).eqNullSafe(F.col("_t"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_of_{k}"))
    return left.join(found, same).select(*left.columns, "_r.*", *more)


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, order: str, high: float = 25) -> DataFrame:
    """For each left row the right row of its key that is nearest in time, the first in ``order`` on ties.

    Times are numbers (``high`` is in their unit); ``apart`` is their distance, and ``confidence`` high for a lone candidate
    or one within ``high``, low without a time, else medium. Without a time the first in ``order`` is taken. Both sides are
    reduced to one row a key and time, and the nearest ones are the last before and after it: no left row meets all right ones.
    """
    asked, at = _at_times(left, right, keys, left_time, right_time, order)
    both = at.unionByName(asked.withColumn("_q", F.lit(1)), allowMissingColumns=True).groupBy(*keys, "_t").agg(F.any_value("_r", True).alias("_r"), F.max("_n").alias("_n"), F.max("_q").alias("_q"))
    key, timed = Window.partitionBy(*keys), F.when(F.col("_t").isNotNull(), F.col("_r"))
    # Descending rather than unbounded following: a frame that only grows takes one step a row.
    sides = {"_before": key.orderBy("_t"), "_after": key.orderBy(F.desc("_t"))}
    seen = both.withColumns({c: F.last(timed, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c, w in sides.items()})
    seen = seen.withColumn("_any", F.min_by("_r", F.col(f"_r.{order}")).over(key)).withColumn("_all", F.sum("_n").over(key)).where("_q = 1 and _all > 0")
    gap = {c: F.abs(F.col("_t") - F.col(f"{c}.{right_time}")) for c in sides}
    tie = (gap["_before"] == gap["_after"]) & (F.col(f"_before.{order}") <= F.col(f"_after.{order}"))
    nearer = F.when(F.col("_t").isNull(), F.col("_any")).when(gap["_after"].isNull() | (gap["_before"] < gap["_after"]) | tie, F.col("_before")).otherwise(F.col("_after"))
    found = seen.withColumn("_r", F.coalesce(nearer, "_any")).withColumn("apart", F.abs(F.col("_t") - F.col(f"_r.{right_time}")))
    sure = F.when((F.col("_all") == 1) | (F.col("apart") <= high), "high").when(F.col("apart").isNull(), "low").otherwise("medium")
    return _rejoined(left, found.withColumn("confidence", sure), keys, left_time, "apart", "confidence")


def first_within(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, order: str, most: float = 5) -> DataFrame:
    """For each left row the first right row in ``order`` at its exact time, else the first at most ``most`` apart.

    Distinct times meet those of the same and the neighbouring spans of ``most``, by an equi-join.
    """
    asked, at = _at_times(left, right, keys, left_time, right_time, order)
    span = F.floor(F.col("_t") / most)
    near = at.withColumn("_span", F.explode(F.array(span - 1, span, span + 1))).withColumnRenamed("_t", "_at")
    pairs = asked.withColumn("_span", span).join(near, [*keys, "_span"]).withColumn("apart", F.abs(F.col("_t") - F.col("_at"))).where(F.col("apart") <= most)
    first = F.min_by(F.struct("_r", "apart"), F.struct(F.col("apart") > 0, F.col(f"_r.{order}"))).alias("_first")
    return _rejoined(left, pairs.groupBy(*keys, "_t").agg(first).select(*keys, "_t", "_first.*"), keys, left_time, "apart")


def by_either(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_id: str, order: str, on: list[str]) -> DataFrame:
    """Match within ``on`` by the first of several key columns that has a partner: equi-joins, no OR.

    ``matched_on`` is the place of that key (from 0); of several partners the first in ``order`` is taken.
    """
    parts = None
    for i, (a, b) in enumerate(keys):
        named = left.where(F.col(a) != "").withColumn("_key", F.col(a))
        part = named.join(right.withColumn("_key", F.col(b)), [*on, "_key"]).drop("_key").withColumn("matched_on", F.lit(i))
        parts = part if parts is None else parts.unionByName(part)
    rank = F.row_number().over(Window.partitionBy(left_id).orderBy("matched_on", order))
    return parts.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


#: Letters from rare to frequent, for picking the letters by which names are looked up; any order gives the same pairs.
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate"


def letters_of(name: str | Column) -> Column:
    """A name's characters, each with its number among equal ones, rare letters first."""
    name = F.col(name) if isinstance(name, str) else name
    order = F.translate(name, RARE_FIRST, "".join(chr(1 + i) for i in range(len(RARE_FIRST))))
    sorted_ = F.array_sort(F.filter(F.split(order, ""), lambda c: c != ""))
    return F.transform(sorted_, lambda c, i: F.concat_ws("#", c, (i - F.array_position(sorted_, c)).cast("string")))


def least_shared(name: str, jaro: float) -> Column:
    """How many characters a name shares at least with one whose Jaro likeness is ``jaro`` or more.

    Jaro is at most (m / a + m / b + 1) / 3 for m shared characters, and m is at most the shorter length b;
    so m / a >= 3 jaro - 2, whichever of the two names is the longer one.
    """
    return F.ceil((3 * jaro - 2) * F.length(name) - 1e-9)


def like_pairs(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, likeness: float) -> DataFrame:
    """Pairs within ``on`` whose Jaro-Winkler likeness may reach ``likeness``: none that does is missing.

    Both sides have ``name``. Names of one first letter gain by a common beginning of up to four, others
    don't; so a name is looked up with its first letter and as many of its rare letters as one of them
    must be shared, and without the first letter by fewer, since more must be. What is found is held
    against the bound with the letters that the two share.
    """
    enough = {True: (likeness - 0.4) / 0.6, False: likeness}  # the Jaro likeness needed, with a common beginning or none

    tokens, n, first = letters_of("name"), F.length("name"), F.substring("name", 1, 1)

    def keys(begins: bool) -> Column:
        rarest = F.slice(tokens, 1, (n - least_shared("name", enough[begins]) + 1).cast("int"))
        return F.transform(rarest, lambda t: F.concat(first if begins else F.lit(""), F.lit("|"), t))

    def keyed(side: DataFrame, own_id: str, side_name: str) -> DataFrame:
        row = F.struct(F.col(own_id).alias("id"), F.col("name"), tokens.alias("tokens")).alias(side_name)
        return side.where(n > 0).select(*on, row, F.explode(F.concat(keys(True), keys(False))).alias("_key"))

    pairs = keyed(left, left_id, "l").join(keyed(right, right_id, "r"), [*on, "_key"])
    shared = F.size(F.array_intersect("l.tokens", "r.tokens"))
    a, b = F.length("l.name"), F.length("r.name")
    begins = F.substring("l.name", 1, 1) == F.substring("r.name", 1, 1)
    could = (shared / a + shared / b + 1) / 3 >= F.when(begins, enough[True]).otherwise(enough[False]) - 1e-9
    return pairs.where(could).select(*on, F.col("l.id").alias(left_id), F.col("r.id").alias(right_id), F.col("l.name").alias("name"), F.col("r.name").alias("f_name")).distinct()


def cascade(missing: DataFrame, found: DataFrame, jaccard_over: float = 0.70, likeness: float = 0.93) -> DataFrame:
    """Second chance for unmatched runners, in order of trust: exact; a day on, a day back; same card; like name.

    ``missing`` has runner_id, day, course, name, card (array of names); ``found`` has row_id, day,
    course, name, card and perhaps trainer and jockey. Of several rows of a day, course and name the one
    that knows more of trainer and jockey is taken, then that of the least row_id; of like names the
    likest, then the least row_id. ``found`` is reduced to a row a day, course and name first, and
    only runners that are still unmatched are compared by likeness, within a day and course.
    """
    known = sum([(F.coalesce(F.col(c), F.lit("")) != "").cast("int") for c in ("trainer", "jockey") if c in found.columns], F.lit(0))
    best = found.groupBy("day", "course", "name").agg(F.min(F.struct((-known).alias("less"), "row_id"))["row_id"].alias("row_id"))
    cards = found.groupBy("day", "course").agg(F.any_value("card").alias("f_card"))
    days = [("exact", 0, 1.0), ("day_off", 1, 0.98), ("day_off", -1, 0.98)]
    tiers = F.explode(F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(t).alias("match_type"), F.date_add("day", d).alias("on"), F.lit(c).alias("confidence")) for i, (t, d, c) in enumerate(days)])).alias("tier")
    asked = missing.select("runner_id", "course", "name", tiers).select("runner_id", "course", "name", "tier.*").withColumnRenamed("on", "day")
    named = asked.join(best, ["day", "course", "name"]).withColumn("score", F.lit(1.0))
    like = jaccard("card", "f_card")
    # A card is asked for by day and course, like the exact match; it decides only where that is switched off.
    card = missing.join(cards, ["day", "course"]).where(like > jaccard_over).join(best, ["day", "course", "name"])
    card = card.select("runner_id", F.lit(3).alias("priority"), F.lit("card").alias("match_type"), F.least(F.lit(0.99), F.greatest(F.lit(0.93), like)).alias("confidence"), "row_id", like.alias("score"))
    columns = ["runner_id", "priority", "match_type", "confidence", "row_id", "score"]
    sure = named.select(*columns).unionByName(card.select(*columns)).groupBy("runner_id").agg(F.min_by(F.struct(*columns[1:]), F.struct("priority", "row_id")).alias("best")).select("runner_id", "best.*")
    left = missing.join(sure, "runner_id", "left_anti")
    score = jaro_winkler("name", "f_name")
    fuzzy = like_pairs(left, found, ["day", "course"], "runner_id", "row_id", likeness).withColumn("score", score).where(F.col("score") >= likeness)
    fuzzy = fuzzy.groupBy("runner_id").agg(F.min_by(F.struct("row_id", "score"), F.struct(-F.col("score"), F.col("row_id"))).alias("best")).select("runner_id", "best.*")
    fuzzy = fuzzy.withColumn("match_type", F.lit("fuzzy")).withColumn("confidence", F.col("score"))
    return sure.unionByName(fuzzy, allowMissingColumns=True).select("runner_id", "row_id", "match_type", "score", "confidence")


def audit(asked: DataFrame, candidates: DataFrame, on: list[str], asked_id: str, sample: int = 20) -> dict[str, DataFrame]:
    """What a match by ``on`` leaves to be looked at: rows without a candidate, those with several and how many, and a sample.

    Candidates are counted by key before they meet the rows. The sample is of those with one candidate, by id.
    """
    counted = asked.join(candidates.groupBy(*on).agg(F.count("*").alias("candidates")), on, "left")
    return {
        "unmatched": counted.where("candidates is null").drop("candidates"),
        "ambiguous": counted.where("candidates > 1"),
        "sample": counted.where("candidates = 1").orderBy(asked_id).limit(sample),
    }
