"""From model scores to probabilities, metrics and bets."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal, localcontext
from functools import cache

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furlong.operators.tables import stored


#: Steps of a whole number in the table of exponentials, and the numbers that it goes to.
EXP_STEPS, EXP_MOST = 64, 16


@cache
def _exponentials() -> tuple[str, str]:
    """Exponentials of the table's steps as SQL arrays: the nearest doubles, and what these lack."""
    with localcontext() as context:
        context.prec = 50
        exact = [(Decimal(k) / EXP_STEPS).exp() for k in range(-EXP_MOST * EXP_STEPS, EXP_MOST * EXP_STEPS + 1)]
        lacking = [float(x - Decimal(float(x))) for x in exact]
    return tuple(f"array({', '.join(f'{float(x)!r}D' for x in values)})" for values in (exact, lacking))


def near_exp(x: Column) -> Column:
    """e to the power of x, rounded as the C library does (0.51 units in the last place), up to 16 on both sides.

    Spark's own ``exp`` may be a whole unit off, so scores that differ in the last digit get other shares than by
    SQL, on the other side of a limit. The nearest step is looked up; the rest, under 1/128, is a short series.
    """
    step = F.round(x * EXP_STEPS).cast("int")
    b = x - step / F.lit(float(EXP_STEPS))
    rest = F.lit(1.0 / 720)
    for n in (120, 24, 6, 2):
        rest = F.lit(1.0 / n) + b * rest
    high, low = (F.get(F.expr(table), step + EXP_MOST * EXP_STEPS) for table in _exponentials())
    return F.when(F.abs(x) < EXP_MOST, high + (low + high * (b + b * b * rest))).otherwise(F.exp(x))


def softmax(df: DataFrame, score: str, group: str, out: str, bounded: bool = False) -> DataFrame:
    """Exponentials of the scores over their sum in the group; the greatest score is taken off first, except from ``bounded`` ones."""
    w = Window.partitionBy(group)
    df = df.withColumn("_e", near_exp(F.col(score)) if bounded else F.exp(F.col(score) - F.max(score).over(w)))
    return df.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def renormalise(df: DataFrame, p: str, group: str, out: str, uniform: bool = True) -> DataFrame:
    """Probabilities over their sum in the group; where that is 0, all alike, or 0 without ``uniform``."""
    w = Window.partitionBy(group)
    total = F.sum(p).over(w)
    return df.withColumn(out, F.when(total > 0, F.col(p) / total).otherwise(1.0 / F.count("*").over(w) if uniform else F.lit(0.0)))


def isotonic(train: DataFrame, apply: DataFrame, p: str, label: str, out: str) -> DataFrame:
    """``apply`` with calibrated probabilities: a monotone step fit on ``train``, flat beyond its range, clipped to 0..1."""
    model = IsotonicRegression(featuresCol="_x", labelCol="_y", predictionCol="_c").fit(VectorAssembler(inputCols=[p], outputCol="_x").transform(train.withColumn("_y", F.col(label).cast("double"))))
    done = model.transform(VectorAssembler(inputCols=[p], outputCol="_x").transform(apply))
    return done.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl("_c", F.lit(0.0)), F.lit(0.0))))).drop("_x", "_c")


def isotonic_steps(counted: DataFrame, p: str, label: str, n: str) -> Callable[[np.ndarray], np.ndarray]:
    """As ``isotonic``, for numbers in a task: fitted on rows that each stand for ``n`` alike."""
    rows = counted.select(F.col(p).alias("_x"), F.col(label).cast("double").alias("_y"), F.col(n).cast("double").alias("_n"))
    rows = VectorAssembler(inputCols=["_x"], outputCol="_v").transform(rows.groupBy("_x").agg((F.sum(F.col("_y") * F.col("_n")) / F.sum("_n")).alias("_y"), F.sum("_n").alias("_n")))
    model = IsotonicRegression(featuresCol="_v", labelCol="_y", weightCol="_n").fit(rows)
    x, y = model.boundaries.toArray(), model.predictions.toArray()

    def apply(values: np.ndarray) -> np.ndarray:
        after = np.searchsorted(x, values)
        low, high = np.clip(after - 1, 0, None), np.clip(after, None, len(x) - 1)
        width = np.where(high > low, x[high] - x[low], 1)
        between = y[low] + (y[high] - y[low]) * (values - x[low]) / width
        return np.clip(np.where((x[high] == values) | (high == low) | (after == 0), y[high], between), 0, 1)

    return apply


def brier(p: str, y: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y).cast("double"), 2))


def log_loss(p: str, y: str) -> Column:
    c = F.least(F.greatest(F.col(p), F.lit(1e-15)), F.lit(1 - 1e-15))
    return -F.avg(F.when(F.col(y), F.ln(c)).otherwise(F.ln(1 - c)))


def top_pick_rate(df: DataFrame, p: str, group: str, y: str, tie: str) -> DataFrame:
    """How often the likeliest of each group wins."""
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(p), tie)) == 1
    return df.withColumn("_top", first).where("_top").agg(F.avg(F.col(y).cast("double")).alias("top_pick"), F.count("*").alias("groups"))


def ndcg(df: DataFrame, score: str, group: str, gain: str, tie: str, k: int) -> DataFrame:
    """Mean over groups (with any gain) of discounted gain in the first k over the best possible."""
    by_score = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    by_gain = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(gain), tie))

    def total(rank: str) -> Column:
        return F.sum(F.when(F.col(rank) <= k, F.col(gain) / F.log2(F.col(rank) + 1.0)).otherwise(0.0))

    ranked = df.withColumn("_s", by_score).withColumn("_g", by_gain)
    return ranked.groupBy(group).agg(total("_s").alias("dcg"), total("_g").alias("best")).where("best > 0").agg(F.avg(F.col("dcg") / F.col("best")).alias(f"ndcg_{k}"))


def quantile_edges(df: DataFrame, column: str, q: int) -> DataFrame:
    """One row: ``_edges``, the distinct exact quantiles from 0 to 1 in q steps. Equal values are counted before they meet."""
    steps = F.array(*[F.lit(i / q) for i in range(q + 1)])
    return df.groupBy(column).agg(F.count("*").alias("_n")).agg(F.array_distinct(F.percentile(column, steps, F.col("_n"))).alias("_edges"))


def quantile_bins(df: DataFrame, column: str, q: int, out: str) -> DataFrame:
    """Number from 0 of the bin (edge, edge] that a value is in, edges being distinct quantiles; the least value is in the first."""
    above = F.size(F.filter("_edges", lambda e: e < F.col(column)))
    return df.crossJoin(F.broadcast(quantile_edges(df, column, q))).withColumn(out, F.greatest(above - 1, F.lit(0))).drop("_edges")  # one row of q + 1 numbers


def edge(p: str, sp: str) -> Column:
    """Probability less that of the price; null without a price over 1."""
    return F.when(F.col(sp) > 1, F.col(p) - 1 / F.col(sp))


def profit(won: str, odds: str, stake: Column | None = None) -> Column:
    """Winnings at the odds, else minus the stake."""
    stake = F.lit(1.0) if stake is None else stake
    return F.when(F.col(won), (F.col(odds) - 1) * stake).otherwise(-stake)


def value_table(bets: DataFrame, thresholds: list[float], segments: dict[str, Column]) -> DataFrame:
    """Bets, wins, profit and return for each segment and edge threshold, in one pass."""
    labels = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in segments.items()]))
    limits = F.array(*map(F.lit, thresholds))
    each = bets.withColumn("segment", F.explode(labels)).withColumn("threshold", F.explode(F.filter(limits, lambda t: F.col("edge") > t)))
    out = each.groupBy("segment", "threshold").agg(F.count("*").alias("bets"), F.sum(F.col("won").cast("long")).alias("wins"), F.sum("profit").alias("profit"))
    return out.withColumn("roi", F.col("profit") / F.col("bets"))


def curve(df: DataFrame, order: list[str], value: str, window: int, least: int) -> DataFrame:
    """Running sum, its greatest so far, the drop from that, and a moving mean once ``least`` rows are in it."""
    w = Window.orderBy(*order)
    so_far, moving = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-(window - 1), 0)
    out = df.withColumn("cumulative", F.sum(value).over(so_far)).withColumn("peak", F.max("cumulative").over(so_far))
    return out.withColumn("drawdown", F.col("cumulative") - F.col("peak")).withColumn("moving", F.when(F.count(value).over(moving) >= least, F.avg(value).over(moving)))


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df``, written, with the place of each row in an order of all rows, from 0.

    Rows are dealt by ranges and numbered within each; a range starts after the sizes of those before it.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_start"))  # one row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(starts), "_range").withColumn(out, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


#: Windows in a block of a moving mean.
BLOCK_WINDOWS = 20


def moving_mean(df: DataFrame, order: list[str], value: str, out: str, most: int = 500, least: int = 50) -> DataFrame:
    """The mean of the last min(most, a third of all rows) values in an order of all rows, null before there are ``least``.

    Rows are numbered by ranges and go to the block of their number; a block's last window goes to the next
    one too, as what came before. So a task needs one block and no window spans all rows. A mean is the
    difference of two running sums, which takes a step a row; a sliding frame would add up all its rows for each.
    """
    rows = numbered(df, order, "_at")
    window = max(1, min(most, rows.count() // 3))
    size = window * BLOCK_WINDOWS
    block = F.floor(F.col("_at") / size)
    blocks = F.when(F.col("_at") % size >= size - window, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = rows.withColumn("_own", block).withColumn("_block", F.explode(blocks))
    ordered = Window.partitionBy("_block").orderBy("_at")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({"_s": F.coalesce(F.sum(value).over(so_far), F.lit(0.0)), "_n": F.count(value).over(so_far)})
    total, n = (F.col(c) - F.coalesce(F.lag(c, window).over(ordered), F.lit(0)) for c in ("_s", "_n"))
    means = summed.withColumns({"_s": total, "_n": n})
    return means.where("_own = _block").withColumn(out, F.when(F.col("_n") >= least, F.try_divide("_s", "_n"))).drop("_own", "_block", "_at", "_s", "_n")


def category_code(df: DataFrame, column: str, out: str) -> DataFrame:
    """Place of a value's text among the sorted distinct texts, from 0; the distinct values are joined, not all rows sorted."""
    named = df.withColumn("_name", F.coalesce(F.col(column).cast("string"), F.lit("None")))
    coded = numbered(named.select("_name").distinct(), ["_name"], out)
    return named.join(coded, "_name").drop("_name")


def top_signals(parts: list[tuple[str, Column]], most: int = 3) -> Column:
    """The labels of the largest positive contributions, comma-joined; a label counts once, equal ones go by label."""
    pairs = F.array(*[F.struct(F.coalesce(v.cast("double"), F.lit(0.0)).alias("v"), F.lit(label).alias("label")) for label, v in parts])
    ordered = F.sort_array(F.filter(pairs, lambda p: p["v"] > 0), asc=False)
    return F.array_join(F.slice(F.array_distinct(F.transform(ordered, lambda p: p["label"])), 1, most), ", ")
