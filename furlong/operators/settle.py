"""Settling bets and adding up profit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The categories of the profit report, and the types that each adds up.
REPORT = {"flat": ["Flat"], "jumps": ["Chase", "Hurdle", "NH Flat"], "hurdle": ["Hurdle"], "chase": ["Chase"], "TOTAL": ["Flat", "Chase", "Hurdle", "NH Flat"]}


def clean_id(c: str) -> Column:
    """A runner id without the exchange's version mark and without a market suffix."""
    return F.regexp_replace(F.replace(F.col(c), F.lit("bfsp_1."), F.lit("bfsp_")), r"_win(?=_|$)", "")


def best_price(results: DataFrame, key: str = "runner_id", sp: str = "sp_decimal") -> DataFrame:
    """One result a runner: the one with the highest price."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(sp).desc_nulls_last(), "won"))
    return results.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def settle(bets: DataFrame, results: DataFrame, stake: float = 1.0) -> DataFrame:
    """Bets with profit at their own odds and at the starting price.

    Unsettled bets (no price yet) have profit 0. Bets without odds over 0 settle at the price.
    """
    joined = bets.join(best_price(results).select("runner_id", "won", "sp_decimal"), "runner_id", "left")
    settled = F.col("sp_decimal").isNotNull()
    odds = F.when(F.col("back_odds") > 0, F.col("back_odds")).otherwise(F.col("sp_decimal"))

    def at(price: Column) -> Column:
        return F.when(~settled, 0.0).when(F.col("won"), (price - 1) * stake).otherwise(F.lit(-stake))

    return joined.withColumns({"settled": settled, "profit": at(odds), "profit_sp": at(F.col("sp_decimal"))})


def by_category(settled: DataFrame, category: str = "category") -> DataFrame:
    """Bets, wins, profit and return for each line of the report; a bet counts in each line it belongs to."""
    lines = F.array_compact(F.array(*[F.when(F.col(category).isin(kinds), F.lit(line)) for line, kinds in REPORT.items()]))
    each = settled.where("settled").withColumn("line", F.explode(lines))
    return each.groupBy("line").agg(F.count("*").alias("bets"), F.sum(F.col("won").cast("long")).alias("wins"), F.sum("profit").alias("profit"), F.sum("profit_sp").alias("profit_sp")).withColumn("roi", F.col("profit") / F.col("bets"))


def daily(settled: DataFrame, date: str = "date") -> DataFrame:
    """A row a day with the sums so far; days are few, so one window over them is small."""
    days = settled.where("settled").groupBy(date).agg(F.count("*").alias("bets"), F.sum(F.col("won").cast("long")).alias("wins"), F.sum("profit").alias("profit"))
    so_far = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumns({"roi": F.col("profit") / F.col("bets"), "total_bets": F.sum("bets").over(so_far), "total_profit": F.sum("profit").over(so_far)})


def price_moves(odds: DataFrame, limit: float = 0.20) -> DataFrame:
    """Runners whose morning price is off the evening one by more than ``limit``; of each label the latest snapshot counts."""
    rank = F.row_number().over(Window.partitionBy("runner_id", "snapshot_label").orderBy(F.desc("snapshot_timestamp_utc"), F.desc("snapshot_id")))
    latest = odds.where(F.col("snapshot_label").isin("evening_21h", "morning_09h")).withColumn("_rank", rank).where("_rank = 1")
    sides = latest.groupBy("runner_id").agg(*[F.max(F.when(F.col("snapshot_label") == label, F.col("decimal_odds"))).alias(name) for label, name in (("evening_21h", "evening_odds"), ("morning_09h", "morning_odds"))])
    move = F.try_divide(F.col("morning_odds") - F.col("evening_odds"), F.col("evening_odds"))
    return sides.withColumn("move", move).where(F.abs("move") > limit)
