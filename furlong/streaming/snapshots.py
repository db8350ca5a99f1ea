"""Price snapshots as streams: duplicates dropped, windows summed, custom state per runner."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "snapshot_id long, runner_id long, snapshot_timestamp_utc timestamp, snapshot_label string, decimal_odds double"


def minutes_to_off(off: str, ts: str) -> Column:
    return F.floor((F.unix_seconds(off) - F.unix_seconds(ts)) / 60)


def ladder_volume(levels: str) -> Column:
    """Traded volume over the levels of a price ladder."""
    return F.aggregate(levels, F.lit(0.0), lambda s, x: s + x["size"])


def best_back(levels: str) -> Column:
    """Price of the first level; null without one."""
    return F.try_element_at(levels, F.lit(1))["price"]


def read(spark: SparkSession, folder: str, files_a_batch: int = 10) -> DataFrame:
    """New snapshot files as they arrive; the checkpoint knows which are done."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def once_each(snapshots: DataFrame, late: str = "1 day") -> DataFrame:
    """Snapshots without repeated ids; state is kept for as long as rows may be late."""
    return snapshots.withWatermark("snapshot_timestamp_utc", late).dropDuplicatesWithinWatermark(["snapshot_id"])


def by_window(snapshots: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Count and mean odds by window of time and label."""
    windows = F.window("snapshot_timestamp_utc", size, slide or size)
    out = snapshots.withWatermark("snapshot_timestamp_utc", late).groupBy(windows.alias("w"), "snapshot_label").agg(F.count("*").alias("n"), F.avg("decimal_odds").alias("odds"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "snapshot_label", "n", "odds")


def by_session(snapshots: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Bursts of snapshots of a runner, apart by more than ``gap``."""
    sessions = F.session_window("snapshot_timestamp_utc", gap)
    out = snapshots.withWatermark("snapshot_timestamp_utc", late).groupBy(sessions.alias("w"), "runner_id").agg(F.count("*").alias("n"))
    return out.select("runner_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def moves(snapshots: DataFrame, limit: float = 0.20, late: str = "1 day") -> DataFrame:
    """An alert each time a runner's morning price is off its evening price by more than ``limit``.

    The state of a runner is its latest evening price; it goes once event time is two days
    past the runner's last row.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["snapshot_timestamp_utc", "snapshot_id"])
        evening = state.get[0] if state.exists else None
        out = []
        for row in rows.itertuples():
            if row.snapshot_label == "evening_21h":
                evening = row.decimal_odds
            elif row.snapshot_label == "morning_09h" and evening and abs((row.decimal_odds - evening) / evening) > limit:
                out.append((key[0], row.snapshot_id, evening, row.decimal_odds))
        if evening is not None:
            state.update((float(evening),))
            state.setTimeoutTimestamp(int(rows["snapshot_timestamp_utc"].max().timestamp() * 1000) + 2 * 86_400_000)
        yield pd.DataFrame(out, columns=["runner_id", "snapshot_id", "evening_odds", "morning_odds"])

    schema = "runner_id long, snapshot_id long, evening_odds double, morning_odds double"
    timed = snapshots.withWatermark("snapshot_timestamp_utc", late)
    return timed.groupBy("runner_id").applyInPandasWithState(step, schema, "evening double", "append", GroupStateTimeout.EventTimeTimeout)


def morning_moves(snapshots: DataFrame, limit: float = 0.20, late: str = "1 day", apart: str = "16 hours") -> DataFrame:
    """Each pair of an evening price and a morning price of the same runner, at most ``apart`` later, that differ by more than ``limit``.

    A join of two streams: the watermarks and the bound on time tell when a price can meet no further
    one and leaves the state. Rows may come in any order within ``late``. An evening price of 0 or null gives no pair.
    """
    timed = snapshots.withWatermark("snapshot_timestamp_utc", late)
    side = lambda label, name: timed.where(F.col("snapshot_label") == label).select(
        F.col("runner_id").alias(f"{name}_runner"), F.col("snapshot_id").alias(f"{name}_id"), F.col("snapshot_timestamp_utc").alias(f"{name}_ts"), F.col("decimal_odds").alias(f"{name}_odds")
    )
    evening, morning = side("evening_21h", "evening"), side("morning_09h", "morning")
    soon = (F.col("morning_ts") > F.col("evening_ts")) & (F.col("morning_ts") <= F.col("evening_ts") + F.expr(f"INTERVAL {apart}"))
    pairs = evening.join(morning, (F.col("evening_runner") == F.col("morning_runner")) & soon)
    moved = F.abs(F.try_divide(F.col("morning_odds") - F.col("evening_odds"), F.col("evening_odds"))) > limit
    return pairs.where(moved).select(F.col("evening_runner").alias("runner_id"), "evening_id", F.col("morning_id").alias("snapshot_id"), "evening_odds", "morning_odds")


def append(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Write what is there and stop; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
