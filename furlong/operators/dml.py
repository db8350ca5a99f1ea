"""Changes to tables as new DataFrames: upserts, updates by join, replacement by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a fixed order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Add the rows whose key is new; of several with one key the first in ``order``. Existing rows stay."""
    new = first_by(incoming, keys, *order).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def update_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], keep_old: bool = False) -> DataFrame:
    """Set ``columns`` from the matching source row: a source value wins unless null, or the old one does.

    The source must have one row a key.
    """
    new = source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(new, keys, "left")
    pairs = {c: (c, f"_new_{c}") if keep_old else (f"_new_{c}", c) for c in columns}
    return joined.select(*[F.coalesce(*pairs[c]).alias(c) if c in pairs else F.col(c) for c in target.columns])


def update_where(target: DataFrame, keys: DataFrame, on: list[str], values: dict[str, Column], condition: Column | None = None) -> DataFrame:
    """Set constants in the rows whose key is among ``keys`` (and that meet ``condition``)."""
    marked = target.join(keys.select(*on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    hit = F.coalesce(F.col("_hit") & (F.lit(True) if condition is None else condition), F.lit(False))
    return marked.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def delete_where_in(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return target.join(keys.select(*on).distinct(), on, "left_anti")


def add_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add null columns of the given types where the table doesn't have them."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def keep_last(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Old and new snapshot rows, of each key the last in ``order``; new rows come after old ones."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return first_by(both, keys, F.desc("_batch"), *[c.desc() for c in order]).drop("_batch")


def append_dates(log: DataFrame, new: DataFrame, date: str = "date", refresh: bool = False) -> DataFrame:
    """Add a day's rows. A day that the log has is left as it is, or replaced with ``refresh``.

    Columns that only one side has are null in the other's rows.
    """
    days = (new if refresh else log).select(date).distinct()
    kept, added = (log.join(days, date, "left_anti"), new) if refresh else (log, new.join(days, date, "left_anti"))
    return kept.unionByName(added, allowMissingColumns=True)


def without_decided(queue: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of a queue when the decided rows are taken out; rows with a null key stay."""
    return delete_where_in(queue, decided, keys)


def enqueued(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The queue with new rows after its own; only its columns are kept, missing ones are null."""
    return queue.unionByName(new.select(*[c for c in queue.columns if c in new.columns]), allowMissingColumns=True)
