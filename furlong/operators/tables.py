"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one folder that a task writes, about.
FOLDER_ROWS = 1_000_000
#: Rows up to which a side is broadcast.
FEW_ROWS = 100_000
#: The same for rows of a key and a few numbers.
NARROW_ROWS = 1_000_000


def new_path(spark: SparkSession, name: str) -> str:
    """A path that no other table has, below spark.checkpoint.dir.

    Only in local mode, and where the session names no such folder, is a temporary one made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='furlong-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below spark.checkpoint.dir and read it: later plans start from the file."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_together(makers: dict[str, Callable[[], DataFrame]], at_once: int = 3) -> dict[str, DataFrame]:
    """``stored`` for what each maker returns, some at a time: what the last tasks of one job leave idle works on another."""
    spark = SparkSession.getActiveSession()
    make = inheritable_thread_target(spark)(lambda name: stored(makers[name](), name))
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(makers, pool.map(make, makers)))


def by_size(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """A written ``df`` to join with: broadcast if it has few rows, else as the planner decides."""
    return F.broadcast(df) if df.count() <= most else df


def dealt_by(df: DataFrame, columns: list[str], most: int = FOLDER_ROWS) -> DataFrame:
    """``df`` dealt by ``columns``, so that a folder gets few files; what one of over ``most`` rows has goes to several tasks.

    Rows are counted by folder before the shuffle; the large folders (at most rows / ``most``) are broadcast.
    """
    large = df.groupBy(*[F.col(c).alias(f"_of_{c}") for c in columns]).agg(F.ceil(F.count("*") / most).alias("_shares")).where("_shares > 1")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in columns]
    share = F.pmod(F.xxhash64(*df.columns), F.coalesce("_shares", F.lit(1)))
    return df.join(F.broadcast(large), same, "left").withColumn("_share", share).repartition(*columns, "_share").select(*df.columns)


def stored_by(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Write ``df`` as CSV in a folder for each value of ``columns`` and read it back."""
    path = new_path(df.sparkSession, name)
    dealt_by(df, columns).write.partitionBy(*columns).option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def replace_folders(df: DataFrame, columns: list[str], path: str, most: int = FOLDER_ROWS) -> None:
    """Write ``df`` to the Parquet table at ``path``, which has a folder for each value of ``columns``.

    Folders that ``df`` has rows for are replaced as a whole, the others keep their files; so a day's
    refresh may be repeated. There need be no table yet.
    """
    dealt_by(df, columns, most).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def create(spark: SparkSession, folder: str, tables: dict[str, DataFrame], reset: bool = False) -> None:
    """An empty table of the schema of each frame below ``folder``, where there is none; with ``reset`` also where there is."""
    for name, df in tables.items():
        spark.createDataFrame([], df.schema).write.mode("overwrite" if reset else "ignore").parquet(f"{folder}/{name}")


def write_sinks(sinks: dict[str, DataFrame], folder: str, dry_run: bool = False) -> dict[str, DataFrame]:
    """Write each frame as CSV below ``folder`` and return the frames; a dry run only returns them."""
    if not dry_run:
        for name, df in sinks.items():
            df.write.option("header", True).csv(f"{folder}/{name}")
    return sinks
