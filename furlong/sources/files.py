"""Which files to read, by name, day and what was read before; CSV files of several layouts."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.operators.quality import between_days
from furlong.sources import readers


def listed(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and modified of the files of a path or pattern; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def chosen(files: DataFrame, since: str | None = None, until: str | None = None, tokens: tuple[str, ...] = ()) -> DataFrame:
    """Files whose name tells a day (``file_day``) within the bounds and has one of the tokens, in any case; without tokens all."""
    name = F.lower(F.element_at(F.split("file", "/"), -1))
    dated = between_days(files.withColumn("file_day", readers.file_date("file")).where("file_day is not null"), "file_day", since, until)
    return dated.where(reduce(Column.__or__, [name.contains(t.lower()) for t in tokens])) if tokens else dated


def unread(files: DataFrame, done: DataFrame) -> DataFrame:
    """The files that are not among those done."""
    return files.join(done.select("file").distinct(), "file", "left_anti")


def mark_done(files: DataFrame, folder: str) -> None:
    """Add the files to the table of those done. To be called when what was read of them has been written."""
    files.select("file", F.current_timestamp().alias("done_at")).write.mode("append").parquet(folder)


def header_of(file: str) -> list[str] | None:
    """The names in a CSV file's first line; None if the file is empty or can't be read."""
    try:
        system, name = (pafs.LocalFileSystem(), file.removeprefix("file:")) if file.startswith("file:") else pafs.FileSystem.from_uri(file)
        with system.open_input_stream(name) as f, io.TextIOWrapper(f, "utf-8-sig") as lines:
            return next(csv.reader(lines), None)
    except (OSError, ValueError, csv.Error):
        return None


def headers(spark: SparkSession, path: str) -> DataFrame:
    """file and header of each readable CSV file; tasks read the first lines."""

    def first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(file, header_of(file)) for file in batch["file"]]
            yield pd.DataFrame([(file, header) for file, header in found if header], columns=["file", "header"])

    return listed(spark, path).select("file").mapInPandas(first_lines, "file string, header array<string>")


def read_layouts(spark: SparkSession, path: str, wanted: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """Rows of CSV files whose columns differ, as strings under fixed names, and ``source_file``.

    Files that can't be read and those without the ``required`` names (in any case) are left out. Only
    file names reach the driver, by layout; each layout is one scan.
    """
    parts = []
    for header, names in headers(spark, path).groupBy("header").agg(F.collect_list("file")).collect():
        if not {c.lower().strip() for c in header} >= set(required):
            continue
        schema = ", ".join(f"_{i} string" for i in range(len(header)))
        rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("ignoreCorruptFiles", True).csv(names)
        parts.append(rows.select(*readers.alias_columns({f"_{i}": c for i, c in enumerate(header)}, wanted), F.col("_metadata.file_path").alias("source_file")))
    if not parts:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in [*wanted, "source_file"]))
    return reduce(DataFrame.unionByName, parts)


def raw_form(spark: SparkSession, path: str) -> DataFrame:
    """Form files as they are: the five columns that a file must have, its name and the time of loading."""
    return read_layouts(spark, path, {c: [c] for c in readers.RAW}, readers.RAW).withColumn("loaded_at_utc", F.current_timestamp())
