"""Tables with a folder for each value: large folders are split, a refresh replaces whole folders and no others."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.operators import tables


def files(path):
    from pathlib import Path

    return {f"{p.parent.name}/{p.name}" for p in Path(path.removeprefix("file://")).glob("*/*.parquet")}


def test_a_refresh_replaces_its_days_only(spark):
    path = tables.new_path(spark, "days")
    rows = spark.range(3_000).select("id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("day"), F.lit("old").alias("source"))
    tables.replace_folders(rows, ["day"], path)
    before = files(path)
    day = rows.where("day = '2024-01-03' and id < 100").withColumn("source", F.lit("new"))
    for _ in range(2):  # a refresh may be repeated
        tables.replace_folders(day, ["day"], path)
        now = files(path)
        assert {f for f in before if "01-03" not in f} == {f for f in now if "01-03" not in f} and not before & {f for f in now if "01-03" in f}
        got = {(str(r["day"]), r["source"]): r["count"] for r in spark.read.schema(rows.schema).parquet(path).groupBy("day", "source").count().collect()}
        assert got == {("2024-01-03", "new"): 20} | {(f"2024-01-0{k}", "old"): 600 for k in (1, 2, 4, 5)}
    tables.replace_folders(day.where("false"), ["day"], path)
    assert files(path) == now


def test_large_folders_go_to_several_tasks(spark):
    rows = spark.range(4_000).select("id", F.when(F.col("id") < 3_900, "hot").when(F.col("id") < 3_990, "b").alias("place"), F.lit(1).alias("_x"))
    dealt = tables.dealt_by(rows, ["place"], 500).withColumn("part", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions are joined otherwise
    spread = {r["place"]: (r["rows"], r["parts"]) for r in dealt.groupBy("place").agg(F.count("*").alias("rows"), F.count_distinct("part").alias("parts")).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {k: v[0] for k, v in spread.items()} == {"hot": 3_900, "b": 90, None: 10}
    assert spread["hot"][1] > 3 and spread["b"][1] == 1 and spread[None][1] == 1
