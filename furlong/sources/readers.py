"""Reading the files of the racing data: CSV, zipped JSON lines, racecards, pages, logs."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.functions import text
from furlong.operators import dml
from furlong.operators.tables import stored

#: Lines of a zipped file that a batch has.
ZIP_LINES = 10_000

SP_COLUMNS = ["event_id", "menu_hint", "event_name", "event_dt", "selection_id", "selection_name", "win_lose", "bsp"]

# The names under which form files have a column; the columns that a raw form file must
# have; the country that the name of a price file tells.
ALIASES = {
    "race_date": ["race_date", "date", "racedate"],
    "course": ["course", "course_name", "track", "venue", "meeting"],
    "horse": ["horse", "horse_name", "runner", "selection_name"],
    "off_time": ["off_time", "off", "race_time", "scheduled_off", "event_dt"],
    "position": ["finishing_position", "position", "pos", "finish_pos"],
    "position_text": ["pos", "finishing_position", "position"],
    "won": ["won", "win", "win_flag", "win_lose"],
    "trainer": ["trainer", "trainer_name"],
    "jockey": ["jockey", "jockey_name", "rider"],
    "draw": ["draw", "stall", "stall_draw"],
    "weight_lbs": ["weight_lbs", "weight", "lbs"],
    "age": ["age"],
    "official_rating": ["official_rating", "or", "rating"],
    "headgear": ["headgear", "hg"],
    "race_type": ["race_type", "type"],
    "race_class": ["race_class", "class", "class_band"],
    "race_name": ["race_name", "race_type", "type"],
    "distance": ["dist_f", "distance_furlongs", "distance", "trip", "dist"],
    "surface": ["surface"],
    "going": ["going", "going_code"],
    "prize": ["prize_money", "prize_money_gbp", "prize"],
    "beaten": ["btn", "btn_lengths", "ovr_btn"],
    "seconds": ["secs", "official_time_secs", "time_secs"],
    "rpr": ["rpr"],
    "sex": ["sex"],
}
RAW = ("horse", "date", "course", "trainer", "jockey")
COUNTRIES = {"pricesuk": "GB", "pricesire": "IE", "pricesaus": "AUS", "pricesusa": "USA"}

RACECARD = "array<struct<course:string,off_time:string,going:string,distance_f:double,race_class:int,runners:array<struct<name:string,sex_code:string>>>>"


def read_sp_csv(spark: SparkSession, path: str) -> DataFrame:
    """Starting-price files: every column a string, names lower-cased, damaged rows in ``_corrupt``."""
    names = [c.lower() for c in spark.read.option("header", True).csv(path).columns]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_corrupt"]])
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("enforceSchema", True).csv(path)


def is_sp_row() -> Column:
    """Whether a starting-price row has the ids and the time that a record needs."""
    named = [F.coalesce(F.trim(c) != "", F.lit(False)) for c in ("event_id", "selection_id", "selection_name")]
    return named[0] & named[1] & named[2] & F.try_to_timestamp(F.trim("event_dt"), F.lit("dd-MM-yyyy HH:mm")).isNotNull()


def sp_counts(rows: DataFrame) -> DataFrame:
    """One row: how many starting-price rows there are, and how many of them make no record."""
    return rows.agg(F.count("*").alias("read"), F.count_if(~is_sp_row()).alias("failed"))


def sp_records(rows: DataFrame) -> dict[str, DataFrame]:
    """Races, runners, results and history rows of starting-price rows that have the ids and the time they need.

    The field's size is the number of rows of the race.
    """
    event = F.regexp_replace(F.trim("event_id"), r"^(?:1\.)?", "1.")
    race = F.concat(F.lit("bfsp_"), event, F.lit("_win"))
    horse = F.coalesce(text.slugify("selection_name"), F.concat(F.lit("sel_"), F.trim("selection_id")))
    off = F.try_to_timestamp(F.trim("event_dt"), F.lit("dd-MM-yyyy HH:mm"))
    ok = rows.where(is_sp_row())
    base = ok.select(
        race.alias("race_id"), horse.alias("horse_id"), F.trim("selection_name").alias("horse_name"), off.alias("scheduled_off_utc"),
        text.normalise_course("menu_hint").alias("course_name"), F.col("event_name").alias("race_type"), (F.trim("win_lose") == "1").alias("won"), F.col("bsp").try_cast("double").alias("sp_decimal"),
    ).withColumn("runner_id", F.concat_ws("_", "race_id", "horse_id"))
    sizes = base.groupBy("race_id").agg(F.count("*").cast("int").alias("field_size"))
    races = base.groupBy("race_id").agg(*[F.min(c).alias(c) for c in ("scheduled_off_utc", "course_name", "race_type")]).join(sizes, "race_id")
    return {
        "races": races.withColumn("decision_cutoff_utc", text.decision_cutoff("scheduled_off_utc")),
        "runners": base.select("runner_id", "race_id", "horse_id", "horse_name"),
        "results": base.select(F.concat("runner_id", F.lit("_res")).alias("result_id"), "runner_id", "race_id", "horse_id", "won", "sp_decimal"),
        "horse_history": base.select(F.concat("runner_id", F.lit("_hist")).alias("history_id"), "horse_id", "horse_name", "race_id", "scheduled_off_utc", "won"),
    }


def file_date(name: str | Column = "file") -> Column:
    """The day in a file name that ends in ddMMyyyy.csv; null if it is no day."""
    day = F.regexp_extract(name, r"(\d{8})\.csv$", 1)
    return F.to_date(F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("ddMMyyyy")))


def file_market(name: str | Column = "file") -> Column:
    """country (GB if the name tells none) and market type that a file name tells."""
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    country = F.coalesce(*[F.when(low.contains(token), code) for token, code in COUNTRIES.items()], F.lit("GB"))
    return F.struct(country.alias("country"), F.when(low.contains("place"), "PLACE").otherwise("WIN").alias("market_type"))


def alias_columns(names: dict[str, str], wanted: dict[str, list[str]]) -> list[Column]:
    """String columns under the wanted names: of the aliases the first that ``names`` (column to name) has, in any case; null without any."""
    have: dict[str, str] = {}
    for column, name in names.items():
        have.setdefault(name.lower().strip(), column)
    found = {name: next((have[n] for n in aliases if n in have), None) for name, aliases in wanted.items()}
    return [(F.lit(None) if column is None else F.col(f"`{column}`")).cast("string").alias(name) for name, column in found.items()]


def aliased(df: DataFrame, wanted: dict[str, list[str]] | None = None) -> DataFrame:
    """The columns of a table under fixed names."""
    return df.select(*alias_columns({c: c for c in df.columns}, wanted or ALIASES))


def form_rows(raw: DataFrame) -> DataFrame:
    """Form rows (under the names of ``ALIASES``) as typed values; rows without a day, course or horse are left out."""
    said = {c: F.nullif(F.trim(c), F.lit("")) for c in raw.columns}
    number = {c: text.to_number(F.regexp_replace(said[c], ",", "")) for c in ("weight_lbs", "distance", "prize", "beaten", "seconds", "rpr")}
    place = text.whole(said["position"])
    won = F.when(said["won"].isNotNull(), F.lower(said["won"]).isin("1", "true", "win", "w")).otherwise(place == 1)
    kept = raw.select(
        F.to_date(text.free_time("race_date")).alias("race_date"), said["course"].alias("course_name"), text.normalise_course("course").alias("course_norm"), said["horse"].alias("horse_name"),
        text.normalise_horse("horse").alias("horse_norm"), text.compact("horse").alias("horse_compact"), text.free_time("off_time").alias("off_time_utc"), said["trainer"].alias("trainer_name"),
        said["jockey"].alias("jockey_name"), text.whole(said["draw"]).alias("draw"), number["weight_lbs"].alias("weight_lbs"), text.whole(said["age"]).alias("age"),
        text.whole(said["official_rating"]).alias("official_rating"), said["headgear"].alias("headgear"), said["race_type"].alias("race_type"), text.race_class(said["race_class"]).alias("race_class"),
        text.is_handicap("race_name").alias("is_handicap"), number["distance"].alias("distance_furlongs"), said["surface"].alias("surface"), said["going"].alias("going_code"), number["prize"].alias("prize_money_gbp"),
        place.alias("finishing_position"), won.alias("won"), number["beaten"].alias("btn_lengths"), number["seconds"].alias("official_time_secs"), number["rpr"].alias("rpr"),
        text.non_completion(said["position_text"]).alias("non_completion"), F.upper(said["sex"]).alias("sex"),
    )
    return kept.where("race_date is not null and course_name is not null and horse_name is not null")


class _Stored(io.RawIOBase):
    """A store's file as Python's own kind of file, whose errors ``zipfile`` knows."""

    def __init__(self, file: pafs.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError("a place before the start")
        return self.file.seek(at)

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)

    def close(self) -> None:
        self.file.close()
        super().close()


def opened(path: str) -> io.BufferedReader:
    """A file of a store, to be read from any place; a path as Spark names files."""
    if path.startswith(("file:", "/")):
        fs, name = pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        fs, name = pafs.FileSystem.from_uri(quote(path, safe=":/@%?=&"))
    return io.BufferedReader(_Stored(fs.open_input_file(name)), 1 << 16)


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """file, member, place (its number in the archive) and bytes (unpacked) of the members of zip files; of a file only its list is read.

    Members that are neither .json, .jsonl nor .csv are left out.
    """

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["path"]:
                with opened(file) as f, zipfile.ZipFile(f) as z:
                    found = [(file, m.filename, i, m.file_size) for i, m in enumerate(z.infolist()) if m.filename.lower().endswith((".json", ".jsonl", ".csv"))]
                yield pd.DataFrame(found, columns=["file", "member", "place", "bytes"])

    names = spark.read.format("binaryFile").load(path).select("path")
    return names.mapInPandas(listed, "file string, member string, place int, bytes long")


def read_zip_lines(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """file, member and line of zip files: the JSON objects of .json and .jsonl members, and the rows of .csv members as such.

    Malformed lines and other members are left out. Members, not archives, are dealt to ``tasks`` tasks
    (four a core by default), so that one large archive spreads; a task reads the list of an archive and the bytes
    of its members there. A member is unpacked as it is read, ``ZIP_LINES`` lines at a time.
    """

    def objects(name: str, lines: Iterable[str]) -> Iterator[str]:
        if name.lower().endswith(".csv"):
            yield from (json.dumps({k: v for k, v in row.items() if k is not None}) for row in csv.DictReader(lines))
            return
        for line in lines:
            try:
                if isinstance(json.loads(line), dict):
                    yield line.strip()
            except ValueError:
                continue

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, members in batch.groupby("file", sort=False):
                with opened(file) as archive, zipfile.ZipFile(archive) as z:
                    places = z.infolist()
                    for member, place in zip(members["member"], members["place"], strict=True):
                        with z.open(places[place]) as f:
                            found = objects(member, io.TextIOWrapper(f, "utf-8", errors="ignore"))
                            while some := list(islice(found, ZIP_LINES)):
                                yield pd.DataFrame({"file": file, "member": member, "line": some})

    dealt = zip_members(spark, path).repartition(tasks or 4 * spark.sparkContext.defaultParallelism, "file", "place").sortWithinPartitions("file", "place")
    return dealt.mapInPandas(lines, "file string, member string, line string")


def write_zip_lines(lines: DataFrame, folder: str, member_lines: int = ZIP_LINES) -> DataFrame:
    """Write ``line`` to zip files below ``folder``, a file a task and a member of .jsonl every ``member_lines`` lines; return file and lines.

    A file has the attempt that wrote it in its name and gets that name when whole; what is returned, and stored, names those of
    finished attempts only.
    """

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        fs, path = pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.zip"
        count, rest = 0, chain.from_iterable(batch["line"] for batch in batches)
        if (some := list(islice(rest, member_lines))) == []:
            return
        with fs.open_output_stream(f"{path}/.{name}", compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            while some:
                z.writestr(f"lines-{count // member_lines:06d}.jsonl", "".join(f"{line}\n" for line in some))
                count += len(some)
                some = list(islice(rest, member_lines))
        fs.move(f"{path}/.{name}", f"{path}/{name}")
        yield pd.DataFrame({"file": [f"{folder}/{name}"], "lines": [count]})

    lines.select("line").mapInPandas(packed, "file string, lines long").write.parquet(f"{folder}/_written")
    return lines.sparkSession.read.schema("file string, lines long").parquet(f"{folder}/_written")


def first_of(*columns: Column) -> Column:
    """The first value of JSON that is neither null, empty, zero nor false."""
    return F.coalesce(*[F.when(~c.isin("", "0", "0.0", "false"), c) for c in columns])


#: What exchange records are read for, under all its names.
EXCHANGE_FIELDS = [
    "marketId", "market_id", "id", "venue", "course_name", "eventName", "marketStartTime", "scheduled_off_utc", "off_time", "runnerName", "horse_name", "trainer", "trainer_name", "jockey", "jockey_name",
    "finishingPosition", "finishing_position", "status", "sp_decimal", "bsp", "sp", "numberOfRunners", "field_size", "country", "headgear_first_time", "is_handicap", "going_code", "going_description", "race_type",
    "race_grade", "surface", "headgear", "distance_furlongs", "prize_money_gbp", "weight_lbs", "btn_lengths", "official_time_secs", "race_class", "draw", "age", "official_rating", "days_since_last_run", "career_runs",
]


def exchange_records(lines: DataFrame) -> dict[str, DataFrame]:
    """Races, runners, results and history rows of exchange records (JSON in ``line``), whose fields go by several names.

    Records without a market's id or a readable time are left out. Of several records of one race or
    runner the one of the least horse, then the least text, is taken. A record is parsed once, whole; one that
    is no whole JSON is left out. The fields are written, and once more the one record of each runner.
    """
    get = lambda *names: first_of(*map(plain, names))
    plain = lambda name: F.col(f"_{name}")
    lines = lines.select("line", F.json_tuple("line", *EXCHANGE_FIELDS).alias(*[f"_{n}" for n in EXCHANGE_FIELDS]))
    number, whole = (lambda name: plain(name).try_cast("double").alias(name)), (lambda name: text.whole(plain(name)).alias(name))
    texts = lambda *names: [plain(n).alias(n) for n in names]
    course, horse = F.coalesce(get("venue", "course_name", "eventName"), F.lit("unknown")), F.coalesce(get("runnerName", "horse_name"), F.lit("unknown_horse"))
    trainer, jockey, place = get("trainer", "trainer_name"), get("jockey", "jockey_name"), get("finishingPosition", "finishing_position")
    base = lines.select(
        "line", get("marketId", "market_id", "id").alias("source_race_id"), course.alias("course_name"), F.coalesce(text.slugify(course), F.lit("unknown_course")).alias("course_id"),
        get("marketStartTime", "scheduled_off_utc", "off_time").try_cast("timestamp").alias("scheduled_off_utc"), horse.alias("horse_name"), F.coalesce(text.slugify(horse), F.lit("unknown_horse")).alias("horse_id"),
        trainer.alias("trainer_name"), text.slugify(trainer).alias("trainer_id"), jockey.alias("jockey_name"), text.slugify(jockey).alias("jockey_id"),
        F.when(place.rlike(r"^\d+$"), place.try_cast("int")).alias("finishing_position"), F.coalesce(get("status"), place, F.lit("")).alias("finishing_position_raw"),
        get("sp_decimal", "bsp", "sp").try_cast("double").alias("sp_decimal"), text.whole(get("numberOfRunners", "field_size")).alias("field_size"), F.coalesce(get("country"), F.lit("GB")).alias("country"),
        get("headgear_first_time").isNotNull().alias("headgear_first_time"), plain("is_handicap").try_cast("boolean").alias("is_handicap"), *texts("going_code", "going_description", "race_type", "race_grade", "surface", "headgear"),
        *map(number, ("distance_furlongs", "prize_money_gbp", "weight_lbs", "btn_lengths", "official_time_secs")), *map(whole, ("race_class", "draw", "age", "official_rating", "days_since_last_run", "career_runs")),
    )
    base = base.where("source_race_id is not null and scheduled_off_utc is not null").withColumn("race_id", F.concat(F.lit("bf_"), "source_race_id"))
    base = base.withColumn("runner_id", F.concat_ws("_", "race_id", "horse_id")).withColumn("race_date", F.to_date("scheduled_off_utc")).withColumn("decision_cutoff_utc", text.decision_cutoff("scheduled_off_utc"))
    base = base.withColumn("won", F.coalesce(F.col("finishing_position") == 1, F.lit(False)))
    base = stored(base, "exchange-fields")
    times = ["scheduled_off_utc", "decision_cutoff_utc"]
    races = dml.first_by(base, ["race_id"], F.col("horse_id"), F.col("line"))
    each = stored(dml.first_by(base, ["runner_id"], F.col("line")).drop("line"), "exchange-runners")
    return {
        "races": races.select("race_id", "source_race_id", "course_id", "course_name", "race_date", *times, "distance_furlongs", "going_code", "going_description", "race_type", "race_class", "race_grade", "prize_money_gbp", "field_size", "is_handicap", "surface", "country"),
        "runners": each.select("runner_id", "race_id", "horse_id", "horse_name", "trainer_id", "trainer_name", "jockey_id", "jockey_name", "draw", "weight_lbs", "age", "official_rating", "headgear", "headgear_first_time", "days_since_last_run", "career_runs", *times),
        "results": each.select(F.concat("runner_id", F.lit("_res")).alias("result_id"), "race_id", "runner_id", "horse_id", "finishing_position", "finishing_position_raw", "btn_lengths", "official_time_secs", "sp_decimal", "won", *times),
        "horse_history": each.select(
            F.concat("runner_id", F.lit("_hist")).alias("history_id"), "horse_id", "horse_name", "race_id", "race_date", "course_id", "distance_furlongs", "going_code", "race_type", "race_class", "is_handicap", "field_size",
            "finishing_position", "won", "btn_lengths", "trainer_id", "jockey_id", "weight_lbs", "official_rating", "headgear", F.col("days_since_last_run").alias("days_since_prev_run"), *times,
        ),
    }


def api_runners(lines: DataFrame) -> DataFrame:
    """Runners of exchange records, whose fields go by several names."""
    get = lambda *names: first_of(*[F.get_json_object("line", f"$.{n}") for n in names])
    return lines.select(get("marketId", "market_id", "id").alias("market_id"), get("runnerName", "horse_name").alias("horse_name"), get("marketStartTime", "scheduled_off_utc", "off_time").alias("off"), get("sp_decimal", "bsp", "sp").try_cast("double").alias("sp_decimal"))


def racecard_runners(cards: DataFrame, column: str = "card") -> DataFrame:
    """A row a runner of racecard documents; races without runners give one row without a name."""
    races = cards.withColumn("race", F.explode(F.from_json(column, RACECARD)))
    each = races.withColumn("runner", F.explode_outer("race.runners"))
    return each.select(*[c for c in cards.columns if c != column], "race.course", "race.off_time", "race.going", "race.distance_f", F.col("runner.name").alias("name"), F.upper("runner.sex_code").alias("sex"))


def page_title(html: str = "html") -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_data(html: str = "html") -> Column:
    """The JSON that a page carries for its scripts; empty if none."""
    return F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)


def links(pages: DataFrame, ending: str) -> DataFrame:
    """Distinct link targets with the given ending."""
    found = F.explode(F.regexp_extract_all("html", F.lit(rf'href="([^"]*{ending})"'), F.lit(1)))
    return pages.select(found.alias("href")).distinct()


def columns_of(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """table, column and type, in order."""
    return [(name, f.name, f.dataType.simpleString()) for name, df in tables.items() for f in df.schema.fields]
