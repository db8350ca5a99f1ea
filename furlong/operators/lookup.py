"""Point lookups: each filters on one name and adds up; the engine pushes the filter to the scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.functions import text

#: Spellings up to which their table is broadcast; it is settings, not data.
MOST_SPELLINGS = 100_000


def spellings_from(path: str) -> dict[str, str]:
    """Spelling to course of a settings file (YAML), spellings in lower case; empty entries don't count."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    return {str(k).strip().lower(): str(v).strip() for k, v in found.items() if k is not None and v is not None}


def with_course(df: DataFrame, column: str, to: str, spellings: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``to``, the course that ``column`` names, as ``text.normalise_course`` tells it.

    ``spellings`` come before the known ones. All are one broadcast table, so a row costs hash lookups
    and no shuffle. An old column ``to`` is replaced; null stays null.
    """
    own = spellings or {}
    events = text.COURSE_ALIASES | text.VENUE_TOKENS | own
    known = [("event", k, v) for k, v in events.items()] + [("name", k, v) for k, v in (text.COURSE_ALIASES | own).items()]
    if len(known) > MOST_SPELLINGS:
        raise ValueError(f"{len(known)} spellings, more than {MOST_SPELLINGS}")
    table = F.broadcast(df.sparkSession.createDataFrame(known, "kind string, key string, course string"))
    token, plain, first = text.course_keys(F.col(f"row.`{column}`"))
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).withColumns({"token": token, "plain": plain, "first": first})
    for key, kind in (("token", "event"), ("plain", "name"), ("first", "name")):
        side = table.where(F.col("kind") == kind).select(F.col("key").alias(f"{key}_key"), F.col("course").alias(f"{key}_course"))
        out = out.join(side, F.col(key) == F.col(f"{key}_key"), "left")
    course = F.coalesce("token_course", "token", "plain_course", "first_course", "plain")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns if c != to], course.alias(to))


def _record(df: DataFrame, *extra) -> DataFrame:
    runs = df.where("won is not null").agg(F.count("*").alias("runs"), F.count_if("won").alias("wins"), *extra)
    return runs.withColumn("win_rate", F.when(F.col("runs") > 0, F.round(F.col("wins") / F.col("runs"), 3)))


def horse_history(r, horse: int, limit: int = 10) -> DataFrame:
    """The latest runs of a horse; ``result_missing`` marks those without a position."""
    runs = r.horse_history.where(F.col("horse_id") == horse)
    columns = ("history_id", "race_date", "course_id", "going_code", "distance_furlongs", "finishing_position", "won")
    return runs.select(*columns, F.col("finishing_position").isNull().alias("result_missing")).orderBy(F.desc("race_date"), "history_id").limit(limit)


def trainer_form(r, trainer: str, course: str | None = None, going: str | None = None) -> DataFrame:
    runs = r.trainer_history.where(F.col("trainer_name") == trainer)
    runs = runs if course is None else runs.where(F.lower("course_name") == course.lower())
    return _record(runs if going is None else runs.where(F.col("going_code") == going))


def jockey_form(r, jockey: str, course: str | None = None) -> DataFrame:
    runs = r.jockey_history.where(F.col("jockey_name") == jockey)
    return _record(runs if course is None else runs.where(F.lower("course_name") == course.lower()))


def going_record(r, horse: int, going: str) -> DataFrame:
    return _record(r.horse_history.where((F.col("horse_id") == horse) & (F.lower("going_code") == going.lower())), F.min("finishing_position").alias("best_position"))


def course_record(r, horse: int, course: str) -> DataFrame:
    runs = r.horse_history.where(F.col("horse_id") == horse)
    return _record(runs.where(F.regexp_replace("course_id", r"_\d+\w*_\w+$", "") == course.lower()), F.min("finishing_position").alias("best_position"))


def race_field(r, race: int) -> DataFrame:
    return r.runners.where(F.col("race_id") == race).select("runner_id", "horse_name", "trainer_name", "jockey_name", "draw", "official_rating").orderBy(F.col("official_rating").desc_nulls_last(), "runner_id")


TOOLS: dict[str, Callable] = {f.__name__: f for f in (horse_history, trainer_form, jockey_form, going_record, course_record, race_field)}


def call(name: str, r, **arguments) -> list[dict] | dict:
    """Run a lookup by name; an error is an answer too."""
    try:
        return [row.asDict(recursive=True) for row in TOOLS[name](r, **arguments).collect()]
    except Exception as e:  # noqa: BLE001  the caller is a program that reads the answer
        return {"error": f"{type(e).__name__}: {e}"}
