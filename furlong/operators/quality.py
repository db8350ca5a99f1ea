"""Data-quality checks: each is a row of name, failures, limit and passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


# Limits by era of the share of runners without a trainer or jockey (in percent), and of
# races where nobody has either; what names a market that is no race; ids of races left out by hand.
ERAS = {
    "pre_2017": {"trainer": 16.0, "jockey": 16.0, "zero_coverage": 2000},
    "from_2017": {"trainer": 5.0, "jockey": 5.0, "zero_coverage": 100},
    "from_2019": {"trainer": 3.0, "jockey": 3.0, "zero_coverage": 0},
}
SETTINGS = {"max_missing_trainer_pct": "trainer", "max_missing_jockey_pct": "jockey", "max_zero_coverage_standard_races": "zero_coverage"}
NO_RACE_TYPES = [
    "%forecast%", "%reverse%", "%arab%", "%how far%", "% v %", "%charity%", "pa%", "% pa %", "% pa", "%each way%", "%each-way%", "%win dist%", "%daily odds%", "%specials%",
]
NO_RACE_TYPE = r"^(?:\d+[mf]\d*[f]?\s+pa)$"
NO_COURSES = ["%win dist%", "%daily odds%", "%specials%"]
NO_RACES = ["bfsp_162366764_win", "bfsp_201092786_win", "bfsp_218291493_win", "bfsp_218647872_win", "bfsp_230193686_win", "bfsp_245106872_win", "bfsp_246247068_win"]
FIELD_SIZES = (2, 40)


class CheckFailed(Exception):
    """A check that must pass did not."""


def failures(df: DataFrame, name: str, limit: int = 0) -> DataFrame:
    """The check's row when ``df`` has the failing rows."""
    return df.agg(F.lit(name).alias("check"), F.count("*").alias("failures"), F.lit(limit).cast("long").alias("max_failures")).withColumn("passed", F.col("failures") <= F.col("max_failures"))


def is_no_race() -> Column:
    """Whether race_type, course_name, race_id or field_size tell of a special market; null where nothing does and one is null."""
    kind, course, size = F.col("race_type"), F.col("course_name"), F.col("field_size")
    tests = [*map(kind.ilike, NO_RACE_TYPES), kind.rlike(NO_RACE_TYPE), *map(course.ilike, NO_COURSES), F.col("race_id").cast("string").isin(NO_RACES), size < FIELD_SIZES[0], size > FIELD_SIZES[1]]
    return reduce(Column.__or__, tests)


def with_standard_flag(races: DataFrame) -> DataFrame:
    """``races`` with ``is_standard_race``: false for special markets; an old false stays, an old null becomes true."""
    old = F.coalesce("is_standard_race", F.lit(True)) if "is_standard_race" in races.columns else F.lit(True)
    return races.withColumn("is_standard_race", old & ~F.coalesce(is_no_race(), F.lit(False)))


def limits_from(path: str | None = None) -> dict[str, dict[str, float]]:
    """The limits by era, with those of a settings file (YAML, ``dq_thresholds``) instead where it has them."""
    found = {}
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            found = (yaml.safe_load(f) or {}).get("dq_thresholds") or {}
    return {era: values | {SETTINGS[k]: float(v) for k, v in (found.get(era) or {}).items() if k in SETTINGS} for era, values in ERAS.items()}


def era_of(since: str | None = None, until: str | None = None) -> str:
    """The era of a range of days (ISO texts): by its end, else its start, else from 2017."""
    year = int((until or since or "2017")[:4])
    return "from_2019" if year >= 2019 else "from_2017" if year >= 2017 else "pre_2017"


def between_days(df: DataFrame, day: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The rows of a range of days; a bound that is None is none."""
    df = df if since is None else df.where(F.col(day) >= F.lit(since).cast("date"))
    return df if until is None else df.where(F.col(day) <= F.lit(until).cast("date"))


def all_checks(r, odds: DataFrame, since: str | None = None, until: str | None = None, limits: dict | None = None) -> DataFrame:
    """The twelve checks over the racing tables; the rates and coverage are those of the standard races of a range of days.

    Races, runners, results and history are summed by race and meet in one shuffle by race, where the
    checks are windows over a race's few rows; runners and results meet once more by runner.
    """
    races, runners, results = r.races, r.runners, r.results
    limit = (limits or ERAS)[era_of(since, until)]
    since_until = F.lit(True)
    for bound in ([] if since is None else [F.col("race_date") >= F.lit(since).cast("date")]) + ([] if until is None else [F.col("race_date") <= F.lit(until).cast("date")]):
        since_until = since_until & bound
    bad_time = lambda c: F.coalesce(~F.year(c).between(2010, 2030), F.lit(True)).cast("long")
    # Every table is summed by race before the shuffle; a race that is there twice, or runs at two times, is few rows.
    one_race = with_standard_flag(races).groupBy("race_id", F.col("scheduled_off_utc").alias("t"), "field_size", (F.col("is_standard_race") & since_until).alias("standard")).agg(
        F.count("*").alias("races"), F.sum(bad_time("scheduled_off_utc") + bad_time("decision_cutoff_utc")).alias("bad_times")
    )
    no_trainer, no_jockey = blank("trainer_name"), blank("jockey_name")
    fields = runners.groupBy("race_id").agg(
        F.count("*").alias("runners"), F.count_if(no_trainer).alias("no_trainer"), F.count_if(no_jockey).alias("no_jockey"), F.count_if(~(no_trainer & no_jockey)).alias("named"), F.count_if(no_key("runner_id")).alias("bad_keys")
    )
    placed = results.groupBy("race_id").agg(F.count("*").alias("results"), F.count_if("won").alias("winners"), F.count_if(no_key("runner_id")).alias("bad_keys"))
    ran = r.horse_history.groupBy("race_id", F.col("scheduled_off_utc").alias("t")).agg(F.count("scheduled_off_utc").alias("ran"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one_race, fields, placed, ran])
    race, then = Window.partitionBy("race_id"), Window.partitionBy("race_id", "t")
    total = lambda c, over=race: F.coalesce(F.sum(c).over(over), F.lit(0))
    seen = rows.withColumns({f"all_{c}": total(c) for c in ("races", "runners", "results", "winners", "ran")} | {"ran_then": total("ran", then), "of_standard": total(F.when(F.col("standard"), F.col("races")))})
    known, first = F.col("race_id").isNotNull(), F.col("races").isNotNull()
    counts = {
        "no_missing_keys": F.when(no_key("race_id") & first, F.col("races")).otherwise(0) + F.coalesce("bad_keys", F.lit(0)),
        "timestamp_range": F.col("bad_times"),
        "referential_integrity": F.when(~known | (F.col("all_races") == 0), F.col("results")),
        "single_winner": (F.col("winners") > 2).cast("long"),
        "races_have_runners": F.when(~known | (F.col("all_runners") == 0), F.col("races")),
        "field_size_consistency": F.when(known & (F.col("all_runners") > 0) & (F.col("field_size") != F.col("all_runners")), F.col("races")),
        # A race's rows stand together; the first of them counts for all.
        "no_duplicate_races": F.when(first & (F.col("all_races") > 1), 1 / F.count("races").over(race)),
        "history_timestamps": F.when(known & F.col("t").isNotNull(), F.col("races") * (F.col("all_ran") - F.col("ran_then"))),
        "n": F.when(known, F.col("runners") * F.col("of_standard")),
        "t": F.when(known, F.col("no_trainer") * F.col("of_standard")),
        "j": F.when(known, F.col("no_jockey") * F.col("of_standard")),
        "zero_coverage_races": (known & (F.col("named") == 0) & (F.col("of_standard") > 0)).cast("long"),
    }
    sums = seen.select(*[v.alias(c) for c, v in counts.items()]).agg(*[F.coalesce(F.round(F.sum(c)).cast("long"), F.lit(0).cast("long")).alias(c) for c in counts])
    of_runner = results.groupBy("runner_id").agg(F.count("*").alias("results")).unionByName(runners.groupBy("runner_id").agg(F.count("*").alias("runners")), allowMissingColumns=True)
    orphans = of_runner.groupBy("runner_id").agg(F.sum("results").alias("results"), F.sum("runners").alias("runners")).agg(F.sum(F.when(F.col("runner_id").isNull() | F.col("runners").isNull(), F.col("results"))).alias("runner_integrity"))
    prices = odds.agg(F.count_if((F.col("decimal_odds") <= 1.01) | (F.col("decimal_odds") > 1000) | F.col("decimal_odds").isNull()).alias("odds_range"))
    one = sums.crossJoin(F.broadcast(orphans)).crossJoin(F.broadcast(prices))  # one row each
    most = {"zero_coverage_races": int(limit["zero_coverage"])}
    plain = [c for c in counts if len(c) > 1] + ["runner_integrity", "odds_range"]
    checks = [_check(c, F.coalesce(c, F.lit(0)), most.get(c, 0)) for c in plain]
    checks.append(_check("trainer_jockey_missing_rate", F.when(names_known(limit), 0).otherwise(F.col("t") + F.col("j"))))
    return one.select(F.inline(F.array(*checks)))


def no_key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string") == "", F.lit(True))


def _check(name: str, failed: Column, limit: int = 0) -> Column:
    most = F.lit(limit).cast("long")
    return F.struct(F.lit(name).alias("check"), failed.cast("long").alias("failures"), most.alias("max_failures"), (failed <= most).alias("passed"))


def names_known(limit: dict[str, float]) -> Column:
    """Whether the shares of ``n`` runners without a trainer (``t``) and a jockey (``j``) are within their limits."""
    shares = {who: F.coalesce(F.try_divide(F.col(c) * 100.0, "n"), F.lit(0.0)) for who, c in (("trainer", "t"), ("jockey", "j"))}
    return (shares["trainer"] <= limit["trainer"]) & (shares["jockey"] <= limit["jockey"])


def missing_names(fields: DataFrame, limit: dict[str, float]) -> DataFrame:
    """The check of runners without a trainer or jockey: fails with the number of both if either share is over its limit."""
    counted = fields.agg(F.count("*").alias("n"), F.count_if("no_trainer").alias("t"), F.count_if("no_jockey").alias("j"))
    passed = names_known(limit)
    return counted.select(F.lit("trainer_jockey_missing_rate").alias("check"), F.when(passed, 0).otherwise(F.col("t") + F.col("j")).alias("failures"), F.lit(0).cast("long").alias("max_failures"), passed.alias("passed"))


def coverage(r, countries: list[str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """One row: races, runners and results of a range of days, and the shares of runners with a trainer, jockey and draw.

    ``countries`` compares ``country``, null as empty and upper-cased, where the races have it.
    """
    races = between_days(r.races, "race_date", since, until)
    if countries and "country" in races.columns:
        races = races.where(F.upper(F.coalesce("country", F.lit(""))).isin([c.upper() for c in countries]))
    ids = races.select("race_id")
    shares = [F.round(F.coalesce(F.try_divide(F.count(c), F.count("*")), F.lit(0.0)), 4).alias(f"{c.split('_')[0]}_coverage") for c in ("trainer_id", "jockey_id", "draw")]
    runners = r.runners.join(ids, "race_id").agg(F.count("*").alias("runners"), *shares)
    results = r.results.join(ids, "race_id").agg(F.count("*").alias("results"))
    return ids.agg(F.count("*").alias("races")).crossJoin(runners).crossJoin(results)  # one row each


def assert_all(checks: DataFrame) -> None:
    """Raise with the names of the checks that failed; a check is one row."""
    failed = [f"{c['check']} ({c['failures']} > {c['max_failures']})" for c in checks.where("not passed").collect()]
    if failed:
        raise CheckFailed(", ".join(failed))


def report(checks: DataFrame) -> str:
    """A line a check."""
    return "\n".join(f"{'PASS' if c['passed'] else 'FAIL'} {c['check']}: {c['failures']}" for c in checks.orderBy("check").collect())


def leaks(features: dict[str, DataFrame]) -> DataFrame:
    """For each feature group the rows whose latest input is after the cutoff."""
    parts = [df.agg(F.lit(name).alias("feature"), F.count_if(F.col("event_timestamp_utc") > F.col("decision_cutoff_utc")).alias("leaks")) for name, df in features.items()]
    return reduce(DataFrame.unionByName, parts)


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls and rows of each column, in one pass over the table."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns]))
    return counts.select(pairs.alias("p"), "_n").select("p.column", "p.nulls", F.col("_n").alias("rows"), (F.col("p.nulls") / F.col("_n")).alias("null_rate"))


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))


def gates(matched: int, unmatched: int, ambiguous: int, least: float = 0.90, most_unmatched: float = 0.07, most_ambiguous: float = 0.03) -> dict[str, bool]:
    """Whether a backfill's match rates allow it to go on."""
    total = max(1, matched + unmatched + ambiguous)
    return {"match": matched / total >= least, "unmatched": unmatched / total <= most_unmatched, "ambiguous": ambiguous / total <= most_ambiguous}


def registry_from(path: str) -> dict[str, dict]:
    """The feature registry of a YAML file: feature to its definition, expected range, null policy and so on."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def registry_faults(df: DataFrame, registry: dict[str, dict]) -> DataFrame:
    """feature, out_of_range and forbidden_nulls of the registered features that the table has, in one pass.

    Nulls are forbidden where the null policy begins with ``never null``.
    """
    parts = []
    for name in sorted(registry.keys() & set(df.columns)):
        value, (low, high) = F.col(f"`{name}`"), registry[name].get("expected_range") or (None, None)
        outside = ([] if low is None else [value < low]) + ([] if high is None else [value > high])
        never = str(registry[name].get("null_policy", "")).lower().startswith("never null")
        wrong = F.coalesce(reduce(Column.__or__, outside), F.lit(False)) if outside else F.lit(False)
        parts.append(F.struct(F.lit(name).alias("feature"), F.count_if(wrong).alias("out_of_range"), F.count_if(value.isNull() & F.lit(never)).alias("forbidden_nulls")))
    if not parts:
        return df.sparkSession.createDataFrame([], "feature string, out_of_range long, forbidden_nulls long")
    return df.agg(F.array(*parts).alias("faults")).select(F.explode("faults").alias("f")).select("f.*")
