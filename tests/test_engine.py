"""Edge cases of the engine's operators on small made-up tables."""

from __future__ import annotations

import datetime as dt
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from furlong.functions import text
from furlong.operators import dml, lookup, match, pit, quality, scoring, settle, tables
from furlong.operators.match import jaro_winkler_of
from furlong.sources import files, readers
from furlong.sources.analogue import racing
from furlong.streaming import snapshots

DATA = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r["y"] for r in df.select("i", column("x").alias("y")).orderBy("i").collect()]


def at(s):
    return dt.datetime.fromisoformat(s)


@pytest.mark.parametrize(
    ("function", "cases"),
    [
        (text.slugify, {"  Red Rum ": "red_rum", "O'Brien--x": "obrien_x", "!!": None, None: None, "": None}),
        (text.compact, {"Red Rum (IRE)": "redrumire", None: None}),
        (text.normalise_horse, {"Westaway I (IRE)": "westaway", "Mr MoonshineI (IRE)": "mr_moonshine", "Sea Fox FR": "sea_fox", "Galileo AUS": "galileo", "DANCERI (IRE)": "dancer", "": "", None: None}),
        (text.normalise_course, {"GB / Newm 3rd Apr": "Newmarket", "Newm 3rd Apr": "Newmarket", "IRE / Leop 5th May": "Leopardstown", "Wolverhampton Polytrack": "Wolverhampton", "Southwell (AW)": "Southwell", "Epsom Downs": "Epsom", "Nowhere 12th Jun": "nowhere", "fr / abcd 1st": "abcd", "": "", None: None}),
        (text.to_int, {"12": 12, "3.9": 3, "class 4": 4, "x": None, None: None}),
        (text.furlongs, {"2m 4f": 20.0, "5f": 5.0, "2m": 16.0, "abc": None, None: None}),
        (text.non_completion, {"PU": "PU", "3": None, "": None, "ur": "UR", None: None}),
        (text.going_name, {"good to soft (good in places)": "Good To Soft", None: None}),
        (text.grade_of, {"The group 2 stakes": "Group 2", "Listed race": "Listed", "Handicap": None}),
    ],
)
def test_text(spark, function, cases):
    assert values(spark, function, list(cases)) == list(cases.values())


def test_sql_functions_agree(spark):
    text.register(spark)
    text.register(spark)
    for name in ("normalise_course", "normalise_horse"):
        for x in ("GB / Newm 3rd Apr", "Southwell (AW)", "Westaway I (IRE)", "Kempton Park", "ire / cork 1st", "Newm 3rd Apr", "Galileo AUS"):
            sql = spark.sql(f"SELECT {name}(:x) AS y", args={"x": x}).first()["y"]
            assert sql == values(spark, getattr(text, name), [x])[0]


def test_times(spark):
    df = spark.createDataFrame([(at("2024-07-01T13:05:00"), "13:05", "12:50")], "t timestamp, a string, b string")
    r = df.select(text.london_time("t").alias("l"), text.decision_cutoff("t").alias("c"), text.minutes_apart("a", "b").alias("m")).first()
    assert (r["l"], r["c"], r["m"]) == ("14:05", at("2024-06-30T21:00:00"), 15)


def test_verdicts(spark):
    got = values(spark, lambda c: text.verdict(c, ["BET", "PASS"]), ['so {"verdict": "bet"} ok', '{"verdict": "maybe"}', "no json", None])
    assert got == ["BET", None, None, None]


def test_cutoff_is_strict_and_span_inclusive(spark):
    """A run at the cutoff doesn't count; one 90 days before it does; one a second earlier than that doesn't."""
    cutoff = at("2024-06-30T21:00:00")
    runs = [cutoff, cutoff - dt.timedelta(seconds=1), cutoff - dt.timedelta(days=90), cutoff - dt.timedelta(days=90, seconds=1)]
    events = spark.createDataFrame([("k", t, True) for t in runs], "key string, t timestamp, won boolean")
    asked = spark.createDataFrame([(1, "k", cutoff), (2, None, cutoff), (3, "other", cutoff)], "id int, key string, decision_cutoff_utc timestamp")
    got = {r["id"]: r for r in rows(pit.with_rates(asked, events, ["key"], {"d90": 90, "ever": None}, latest=True))}
    assert (got[1]["d90_runs"], got[1]["ever_runs"], got[1]["latest"]) == (2, 3, runs[1])
    assert got[2]["d90_runs"] is None and got[3]["ever_rate"] is None


def test_later_runs_change_nothing(spark):
    base = spark.createDataFrame([(1, "h", at("2024-01-10T21:00:00"))], "runner_id int, horse_id string, decision_cutoff_utc timestamp")
    old = [("a", "h", at("2024-01-01T12:00:00"), 1), ("b", "h", at("2024-01-02T12:00:00"), None)]
    schema = "history_id string, horse_id string, scheduled_off_utc timestamp, finishing_position int"
    before = rows(pit.prior_runs(base, spark.createDataFrame(old, schema)).orderBy("rn"))
    after = rows(pit.prior_runs(base, spark.createDataFrame([*old, ("z", "h", at("2024-01-10T21:00:00"), 1)], schema)).orderBy("rn"))
    assert before == after and [r["h_history_id"] for r in before] == ["b", "a"]
    assert [r["h_history_id"] for r in rows(pit.prior_runs(base, spark.createDataFrame(old, schema), finished=True))] == ["a"]
    debut = rows(pit.prior_runs(base.withColumn("horse_id", F.lit("new")), spark.createDataFrame(old, schema)))
    assert len(debut) == 1 and debut[0]["rn"] == 1 and debut[0]["h_history_id"] is None


def test_equal_times_are_ranked_by_id(spark):
    base = spark.createDataFrame([(1, "h", at("2024-01-10T21:00:00"))], "runner_id int, horse_id string, decision_cutoff_utc timestamp")
    tied = spark.createDataFrame([(x, "h", at("2024-01-01T12:00:00"), 1) for x in "cab"], "history_id string, horse_id string, scheduled_off_utc timestamp, finishing_position int")
    assert [r["h_history_id"] for r in rows(pit.prior_runs(base, tied).orderBy("rn"))] == ["a", "b", "c"]


def test_as_of_last(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 1)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, "five"), ("a", 9, "nine")], "k string, u int, v string")
    assert {r["id"]: r["v"] for r in rows(pit.as_of_last(left, right, ["k"], "t", "u", ["v"]))} == {1: "nine", 2: None, 3: None}


def test_nearest_and_first_within_match_brute_force(spark):
    """Ties, repeated times, times and keys that are null, lone candidates, keys without a partner."""
    drawn = random.Random(5)
    left = [(i, drawn.choice(["a", "b", "c", None]), drawn.choice([None, *range(0, 90, 3)])) for i in range(120)] + [(500, "z", 4), (501, "lone", 90), (502, "lone", None), (503, "timeless", 7)]
    right = [(1000 + i, drawn.choice(["a", "b", "c", None]), drawn.choice([None, *range(0, 90, 5)]), f"r{i}") for i in range(60)] + [(2000, "lone", 1, "x"), (2001, "timeless", None, "y"), (2002, "timeless", None, "z")]
    lefts, rights = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "rid int, k string, u int, v string")
    nearest, within = {}, {}
    for i, k, t in left:
        here = [r for r in right if k is not None and r[1] == k]
        apart = {r[0]: None if t is None or r[2] is None else abs(t - r[2]) for r in here}
        if here:
            best = min(here, key=lambda r: (apart[r[0]] is None, apart[r[0]] or 0, r[0]))
            d = apart[best[0]]
            nearest[i] = (best[0], best[3], d, "high" if len(here) == 1 or (d is not None and d <= 25) else "low" if d is None else "medium")
        close = [r for r in here if apart[r[0]] is not None and apart[r[0]] <= 5]
        if close:
            best = min(close, key=lambda r: (apart[r[0]] > 0, r[0]))
            within[i] = (best[0], best[3], apart[best[0]])
    assert {r["id"]: (r["rid"], r["v"], r["apart"], r["confidence"]) for r in rows(match.nearest_in_time(lefts, rights, ["k"], "t", "u", "rid"))} == nearest
    assert {r["id"]: (r["rid"], r["v"], r["apart"]) for r in rows(match.first_within(lefts, rights, ["k"], "t", "u", "rid"))} == within
    assert {"high", "low"} <= {r[3] for r in nearest.values()}


def test_codes_follow_the_order_of_texts(spark):
    names = ["b", None, "a", "b", "None", "c", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, x string")
    place = {x: k for k, x in enumerate(sorted({x or ("None" if x is None else "") for x in names}))}
    assert {r["i"]: r["code"] for r in rows(scoring.category_code(df, "x", "code"))} == {i: place["None" if x is None else x] for i, x in enumerate(names)}
    assert rows(scoring.category_code(df.where("i < 0"), "x", "code")) == []


def test_updates(spark):
    have = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "k int, v string")
    merged = dml.upsert_ignore(have, new, ["k"], F.col("v"))
    assert sorted((r["k"], r["v"]) for r in rows(merged)) == [(1, "a"), (2, None), (3, "y")]
    assert sorted(rows(dml.upsert_ignore(merged, new, ["k"], F.col("v"))), key=str) == sorted(rows(merged), key=str)
    source = spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert sorted((r["k"], r["v"]) for r in rows(dml.update_from(have, source, ["k"], ["v"]))) == [(1, "b"), (2, "b")]
    assert sorted((r["k"], r["v"]) for r in rows(dml.update_from(have, source, ["k"], ["v"], keep_old=True))) == [(1, "a"), (2, "b")]
    assert dml.add_missing(have, {"v": "string", "w": "double"}).columns == ["k", "v", "w"]


def test_names():
    assert jaro_winkler_of("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler_of("", "a") == 0 and jaro_winkler_of("", "") == 1 and jaro_winkler_of("ab", "cd") == 0
    assert jaro_winkler_of("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)


def test_jaccard_of_empty_sets(spark):
    df = spark.createDataFrame([([], []), (["a"], ["a", "b"])], "a array<string>, b array<string>")
    assert sorted(r["j"] for r in rows(df.select(match.jaccard("a", "b").alias("j")))) == [0.5, 1.0]


def test_cascade_prefers_trust(spark):
    day = dt.date(2024, 5, 2)
    card = ["bold move", "red rum"]
    found = [(1, day, "york", "red rum", card), (2, dt.date(2024, 5, 3), "york", "far cry", card), (3, day, "york", "bold move", card)]
    missing = [("exact", day, "york", "red rum", card), ("off", day, "york", "far cry", card), ("like", day, "york", "bold movee", card), ("none", day, "york", "zzz", card)]
    schema = "day date, course string, name string, card array<string>"
    got = rows(match.cascade(spark.createDataFrame(missing, f"runner_id string, {schema}"), spark.createDataFrame(found, f"row_id int, {schema}")))
    assert {r["runner_id"]: (r["row_id"], r["match_type"]) for r in got} == {"exact": (1, "exact"), "off": (2, "day_off"), "like": (3, "fuzzy")}


def test_scores(spark):
    df = spark.createDataFrame([(1, "r", 700.0), (2, "r", 701.0), (3, "s", 0.0)], "id int, race string, score double")
    p = {r["id"]: r["p"] for r in rows(scoring.softmax(df, "score", "race", "p"))}
    assert p[1] + p[2] == pytest.approx(1) and p[3] == 1 and p[2] / p[1] == pytest.approx(2.718281828)
    zero = spark.createDataFrame([(1, "r", 0.0), (2, "r", 0.0)], "id int, race string, p double")
    assert [r["q"] for r in rows(scoring.renormalise(zero, "p", "race", "q"))] == [0.5, 0.5]
    assert [r["q"] for r in rows(scoring.renormalise(zero, "p", "race", "q", uniform=False))] == [0, 0]


def test_isotonic_is_monotone_and_clips(spark):
    train = spark.createDataFrame([(i / 20, i % 3 == 0 if i < 10 else i % 3 > 0) for i in range(20)], "p double, y boolean")
    apply = spark.createDataFrame([(x,) for x in (-1.0, 0.1, 0.5, 0.9, 5.0)], "p double")
    got = [r["c"] for r in scoring.isotonic(train, apply, "p", "y", "c").orderBy("p").collect()]
    assert got == sorted(got) and 0 <= got[0] and got[-1] <= 1


def test_settling(spark):
    bets = spark.createDataFrame([("a", 5.0), ("b", None), ("c", 4.0), ("d", 0.0)], "runner_id string, back_odds double")
    results = spark.createDataFrame([("a", True, 4.0), ("a", False, None), ("b", True, 3.0), ("c", False, None), ("d", False, 2.0)], "runner_id string, won boolean, sp_decimal double")
    got = {r["runner_id"]: (r["settled"], r["profit"], r["profit_sp"]) for r in rows(settle.settle(bets, results))}
    assert got == {"a": (True, 4.0, 3.0), "b": (True, 2.0, 2.0), "c": (False, 0.0, 0.0), "d": (True, -1.0, -1.0)}


def test_checks(spark, tmp_path):
    r = racing(spark, DATA)
    checks = quality.all_checks(r, r.odds)
    assert checks.count() == 12
    with pytest.raises(quality.CheckFailed, match="timestamp_range"):
        quality.assert_all(checks)
    assert "FAIL timestamp_range" in quality.report(checks)
    assert quality.gates(95, 4, 1) == {"match": True, "unmatched": True, "ambiguous": True}
    assert [quality.era_of(*d) for d in ((None, None), ("2015-01-01", None), (None, "2016-12-31"), ("2015-01-01", "2018-01-01"), ("2020-05-05", None))] == ["from_2017", "pre_2017", "pre_2017", "from_2017", "from_2019"]
    names = spark.createDataFrame([(1, True, False), (2, False, False), (3, False, False)], "race_id long, no_trainer boolean, no_jockey boolean")
    for limit, failed in ((33.0, 1), (34.0, 0)):
        assert quality.missing_names(names, {"trainer": limit, "jockey": 5.0}).first()["failures"] == failed
    settings = tmp_path / "settings.yaml"
    settings.write_text("dq_thresholds:\n  from_2019:\n    max_missing_jockey_pct: 7\n")
    assert quality.limits_from(str(settings))["from_2019"] == {"trainer": 3.0, "jockey": 7.0, "zero_coverage": 0} and quality.limits_from() == quality.ERAS
    odds = spark.createDataFrame([(1.01,), (1.0101,), (1000.0,), (1000.1,), (None,)], "decimal_odds double")
    assert odds.where("decimal_odds <= 1.01 or decimal_odds > 1000 or decimal_odds is null").count() == 3


def test_lookups(spark):
    r = racing(spark, DATA)
    assert len(lookup.call("horse_history", r, horse=7, limit=3)) == 3
    assert lookup.call("trainer_form", r, trainer="nobody") == [{"runs": 0, "wins": 0, "win_rate": None}]
    assert "error" in lookup.call("nothing", r)


def test_csv_and_zip(spark, tmp_path):
    (tmp_path / "dwbfpricesukwin03042024.csv").write_text("EVENT_ID,MENU_HINT,EVENT_NAME,EVENT_DT,SELECTION_ID,SELECTION_NAME,WIN_LOSE,BSP\r\n12,GB / Newm 3rd Apr,2m Hcap,03-04-2024 13:05,7,Red Rum,1,3.5\r\n1.12,GB / Newm 3rd Apr,2m Hcap,03-04-2024 13:05,8,Bold,0,x\r\n,,,,,,,\r\n")
    raw = readers.read_sp_csv(spark, str(tmp_path / "*.csv"))
    records = readers.sp_records(raw)
    race = rows(records["races"])[0]
    assert (race["race_id"], race["field_size"], race["course_name"], race["decision_cutoff_utc"]) == ("bfsp_1.12_win", 2, "Newmarket", at("2024-04-02T21:00:00"))
    assert sorted((x["won"], x["sp_decimal"]) for x in rows(records["results"])) == [(False, None), (True, 3.5)]
    assert {k: v.count() for k, v in records.items()} == {"races": 1, "runners": 2, "results": 2, "horse_history": 2}
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("m.json", json.dumps({"market_id": "1.5", "runnerName": "", "horse_name": "Bold", "bsp": "2.5"}) + "\nnot json\n[1]\n")
    got = rows(readers.api_runners(readers.read_zip_lines(spark, str(tmp_path / "*.zip"))))
    assert got == [{"market_id": "1.5", "horse_name": "Bold", "off": None, "sp_decimal": 2.5}]


def test_stream_equals_batch(spark, tmp_path):
    odds = racing(spark, DATA).odds.select("snapshot_id", "runner_id", "snapshot_timestamp_utc", "snapshot_label", "decimal_odds")
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    odds.repartition(4).write.parquet(source)
    snapshots.append(snapshots.once_each(snapshots.read(spark, source), "60 days"), out, state)
    odds.limit(20).write.mode("append").parquet(source)
    snapshots.append(snapshots.once_each(snapshots.read(spark, source), "60 days"), out, state)
    stored = spark.read.parquet(out)
    assert stored.count() == odds.count() == stored.select("snapshot_id").distinct().count()
    stream = snapshots.by_window(snapshots.read(spark, source).dropDuplicates(["snapshot_id"]))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, rows(spark.table("windows").select("start", "snapshot_label", "n")))) == sorted(map(str, rows(snapshots.by_window(odds).select("start", "snapshot_label", "n"))))


def test_stream_alerts(spark, tmp_path):
    t = at("2024-01-01T21:00:00")
    data = [(1, 7, t, "evening_21h", 4.0), (2, 7, t + dt.timedelta(hours=12), "morning_09h", 5.0), (3, 8, t, "evening_21h", 4.0), (4, 8, t + dt.timedelta(hours=12), "morning_09h", 4.2)]
    source = str(tmp_path / "in")
    spark.createDataFrame(data, snapshots.SCHEMA).write.parquet(source)
    query = snapshots.moves(snapshots.read(spark, source)).writeStream.format("memory").queryName("alerts").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["runner_id"], r["evening_odds"], r["morning_odds"]) for r in rows(spark.table("alerts"))] == [(7, 4.0, 5.0)]


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2), (2, 3, 1, 0)])
def test_stream_join_in_any_order(spark, tmp_path, order):
    t = at("2024-01-01T21:00:00")
    parts = [
        [(1, 7, t, "evening_21h", 4.0), (2, 8, t, "evening_21h", 4.0), (3, 9, t, "evening_21h", 0.0)],
        [(4, 7, t + dt.timedelta(hours=12), "morning_09h", 5.0), (5, 8, t + dt.timedelta(hours=12), "morning_09h", 4.2), (6, 9, t + dt.timedelta(hours=12), "morning_09h", 4.2)],
        [(7, 7, t + dt.timedelta(minutes=5), "evening_21h", 10.0), (8, 7, t + dt.timedelta(hours=16), "morning_09h", 2.0)],
        [(9, 7, t + dt.timedelta(hours=16, seconds=1), "morning_09h", 2.0), (10, None, t, "evening_21h", 1.0), (11, 7, t + dt.timedelta(hours=1), "near_off", 90.0), (12, 7, t, "morning_09h", 90.0)],
    ]
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for i in order:
        spark.createDataFrame(parts[i], snapshots.SCHEMA).coalesce(1).write.mode("append").parquet(source)
        snapshots.append(snapshots.morning_moves(snapshots.read(spark, source, files_a_batch=1)), out, state)
    got = {(r["evening_id"], r["snapshot_id"]) for r in rows(spark.read.parquet(out))}
    assert got == {(1, 4), (1, 8), (7, 4), (7, 8), (7, 9)}
    assert got == {(r["evening_id"], r["snapshot_id"]) for r in rows(snapshots.morning_moves(spark.read.parquet(source)))}


def test_course_spellings(spark, tmp_path):
    path = tmp_path / "courses.yaml"
    path.write_text("Galway: Ballybrit\nYork:\nwexx: The Flat\n")
    own = lookup.spellings_from(str(path))
    assert own == {"galway": "Ballybrit", "wexx": "The Flat"}
    names = ["GB / Newm 3rd Apr", "FR / Wexx 1st Jan", "galway (AW)", "Wolverhampton Polytrack", "Nowhere 12th Jun", "fr / abcd 1st", "", None]
    df = spark.createDataFrame([(n, "old", 1, n) for n in names], "name string, course string, row int, token string")
    plain = {r["name"]: r["course"] for r in rows(lookup.with_course(df, "name", "course"))}
    assert plain == {r["name"]: r["c"] for r in rows(df.select("name", text.normalise_course("name").alias("c")))}
    edited = lookup.with_course(df, "name", "course", own)
    assert {r["name"]: r["course"] for r in rows(edited)} == plain | {"FR / Wexx 1st Jan": "The Flat", "galway (AW)": "Ballybrit"}
    assert sorted(edited.columns) == sorted(df.columns) and "Exchange hashpartitioning" not in edited._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="spellings"):
        lookup.with_course(df, "name", "course", {str(i): "x" for i in range(lookup.MOST_SPELLINGS)})


def test_checks_scan_little(spark):
    r = racing(spark, DATA)
    r.store()
    plan = quality.all_checks(r, r.odds)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 8


def test_checks_of_null_keys(spark):
    from types import SimpleNamespace

    r = racing(spark, DATA)
    none = F.when(F.col("race_id") % 5 != 0, F.col("race_id")).alias("race_id")
    nulled = {t: getattr(r, t).withColumn("race_id", none) for t in ("races", "runners", "results", "horse_history")}
    got = {c["check"]: c["failures"] for c in rows(quality.all_checks(SimpleNamespace(**nulled), r.odds))}
    fifth = r.races.where("race_id % 5 = 0").count()
    empty_field = r.races.where("race_id % 5 <> 0").join(r.runners, "race_id", "left_anti").count()
    assert got["no_missing_keys"] == fifth and got["races_have_runners"] == fifth + empty_field and got["no_duplicate_races"] == 1
    assert got["referential_integrity"] == r.results.where("race_id % 5 = 0").count() and got["runner_integrity"] == 0
    empty = SimpleNamespace(**{t: df.limit(0) for t, df in nulled.items()})
    assert {c["failures"] for c in rows(quality.all_checks(empty, r.odds.limit(0)))} == {0}


def test_sessions(spark):
    t = at("2024-01-01T10:00:00")
    data = [(i, 1, t + dt.timedelta(minutes=m), "near_off", 2.0) for i, m in enumerate((0, 10, 70, 75))]
    got = rows(snapshots.by_session(spark.createDataFrame(data, snapshots.SCHEMA)).orderBy("start"))
    assert [r["n"] for r in got] == [2, 2]


def test_free_times_and_kinds(spark):
    got = values(spark, text.free_time, ["2024-04-03", "03-04-2024 13:05", "13/04/2024", "3 Apr 2024", "Apr 3 2024 1:05:09", "apr 31 2024", "x", "", None])
    assert got == [at("2024-04-03T00:00:00"), at("2024-03-04T13:05:00"), at("2024-04-13T00:00:00"), at("2024-04-03T00:00:00"), at("2024-04-03T01:05:09"), None, None, None, None]
    assert values(spark, text.race_kind, ["2m NHF", "Steeplechase", "Hrd Chs", None]) == ["NH Flat", "Chase", "Chase", "Flat"]
    assert values(spark, text.whole, ["3.9", "1st", "nan", "1e99", None]) == [3, None, None, None, None]
    assert values(spark, text.to_int, ["99999999999"]) == [None]


def test_file_names(spark):
    names = ["dwbfpricesuswin03042024.csv", "dwbfpricesuswin31022024.csv", "dwbfPricesAUSplace03042024.csv", "dwbfpricesirewin03042024.csv"]
    got = rows(spark.createDataFrame([(n,) for n in names], "file string").select(readers.file_date().alias("d"), readers.file_market().alias("m")))
    assert [(r["d"] is not None, r["m"]["country"], r["m"]["market_type"]) for r in got] == [(True, "GB", "WIN"), (False, "GB", "WIN"), (True, "AUS", "PLACE"), (True, "IE", "WIN")]


def test_files_are_read_once(spark, tmp_path):
    for day in ("01042024", "02042024", "03052024"):
        (tmp_path / f"pricesukwin{day}.csv").write_text("a\n1\n")
    found = files.listed(spark, str(tmp_path / "*.csv"))
    done = str(tmp_path / "done")
    first = files.chosen(found, "2024-04-01", "2024-04-01")
    files.mark_done(first, done)
    rest = files.unread(files.chosen(found, until="2024-04-30", tokens=("UKwin", "ire")), spark.read.parquet(done))
    assert [r["file"].rsplit("/", 1)[1] for r in rows(rest)] == ["pricesukwin02042024.csv"]


def test_form_files_of_several_layouts(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('Horse,Date,Course,Trainer,Jockey,Horse\n"Red, Rum",2024-04-03,York,,J,other\n')
    (tmp_path / "c.csv").write_bytes(b"\xef\xbb\xbfdate,HORSE,jockey,trainer,course\r\n2024-04-04,Bold,,T,Ayr\r\n")
    (tmp_path / "d.csv").write_text("horse,date\nNo,2024-04-05\n")
    (tmp_path / "e.csv").write_bytes(b"\xff\xfe\x00bad\n")
    (tmp_path / "f.csv").write_text("")
    got = rows(files.raw_form(spark, str(tmp_path / "*.csv")))
    assert sorted((r["horse"], r["date"], r["course"], r["trainer"], r["jockey"]) for r in got) == [("Bold", "2024-04-04", "Ayr", "T", None), ("Red, Rum", "2024-04-03", "York", None, "J")]
    assert all(r["source_file"].endswith(".csv") and r["loaded_at_utc"] for r in got)
    assert rows(files.read_layouts(spark, str(tmp_path / "f.csv"), readers.ALIASES)) == []


def test_form_rows(spark):
    raw = spark.createDataFrame([("2024-04-03", "York", "Red Rum (IRE)", "PU", "£1,200", "Class 4", None), ("2024-04-03", "York", "Bold", "1", None, "x", " "), ("never", "York", "Late", "2", None, None, None), ("2024-04-03", " ", "Lost", "2", None, None, None)], "date string, track string, horse string, pos string, prize string, class string, trainer string")
    got = {r["horse_name"]: r for r in rows(readers.form_rows(readers.aliased(raw)))}
    assert set(got) == {"Red Rum (IRE)", "Bold"}
    assert (got["Red Rum (IRE)"]["non_completion"], got["Red Rum (IRE)"]["prize_money_gbp"], got["Red Rum (IRE)"]["race_class"], got["Red Rum (IRE)"]["won"]) == ("PU", 1200.0, 4, None)
    assert (got["Bold"]["won"], got["Bold"]["non_completion"], got["Bold"]["trainer_name"], got["Bold"]["race_class"]) == (True, None, None, None)


def test_starting_price_counts(spark):
    schema = "event_id string, selection_id string, selection_name string, event_dt string"
    df = spark.createDataFrame([("1", "2", "a", "03-04-2024 13:05"), ("1", "2", "a", "late"), (None, "2", "a", "03-04-2024 13:05"), ("1", " ", "a", "03-04-2024 13:05")], schema)
    assert rows(readers.sp_counts(df)) == [{"read": 4, "failed": 3}]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("a.csv", "market_id,horse_name\n1.5,Bold\n")
        z.writestr("b.txt", '{"market_id": "no"}\n')
        z.writestr("c.JSONL", '{"id": "1.6", "runnerName": "Red", "btn_lengths": 0, "marketStartTime": "2024-04-03T13:05:00Z", "finishingPosition": 1}\n\n{"id": "1.6", "runnerName": "Red", "marketStartTime": "soon"}\n')
    lines = readers.read_zip_lines(spark, str(tmp_path / "*.zip"))
    assert lines.count() == 3
    got = readers.exchange_records(lines)
    assert {k: v.count() for k, v in got.items()} == {"races": 1, "runners": 1, "results": 1, "horse_history": 1}
    result = rows(got["results"])[0]
    assert (result["result_id"], result["won"], result["btn_lengths"], result["decision_cutoff_utc"]) == ("bf_1.6_red_res", True, 0.0, at("2024-04-02T21:00:00"))


def test_zip_members_spread(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    with zipfile.ZipFile(folder / "big.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(40):
            z.writestr(f"{i:02d}.jsonl", "".join(json.dumps({"id": i * 100 + k}) + "\n" for k in range(100)))
        z.writestr("00.jsonl", '{"id": -1}\n')  # a second member of that name
        z.writestr("empty.json", "")
    zipfile.ZipFile(folder / "none.zip", "w").close()
    members = readers.zip_members(spark, str(folder / "*.zip"))
    assert (members.count(), members.select("place").distinct().count()) == (42, 42)
    lines = readers.read_zip_lines(spark, str(folder / "*.zip"), 8)
    got = lines.select(F.get_json_object("line", "$.id").cast("long").alias("id"), F.spark_partition_id().alias("p")).collect()
    assert sorted(r["id"] for r in got) == [-1, *range(4_000)]
    assert len({r["p"] for r in got}) > 4


def test_zip_files_written(spark, tmp_path):
    lines = spark.range(2_500).repartition(2).selectExpr("concat('{\"id\": ', id, '}') AS line")
    folder = f"file://{tmp_path}/zips"
    written = rows(readers.write_zip_lines(lines, folder, 500))
    assert sum(r["lines"] for r in written) == 2_500 and len(written) == 2
    assert readers.zip_members(spark, f"{folder}/*.zip").count() >= 5
    assert sorted(r["line"] for r in rows(readers.read_zip_lines(spark, f"{folder}/*.zip"))) == sorted(r["line"] for r in rows(lines))
    assert rows(readers.write_zip_lines(lines.where("line IS NULL"), f"{folder}-empty")) == []


def test_tables_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    folder = str(tmp_path / "tables")
    tables.create(spark, folder, {"t": df})
    df.write.mode("append").parquet(f"{folder}/t")
    tables.create(spark, folder, {"t": df})
    assert spark.read.parquet(f"{folder}/t").count() == 1
    tables.create(spark, folder, {"t": df}, reset=True)
    assert spark.read.parquet(f"{folder}/t").count() == 0 and spark.read.parquet(f"{folder}/t").schema == df.schema
    tables.write_sinks({"s": df}, str(tmp_path / "sinks"), dry_run=True)
    assert not (tmp_path / "sinks").exists()


def test_moving_mean_matches_brute_force(spark):
    drawn = random.Random(3)
    for n in (0, 1, 2, 7, 200):
        data = [(i, float(drawn.randint(-5, 5))) for i in range(n)]
        drawn.shuffle(data)
        got = {r["i"]: r["m"] for r in rows(scoring.moving_mean(spark.createDataFrame(data, "i int, v double"), ["i"], "v", "m", most=40, least=3))}
        ordered, w = [v for _, v in sorted(data)], max(1, min(40, n // 3))
        want = {i: (sum(part) / len(part) if len(part := ordered[max(0, i - w + 1) : i + 1]) >= 3 else None) for i in range(n)}
        assert got == pytest.approx(want)


def test_registry(spark, tmp_path):
    path = tmp_path / "registry.yaml"
    path.write_text("a:\n  expected_range: [0.0, 1.0]\n  null_policy: impute\nb:\n  null_policy: never null\nc:\n  expected_range: [0, 1]\n")
    df = spark.createDataFrame([(0.5, None), (1.5, 1), (None, 2)], "a double, b int")
    got = {r["feature"]: (r["out_of_range"], r["forbidden_nulls"]) for r in rows(quality.registry_faults(df, quality.registry_from(str(path))))}
    assert got == {"a": (1, 0), "b": (0, 1)}
    assert rows(quality.registry_faults(df, {})) == []
