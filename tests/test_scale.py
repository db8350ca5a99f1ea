"""Steps that only go wrong on larger tables."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import functions as F

from furlong.operators import pit, scoring


def test_equal_scores_share_as_by_sql(spark):
    """Scores that differ in the last digit alone get the shares that SQL gives them, on the same side of a limit."""
    by_hundredths: dict[int, set[float]] = {}
    for rating, weight, draw in product(range(5, 51), range(1, 51), range(1, 7)):
        score = float(rating) * 0.08 + (weight + 100.0 - 120) * 0.02 - float(draw) * 0.05
        by_hundredths.setdefault(round(score * 100), set()).add(score)
    pairs = [(a, b) for same in by_hundredths.values() for a in same for b in same]
    rows = [(race, who, s) for race, pair in enumerate(pairs) for who, s in enumerate(pair)]
    df = scoring.softmax(spark.createDataFrame(rows, "race long, who int, score double"), "score", "race", "p", bounded=True)
    got = {(r.race, r.who): r.p for r in df.collect()}
    for race, pair in enumerate(pairs):
        first, second = map(math.exp, pair)
        for who, want in enumerate((first / (first + second), second / (first + second))):
            for price, limit in ((2.0, 0.0), (2.5, 0.1)):
                assert (got[race, who] - 1 / price > limit) == (want - 1 / price > limit), pair


def test_near_exp(spark):
    values = [*range(-16, 17), -700.5, 700.5, 0.0, *[k / 7 for k in range(-111, 112)]]
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", scoring.near_exp(F.col("x")).alias("y")).collect()
    assert all(math.isclose(r.y, math.exp(r.x), rel_tol=3e-16) for r in rows)
    assert spark.range(1).select(scoring.near_exp(F.lit(None).cast("double")).alias("y")).first().y is None


def test_prior_runs_are_not_sorted_after_the_join(spark):
    """many rows a runner come out of the join; a window over them spilled by the square of careers."""
    base = spark.range(20).selectExpr("id AS runner_id", "id % 3 AS horse_id", "timestamp_seconds(id * 1000) AS decision_cutoff_utc")
    ran = spark.range(40).selectExpr("id AS history_id", "id % 4 AS horse_id", "timestamp_seconds(floor(id / 8) * 4000) AS scheduled_off_utc", "IF(id % 5 = 0, null, id) AS finishing_position")
    joined = pit.prior_runs(base, ran)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join ") < plan.index("Window "), plan
    runs, got = ran.collect(), joined.collect()
    for b in base.collect():
        mine = sorted((r for r in runs if r.horse_id == b.horse_id and r.scheduled_off_utc < b.decision_cutoff_utc), key=lambda r: (-r.scheduled_off_utc.timestamp(), r.history_id))
        want = list(enumerate([r.history_id for r in mine], 1)) or [(1, None)]
        assert sorted((g.rn, g.h_history_id) for g in got if g.runner_id == b.runner_id) == want
    assert pit.prior_runs(base, ran, how="inner", most=2).count() == sum(g.h_history_id is not None and g.rn <= 2 for g in got)


def test_wide_table_writes_runs_once(spark):
    """of the racing tables only ``runs`` is written, and a group's query writes the columns it reads."""
    from furlong.plans import feature_queries
    from furlong.sources.analogue import racing

    r = racing(spark, "/root/testdata/sf0.001")
    r.store_runs(feature_queries.NEEDED["f007_collateral_form"])
    assert set(r.runs.columns) == set(feature_queries.NEEDED["f007_collateral_form"])
    assert "Exchange" not in r.horse_history.select("horse_id")._jdf.queryExecution().executedPlan().toString()


def test_moving_mean_slides_no_frame(spark):
    """a frame of 500 rows was added up for each row; values may be null, and blocks are crossed."""
    values = [None if i % 11 == 0 else float(i * 7 % 13) for i in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double")
    found = scoring.moving_mean(df, ["i"], "v", "m", most=9, least=5)
    assert "specifiedwindowframe(RowFrame, -8" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.i: r.m for r in found.collect()}
    assert len(got) == 500
    for i in range(500):
        last = [v for v in values[max(0, i - 8) : i + 1] if v is not None]
        assert got[i] is None if len(last) < 5 else math.isclose(got[i], sum(last) / len(last), abs_tol=1e-9)


def test_each_course_name_is_normalised_once(spark):
    """the map of spellings was looked through for each race."""
    import __spark_entry__ as entry

    plan = entry.queries()["f16_f26_race_texts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "map(" not in plan and "keys: [" not in plan and "element_at" not in plan


def test_scores_are_derived_once_for_a_fit(spark):
    """the fit and what it is applied to each derived the scores anew."""
    import __spark_entry__ as entry

    for name in ("m07_stacked_logistic", "m03_isotonic_calibration"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan


def test_exchange_lines_are_made_once(spark):
    """F8: each of the four kinds of record derived the runners anew."""
    import __spark_entry__ as entry

    plan = entry.queries()["s05_exchange_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_races_are_written_some_thousands_a_row(spark, monkeypatch):
    """a race was a row of lists, which each level of each tree turned into numbers anew."""
    import numpy as np

    from furlong.operators import ranking

    monkeypatch.setattr(ranking, "BLOCK_RUNNERS", 40)
    rows = [(race if race else None, 100 * race + n, float(n % 3), None if n == 1 else float(race % 5)) for race in range(60) for n in range(1 + race % 9)]
    df = spark.createDataFrame(rows, "race long, id long, gain double, x double")
    want = {(race, i) for race, i, *_ in rows}
    hashes = {r.h: r.id for r in df.select(F.xxhash64("id").alias("h"), "id").collect()}
    races = {r.h: r.race for r in df.select(F.xxhash64("race").alias("h"), "race").collect()}
    of = {i: (gain, 0 if x is None else 1 + int(x > 2)) for _, i, gain, x in rows}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        written = ranking.lists(df.coalesce(2), "race", "id", "gain", ranking.Ranker(["x"], [np.array([2.0])])).toArrow()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    parts = list(ranking.Races.each(written.drop_columns(["key"]).to_batches(), 1))
    assert len(parts) < 25
    got = []
    for part in parts:
        assert (np.diff(part.sizes) >= 0).all() and sum(n * size for _, (n, size) in part.blocks()) == len(part.gains)
        ids = [hashes[h] for h in part.ids]
        assert [(g, b) for g, b in zip(part.gains, part.bins[:, 0], strict=True)] == [of[i] for i in ids]
        got += zip([races[k] for k in np.repeat(part.keys, part.sizes)], ids, strict=True)
    assert len(got) == len(want) and set(got) == want
    # A race is whole, in one row.
    assert sum(len(part.keys) for part in parts) == 60


def test_search_deals_no_race_anew_for_a_trial(spark):
    """each trial dealt the races of calibration and test anew, and fitted on all runners, not on distinct scores."""
    from furlong.operators import ranking
    from furlong.plans import model_queries
    from furlong.sources.analogue import racing

    rows = model_queries.ranker_rows(racing(spark, "/root/testdata/sf0.001"))
    train, calibrate, test = model_queries.split(rows)
    blank = ranking.Ranker(model_queries.FEATURES, ranking.learned_edges(train, model_queries.FEATURES))
    model = ranking.train(model_queries.as_lists(train, blank), blank, ranking.Params(rounds=2))
    valid, held = model_queries.as_lists(calibrate, blank), model_queries.as_lists(test, blank, "sp_decimal")
    bets = model_queries.bets_in(model, valid, held)
    assert "Exchange" not in bets._jdf.queryExecution().executedPlan().toString()
    # The same as by windows over the races and the fit on all runners.
    probs = [scoring.softmax(ranking.scored(part, model), "margin", "race_id", "prob") for part in (calibrate, test)]
    done = scoring.renormalise(scoring.isotonic(*[p.withColumn("prob", F.round("prob", 12)) for p in probs], "prob", "won", "c"), "c", "race_id", "p")
    want = sorted((round(r.p, 9), r.sp_decimal, r.won) for r in done.collect())
    steps = scoring.isotonic_steps(ranking.shares(valid, model).withColumn("share", F.round("share", 12)), "share", "gain", "n")
    got = ranking.calibrated_shares(held, model, lambda p: steps(p.round(12)), "sp_decimal").collect()
    assert sorted((round(r.p, 9), r.sp_decimal, r.gain > 0) for r in got) == want


def test_rates_of_one_key_deal_runners_once(spark):
    """each of five sets of keys dealt all runners, and its runs three times; keys with many rows still go by days."""
    base = spark.range(90).selectExpr("id AS runner_id", "IF(id % 9 = 0, null, id % 4) AS a", "IF(id % 7 = 0, null, id % 2) AS b", "id % 5 + 0.5D AS x", "IF(id % 11 = 0, null, timestamp_seconds(id % 13 * 86400 * 20 + 75600)) AS decision_cutoff_utc")
    ran = spark.range(200).selectExpr("IF(id % 17 = 0, null, id % 5) AS a", "IF(id % 19 = 0, null, id % 3) AS b", "id % 6 + 0.25D AS x", "timestamp_seconds(id % 23 * 86400 * 12 + id * 60) AS t", "id % 3 = 0 AS won", "id % 2 AS odd")
    sets, only, near = [(["a"], {"d90": 90, "odd": None}), (["a", "b"], {"both": None})], {"odd": F.col("odd") == 1}, ("x", 1.0, {"close": 60})
    want = pit.with_rates(base, ran, ["a"], {"d90": 90, "odd": None}, latest=True, only=only)
    want = pit.with_rates(pit.with_rates(want, ran, ["a", "b"], {"both": None}), pit.near_values(ran, "x", base, 1.0), ["a", "x"], {"close": 60})
    rows = sorted(map(str, want.collect()))
    for most in (1_000, 50, 1):
        got = pit.with_rates_by("a", base, ran, sets, only, near, most).select(want.columns)
        assert sorted(map(str, got.collect())) == rows
    plan = pit.with_rates_by("a", base, ran, sets, only, near)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning(a#") == 1


def test_jockey_rates_by_day_are_broadcast(spark):
    """F16: all runners were dealt by jockey and day, and by course name, to meet few rows."""
    from furlong.plans import feature_queries, features
    from furlong.sources.analogue import racing

    r = racing(spark, "/root/testdata/sf0.001")
    r.store_runs(feature_queries.NEEDED["f004_jockey_stats"])
    assert "days_since_prev_run" not in r.runs.columns
    joins = [line for line in features.jockey_stats(r)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line and "_day" in line]
    assert any("rightHint=(strategy=broadcast)" in line for line in joins)


def test_draw_rates_meet_runners_by_day(spark):
    """all runners were dealt by race nine times and joined with rates by quarter, course and going four times."""
    from furlong.plans import features
    from furlong.sources.analogue import racing

    plan = features.draw_bias(racing(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "rightHint=(strategy=broadcast)" in plan
    assert "Window " not in plan and "l_orderkey" not in plan


def test_rates_of_days_by_brute_force(spark):
    """days without runs, days after all runs, and null keys, which match nothing."""
    days = [("a", 1, 1, 2, 10), ("a", 5, 0, 1, 50), ("b", 3, 2, 2, 30), (None, 1, 1, 1, 11)]
    asked = [("a", 1), ("a", 2), ("a", 9), ("b", 3), ("b", 4), ("c", 4), (None, 9)]
    got = pit.rates_of_days(spark.createDataFrame(asked, "k string, _day int"), spark.createDataFrame(days, "k string, _day int, _w long, _n long, _t long"), ["k"], "x").collect()
    want = {}
    for k, day in asked:
        past = [d for d in days if d[0] == k is not None and d[1] < day]
        want[k, day] = (sum(d[2] for d in past) / sum(d[3] for d in past), max(d[4] for d in past)) if past else (None, None)
    assert {(r.k, r._day): (r.x, r.x_latest) for r in got} == want and len(got) == len(asked)


def test_rivals_are_no_join(spark):
    """a row a runner, past run and rival came out of two joins and was dealt by race and by runner."""
    from furlong.plans import feature_queries, features
    from furlong.sources.analogue import racing

    r = racing(spark, "/root/testdata/sf0.001")
    r.store_runs(feature_queries.NEEDED["f007_collateral_form"])
    plan = features.collateral_form(r)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join " not in plan and "Aggregate " not in plan


def test_last_runs_are_those_of_the_join(spark):
    """the latest runs by one order of questions and runs, as by joining each runner with its horse's runs."""
    rows = spark.range(120).selectExpr(
        "id AS runner_id", "id % 4 AS horse_id", "concat(id, '_hist') AS history_id", "IF(id % 13 = 0, null, id) AS finishing_position",
        "IF(id % 17 = 0, null, timestamp_seconds(floor(id / 9) * 4000)) AS scheduled_off_utc", "IF(id % 19 = 0, null, timestamp_seconds(id * 350)) AS decision_cutoff_utc",
    )
    past = rows.select("history_id", "horse_id", "scheduled_off_utc", "finishing_position")
    joined = pit.prior_runs(rows.select("runner_id", "horse_id", "decision_cutoff_utc"), past, finished=True, how="inner", most=3)
    want = {r.runner_id: [x.id for x in sorted(r.ids)] for r in joined.groupBy("runner_id").agg(F.collect_list(F.struct("rn", F.col("h_history_id").alias("id"))).alias("ids")).collect()}
    found = pit.last_runs(rows, F.when(F.col("finishing_position").isNotNull(), F.col("history_id")), 3)
    assert {r.runner_id: r.last for r in found.collect() if r.last} == want and found.count() == 120 and len(want) > 60
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_speed_joins_no_parts_by_runner(spark):
    """a runner's last runs, rides, jockey and trainer were made apart and joined by runner one after another."""
    from furlong.plans import feature_queries, features
    from furlong.sources.analogue import racing

    r = racing(spark, "/root/testdata/sf0.001")
    r.store_runs(feature_queries.NEEDED["f009_speed_and_changes"])
    plan = features.speed_and_changes(r)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("runner_id" in line for line in joins) and all("rightHint=(strategy=broadcast)" in line for line in joins)
    # Runs of one horse in one race are known from the table, without dealing it anew.
    history = r.trainer_history._jdf.queryExecution().optimizedPlan().toString()
    assert "Window " not in history


def test_exchange_records_are_parsed_once(spark):
    """each of some forty fields parsed the record anew, for each of the four kinds of record."""
    from furlong.sources import readers

    texts = ['{"id": "1.5", "runnerName": "Red", "marketStartTime": "2024-04-03T13:05:00Z", "bsp": 2.50, "status": "A\\"B"}', '{"id": "1.6", "runnerName": "Cut", "marketStartTime": "2024-04-03T13:05:00Z", "bs', "[]", "", None]
    made = readers.exchange_records(spark.createDataFrame([(t,) for t in texts], "line string"))
    for df in made.values():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "get_json_object" not in plan and "json_tuple" not in plan
    assert [(r.runner_id, r.sp_decimal, r.finishing_position_raw) for r in made["results"].collect()] == [("bf_1.5_red", 2.5, 'A"B')]


def test_trials_train_until_nothing_is_gained(spark, monkeypatch):
    """a trial of the search grew three trees, where the original stops after a hundred without a gain, of three thousand."""
    from furlong.operators import ranking
    from furlong.plans import model_queries
    from furlong.sources.analogue import racing

    rows, asked = model_queries.ranker_rows(racing(spark, "/root/testdata/sf0.001")), []

    def seen(races, blank, params, valid, patience):
        asked.append((params.rounds, patience))
        return train(races, blank, ranking.Params(rounds=2), valid)

    train = ranking.train
    monkeypatch.setattr(ranking, "train", seen)
    assert len(model_queries.tuned(rows, trials=2)) == 2 and asked == [(3_000, 100)] * 2


def test_kept_scores_grow_the_same_trees(spark, monkeypatch):
    """scores of all trees so far were computed anew for each level of each tree."""
    import numpy as np

    from furlong.operators import ranking

    rows = [(race, 100 * race + n, float((race + n) % 3 == 0), float(n * race % 11), float(race % 5 - n)) for race in range(90) for n in range(2 + race % 6)]
    blank = ranking.Ranker(["x", "y"], [np.arange(10.0), np.arange(-5.0, 5.0)])
    races = ranking.lists(spark.createDataFrame(rows, "race long, id long, gain double, x double, y double"), "race", "id", "gain", blank)
    used = []
    want = ranking.train(races, blank, ranking.Params(rounds=7, subsample=0.8))
    monkeypatch.setattr(ranking, "KEPT_TREES", 2)
    keep = ranking.with_scores
    monkeypatch.setattr(ranking, "with_scores", lambda *a: used.append(a[2]) or keep(*a))
    got = ranking.train(races, blank, ranking.Params(rounds=7, subsample=0.8))
    assert used == [0, 2, 4] and len(got.trees) == 7
    for a, b in zip(want.trees, got.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
