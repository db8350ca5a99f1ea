"""Registered queries of the feature groups and the wide table, with oracles in the naive join form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.operators.quality import NO_COURSES, NO_RACE_TYPES, NO_RACES
from furlong.plans import features
from furlong.sources.analogue import CTES, racing


def comparable(df: DataFrame) -> DataFrame:
    """Doubles to six places, whole numbers as long, times without a zone."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.LongType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def _query(name: str, make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = racing(spark, sf_dir)
        if name in features.GROUPS and name not in READ_ONCE:
            r.store_runs(NEEDED.get(name))
        return comparable(make(r))

    run.__name__ = name
    return run


_IDS = ["runner_id", "race_id", "horse_id", "decision_cutoff_utc", "scheduled_off_utc", "finishing_position"]
_FORM = [*_IDS, "headgear", "course_id", "going_code", "distance_furlongs", "race_class", "won", "official_rating", "rpr", "field_size", "non_completion"]
_RATES = ["runner_id", "race_id", "horse_id", "trainer_id", "trainer_name", "course_name", "distance_furlongs", "decision_cutoff_utc", "scheduled_off_utc", "won"]
#: The columns of ``runs`` that a group reads; they are written once. Groups that aren't listed read most of them.
NEEDED = {
    "f001_horse_form": _FORM,
    "f003_trainer_stats": [*_RATES, "going_code", "race_rests"],
    "f004_jockey_stats": [*_RATES, "jockey_id", "jockey_name", "race_times"],
    "f005_class_features": [*_FORM, "race_grade", "race_type", "is_handicap", "prize_money_gbp"],
    "f006_race_context": [*_IDS, "field_size", "going_code", "surface", "race_type", "distance_furlongs", "race_date"],
    "f007_collateral_form": [*_IDS, "won"],
    "f008_runner_profile": [*_IDS, "won", "weight_lbs", "age", "official_rating"],
    "f009_speed_and_changes": [*_RATES, "jockey_id", "jockey_name", "weight_lbs", "race_type", "going_code", "btn_lengths", "race_times"],
}
#: Groups that read ``runs`` once, so that it isn't written for them.
READ_ONCE = {"f002_draw_bias", "f007_collateral_form"}
QUERIES = {name: _query(name, make) for name, make in features.GROUPS.items()} | {"feature_store": _query("feature_store", features.feature_store)}


def _rate(won: str, condition: str) -> str:
    return f"round(avg(CAST(coalesce({won}, false) AS INTEGER)) FILTER (WHERE {condition}), 6)"


def _going_case(column: str) -> str:
    return "CASE " + " ".join(f"WHEN lower({column}) IN ({', '.join(repr(c) for c in codes)}) THEN '{g}'" for g, codes in features.GOING_GROUPS.items()) + " END"


def _venue(column: str) -> str:
    return rf"regexp_replace({column}, '_\d+\w*_\w+$', '')"


FIELDS = "runners u JOIN races a USING (race_id)"
PAST = f"""
past AS (
  SELECT u.runner_id, u.race_id, a.decision_cutoff_utc AS cutoff, u.headgear AS gear, a.race_class AS class_now, {_venue('a.course_id')} AS venue_now,
    a.going_code AS going_now, {_going_case('a.going_code')} AS group_now, a.distance_furlongs AS dist_now, h.*, {_venue('h.course_id')} AS venue,
    {_going_case('h.going_code')} AS grp, CAST(h.finishing_position AS DOUBLE) AS fp, h.finishing_position IS NOT NULL AS fin,
    u.weight_lbs AS weight_now, u.jockey_id AS jockey_now, u.trainer_name AS trainer_now,
    row_number() OVER (PARTITION BY u.runner_id ORDER BY h.scheduled_off_utc DESC NULLS LAST, h.history_id NULLS LAST) AS rn
  FROM {FIELDS} LEFT JOIN (SELECT * EXCLUDE (runner_id, race_id), race_id AS past_race, horse_id AS h_horse FROM horse_history) h
    ON h.h_horse = u.horse_id AND h.scheduled_off_utc < a.decision_cutoff_utc)"""

ALIKE = {"going": "going_code = going_now", "going_group": "grp = group_now", "distance": "abs(coalesce(distance_furlongs, 0) - coalesce(dist_now, 0)) <= 1", "course": "venue = venue_now"}

FORM = f"""{PAST},
form AS (
  SELECT runner_id, race_id, cutoff,
    list(finishing_position ORDER BY scheduled_off_utc DESC NULLS LAST, history_id) FILTER (WHERE rn <= 3) AS horse_runs_last_3_positions,
    avg(fp) FILTER (WHERE rn <= 5) AS horse_runs_last_5_positions,
    count(*) FILTER (WHERE won AND rn <= 5) AS horse_wins_last_5,
    {_rate('won', 'rn <= 10')} AS horse_win_rate_last_10,
    date_diff('day', max(scheduled_off_utc), cutoff) AS horse_days_since_last_run,
    count(*) FILTER (WHERE scheduled_off_utc >= cutoff - INTERVAL 90 DAY) AS horse_runs_last_90_days,
    {', '.join(f"{_rate('won', f'{c} AND fin')} AS horse_{k}_affinity, {_rate('fp <= 3', f'{c} AND fin AND field_size > 0')} AS horse_{k}_place_rate" for k, c in ALIKE.items())},
    CAST(count(*) FILTER (WHERE venue = venue_now AND fin) AS BIGINT) AS horse_course_runs,
    sum((1 - fp / field_size) * (6 - rn)) FILTER (WHERE rn <= 5 AND fin) / sum(6 - rn) FILTER (WHERE rn <= 5 AND fin) AS horse_weighted_form,
    {_rate('fp <= 3', 'rn <= 5 AND fin')} AS horse_place_rate_last_5, {_rate('fp <= 3', 'rn <= 10 AND fin')} AS horse_place_rate_last_10,
    avg(fp) FILTER (WHERE rn <= 3) - avg(fp) FILTER (WHERE rn BETWEEN 4 AND 10) AS horse_improvement_index,
    avg(fp / field_size) FILTER (WHERE rn <= 5) AS horse_avg_position_pct_last_5,
    max(official_rating) FILTER (WHERE rn <= 5) AS horse_best_rpr_last_5, max(rpr) FILTER (WHERE rn <= 5) AS horse_best_rpr_rp_last_5,
    avg(rpr) FILTER (WHERE rn <= 3) AS horse_avg_rpr_last_3, max(rpr) FILTER (WHERE rn = 1) AS horse_last_rpr,
    avg(race_class) FILTER (WHERE rn <= 3) AS horse_avg_class_last_3, any_value(class_now) AS class_now, any_value(gear) AS gear,
    CASE WHEN count(fp) FILTER (WHERE rn <= 5) >= 3 THEN regr_slope(fp, rn) FILTER (WHERE rn <= 5) END AS horse_form_trend,
    max(headgear) FILTER (WHERE rn = 1) AS last_gear,
    CAST(count(*) FILTER (WHERE non_completion = 'PU') AS DOUBLE) / count(*) AS horse_pu_rate,
    CAST(count(non_completion) FILTER (WHERE rn <= 5) AS BIGINT) AS horse_nc_last_5, max(scheduled_off_utc) AS latest
  FROM past GROUP BY runner_id, race_id, cutoff),
f001 AS (
  SELECT * EXCLUDE (cutoff, class_now, gear, last_gear, latest), class_now - horse_avg_class_last_3 AS horse_class_delta,
    CASE WHEN gear <> '' AND coalesce(last_gear, '') = '' THEN 1 ELSE 0 END AS horse_first_time_headgear,
    coalesce(latest, cutoff - INTERVAL 1 SECOND) AS event_timestamp_utc, cutoff AS decision_cutoff_utc
  FROM (SELECT * FROM form))"""

AW = "lower(surface) IN ('aw', 'allweather', 'all_weather')"
F002 = f"""
quarters AS (SELECT u.*, a.* EXCLUDE (race_id), ntile(4) OVER (PARTITION BY u.race_id ORDER BY draw NULLS LAST, runner_id) AS q FROM {FIELDS}),
drawn AS (SELECT ntile(4) OVER (PARTITION BY u.race_id ORDER BY draw, runner_id) AS q, a.course_id, coalesce(a.going_code, '') AS going, a.scheduled_off_utc AS t, r.won
  FROM {FIELDS} JOIN results r USING (runner_id) WHERE draw IS NOT NULL AND (lower(race_type) LIKE '%flat%' OR {AW})),
wins AS (
  SELECT b.runner_id, max(t) AS latest, {_rate('d.won', "d.course_id = b.course_id AND d.going = coalesce(b.going_code, '')")} AS r1,
    {_rate('d.won', 'd.course_id = b.course_id')} AS r2, {_rate('d.won', "d.going = coalesce(b.going_code, '')")} AS r3, {_rate('d.won', 'true')} AS r4,
    avg(CAST(d.won AS INTEGER)) FILTER (WHERE d.course_id = b.course_id AND d.going = coalesce(b.going_code, '')) AS e1,
    avg(CAST(d.won AS INTEGER)) FILTER (WHERE d.course_id = b.course_id) AS e2, avg(CAST(d.won AS INTEGER)) FILTER (WHERE d.going = coalesce(b.going_code, '')) AS e3, avg(CAST(d.won AS INTEGER)) AS e4
  FROM quarters b JOIN drawn d ON d.q = b.q AND b.draw IS NOT NULL AND d.t < b.decision_cutoff_utc GROUP BY 1),
f002 AS (
  SELECT b.runner_id, b.race_id, draw AS draw_position,
    CASE WHEN lower(surface) <> 'jumps' AND draw IS NOT NULL THEN least(1.0, draw / field_size) END AS draw_field_percentile,
    CASE WHEN lower(surface) <> 'jumps' THEN coalesce(r1, r2, r3, r4) END AS draw_course_going_win_rate,
    CASE WHEN lower(surface) <> 'jumps' THEN coalesce(e1, e2, e3, e4) / (CAST(1 AS DOUBLE) / CAST(field_size AS DOUBLE)) END AS draw_bias_coefficient,
    CAST(draw IS NULL AS INTEGER) AS draw_is_null, coalesce(latest, decision_cutoff_utc - INTERVAL 1 SECOND) AS event_timestamp_utc, decision_cutoff_utc
  FROM quarters b LEFT JOIN wins w USING (runner_id))"""

KNOWN = "coalesce(nullif(trim({}), ''), 'Unknown')"
IN90 = "t >= cutoff - INTERVAL 90 DAY"
NEAR = "abs(dist - dist_now) <= 1"
F003 = f"""
tbase AS (SELECT runner_id, race_id, {KNOWN.format('trainer_name')} AS who, lower(course_name) AS course_now, coalesce(going_code, '') AS going_now,
  coalesce(distance_furlongs, 0) AS dist_now, decision_cutoff_utc AS cutoff FROM {FIELDS}),
thist AS (SELECT {KNOWN.format('trainer_name')} AS who, lower(course_name) AS course, coalesce(going_code, '') AS going, coalesce(distance_furlongs, 0) AS dist,
  days_since_last_run AS rest, scheduled_off_utc AS t, won FROM trainer_history),
f003 AS (
  SELECT runner_id, race_id, {_rate('won', f'won IS NOT NULL AND {IN90}')} AS trainer_win_rate_90d,
    coalesce({_rate('won', f'course = course_now AND {IN90}')}, {_rate('won', 'course = course_now')}) AS trainer_win_rate_course_90d,
    {_rate('won', f'going = going_now AND {IN90}')} AS trainer_win_rate_going_90d, {_rate('won', f'{NEAR} AND {IN90}')} AS trainer_win_rate_dist_band_90d,
    count(t) FILTER (WHERE {IN90}) AS trainer_runs_90d, {_rate('won', 'course = course_now AND going = going_now')} AS trainer_course_going_win_rate,
    {_rate('won', NEAR)} AS trainer_dist_alltime_win_rate, {_rate('won', 'rest > 60')} AS trainer_fresh_win_rate, count(t) FILTER (WHERE rest > 60) AS trainer_fresh_runs,
    CAST(who = 'Unknown' AS INTEGER) AS trainer_is_unknown, coalesce(max(t), cutoff - INTERVAL 1 SECOND) AS event_timestamp_utc, cutoff AS decision_cutoff_utc
  FROM tbase LEFT JOIN thist USING (who) WHERE t IS NULL OR t < cutoff GROUP BY runner_id, race_id, who, cutoff
  UNION ALL BY NAME
  SELECT runner_id, race_id, 0 AS trainer_runs_90d, 0 AS trainer_fresh_runs, CAST(who = 'Unknown' AS INTEGER) AS trainer_is_unknown, cutoff - INTERVAL 1 SECOND AS event_timestamp_utc, cutoff AS decision_cutoff_utc
  FROM tbase b WHERE EXISTS (FROM thist h WHERE h.who = b.who) AND NOT EXISTS (FROM thist h WHERE h.who = b.who AND h.t < b.cutoff))"""
F004 = f"""
jbase AS (SELECT runner_id, race_id, {KNOWN.format('jockey_name')} AS who, {KNOWN.format('trainer_name')} AS tr_now, lower(course_name) AS course_now,
  coalesce(distance_furlongs, 0) AS dist_now, decision_cutoff_utc AS cutoff FROM {FIELDS}),
jhist AS (SELECT {KNOWN.format('j.jockey_name')} AS who, {KNOWN.format('t.trainer_name')} AS tr, lower(j.course_name) AS course, coalesce(j.distance_furlongs, 0) AS dist, j.scheduled_off_utc AS t, j.won
  FROM jockey_history j LEFT JOIN trainer_history t USING (race_id, trainer_id)),
f004 AS (
  SELECT b.runner_id, b.race_id, {_rate('won', IN90)} AS jockey_win_rate_90d, coalesce({_rate('won', f'course = course_now AND {IN90}')}, {_rate('won', 'course = course_now')}) AS jockey_win_rate_course_90d,
    {_rate('won', f'tr = tr_now AND {IN90}')} AS jockey_trainer_combo_win_rate, count(t) FILTER (WHERE tr = tr_now AND {IN90}) AS jockey_trainer_combo_runs,
    count(t) FILTER (WHERE {IN90}) AS jockey_runs_90d, {_rate('won', f'{NEAR} AND {IN90}')} AS jockey_dist_win_rate_90d, CAST(b.who = 'Unknown' AS INTEGER) AS jockey_is_unknown,
    coalesce(max(t), cutoff - INTERVAL 1 SECOND) AS event_timestamp_utc, cutoff AS decision_cutoff_utc
  FROM jbase b LEFT JOIN jhist h ON h.who = b.who AND h.t < b.cutoff GROUP BY b.runner_id, b.race_id, b.who, cutoff)"""
GRADE = "lower(coalesce(race_grade, ''))"
F005 = f"""
f005 AS (
  SELECT u.runner_id, u.race_id, CASE WHEN race_class BETWEEN 1 AND 7 THEN race_class {' '.join(f"WHEN {GRADE} = '{k}' THEN {v}" for k, v in features.GRADE_CLASS.items())} END AS race_class_encoded,
    coalesce(is_handicap, false) AS is_handicap,
    CASE {GRADE} WHEN 'group 1' THEN 'Group1' WHEN 'listed' THEN 'Listed' ELSE CASE WHEN is_handicap THEN 'Handicap' ELSE 'Other' END END AS race_grade,
    ln(prize_money_gbp + 1) AS prize_money_log, CASE WHEN race_class BETWEEN 1 AND 7 THEN race_class - horse_avg_class_last_3 END AS horse_class_delta,
    CAST(coalesce(race_class BETWEEN 1 AND 7 AND race_class - horse_avg_class_last_3 >= 1, false) AS INTEGER) AS is_class_dropper,
    horse_first_time_headgear AS is_first_time_headgear, a.decision_cutoff_utc - INTERVAL 1 SECOND AS event_timestamp_utc, a.decision_cutoff_utc
  FROM {FIELDS} LEFT JOIN f001 f ON f.runner_id = u.runner_id)"""
F006 = f"""
style AS (
  SELECT runner_id, race_id, max(scheduled_off_utc) AS latest, coalesce(avg(CAST(coalesce(fp <= 2, false) AS INTEGER)) FILTER (WHERE rn <= 3) >= 0.5, false) AS front,
    coalesce(avg(CAST(coalesce(fp >= ceil(field_size * 0.75), false) AS INTEGER)) FILTER (WHERE rn <= 3) >= 0.5, false) AS held FROM past GROUP BY ALL),
pace AS (SELECT race_id, count(*) FILTER (WHERE front) AS fr, count(*) FILTER (WHERE held) AS hu, max(latest) AS latest FROM style GROUP BY 1),
f006 AS (
  SELECT u.runner_id, u.race_id, field_size, CAST(fr AS BIGINT) AS pace_front_runners, CAST(hu AS BIGINT) AS pace_hold_up_horses, CAST(fr AS DOUBLE) / field_size AS pace_pressure_index,
    CASE WHEN {AW} THEN 1 WHEN lower(surface) = 'jumps' THEN 2 ELSE 0 END AS surface_encoded, distance_furlongs,
    CASE going_code WHEN 'good to firm' THEN 1 WHEN 'good to soft' THEN 3 ELSE CASE WHEN {AW} THEN 6 END END AS going_encoded, race_type AS race_type_encoded,
    month(race_date) AS race_month, dayofweek(race_date) AS race_day_of_week, coalesce(latest, decision_cutoff_utc - INTERVAL 1 SECOND) AS event_timestamp_utc, decision_cutoff_utc
  FROM {FIELDS} JOIN pace USING (race_id))"""
F007 = f"""
done AS (SELECT *, lead(scheduled_off_utc, n) OVER w AS later, CAST(lead(won, n) OVER w AS INTEGER) AS lw, CAST(lead(finishing_position <= 3, n) OVER w AS INTEGER) AS lp
  FROM horse_history, (SELECT unnest([1, 2, 3]) AS n) WHERE finishing_position IS NOT NULL WINDOW w AS (PARTITION BY n, horse_id ORDER BY scheduled_off_utc, history_id)),
mine AS (SELECT u.runner_id, u.horse_id, a.decision_cutoff_utc AS cutoff, h.race_id AS past_race, h.finishing_position AS pos, row_number() OVER (PARTITION BY u.runner_id ORDER BY h.scheduled_off_utc DESC, h.history_id) AS rn
  FROM {FIELDS} JOIN horse_history h ON h.horse_id = u.horse_id AND h.scheduled_off_utc < a.decision_cutoff_utc AND h.finishing_position IS NOT NULL),
rival AS (SELECT m.runner_id, m.past_race, m.rn, d.history_id, d.horse_id AS opp, avg(lw) AS wr, avg(lp) AS pr, max(lw) AS any_win
  FROM mine m JOIN done d ON d.race_id = m.past_race AND d.horse_id <> m.horse_id AND d.finishing_position > m.pos AND d.later < m.cutoff WHERE m.rn <= 5 GROUP BY ALL),
beaten AS (SELECT runner_id, avg(wr) AS w, avg(pr) AS p, sum(any_win) AS f, count(DISTINCT opp) AS n FROM rival GROUP BY 1),
f007 AS (SELECT u.runner_id, u.race_id, w AS collateral_beaten_win_rate, p AS collateral_beaten_place_rate, CAST(coalesce(f, 0) AS BIGINT) AS collateral_franked_winners,
  coalesce(n, 0) AS collateral_beaten_count, a.decision_cutoff_utc - INTERVAL 1 SECOND AS event_timestamp_utc, a.decision_cutoff_utc FROM {FIELDS} LEFT JOIN beaten b ON b.runner_id = u.runner_id)"""
F008 = f"""
finished AS (SELECT *, row_number() OVER (PARTITION BY runner_id ORDER BY rn) AS k FROM past WHERE fin),
career AS (SELECT runner_id, count(*) AS n, {_rate('won', 'true')} AS w, {_rate('fp <= 3', 'true')} AS p,
  CASE WHEN count(*) >= 3 THEN stddev_samp(fp) FILTER (WHERE k <= 10) ELSE stddev_samp(fp) END AS s FROM finished GROUP BY 1),
f008 AS (SELECT u.runner_id, u.race_id, weight_lbs, weight_lbs - max(weight_lbs) OVER f AS weight_vs_top, weight_lbs - avg(weight_lbs) OVER f AS weight_vs_field_avg, age AS horse_age,
  official_rating AS runner_official_rating, official_rating - max(official_rating) OVER f AS rating_vs_top, official_rating - avg(official_rating) OVER f AS rating_vs_field_avg,
  avg(official_rating) OVER f AS field_avg_rating, coalesce(n, 0) AS career_runs, w AS career_win_rate, p AS career_place_rate, s AS position_consistency,
  a.decision_cutoff_utc - INTERVAL 1 SECOND AS event_timestamp_utc, a.decision_cutoff_utc FROM {FIELDS} LEFT JOIN career c ON c.runner_id = u.runner_id WINDOW f AS (PARTITION BY u.race_id))"""
F009 = f"""
timed AS (SELECT p.runner_id, p.going_code, p.distance_furlongs AS d, x.official_time_secs / p.distance_furlongs AS spf, row_number() OVER (PARTITION BY p.runner_id ORDER BY p.rn, x.runner_id) AS k, p.rn
  FROM past p LEFT JOIN results x ON x.race_id = p.past_race AND x.horse_id = p.h_horse WHERE p.history_id IS NOT NULL),
medians AS (SELECT going_code, round(h.distance_furlongs) AS d, median(x.official_time_secs / h.distance_furlongs) AS m
  FROM horse_history h JOIN results x ON x.race_id = h.race_id AND x.horse_id = h.horse_id
  WHERE x.official_time_secs / h.distance_furlongs BETWEEN 5 AND 25 GROUP BY 1, 2 HAVING count(*) >= 20),
speed AS (SELECT runner_id, avg((m - spf) * 100) FILTER (WHERE k <= 3) AS a3, max((m - spf) * 100) FILTER (WHERE k <= 5) AS b5, max((m - spf) * 100) FILTER (WHERE k = 1) AS l1
  FROM timed t JOIN medians g ON g.going_code = t.going_code AND g.d = round(t.d) WHERE k <= 10 GROUP BY 1),
ride AS (SELECT jockey_id, scheduled_off_utc AS t, CAST(won AS INTEGER) AS w FROM jockey_history),
now AS (SELECT u.runner_id, avg(w) AS q FROM {FIELDS} JOIN ride x ON x.jockey_id = u.jockey_id AND x.t < a.decision_cutoff_utc AND x.t >= a.decision_cutoff_utc - INTERVAL 90 DAY GROUP BY 1),
expanded AS (SELECT p.*, row_number() OVER (PARTITION BY p.runner_id ORDER BY p.rn, x.runner_id) AS k FROM past p LEFT JOIN results x ON x.race_id = p.past_race AND x.horse_id = p.h_horse WHERE p.history_id IS NOT NULL),
each AS (SELECT p.runner_id, p.k, avg(w) AS q FROM expanded p LEFT JOIN ride x ON x.jockey_id = p.jockey_id AND x.t < p.scheduled_off_utc AND x.t >= p.scheduled_off_utc - INTERVAL 90 DAY WHERE p.k <= 5 GROUP BY 1, 2),
usual AS (SELECT runner_id, avg(q) AS q FROM each GROUP BY 1),
fortnight AS (SELECT u.runner_id, {_rate('h.won', 'true')} AS r, count(*) AS n FROM {FIELDS} JOIN trainer_history h ON {KNOWN.format('h.trainer_name')} = {KNOWN.format('u.trainer_name')}
  AND h.scheduled_off_utc < a.decision_cutoff_utc AND h.scheduled_off_utc >= a.decision_cutoff_utc - INTERVAL 14 DAY GROUP BY 1),
f009 AS (SELECT u.runner_id, u.race_id, a3 AS avg_speed_last_3, b5 AS best_speed_last_5, l1 AS last_run_speed, CAST(lower(a.race_type) IN ('chase', 'hurdle', 'nh flat') AS INTEGER) AS is_jumps,
  a.distance_furlongs - e.distance_furlongs AS trip_change_furlongs, u.weight_lbs - e.weight_lbs AS weight_change_lbs, CASE WHEN e.runner_id IS NOT NULL THEN coalesce(e.btn_lengths, 0) END AS last_run_btn_lengths,
  e.btn_lengths AS avg_btn_last_3, now.q - usual.q AS jockey_upgrade_signal, fortnight.r AS trainer_win_rate_14d, coalesce(fortnight.n, 0) AS trainer_runs_14d,
  a.decision_cutoff_utc - INTERVAL 1 SECOND AS event_timestamp_utc, a.decision_cutoff_utc
  FROM {FIELDS} LEFT JOIN expanded e ON e.runner_id = u.runner_id AND e.k = 1 LEFT JOIN speed s ON s.runner_id = u.runner_id LEFT JOIN now ON now.runner_id = u.runner_id
  LEFT JOIN usual ON usual.runner_id = u.runner_id LEFT JOIN fortnight ON fortnight.runner_id = u.runner_id)"""

#: What each group's last expression needs before it.
PARTS = {"f001": [FORM], "f002": [F002], "f003": [F003], "f004": [F004], "f005": [FORM, F005], "f006": [PAST, F006], "f007": [F007], "f008": [PAST, F008], "f009": [PAST, F009]}


def _oracle(tables: list[str], query: str, doubles: list[str], longs: list[str]) -> str:
    swaps = [f"round({c}, 6) AS {c}" for c in doubles] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs]
    return f"WITH {', '.join([CTES, *tables])}, _out AS ({query}) SELECT * REPLACE ({', '.join(swaps)}) FROM _out"


DOUBLES = {
    "f001": ["horse_runs_last_5_positions", "horse_weighted_form", "horse_improvement_index", "horse_avg_position_pct_last_5", "horse_avg_rpr_last_3", "horse_avg_class_last_3", "horse_class_delta", "horse_form_trend", "horse_pu_rate"],
    "f002": ["draw_field_percentile", "draw_bias_coefficient"],
    "f003": [],
    "f004": [],
    "f005": ["prize_money_log", "horse_class_delta"],
    "f006": ["pace_pressure_index", "distance_furlongs"],
    "f007": ["collateral_beaten_win_rate", "collateral_beaten_place_rate"],
    "f008": ["weight_vs_field_avg", "rating_vs_field_avg", "field_avg_rating", "position_consistency"],
    "f009": ["avg_speed_last_3", "best_speed_last_5", "last_run_speed", "jockey_upgrade_signal"],
}
LONGS = {
    "f001": ["horse_best_rpr_last_5", "horse_first_time_headgear"],
    "f002": ["draw_position", "draw_is_null"],
    "f003": ["trainer_is_unknown", "trainer_runs_90d", "trainer_fresh_runs"],
    "f004": ["jockey_is_unknown"],
    "f005": ["race_class_encoded", "is_class_dropper", "is_first_time_headgear"],
    "f006": ["field_size", "surface_encoded", "going_encoded", "race_month", "race_day_of_week"],
    "f007": [],
    "f008": ["horse_age", "runner_official_rating", "rating_vs_top"],
    "f009": ["is_jumps"],
}
ORACLES = {name: _oracle(PARTS[name[:4]], f"SELECT * FROM {name[:4]}", DOUBLES[name[:4]], LONGS[name[:4]]) for name in features.GROUPS}

NO_RACE = (
    " OR ".join(f"race_type ILIKE '{p}'" for p in NO_RACE_TYPES)
    + rf" OR race_type ~ '\d+[mf]\d*[f]?\s+pa' OR CAST(race_id AS VARCHAR) IN ({', '.join(map(repr, NO_RACES))}) OR "
    + " OR ".join(f"course_name ILIKE '{p}'" for p in NO_COURSES)
    + " OR field_size < 2 OR field_size > 40"
)
_DROP = {"f001": "horse_going_affinity, horse_going_place_rate, horse_class_delta", "f003": "trainer_is_unknown", "f004": "jockey_is_unknown", "f005": "is_first_time_headgear", "f006": "distance_furlongs"}
STORE = f"""
wide AS (
  SELECT u.runner_id, u.race_id, a.race_date, a.decision_cutoff_utc, r.won AS target, u.sex, a.surface, a.race_type, a.distance_furlongs AS parsed,
    {', '.join(f"{f}.* EXCLUDE (runner_id, race_id, event_timestamp_utc, decision_cutoff_utc{', ' + _DROP[f] if f in _DROP else ''})" for f in sorted(PARTS))}
  FROM {FIELDS} JOIN results r USING (runner_id) {' '.join(f'LEFT JOIN {f} ON {f}.runner_id = u.runner_id' for f in sorted(PARTS))}
  WHERE NOT coalesce({NO_RACE.replace("race_id", "u.race_id").replace("race_type", "a.race_type").replace("field_size", "a.field_size")}, false))
"""
ORACLES["feature_store"] = _oracle(
    [FORM, F002, F003, F004, F005, F006, F007, F008, F009, STORE],
    """SELECT w.* EXCLUDE (sex, surface, race_type, parsed), least(coalesce(parsed, kind.m, (SELECT median(parsed) FROM wide)), 36.0) AS distance_furlongs,
      CASE sex WHEN 'G' THEN 0 WHEN 'M' THEN 1 WHEN 'F' THEN 2 WHEN 'C' THEN 3 WHEN 'H' THEN 4 END AS sex_encoded, CAST(sex IN ('F', 'M') AS INTEGER) AS is_female
    FROM wide w LEFT JOIN (SELECT surface, race_type, median(parsed) AS m FROM wide GROUP BY ALL) kind USING (surface, race_type)""",
    [c for k, v in DOUBLES.items() for c in v if c not in ("distance_furlongs", "horse_class_delta") or (k, c) == ("f005", "horse_class_delta")] + ["distance_furlongs"],
    [c for v in LONGS.values() for c in v if c not in ("trainer_is_unknown", "jockey_is_unknown", "is_first_time_headgear")] + ["sex_encoded", "is_female"],
)
#: Rows of each group whose latest input is after the cutoff; the last row is of a group that looks a day too far.
LEAKS = _oracle(
    [FORM, F002, F003, F004, F005, F006, F007, F008, F009],
    " UNION ALL ".join(f"SELECT '{name}' AS feature, count(*) FILTER (WHERE event_timestamp_utc > decision_cutoff_utc) AS leaks FROM {name[:4]}" for name in features.GROUPS)
    + " UNION ALL SELECT 'planted', count(*) FROM runners u JOIN races a USING (race_id) WHERE EXISTS (FROM horse_history h WHERE h.horse_id = u.horse_id AND h.scheduled_off_utc > a.decision_cutoff_utc AND h.scheduled_off_utc < a.decision_cutoff_utc + INTERVAL 1 DAY)",
    [],
    ["leaks"],
)
