"""Registered queries of updates, matching, scoring, settlement, quality, lookups and text, with oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furlong.functions import text
from furlong.operators import dml, lookup, match, pit, quality, scoring, settle, tables
from furlong.plans import features
from furlong.plans.feature_queries import LEAKS, NO_RACE, comparable
from furlong.sources import files, readers
from furlong.sources.analogue import CTES, racing
from furlong.streaming import snapshots

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, raw: bool = False):
    """Add a function of the racing tables as a query, and its DuckDB SQL over the same tables (``raw``: over the driver's)."""

    def add(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(make(racing(spark, sf_dir)))

        run.__name__, run.__doc__ = make.__name__, make.__doc__
        QUERIES[make.__name__] = run
        if sql:
            ORACLES[make.__name__] = sql if raw else f"WITH {CTES} {sql}" if not sql.lstrip().startswith(",") else f"WITH {CTES}{sql}"
        return make

    return add


# --- updates -------------------------------------------------------------------------------------


@register("""SELECT race_id, course_name, 1 AS source FROM races WHERE race_id % 3 <> 0
  UNION ALL SELECT race_id, min(upper(course_name)), 2 FROM races WHERE race_id % 3 = 0 GROUP BY 1""")
def d03_upsert_ignore(r):
    """New races are added once, known ones stay."""
    have = r.races.where("race_id % 3 <> 0").select("race_id", "course_name", F.lit(1).alias("source"))
    new = r.races.where("race_id % 3 = 0 or race_id % 2 = 0").select("race_id", F.upper("course_name").alias("course_name"), F.lit(2).alias("source"))
    return dml.upsert_ignore(have, new.unionByName(new), ["race_id"], F.col("course_name"))


@register("""SELECT runner_id, coalesce(CASE WHEN x.finishing_position > 1 THEN x.finishing_position END, u.draw) AS draw,
  coalesce(u.official_rating, CAST(x.rpr AS INTEGER)) AS official_rating FROM runners u LEFT JOIN results x USING (runner_id)""")
def d04_d05_coalesce_updates(r):
    """The source's value wins for the draw, the old one for the rating."""
    source = r.results.select("runner_id", F.when(F.col("finishing_position") > 1, F.col("finishing_position")).alias("draw"), F.col("rpr").cast("int").alias("official_rating"))
    base = r.runners.select("runner_id", F.col("draw").cast("int").alias("draw"), "official_rating")
    return dml.update_from(dml.update_from(base, source, ["runner_id"], ["draw"]), source, ["runner_id"], ["official_rating"], keep_old=True)


@register("SELECT history_id, days_since_prev_run FROM horse_history")
def d06_days_since_previous(r):
    return r.horse_history.select("history_id", "days_since_prev_run")


@register("SELECT runner_id, trainer_id, won, days_since_last_run FROM trainer_history")
def d07_rebuild_trainer_history(r):
    return r.trainer_history.select("runner_id", "trainer_id", "won", "days_since_last_run")


@register("SELECT runner_id, race_id FROM results WHERE race_id NOT IN (SELECT race_id FROM races WHERE race_class = 1)")
def d08_delete_where_in(r):
    return dml.delete_where_in(r.results, r.races.where("race_class = 1"), ["race_id"]).select("runner_id", "race_id")


@register("""SELECT runner_id, CASE WHEN race_id IN (SELECT race_id FROM races WHERE surface = 'AW') THEN 'coverage_gap' ELSE 'exact' END AS match_type,
  CASE WHEN race_id IN (SELECT race_id FROM races WHERE surface = 'AW') AND trainer_name = '' THEN NULL ELSE trainer_name END AS trainer_name FROM runners""")
def d09_d10_conditional_updates(r):
    """A tag for all runners of some races, and a null for some of those."""
    gap = r.races.where("surface = 'AW'").select("race_id")
    tagged = dml.update_where(r.runners.withColumn("match_type", F.lit("exact")), gap, ["race_id"], {"match_type": F.lit("coverage_gap")})
    done = dml.update_where(tagged, gap, ["race_id"], {"trainer_name": F.lit(None).cast("string")}, F.col("trainer_name") == "")
    return done.select("runner_id", "match_type", "trainer_name")


@register("""SELECT u.runner_id, u.horse_name, x.sp_decimal FROM runners u LEFT JOIN (
    SELECT DISTINCT ON (lower(replace(horse_name, ' ', '')), race_id) replace(lower(horse_name), ' ', '') AS k, race_id, sp_decimal FROM runners JOIN results USING (runner_id, race_id) ORDER BY runner_id) x
  ON x.race_id = u.race_id AND x.k = replace(lower(u.horse_name), ' ', '')""")
def d11_first_match_update(r):
    """Each runner takes the price of the first result with its race and compact name."""
    found = r.runners.select("runner_id", "race_id", text.compact("horse_name").alias("k")).join(r.results.select("runner_id", "sp_decimal"), "runner_id")
    first = dml.first_by(found, ["k", "race_id"], F.col("runner_id")).select("k", "race_id", "sp_decimal")
    return r.runners.withColumn("k", text.compact("horse_name")).join(first, ["k", "race_id"], "left").select("runner_id", "horse_name", "sp_decimal")


@register("""SELECT runner_id, false AS won, first_off AS scheduled_off_utc FROM runners JOIN races USING (race_id)
  JOIN (SELECT race_date, min(scheduled_off_utc) AS first_off FROM races GROUP BY 1) USING (race_date)""")
def d12_placeholders(r):
    """Runners of each day's card before their results; all take the day's first race's time, as in the definition."""
    first = r.races.groupBy("race_date").agg(F.min("scheduled_off_utc").alias("scheduled_off_utc"))
    card = r.races.select("race_id", "race_date").join(first, "race_date")
    return r.runners.select("runner_id", "race_id", F.lit(False).alias("won")).join(card, "race_id").select("runner_id", "won", "scheduled_off_utc")


@register("""SELECT runner_id, snapshot_label, snapshot_id, decimal_odds FROM (SELECT *, row_number() OVER (PARTITION BY runner_id, snapshot_label ORDER BY batch DESC, snapshot_id DESC) AS k FROM (
    SELECT *, 0 AS batch FROM odds UNION ALL SELECT * REPLACE (decimal_odds + 1 AS decimal_odds), 1 FROM odds WHERE snapshot_id % 5 = 0)) WHERE k = 1""")
def d14_keep_last_snapshot(r):
    old, new = r.odds, r.odds.where("snapshot_id % 5 = 0").withColumn("decimal_odds", F.col("decimal_odds") + 1)
    return dml.keep_last(old, new, ["runner_id", "snapshot_label"], F.col("snapshot_id")).select("runner_id", "snapshot_label", "snapshot_id", "decimal_odds")


@register("""SELECT race_date AS date, count(*) AS n, 'old' AS source, NULL AS note FROM races WHERE race_id % 2 = 0 GROUP BY 1
  UNION ALL SELECT race_date, count(*), 'new', 'x' FROM races WHERE race_date NOT IN (SELECT race_date FROM races WHERE race_id % 2 = 0) GROUP BY 1""")
def d15_append_new_dates(r):
    log, new = _day_logs(r)
    return dml.append_dates(log, new)


@register("""SELECT race_date AS date, count(*) AS n, 'new' AS source, 'x' AS note FROM races GROUP BY 1""")
def d15_refresh_dates(r):
    log, new = _day_logs(r)
    return dml.append_dates(log, new, refresh=True)


@register("""SELECT strftime(race_date, '%Y-%m') AS month, CASE WHEN month(race_date) IN (1, 7) THEN 'new' ELSE 'old' END AS source, count(*) AS races, sum(race_id) AS ids FROM races GROUP BY 1, 2""")
def d15_x06_replaced_on_disk(r):
    """A table on disk with a folder a month; the Januaries and Julys are written again, and the whole is read back."""
    rows = r.races.select("race_id", F.lit("old").alias("source"), F.date_format("race_date", "yyyy-MM").alias("month"), F.month("race_date").alias("of_year"))
    path = tables.new_path(r.spark, "months")
    tables.replace_folders(rows, ["month"], path)
    tables.replace_folders(rows.where("of_year in (1, 7)").withColumn("source", F.lit("new")), ["month"], path)
    return r.spark.read.schema(rows.schema).parquet(path).groupBy("month", "source").agg(F.count("*").alias("races"), F.sum("race_id").alias("ids"))


def _day_logs(r) -> tuple[DataFrame, DataFrame]:
    races = r.races.withColumnRenamed("race_date", "date")
    log = races.where("race_id % 2 = 0").groupBy("date").agg(F.count("*").alias("n"), F.lit("old").alias("source"))
    return log, races.groupBy("date").agg(F.count("*").alias("n"), F.lit("new").alias("source"), F.lit("x").alias("note"))


@register("SELECT race_id, coalesce(going_code, 'unknown') AS going_code, 'GB' AS country, true AS is_standard_race FROM races")
def d13_d23_columns_and_defaults(r):
    wide = dml.add_missing(r.races.select("race_id", "going_code"), {"country": "string", "is_standard_race": "boolean"})
    return dml.with_defaults(wide, {"going_code": "unknown", "country": "GB", "is_standard_race": True})


# --- predicates, sets, sorting ---------------------------------------------------------------------


@register("""SELECT race_id, race_type ILIKE 'flat%' OR course_name ~ '.*[0-4]$' OR coalesce(field_size BETWEEN 2 AND 3, false) OR race_id IN (1, 5, 9) AS is_standard,
  coalesce(nullif(trim(going_code), ''), 'Unknown') AS going, CASE WHEN going_code IS NULL THEN 1 ELSE 0 END AS going_unknown FROM races""")
def p01_p06_standard_flags(r):
    standard = F.col("race_type").ilike("flat%") | F.col("course_name").rlike("[0-4]$") | F.coalesce(F.col("field_size").between(2, 3), F.lit(False)) | F.col("race_id").isin(1, 5, 9)
    return r.races.select("race_id", standard.alias("is_standard"), features.name_or_unknown("going_code").alias("going"), features.flag(F.col("going_code").isNull()).alias("going_unknown"))


@register("""SELECT u.runner_id FROM runners u JOIN races a USING (race_id) JOIN results x USING (runner_id)
  WHERE a.race_date >= DATE '1997-01-01' AND a.race_date < DATE '1998-01-01' AND NOT (x.won = false AND x.finishing_position IS NULL AND x.non_completion IS NULL)
  AND a.race_type IN ('Chase', 'Hurdle') AND x.sp_decimal < 50 AND NOT (coalesce(a.going_code, '') = 'good to soft' AND x.sp_decimal > 20)""")
def p07_p13_settled_slice(r):
    """A half-open year, settled runners, types and a guarded price rule."""
    rows = features.with_results(r, "won", "finishing_position", "non_completion", "sp_decimal")
    in_year = (F.col("race_date") >= "1997-01-01") & (F.col("race_date") < "1998-01-01")
    pending = ~F.col("won") & F.col("finishing_position").isNull() & F.col("non_completion").isNull()
    late = F.coalesce((F.col("going_code") == "good to soft") & (F.col("sp_decimal") > 20), F.lit(False))
    return rows.where(in_year & ~pending & F.col("race_type").isin("Chase", "Hurdle") & (F.col("sp_decimal") < 50) & ~late).select("runner_id")


@register("""SELECT a.race_id, count(b.race_id) AS same_going FROM races a LEFT JOIN races b ON coalesce(a.going_code, '') = coalesce(b.going_code, '')
  AND a.course_name = b.course_name AND a.race_date = b.race_date GROUP BY 1""")
def j13_null_tolerant_join(r):
    """Null and empty going match each other."""
    keyed = r.races.select("race_id", "course_name", "race_date", F.coalesce("going_code", F.lit("")).alias("going"))
    sizes = keyed.groupBy("course_name", "race_date", "going").agg(F.count("*").alias("same_going"))
    return keyed.join(sizes, ["course_name", "race_date", "going"]).select("race_id", "same_going")


@register("""SELECT 'without_runners' AS kind, count(*) AS n FROM races a WHERE NOT EXISTS (FROM runners u WHERE u.race_id = a.race_id)
  UNION ALL SELECT 'with_winner', count(*) FROM races WHERE race_id IN (SELECT race_id FROM results WHERE won)""")
def j15_j16_anti_and_semi(r):
    without = r.races.join(r.runners, "race_id", "left_anti").agg(F.lit("without_runners").alias("kind"), F.count("*").alias("n"))
    return without.unionByName(r.races.join(r.results.where("won"), "race_id", "left_semi").agg(F.lit("with_winner").alias("kind"), F.count("*").alias("n")))


@register("""SELECT runner_id FROM runners EXCEPT SELECT runner_id FROM results WHERE finishing_position IS NOT NULL""")
def u04_non_runners(r):
    """Declared runners without a place in the result."""
    return r.runners.select("runner_id").join(r.results.where("finishing_position is not null"), "runner_id", "left_anti")


@register("""SELECT race_id, count(*) AS rows FROM (SELECT race_id FROM races UNION ALL SELECT race_id FROM runners UNION ALL SELECT race_id FROM results) GROUP BY 1""")
def u01_union_of_keys(r):
    return reduce(DataFrame.unionByName, [t.select("race_id") for t in (r.races, r.runners, r.results)]).groupBy("race_id").agg(F.count("*").alias("rows"))


@register("SELECT runner_id, race_date, sp_decimal FROM runners JOIN races USING (race_id) JOIN results USING (runner_id) ORDER BY sp_decimal DESC NULLS LAST, runner_id LIMIT 20")
def o03_o05_top_prices(r):
    rows = r.runners.join(r.races.select("race_id", "race_date"), "race_id").join(r.results.select("runner_id", "sp_decimal"), "runner_id")
    return rows.select("runner_id", "race_date", "sp_decimal").orderBy(F.col("sp_decimal").desc_nulls_last(), "runner_id").limit(20)


# --- aggregates ------------------------------------------------------------------------------------


@register("""SELECT strftime(race_date, '%Y-%m') AS month, count(*) AS races, count(DISTINCT course_name) AS courses, avg(field_size) AS field, median(prize_money_gbp) AS prize,
  count(*) FILTER (WHERE is_handicap) AS handicaps, round(stddev_samp(field_size), 6) AS spread FROM races GROUP BY 1 HAVING count(*) > 1""".replace("avg(field_size)", "round(avg(field_size), 6)").replace("median(prize_money_gbp)", "round(median(prize_money_gbp), 6)"))
def a07_a18_monthly(r):
    months = r.races.groupBy(F.date_format("race_date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("races"), F.count_distinct("course_name").alias("courses"), F.avg("field_size").alias("field"), F.median("prize_money_gbp").alias("prize"),
        F.count_if("is_handicap").alias("handicaps"), F.stddev_samp("field_size").alias("spread"),
    )
    return months.where("races > 1")


_NULLS = ["draw", "official_rating", "headgear", "trainer_name"]


@register(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(sum(CAST({c} IS NULL AS INTEGER)) AS BIGINT) AS nulls, count(*) AS rows, round(sum(CAST({c} IS NULL AS INTEGER)) / count(*), 6) AS null_rate FROM runners" for c in _NULLS))
def a16_null_profile(r):
    return quality.null_profile(r.runners.select(*_NULLS))


@register("""SELECT a.surface, a.race_type, count(*) AS runs, count(*) FILTER (WHERE x.non_completion IS NULL) AS finished, round(avg(CAST(x.non_completion IS NULL AS INTEGER)), 6) AS completion_rate,
  round(avg(CAST(coalesce(x.non_completion = 'PU', false) AS INTEGER)), 6) AS pulled_up_rate FROM results x JOIN races a USING (race_id) GROUP BY ROLLUP (a.surface, a.race_type)""")
def a26_a29_completion_rollup(r):
    """Completion and pulled-up rates by surface and type, with subtotals."""
    rows = r.results.join(r.races.select("race_id", "surface", "race_type"), "race_id")
    done = F.col("non_completion").isNull()
    return rows.rollup("surface", "race_type").agg(
        F.count("*").alias("runs"), F.count_if(done).alias("finished"), F.avg(done.cast("double")).alias("completion_rate"), F.avg(features.share(F.col("non_completion") == "PU")).alias("pulled_up_rate")
    )


BANDS = [(1.0, 4.0), (4.0, 8.0), (8.0, 16.0), (16.0, 100.0)]


@register("""SELECT band, count(*) AS bets, CAST(sum(CAST(won AS INTEGER)) AS BIGINT) AS wins, round(sum(CASE WHEN won THEN sp_decimal - 1 ELSE -1 END) / count(*), 6) AS roi FROM (
  SELECT *, CASE WHEN sp_decimal < 4 THEN 0 WHEN sp_decimal < 8 THEN 1 WHEN sp_decimal < 16 THEN 2 ELSE 3 END AS band FROM results WHERE sp_decimal >= 1 AND sp_decimal < 100) GROUP BY 1 HAVING count(*) >= 10""")
def a19_price_bands(r):
    """Return by price band [low, high); small bands are left out."""
    band = None
    for i, (low, high) in enumerate(BANDS):
        inside = (F.col("sp_decimal") >= low) & (F.col("sp_decimal") < high)
        band = (F if band is None else band).when(inside, i)
    rows = r.results.withColumn("band", band).where("band is not null").withColumn("profit", scoring.profit("won", "sp_decimal"))
    return rows.groupBy("band").agg(F.count("*").alias("bets"), F.sum(F.col("won").cast("long")).alias("wins"), (F.sum("profit") / F.count("*")).alias("roi")).where("bets >= 10")


@register("SELECT match_type, count(*) AS n, min(field) AS least, max(field) AS most, round(avg(field), 6) AS mean FROM (SELECT race_type AS match_type, field_size AS field FROM races) GROUP BY 1")
def a24_a25_value_counts(r):
    return r.races.groupBy(F.col("race_type").alias("match_type")).agg(F.count("*").alias("n"), F.min("field_size").alias("least"), F.max("field_size").alias("most"), F.avg("field_size").alias("mean"))


# --- scores, bets and curves -------------------------------------------------------------------------


def scores(r) -> DataFrame:
    """Runners with a deterministic score, the softmax of each race, price and result."""
    score = F.coalesce("official_rating", F.lit(20)) * 0.08 + (F.col("weight_lbs") - 120) * 0.02 - F.coalesce("draw", F.lit(4)) * 0.05
    rows = features.with_results(r, "won", "sp_decimal", "finishing_position")
    out = rows.select("runner_id", "race_id", "race_date", "race_type", "surface", "horse_name", "course_name", "won", "sp_decimal", "finishing_position", score.cast("double").alias("score"))
    return scoring.softmax(out, "score", "race_id", "prob", bounded=True)  # as SQL adds them up, to the last digit


SCORES = """,
scored AS (SELECT u.runner_id, u.race_id, a.race_date, a.race_type, a.surface, u.horse_name, a.course_name, x.won, x.sp_decimal, x.finishing_position,
    CAST(coalesce(u.official_rating, 20) AS DOUBLE) * CAST(0.08 AS DOUBLE) + (u.weight_lbs - 120) * CAST(0.02 AS DOUBLE) - CAST(coalesce(u.draw, 4) AS DOUBLE) * CAST(0.05 AS DOUBLE) AS score
  FROM runners u JOIN races a USING (race_id) JOIN results x USING (runner_id)),
probs AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY race_id) AS prob FROM scored),
bets AS (SELECT *, prob - 1 / sp_decimal AS edge, CASE WHEN won THEN sp_decimal - 1 ELSE -1 END AS profit FROM probs WHERE sp_decimal > 1)
"""


def value_bets(r) -> DataFrame:
    return scores(r).withColumn("edge", scoring.edge("prob", "sp_decimal")).where("edge is not null").withColumn("profit", scoring.profit("won", "sp_decimal"))


@register(SCORES + "SELECT runner_id, round(prob, 6) AS prob, row_number() OVER (PARTITION BY race_id ORDER BY round(prob, 9) DESC, runner_id) AS place, round(sum(prob) OVER (PARTITION BY race_id), 6) AS total FROM probs")
def w09_softmax_by_race(r):
    w = Window.partitionBy("race_id")
    return scores(r).select("runner_id", "prob", F.row_number().over(w.orderBy(F.desc(F.round("prob", 9)), "runner_id")).alias("place"), F.sum("prob").over(w).alias("total"))


@register(SCORES + """, left_in AS (SELECT runner_id, race_id, CASE WHEN race_id % 10 = 0 THEN 0.0 ELSE prob END AS p FROM probs WHERE finishing_position IS NOT NULL)
SELECT runner_id, round(CASE WHEN sum(p) OVER w > 0 THEN p / sum(p) OVER w ELSE 1.0 / count(*) OVER w END, 6) AS p FROM left_in WINDOW w AS (PARTITION BY race_id)""")
def w10_m17_renormalise_without_non_runners(r):
    """Non-runners leave and the rest is scaled; where all are 0, all are alike."""
    left_in = scores(r).where("finishing_position is not null").withColumn("p0", F.when(F.col("race_id") % 10 == 0, 0.0).otherwise(F.col("prob")))
    return scoring.renormalise(left_in, "p0", "race_id", "p").select("runner_id", "p")


@register(SCORES + """SELECT round(avg(power(prob - CAST(won AS INTEGER), 2)), 6) AS brier, round(-avg(CASE WHEN won THEN ln(greatest(least(prob, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least(prob, 1 - 1e-15), 1e-15)) END), 6) AS log_loss,
  (SELECT round(avg(CAST(won AS INTEGER)), 6) FROM (SELECT won, row_number() OVER (PARTITION BY race_id ORDER BY round(prob, 9) DESC, runner_id) AS k FROM probs) WHERE k = 1) AS top_pick FROM probs""")
def m08_m09_metrics(r):
    p = scores(r).withColumn("rounded", F.round("prob", 9))
    return p.agg(scoring.brier("prob", "won").alias("brier"), scoring.log_loss("prob", "won").alias("log_loss")).crossJoin(F.broadcast(scoring.top_pick_rate(p, "rounded", "race_id", "won", "runner_id").select("top_pick")))


@register(SCORES + """, gains AS (SELECT race_id, CASE finishing_position WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS g, row_number() OVER (PARTITION BY race_id ORDER BY round(prob, 9) DESC, runner_id) AS s FROM probs),
ideal AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY g DESC) AS b FROM gains),
each AS (SELECT race_id, sum(g / log2(s + 1)) FILTER (WHERE s <= 3) AS dcg, sum(g / log2(b + 1)) FILTER (WHERE b <= 3) AS best FROM ideal GROUP BY 1)
SELECT round(avg(dcg / best), 6) AS ndcg_3 FROM each WHERE best > 0""")
def m11_ndcg(r):
    p = scores(r).withColumn("gain", F.when(F.col("finishing_position") <= 3, 4 - F.col("finishing_position")).otherwise(0)).withColumn("rounded", F.round("prob", 9))
    return scoring.ndcg(p, "rounded", "race_id", "gain", "runner_id", 3)


@register(SCORES + """, edges AS (SELECT list_distinct(quantile_cont(round(prob, 6), [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS e FROM probs),
binned AS (SELECT greatest(len(list_filter(e, lambda x: x < round(prob, 6))) - 1, 0) AS bin, prob, won FROM probs, edges)
SELECT bin, count(*) AS n, round(avg(prob), 6) AS mean_prob, round(avg(CAST(won AS INTEGER)), 6) AS win_rate FROM binned GROUP BY 1""")
def a20_m10_calibration_deciles(r):
    """Ten bins by exact quantile, equal edges merged."""
    binned = scoring.quantile_bins(scores(r).withColumn("rounded", F.round("prob", 6)), "rounded", 10, "bin")
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("prob").alias("mean_prob"), F.avg(F.col("won").cast("double")).alias("win_rate"))


THRESHOLDS = [0.0, 0.05, 0.10, 0.15]
_SEGMENTS = {"all": "true", "aw": "surface = 'AW'", "short": "sp_decimal < 8"}


@register(SCORES + " UNION ALL ".join(f"SELECT '{n}' AS segment, CAST({t} AS DOUBLE) AS threshold, count(*) AS bets, CAST(sum(CAST(won AS INTEGER)) AS BIGINT) AS wins, round(sum(profit), 6) AS profit, round(sum(profit) / count(*), 6) AS roi FROM bets WHERE {c} AND edge > {t} HAVING count(*) > 0" for n, c in _SEGMENTS.items() for t in THRESHOLDS))
def m13_value_by_segment(r):
    segments = {"all": F.lit(True), "aw": F.col("surface") == "AW", "short": F.col("sp_decimal") < 8}
    return scoring.value_table(value_bets(r), THRESHOLDS, segments)


# First day of each walk-forward test window and the day after its last.
WINDOWS = [("1996", "1996-01-01", "1997-01-01"), ("1997", "1997-01-01", "1998-01-01"), ("1998", "1998-01-01", "1999-01-01"), ("1999-00", "1999-01-01", "2001-01-01")]


@register(SCORES + " UNION ALL ".join(f"SELECT '{n}' AS test_window, count(*) FILTER (WHERE race_date < DATE '{a}') AS train_rows, count(*) FILTER (WHERE race_date >= DATE '{a}') AS test_rows, count(DISTINCT race_id) FILTER (WHERE race_date >= DATE '{a}') AS test_races, round(avg(power(prob - CAST(won AS INTEGER), 2)) FILTER (WHERE race_date >= DATE '{a}'), 6) AS brier FROM probs WHERE race_date < DATE '{b}'" for n, a, b in WINDOWS))
def m12_walk_forward(r):
    """Expanding training ranges and the metrics of each test window, in one pass over the scores."""
    dim = F.array(*[F.struct(F.lit(n).alias("test_window"), F.lit(a).cast("date").alias("start"), F.lit(b).cast("date").alias("stop")) for n, a, b in WINDOWS])
    each = scores(r).withColumn("w", F.explode(dim)).select("*", "w.*").where("race_date < stop")
    test = F.col("race_date") >= F.col("start")
    return each.groupBy("test_window").agg(F.count_if(~test).alias("train_rows"), F.count_if(test).alias("test_rows"), F.count_distinct(F.when(test, F.col("race_id"))).alias("test_races"), scoring_brier_if(test))


def scoring_brier_if(test: Column) -> Column:
    return F.avg(F.when(test, F.pow(F.col("prob") - F.col("won").cast("double"), 2))).alias("brier")


@register(SCORES + """, days AS (SELECT race_date, round(sum(profit), 6) AS p FROM bets WHERE edge > 0.05 GROUP BY 1),
run AS (SELECT race_date, p, sum(p) OVER (ORDER BY race_date) AS c, CASE WHEN count(p) OVER m >= 10 THEN avg(p) OVER m END AS mv FROM days WINDOW m AS (ORDER BY race_date ROWS 29 PRECEDING))
SELECT race_date, round(c, 4) AS cumulative, round(c - max(c) OVER (ORDER BY race_date), 4) AS drawdown, round(mv, 4) AS moving FROM run""")
def w06_w08_profit_curve(r):
    """Daily profit added up, with drawdown and a moving mean; one row a day."""
    days = value_bets(r).where("edge > 0.05").groupBy("race_date").agg(F.round(F.sum("profit"), 6).alias("p"))
    return scoring.curve(days, ["race_date"], "p", 30, 10).select("race_date", *[F.round(c, 4).alias(c) for c in ("cumulative", "drawdown", "moving")])


@register(SCORES + """, names AS (SELECT DISTINCT horse_name FROM probs) SELECT runner_id, code FROM probs JOIN (SELECT horse_name, row_number() OVER (ORDER BY horse_name) - 1 AS code FROM names) USING (horse_name)""")
def m15_category_codes(r):
    return scoring.category_code(r.runners.select("runner_id", "horse_name"), "horse_name", "code").select("runner_id", "code")


@register(SCORES + """SELECT runner_id, round(prob, 4) AS prob, round(1 / prob, 2) AS fair_odds, round(edge, 4) AS edge, k = 1 AS top_pick, edge > 0.1 AS value_bet FROM (
  SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(prob, 9) DESC, runner_id) AS k FROM bets)""")
def m18_daily_picks(r):
    """The runners of every day with probability, fair odds, edge, the top pick and the value bets."""
    first = F.row_number().over(Window.partitionBy("race_id").orderBy(F.desc(F.round("prob", 9)), "runner_id")) == 1
    return value_bets(r).select("runner_id", F.round("prob", 4).alias("prob"), F.round(1 / F.col("prob"), 2).alias("fair_odds"), F.round("edge", 4).alias("edge"), first.alias("top_pick"), (F.col("edge") > 0.1).alias("value_bet"))


@register()
def m03_isotonic_calibration(r):
    """Fit on the races before 1999, applied to those after; then scaled to 1 in each race."""
    p = tables.stored(scores(r).select("runner_id", "race_id", "race_date", "won", "prob"), "scores")
    done = scoring.isotonic(p.where("race_date < '1999-01-01'"), p.where("race_date >= '1999-01-01'"), "prob", "won", "calibrated")
    return scoring.renormalise(done, "calibrated", "race_id", "final").select("runner_id", "prob", "calibrated", "final")


@register(SCORES + """, fit AS (SELECT round(prob, 3) AS x, sum(CAST(won AS INTEGER)) AS s, count(*) AS n FROM probs WHERE race_date < DATE '1999-01-01' GROUP BY 1),
summed AS (SELECT x, s, n, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS cs, sum(n) OVER (ORDER BY x) AS cn FROM fit),
spans AS (SELECT a.i AS a, b.i AS b, CAST(b.cs - a.cs + a.s AS DOUBLE) / (b.cn - a.cn + a.n) AS mean FROM summed a JOIN summed b ON b.i >= a.i),
least_after AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM spans),
steps AS (SELECT x, max(m) AS g FROM least_after JOIN summed USING (i) GROUP BY x),
asked AS (SELECT runner_id, race_id, prob, round(prob, 3) AS x FROM probs WHERE race_date >= DATE '1999-01-01'),
beside AS (SELECT q.x, (SELECT max(t.x) FROM steps t WHERE t.x <= q.x) AS lo, (SELECT min(t.x) FROM steps t WHERE t.x >= q.x) AS hi FROM (SELECT DISTINCT x FROM asked) q),
told AS (SELECT b.x, CASE WHEN lo IS NULL THEN h.g WHEN hi IS NULL OR lo = hi THEN l.g ELSE l.g + (h.g - l.g) * (b.x - lo) / (hi - lo) END AS c FROM beside b LEFT JOIN steps l ON l.x = lo LEFT JOIN steps h ON h.x = hi)
SELECT runner_id, round(prob, 6) AS prob, round(c, 6) AS calibrated, round(CASE WHEN sum(c) OVER w > 0 THEN c / sum(c) OVER w ELSE 1.0 / count(*) OVER w END, 6) AS final FROM asked JOIN told USING (x) WINDOW w AS (PARTITION BY race_id)""")
def m03_isotonic_steps(r):
    """As ``m03_isotonic_calibration``, on scores of three digits: the least of later means, of these the greatest of earlier ones."""
    p = scores(r).withColumn("x", F.round("prob", 3))
    done = scoring.isotonic(p.where("race_date < '1999-01-01'"), p.where("race_date >= '1999-01-01'"), "x", "won", "calibrated")
    return scoring.renormalise(done, "calibrated", "race_id", "final").select("runner_id", "prob", "calibrated", "final")


@register()
def m05_ranker_stand_in(r):
    """Boosted trees on the win flag, softmax by race; a pointwise stand-in for a listwise ranker."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    names = ["official_rating", "weight_lbs", "draw", "field_size", "distance_furlongs"]
    rows = features.with_results(r, "won").select("runner_id", "race_id", "race_date", F.col("won").cast("double").alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in names])
    vectors = VectorAssembler(inputCols=names, outputCol="x").transform(rows)
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=5, maxDepth=3, seed=1).fit(vectors.where("race_date < '1999-01-01'"))
    scored = model.transform(vectors.where("race_date >= '1999-01-01'")).withColumn("margin", F.element_at(_array("rawPrediction"), 2))
    return scoring.softmax(scored, "margin", "race_id", "prob").select("runner_id", "prob")


def _array(column: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(column))


@register()
def m07_stacked_logistic(r):
    """A logistic regression over the probabilities of three scores."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    p = scores(r).withColumn("rate", 1 / F.col("sp_decimal")).withColumn("flat", 1.0 / F.count("*").over(Window.partitionBy("race_id")))
    p = tables.stored(p.select("runner_id", "race_id", "race_date", "won", "prob", "rate", "flat"), "scores")  # the fit reads them more than once
    vectors = VectorAssembler(inputCols=["prob", "rate", "flat"], outputCol="x").transform(p.withColumn("y", F.col("won").cast("double")))
    model = LogisticRegression(featuresCol="x", labelCol="y", maxIter=20).fit(vectors.where("race_date < '1999-01-01'"))
    done = model.transform(vectors.where("race_date >= '1999-01-01'")).withColumn("stacked", F.element_at(_array("probability"), 2))
    return scoring.renormalise(done, "stacked", "race_id", "final").select("runner_id", "final")


@register(SCORES + """SELECT edge_over, price_under, count(*) AS bets, round(sum(profit) / count(*), 6) AS roi, CASE WHEN count(*) >= 100 THEN round(sum(profit) / count(*), 6) ELSE -1 END AS objective
  FROM bets, (SELECT CAST(unnest([0.0, 0.05, 0.1, 0.15]) AS DOUBLE) AS edge_over), (SELECT CAST(unnest([5.0, 10.0, 20.0]) AS DOUBLE) AS price_under) WHERE edge > edge_over AND sp_decimal < price_under GROUP BY 1, 2""")
def m14_parameter_search(r):
    """Return of a small grid of edge thresholds and price limits; a choice with under 100 bets counts as -1."""
    grid = F.explode(F.array(*[F.struct(F.lit(e).alias("edge_over"), F.lit(m).alias("price_under")) for e in (0.0, 0.05, 0.1, 0.15) for m in (5.0, 10.0, 20.0)])).alias("g")
    each = value_bets(r).select("edge", "sp_decimal", "profit", grid).select("*", "g.*").where("edge > edge_over and sp_decimal < price_under")
    out = each.groupBy("edge_over", "price_under").agg(F.count("*").alias("bets"), (F.sum("profit") / F.count("*")).alias("roi"))
    return out.withColumn("objective", F.when(F.col("bets") >= 100, F.col("roi")).otherwise(-1.0))


# --- settlement --------------------------------------------------------------------------------------


def bet_log(r) -> DataFrame:
    """A bet on every runner; some without odds, some on races without a result."""
    rows = scores(r)
    odds = F.when(F.col("race_id") % 3 != 0, F.col("sp_decimal") * 1.1)
    return rows.select(F.col("race_date").alias("date"), "runner_id", F.col("race_type").alias("category"), odds.alias("back_odds"))


def bet_results(r) -> DataFrame:
    price = F.when(F.col("race_id") % 5 != 0, F.col("sp_decimal"))
    return r.results.select("runner_id", "won", price.alias("sp_decimal"))


BETS = SCORES + """, settled AS (SELECT race_date AS date, runner_id, race_type AS category, race_id % 5 <> 0 AS settled, won, CASE WHEN race_id % 5 = 0 THEN 0 WHEN won THEN sp_decimal * CASE WHEN race_id % 3 <> 0 THEN 1.1 ELSE 1 END - 1 ELSE -1 END AS profit,
  CASE WHEN race_id % 5 = 0 THEN 0 WHEN won THEN sp_decimal - 1 ELSE -1 END AS profit_sp FROM probs)
"""


@register(BETS + "SELECT date, runner_id, category, settled, round(profit, 6) AS profit, round(profit_sp, 6) AS profit_sp FROM settled")
def f33_settled_bets(r):
    return settle.settle(bet_log(r), bet_results(r)).select("date", "runner_id", "category", "settled", "profit", "profit_sp")


@register(BETS + """, days AS (SELECT date, count(*) AS bets, sum(CAST(won AS INTEGER)) AS wins, sum(profit) AS profit FROM settled WHERE settled GROUP BY 1)
SELECT date, bets, CAST(wins AS BIGINT) AS wins, round(profit, 6) AS profit, round(profit / bets, 6) AS roi, CAST(sum(bets) OVER (ORDER BY date) AS BIGINT) AS total_bets, round(sum(profit) OVER (ORDER BY date), 6) AS total_profit FROM days""")
def a22_daily_profit(r):
    return settle.daily(settle.settle(bet_log(r), bet_results(r)))


@register(BETS + " UNION ALL ".join(f"SELECT '{line}' AS line, count(*) AS bets, CAST(sum(CAST(won AS INTEGER)) AS BIGINT) AS wins, round(sum(profit), 6) AS profit, round(sum(profit_sp), 6) AS profit_sp, round(sum(profit) / count(*), 6) AS roi FROM settled WHERE settled AND category IN ({', '.join(map(repr, kinds))})" for line, kinds in settle.REPORT.items()))
def a23_profit_by_category(r):
    return settle.by_category(settle.settle(bet_log(r), bet_results(r)))


@register("""SELECT e.runner_id, e.decimal_odds AS evening_odds, m.decimal_odds AS morning_odds, (m.decimal_odds - e.decimal_odds) / e.decimal_odds AS move FROM
  (SELECT DISTINCT ON (runner_id) * FROM odds WHERE snapshot_label = 'evening_21h' ORDER BY snapshot_timestamp_utc DESC, snapshot_id DESC) e
  JOIN (SELECT DISTINCT ON (runner_id) * FROM odds WHERE snapshot_label = 'morning_09h' ORDER BY snapshot_timestamp_utc DESC, snapshot_id DESC) m USING (runner_id)
  WHERE abs(m.decimal_odds - e.decimal_odds) / e.decimal_odds > 0.2""".replace("(m.decimal_odds - e.decimal_odds) / e.decimal_odds AS move", "round((m.decimal_odds - e.decimal_odds) / e.decimal_odds, 6) AS move").replace("e.decimal_odds AS evening_odds", "round(e.decimal_odds, 6) AS evening_odds").replace("m.decimal_odds AS morning_odds", "round(m.decimal_odds, 6) AS morning_odds"))
def j19_x05_price_moves(r):
    return settle.price_moves(r.odds)


@register("""SELECT e.runner_id, e.snapshot_id AS evening_id, m.snapshot_id AS snapshot_id, round(e.decimal_odds, 6) AS evening_odds, round(m.decimal_odds, 6) AS morning_odds FROM odds e JOIN odds m USING (runner_id)
  WHERE e.snapshot_label = 'evening_21h' AND m.snapshot_label = 'morning_09h' AND m.snapshot_timestamp_utc > e.snapshot_timestamp_utc AND m.snapshot_timestamp_utc <= e.snapshot_timestamp_utc + INTERVAL 16 HOUR
    AND abs(m.decimal_odds - e.decimal_odds) / e.decimal_odds > 0.2""")
def x05_morning_moves(r):
    """The join of evening and morning prices that the stream of snapshots makes, over the whole table at once."""
    return snapshots.morning_moves(r.odds)


# --- matching ------------------------------------------------------------------------------------------


@register("""SELECT a.race_id, count(x.race_id) AS races_that_day, min(x.race_id) AS first_race FROM races a LEFT JOIN races x ON x.race_date = a.race_date AND x.course_name = a.course_name AND x.race_id <> a.race_id GROUP BY 1""")
def j20_exact_race_index(r):
    """The other races at a race's course and day: a day's list is one row of an index, looked up by both keys."""
    index = r.races.groupBy("race_date", "course_name").agg(F.sort_array(F.collect_list("race_id")).alias("ids"))
    found = r.races.select("race_id", "race_date", "course_name").join(index, ["race_date", "course_name"]).withColumn("others", F.array_remove("ids", F.col("race_id")))
    return found.select("race_id", F.size("others").alias("races_that_day"), F.try_element_at("others", F.lit(1)).alias("first_race"))


@register("""SELECT race_id, near_id, apart, confidence FROM (SELECT a.race_id, b.race_id AS near_id, abs(date_diff('minute', a.t, b.t)) AS apart, count(*) OVER (PARTITION BY a.race_id) AS n,
    row_number() OVER (PARTITION BY a.race_id ORDER BY abs(date_diff('minute', a.t, b.t)), b.race_id) AS k,
    CASE WHEN count(*) OVER (PARTITION BY a.race_id) = 1 OR abs(date_diff('minute', a.t, b.t)) <= 25 THEN 'high' ELSE 'medium' END AS confidence
  FROM (SELECT race_id, race_date, scheduled_off_utc + to_minutes(CAST(race_id % 50 AS INTEGER)) AS t FROM races) a
  JOIN (SELECT race_id, race_date, scheduled_off_utc AS t FROM races) b USING (race_date)) WHERE k = 1""")
def j22_nearest_time(r):
    left = r.races.select("race_id", "race_date", (F.unix_seconds("scheduled_off_utc") / 60 + F.col("race_id") % 50).alias("m1"))
    right = r.races.select(F.col("race_id").alias("near_id"), "race_date", (F.unix_seconds("scheduled_off_utc") / 60).alias("m2"))
    found = match.nearest_in_time(left, right, ["race_date"], "m1", "m2", "near_id")
    return found.select("race_id", "near_id", F.col("apart").cast("long").alias("apart"), "confidence")


@register("""SELECT race_id, near_id, apart FROM (SELECT a.race_id, b.race_id AS near_id, abs(a.m - b.m) AS apart, row_number() OVER (PARTITION BY a.race_id ORDER BY CASE WHEN a.m = b.m THEN 0 ELSE 1 END, b.race_id) AS k
  FROM (SELECT race_id, race_date, hour(scheduled_off_utc) * 60 + race_id % 7 AS m FROM races) a JOIN (SELECT race_id, race_date, hour(scheduled_off_utc) * 60 AS m FROM races) b
  ON a.race_date = b.race_date AND abs(a.m - b.m) <= 5) WHERE k = 1""")
def j23_first_within_minutes(r):
    left = r.races.select("race_id", "race_date", (F.hour("scheduled_off_utc") * 60 + F.col("race_id") % 7).alias("m1"))
    right = r.races.select(F.col("race_id").alias("near_id"), "race_date", (F.hour("scheduled_off_utc") * 60).alias("m2"))
    return match.first_within(left, right, ["race_date"], "m1", "m2", "near_id").select("race_id", "near_id", F.col("apart").cast("long").alias("apart"))


@register("""SELECT runner_id, other, matched_on FROM (SELECT u.runner_id, b.runner_id AS other, 0 AS matched_on FROM runners u JOIN runners b ON b.race_id = u.race_id AND b.horse_name = u.horse_name
  UNION ALL SELECT u.runner_id, b.runner_id, 1 FROM runners u JOIN runners b ON b.race_id = u.race_id AND replace(b.horse_name, ' ', '') = replace(u.horse_name, ' ', ''))
  QUALIFY row_number() OVER (PARTITION BY runner_id ORDER BY matched_on, other) = 1""")
def j21_j24_name_then_compact(r):
    left = r.runners.select("runner_id", "race_id", F.col("horse_name").alias("name"), text.compact("horse_name").alias("short"))
    right = r.runners.select(F.col("runner_id").alias("other"), "race_id", F.col("horse_name").alias("name2"), text.compact("horse_name").alias("short2"))
    return match.by_either(left, right, [("name", "name2"), ("short", "short2")], "runner_id", "other", ["race_id"]).select("runner_id", "other", "matched_on")


@register()
def j25_j26_rematch_cascade(r):
    """Runners whose name was garbled or day shifted, found again by the cascade."""
    rows = features.runners_with_races(r).select("runner_id", F.col("race_date").alias("day"), F.col("course_name").alias("course"), F.lower("horse_name").alias("name"))
    rows = dml.first_by(rows, ["day", "course", "name"], F.col("runner_id"))
    cards = rows.groupBy("day", "course").agg(F.collect_set("name").alias("card"))
    full = rows.join(cards, ["day", "course"])
    kind = F.crc32("runner_id") % 4
    garbled = F.concat(F.substring("name", 1, 4), F.lit("x"), F.expr("substring(name, 5)"))
    missing = full.withColumn("name", F.when(kind == 1, garbled).otherwise(F.col("name"))).withColumn("day", F.when(kind == 2, F.date_add("day", -1)).otherwise(F.col("day")))
    return match.cascade(missing, full.withColumnRenamed("runner_id", "row_id"))


@register(""", every AS (SELECT u.runner_id, u.race_id, a.race_date AS day, a.course_name AS course, lower(u.horse_name) AS name FROM runners u JOIN races a USING (race_id)),
  own AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY day, course, name ORDER BY runner_id) = 1),
  found AS (SELECT '1-' || runner_id AS row_id, day, course, name, CASE race_id % 3 WHEN 0 THEN 2 ELSE 1 END AS known FROM own UNION ALL SELECT '2-' || runner_id, day, course, name, CASE race_id % 3 WHEN 1 THEN 2 ELSE 1 END FROM own),
  asked AS (SELECT runner_id, course, CASE WHEN race_id % 4 = 1 THEN substr(name, 1, 4) || 'x' || substr(name, 5) ELSE name END AS name, CASE WHEN race_id % 4 = 2 THEN day - 1 ELSE day END AS day FROM own)
SELECT runner_id, row_id, match_type, confidence FROM (SELECT q.runner_id, f.row_id, match_type, confidence, row_number() OVER (PARTITION BY q.runner_id ORDER BY priority, known DESC, row_id) AS k
  FROM asked q, (VALUES (0, 0, 'exact', CAST(1 AS DOUBLE)), (1, 1, 'day_off', CAST(0.98 AS DOUBLE)), (2, -1, 'day_off', CAST(0.98 AS DOUBLE))) t(priority, d, match_type, confidence), found f
  WHERE f.day = q.day + d AND f.course = q.course AND f.name = q.name) WHERE k = 1""")
def j25_j26_best_candidate(r):
    """The exact and the day-off matches: of two rows of a day, course and name that which knows trainer and jockey, else the first."""
    rows = features.runners_with_races(r).select("runner_id", "race_id", F.col("race_date").alias("day"), F.col("course_name").alias("course"), F.lower("horse_name").alias("name"), F.lit("t").alias("trainer"))
    rows = dml.first_by(rows, ["day", "course", "name"], F.col("runner_id"))
    full = rows.join(rows.groupBy("day", "course").agg(F.collect_set("name").alias("card")), ["day", "course"])
    found = [full.withColumn("row_id", F.concat(F.lit(f"{i + 1}-"), "runner_id")).withColumn("jockey", F.when(F.col("race_id") % 3 == i, "j")) for i in (0, 1)]
    kind = F.col("race_id") % 4
    garbled = F.concat(F.substring("name", 1, 4), F.lit("x"), F.expr("substring(name, 5)"))
    missing = full.withColumn("name", F.when(kind == 1, garbled).otherwise(F.col("name"))).withColumn("day", F.when(kind == 2, F.date_add("day", -1)).otherwise(F.col("day")))
    matched = match.cascade(missing, found[0].unionByName(found[1]))
    return matched.where("match_type in ('exact', 'day_off')").select("runner_id", "row_id", "match_type", "confidence")


# --- text ------------------------------------------------------------------------------------------------


@register("""SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(s_name)), '[^a-z0-9\\s_-]', '', 'g'), '[\\s-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
  regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS short, TRY_CAST(regexp_extract(s_name, '(-?[0-9]+(\\.[0-9]+)?)', 1) AS INTEGER) AS number FROM supplier""", raw=True)
def f14_f18_names_and_numbers(r):
    return r.table("supplier").select("s_suppkey", text.slugify("s_name").alias("slug"), text.compact("s_name").alias("short"), text.to_int("s_name").alias("number"))


@register("""SELECT race_id, race_type ILIKE '%hcap%' OR race_type ILIKE '%handicap%' AS handicap, lower(course_name) AS course, strftime(scheduled_off_utc AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London', '%H:%M') AS london,
  date_trunc('day', scheduled_off_utc) - INTERVAL 3 HOUR AS cutoff, CASE WHEN race_id % 5 = 0 THEN NULL ELSE CAST(race_id % 3 AS DOUBLE) * 8 + race_id % 8 END AS furlongs FROM races""")
def f16_f26_race_texts(r):
    trip = F.when(F.col("race_id") % 5 == 0, "abc").otherwise(F.concat(F.col("race_id") % 3, F.lit("m "), F.col("race_id") % 8, F.lit("f")))
    races = tables.stored(r.races.select("race_id", "race_type", "course_name", "scheduled_off_utc"), "race-texts")
    names = tables.stored(races.select("course_name").distinct().withColumn("course", text.normalise_course("course_name")), "course-names")  # each name once
    return races.join(tables.by_size(names), "course_name", "left").select("race_id", text.is_handicap("race_type").alias("handicap"), "course", text.london_time("scheduled_off_utc").alias("london"), text.decision_cutoff("scheduled_off_utc").alias("cutoff"), text.furlongs(trip).alias("furlongs"))


@register("""SELECT page_id, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) AS title, length(html) AS data_chars FROM pages""", raw=True)
def s14_s15_page_title_and_data(r):
    """Titles, and the data that a script tag of the page carries: here the page's own text, as JSON."""
    tag = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), F.to_json(F.struct(F.regexp_replace("html", "<", "&lt;").alias("page"))), F.lit("</script>"))
    pages = r.table("pages").withColumn("with_data", F.concat("html", tag))
    page = F.regexp_replace(F.get_json_object(readers.page_data("with_data"), "$.page"), "&lt;", "<")
    return pages.select("page_id", readers.page_title().alias("title"), F.length(page).alias("data_chars"))


@register("""SELECT DISTINCT href FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*n)"', 1)) AS href FROM pages)""", raw=True)
def s16_page_links(r):
    return readers.links(r.table("pages"), "n")


@register("""SELECT race_id, course_name AS course, 'horse ' || n AS name, CASE WHEN n % 2 = 0 THEN 'F' ELSE 'G' END AS sex FROM races, (SELECT unnest([0, 1]) AS n) WHERE race_id % 4 <> 0
  UNION ALL SELECT race_id, course_name, NULL, NULL FROM races WHERE race_id % 4 = 0""")
def s13_racecards(r):
    """Nested documents made of the races, read and unfolded again."""
    horse = lambda n, sex: F.struct(F.lit(f"horse {n}").alias("name"), F.lit(sex).alias("sex_code"))
    runners = F.when(F.col("race_id") % 4 != 0, F.array(horse(0, "f"), horse(1, "g"))).otherwise(F.array().cast("array<struct<name:string,sex_code:string>>"))
    cards = r.races.select("race_id", F.to_json(F.array(F.struct(F.col("course_name").alias("course"), runners.alias("runners")))).alias("card"))
    return readers.racecard_runners(cards).select("race_id", "course", "name", "sex")


@register("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS file_day, 'GB' AS country, CASE WHEN o_orderkey % 2 = 0 THEN 'PLACE' ELSE 'WIN' END AS market_type FROM orders""", raw=True)
def s07_s08_file_names(r):
    name = F.concat(F.lit("dwbfpricesuk"), F.when(F.col("o_orderkey") % 2 == 0, "place").otherwise("win"), F.date_format("o_orderdate", "ddMMyyyy"), F.lit(".csv"))
    rows = r.table("orders").select("o_orderkey", name.alias("file"))
    return rows.select("o_orderkey", readers.file_date().alias("file_day"), readers.file_market().alias("m")).select("o_orderkey", "file_day", "m.*")


@register("""SELECT CAST(o_orderkey AS VARCHAR) AS race_date, CAST(o_custkey AS VARCHAR) AS course, CAST(o_totalprice AS VARCHAR) AS horse FROM orders""", raw=True)
def s11_aliased_columns(r):
    """The first alias that is there wins, in any case; the others are ignored."""
    rows = r.table("orders").select(F.col("o_orderkey").alias("RaceDate"), F.col("o_custkey").alias("Track"), F.lit("x").alias("venue"), F.col("o_totalprice").alias("Runner"))
    return readers.aliased(rows, {k: readers.ALIASES[k] for k in ("race_date", "course", "horse")})


@register("""WITH sp AS (SELECT 'bfsp_1.' || o_orderkey || '_win' AS race_id, 'horse_' || l_partkey AS horse_id, 'Horse ' || l_partkey AS horse_name, CAST(o_orderdate AS TIMESTAMP) AS off, l_linenumber % 3 = 0 AS won, CAST(l_quantity AS DOUBLE) AS sp FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'races' AS kind, race_id AS id, race_id, NULL AS horse_id, '2m Hcap' AS name, 'Newmarket' AS course, max(off) AS off, date_trunc('day', max(off)) - INTERVAL 3 HOUR AS cutoff, NULL AS won, NULL AS sp, count(*) AS field_size FROM sp GROUP BY race_id
UNION ALL SELECT 'runners', race_id || '_' || horse_id, race_id, horse_id, horse_name, NULL, NULL, NULL, NULL, NULL, NULL FROM sp
UNION ALL SELECT 'results', race_id || '_' || horse_id || '_res', race_id, horse_id, race_id || '_' || horse_id, NULL, NULL, NULL, won, sp, NULL FROM sp
UNION ALL SELECT 'horse_history', race_id || '_' || horse_id || '_hist', race_id, horse_id, horse_name, NULL, off, NULL, won, NULL, NULL FROM sp""", raw=True)
def s02_s03_starting_price_rows(r):
    """Starting-price rows made of the lines, split into the records of four tables; the field's size is the rows of the race."""
    rows = r.table("lineitem").join(r.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").cast("string").alias("event_id"), F.lit("GB / Newm 3rd Apr").alias("menu_hint"), F.lit("2m Hcap").alias("event_name"), F.date_format("o_orderdate", "dd-MM-yyyy HH:mm").alias("event_dt"),
        F.col("l_linenumber").cast("string").alias("selection_id"), F.concat(F.lit("Horse "), F.col("l_partkey")).alias("selection_name"), F.when(F.col("l_linenumber") % 3 == 0, "1").otherwise("0").alias("win_lose"), F.col("l_quantity").cast("string").alias("bsp"),
    )
    columns = {
        "races": {"id": "race_id", "name": "race_type", "course": "course_name", "off": "scheduled_off_utc", "cutoff": "decision_cutoff_utc", "field_size": "field_size"},
        "runners": {"id": "runner_id", "horse_id": "horse_id", "name": "horse_name"},
        "results": {"id": "result_id", "horse_id": "horse_id", "name": "runner_id", "won": "won", "sp": "sp_decimal"},
        "horse_history": {"id": "history_id", "horse_id": "horse_id", "name": "horse_name", "off": "scheduled_off_utc", "won": "won"},
    }
    records = readers.sp_records(rows)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [records[kind].select(F.lit(kind).alias("kind"), "race_id", *[F.col(c).alias(to) for to, c in named.items()]) for kind, named in columns.items()])


# --- quality, lookups, streams -------------------------------------------------------------------------------


CHECKS = f"""counted AS (SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(trim(trainer_name), '') = '') AS t, count(*) FILTER (WHERE coalesce(trim(jockey_name), '') = '') AS j
  FROM {{runners}} u JOIN (SELECT race_id FROM {{races}} WHERE NOT coalesce({NO_RACE}, false)) USING (race_id)),
failing AS (
  SELECT 'no_missing_keys' AS "check", count(*) AS failures, 0 AS max_failures FROM (SELECT CAST(race_id AS VARCHAR) AS k FROM {{races}} UNION ALL SELECT runner_id FROM {{runners}} UNION ALL SELECT runner_id FROM {{results}}) WHERE coalesce(k, '') = ''
  UNION ALL SELECT 'timestamp_range', count(*), 0 FROM (SELECT scheduled_off_utc AS t FROM {{races}} UNION ALL SELECT decision_cutoff_utc FROM {{races}}) WHERE t IS NULL OR year(t) NOT BETWEEN 2010 AND 2030
  UNION ALL SELECT 'referential_integrity', count(*), 0 FROM {{results}} x WHERE NOT EXISTS (FROM {{races}} a WHERE a.race_id = x.race_id)
  UNION ALL SELECT 'runner_integrity', count(*), 0 FROM {{results}} x WHERE NOT EXISTS (FROM {{runners}} u WHERE u.runner_id = x.runner_id)
  UNION ALL SELECT 'single_winner', count(*), 0 FROM (SELECT race_id FROM {{results}} WHERE won GROUP BY 1 HAVING count(*) > 2)
  UNION ALL SELECT 'races_have_runners', count(*), 0 FROM {{races}} a WHERE NOT EXISTS (FROM {{runners}} u WHERE u.race_id = a.race_id)
  UNION ALL SELECT 'odds_range', count(*), 0 FROM odds WHERE decimal_odds <= 1.01 OR decimal_odds > 1000 OR decimal_odds IS NULL
  UNION ALL SELECT 'field_size_consistency', count(*), 0 FROM {{races}} a JOIN (SELECT race_id, count(*) AS n FROM {{runners}} GROUP BY 1) s USING (race_id) WHERE a.field_size <> s.n
  UNION ALL SELECT 'no_duplicate_races', count(*), 0 FROM (SELECT race_id FROM {{races}} GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'history_timestamps', count(*), 0 FROM {{history}} h JOIN {{races}} a USING (race_id) WHERE h.scheduled_off_utc <> a.scheduled_off_utc
  UNION ALL SELECT 'trainer_jockey_missing_rate', CASE WHEN 100.0 * t <= {{trainer}} * n AND 100.0 * j <= {{jockey}} * n THEN 0 ELSE t + j END, 0 FROM counted
  UNION ALL SELECT 'zero_coverage_races', count(*), {{zero}} FROM (SELECT race_id FROM {{runners}} JOIN (SELECT race_id FROM {{races}} WHERE NOT coalesce({NO_RACE}, false)) USING (race_id)
    GROUP BY 1 HAVING count(*) FILTER (WHERE coalesce(trim(trainer_name), '') <> '' OR coalesce(trim(jockey_name), '') <> '') = 0))
SELECT "check", failures, max_failures, failures <= max_failures AS passed FROM failing"""


@register(", " + CHECKS.format(races="races", runners="runners", results="results", history="horse_history", trainer=5.0, jockey=5.0, zero=100))
def q01_q12_checks(r):
    return quality.all_checks(r, r.odds)


FAULTY = """, races2 AS (SELECT * REPLACE (scheduled_off_utc + to_days(CASE WHEN race_id % 50 = 0 THEN 12000 ELSE 0 END) AS scheduled_off_utc, field_size + CASE WHEN race_id % 20 = 0 THEN 1 ELSE 0 END AS field_size) FROM races
  UNION ALL SELECT * FROM races WHERE race_id % 25 = 0),
runners2 AS (SELECT * REPLACE (CASE WHEN race_id % 9 = 0 THEN ' ' ELSE trainer_name END AS trainer_name, CASE WHEN race_id % 9 = 0 THEN NULL ELSE jockey_name END AS jockey_name, CASE WHEN race_id % 61 = 0 THEN '' ELSE runner_id END AS runner_id)
  FROM runners WHERE race_id % 40 <> 0),
results2 AS (SELECT * REPLACE (won OR race_id % 10 = 0 AS won, race_id + CASE WHEN race_id % 33 = 0 THEN 1000000000 ELSE 0 END AS race_id) FROM results),
history2 AS (SELECT * REPLACE (scheduled_off_utc + to_hours(CASE WHEN race_id % 15 = 0 THEN 1 ELSE 0 END) AS scheduled_off_utc) FROM horse_history), """


@register(FAULTY + CHECKS.format(races="races2", runners="runners2", results="results2", history="history2", trainer=3.0, jockey=3.0, zero=0))
def q01_q12_checks_find_faults(r):
    """The checks over tables with a fault of every kind, at the limits of the latest era."""
    from types import SimpleNamespace

    race, off = F.col("race_id"), F.unix_seconds("scheduled_off_utc")
    races = r.races.withColumn("scheduled_off_utc", F.timestamp_seconds(off + F.when(race % 50 == 0, 12_000 * 86_400).otherwise(0))).withColumn("field_size", F.col("field_size") + F.when(race % 20 == 0, 1).otherwise(0))
    runners = r.runners.where(race % 40 != 0).withColumns({"trainer_name": F.when(race % 9 == 0, " ").otherwise(F.col("trainer_name")), "jockey_name": F.when(race % 9 != 0, F.col("jockey_name")), "runner_id": F.when(race % 61 == 0, "").otherwise(F.col("runner_id"))})
    results = r.results.withColumn("won", F.col("won") | (race % 10 == 0)).withColumn("race_id", race + F.when(race % 33 == 0, 1_000_000_000).otherwise(0))
    history = r.horse_history.withColumn("scheduled_off_utc", F.timestamp_seconds(off + F.when(race % 15 == 0, 3_600).otherwise(0)))
    faulty = SimpleNamespace(races=races.unionByName(r.races.where(race % 25 == 0)), runners=runners, results=results, horse_history=history)
    return quality.all_checks(faulty, r.odds, limits={era: quality.ERAS["from_2019"] for era in quality.ERAS})


def q15_leakage_guard(r):
    """All nine groups, and one with a planted leak: the form of a horse up to a day after the cutoff."""
    from types import SimpleNamespace

    r.store_runs()
    day = F.expr("INTERVAL '1' DAY")
    late = SimpleNamespace(runs=r.runs.withColumn("decision_cutoff_utc", F.col("decision_cutoff_utc") + day), horse_history=r.horse_history)
    planted = features.horse_form(late).withColumn("decision_cutoff_utc", F.col("decision_cutoff_utc") - day)
    return quality.leaks({name: make(r) for name, make in features.GROUPS.items()} | {"planted": planted})


register()(q15_leakage_guard)
ORACLES["q15_leakage_guard"] = LEAKS


@register("""SELECT history_id, race_date, course_id, going_code, distance_furlongs, finishing_position, won, finishing_position IS NULL AS result_missing FROM horse_history WHERE horse_id = 7 ORDER BY race_date DESC, history_id LIMIT 10""")
def l01_horse_history(r):
    return lookup.horse_history(r, 7)


@register("SELECT count(*) AS runs, count(*) FILTER (WHERE won) AS wins, round(count(*) FILTER (WHERE won) / nullif(count(*), 0), 3) AS win_rate FROM trainer_history WHERE trainer_name = 'Supplier#000000003' AND lower(course_name) = 'nation_3'")
def l02_trainer_form(r):
    return lookup.trainer_form(r, "Supplier#000000003", course="NATION_3")


@register("SELECT count(*) AS runs, count(*) FILTER (WHERE won) AS wins, round(count(*) FILTER (WHERE won) / nullif(count(*), 0), 3) AS win_rate FROM jockey_history WHERE jockey_name = 'Jockey 5'")
def l03_jockey_form(r):
    return lookup.jockey_form(r, "Jockey 5")


@register("SELECT count(*) AS runs, count(*) FILTER (WHERE won) AS wins, min(finishing_position) AS best_position, round(count(*) FILTER (WHERE won) / nullif(count(*), 0), 3) AS win_rate FROM horse_history WHERE horse_id = 7 AND going_code = 'good to firm'")
def l04_going_record(r):
    return lookup.going_record(r, 7, "Good To Firm")


@register("SELECT count(*) AS runs, count(*) FILTER (WHERE won) AS wins, min(finishing_position) AS best_position, round(count(*) FILTER (WHERE won) / nullif(count(*), 0), 3) AS win_rate FROM horse_history WHERE horse_id = 7 AND course_id LIKE 'nation-1!_%' ESCAPE '!'")
def l05_course_record(r):
    return lookup.course_record(r, 7, "NATION-1")


@register("SELECT runner_id, horse_name, trainer_name, jockey_name, draw, official_rating FROM runners WHERE race_id = 5")
def l06_race_field(r):
    return lookup.race_field(r, 5)


@register("""SELECT time_bucket(INTERVAL 1 HOUR, snapshot_timestamp_utc) AS start, time_bucket(INTERVAL 1 HOUR, snapshot_timestamp_utc) + INTERVAL 1 HOUR AS "end", snapshot_label, count(*) AS n, round(avg(decimal_odds), 6) AS odds FROM odds GROUP BY 1, 2, 3""")
def x_hourly_odds(r):
    """The windowed sums of the snapshot stream, over the whole table at once."""
    return snapshots.by_window(r.odds)


@register("""SELECT snapshot_id, CAST(floor(date_diff('second', snapshot_timestamp_utc, date_trunc('day', snapshot_timestamp_utc) + INTERVAL 23 HOUR) / 60) AS BIGINT) AS minutes_to_off, traded_volume_gbp * 1.5 AS volume, decimal_odds AS best_back FROM odds""".replace("decimal_odds AS best_back", "round(decimal_odds, 6) AS best_back"))
def x03_x04_ladder(r):
    """Minutes to the off, volume over the ladder and its first price."""
    level = lambda price, size: F.struct(price.alias("price"), size.alias("size"))
    ladder = F.array(level(F.col("decimal_odds"), F.col("traded_volume_gbp")), level(F.col("decimal_odds") + 1, F.col("traded_volume_gbp") / 2))
    off = F.timestamp_seconds(F.unix_seconds(F.date_trunc("day", "snapshot_timestamp_utc")) + 23 * 3600)
    rows = r.odds.withColumn("ladder", ladder).withColumn("off", off)
    return rows.select("snapshot_id", snapshots.minutes_to_off("off", "snapshot_timestamp_utc").alias("minutes_to_off"), snapshots.ladder_volume("ladder").alias("volume"), snapshots.best_back("ladder").alias("best_back"))


@register("""SELECT u.runner_id, h.rpr AS last_rpr FROM runners u JOIN races a USING (race_id) ASOF LEFT JOIN (SELECT horse_id, scheduled_off_utc, max(rpr) AS rpr FROM horse_history GROUP BY 1, 2) h
  ON h.horse_id = u.horse_id AND h.scheduled_off_utc < a.decision_cutoff_utc""")
def j28_as_of_last(r):
    """The latest earlier rating of each runner's horse, by one union and one window."""
    left = features.runners_with_races(r).select("runner_id", "horse_id", "decision_cutoff_utc")
    right = r.horse_history.groupBy("horse_id", "scheduled_off_utc").agg(F.max("rpr").alias("last_rpr"))
    return pit.as_of_last(left, right, ["horse_id"], "decision_cutoff_utc", "scheduled_off_utc", ["last_rpr"]).select("runner_id", "last_rpr")


# --- standard races, coverage, outputs ---------------------------------------------------------------------------

#: Texts of markets, some of which are no races, dealt by race_id over the races.
MARKETS = ["2m Hcap", "Forecast 2m", "1m2f pa", "Arab race", "To Win v Field", "PA special", "Each Way", "each-way 5f", "2m PA", "Charity Stakes", "5f Listed", "Winning Distance how far"]


@register(f""", markets AS (SELECT * REPLACE ({MARKETS!r}[race_id % {len(MARKETS)} + 1] AS race_type, CASE WHEN race_id % 19 = 0 THEN NULL WHEN race_id % 17 = 0 THEN 'Daily Odds' ELSE course_name END AS course_name, nullif(field_size, 3) AS field_size) FROM races)
  SELECT race_id, race_id % 23 <> 0 AND NOT coalesce({NO_RACE}, false) AS is_standard_race FROM markets""")
def p06_q13_standard_races(r):
    """The flag of standard races: special markets lose it, those flagged before stay so."""
    markets = r.races.select("race_id", F.element_at(F.array(*map(F.lit, MARKETS)), (F.col("race_id") % len(MARKETS) + 1).cast("int")).alias("race_type"), F.when(F.col("race_id") % 19 == 0, None).when(F.col("race_id") % 17 == 0, "Daily Odds").otherwise(F.col("course_name")).alias("course_name"), F.nullif("field_size", F.lit(3)).alias("field_size"), F.when(F.col("race_id") % 23 == 0, False).when(F.col("race_id") % 2 == 0, True).alias("is_standard_race"))
    return quality.with_standard_flag(markets).select("race_id", "is_standard_race")


@register("""SELECT (SELECT count(*) FROM races WHERE race_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31') AS races, count(*) AS runners, round(count(trainer_id) / count(*), 4) AS trainer_coverage, round(count(jockey_id) / count(*), 4) AS jockey_coverage,
  round(count(draw) / count(*), 4) AS draw_coverage, (SELECT count(*) FROM results JOIN races USING (race_id) WHERE race_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31') AS results
  FROM runners JOIN races USING (race_id) WHERE race_date BETWEEN DATE '1995-01-01' AND DATE '1997-12-31'""")
def a28_coverage(r):
    return quality.coverage(r, since="1995-01-01", until="1997-12-31")


@register("""SELECT race_id FROM races WHERE upper(coalesce(CASE race_id % 4 WHEN 0 THEN 'gb' WHEN 1 THEN 'Ire' WHEN 2 THEN 'FR' END, '')) IN ('GB', 'IRE')""")
def p16_countries(r):
    country = F.when(F.col("race_id") % 4 == 0, "gb").when(F.col("race_id") % 4 == 1, "Ire").when(F.col("race_id") % 4 == 2, "FR")
    return r.races.withColumn("country", country).where(F.upper(F.coalesce("country", F.lit(""))).isin("GB", "IRE")).select("race_id")


@register("SELECT history_id, row_number() OVER (PARTITION BY horse_id ORDER BY scheduled_off_utc DESC, history_id) AS rn_desc FROM horse_history")
def w02_career_recency(r):
    """How recent each run is in its horse's whole career."""
    return r.horse_history.select("history_id", F.row_number().over(Window.partitionBy("horse_id").orderBy(F.desc("scheduled_off_utc"), "history_id")).alias("rn_desc"))


@register(SCORES + "SELECT runner_id, round(edge, 6) AS edge FROM bets ORDER BY edge DESC, runner_id LIMIT 50")
def o11_best_edges(r):
    """The bets with the largest edge, for display; the number is the feature."""
    return value_bets(r).select("runner_id", F.round("edge", 9).alias("edge"), F.col("edge").alias("exact")).orderBy(F.desc("exact"), "runner_id").limit(50).drop("exact")


@register("SELECT race_id, scheduled_off_utc, course_name FROM races WHERE race_date = (SELECT max(race_date) FROM races) ORDER BY scheduled_off_utc, course_name, race_id")
def o09_o10_last_card(r):
    """The races of the last day of the log, by time and course."""
    last = r.races.agg(F.max("race_date").alias("race_date"))
    return r.races.join(F.broadcast(last), "race_date").orderBy("scheduled_off_utc", "course_name", "race_id").select("race_id", "scheduled_off_utc", "course_name")


@register("SELECT race_id, scheduled_off_utc FROM races WHERE scheduled_off_utc > decision_cutoff_utc + INTERVAL 21 HOUR ORDER BY race_id LIMIT 5")
def o04_leak_sample(r):
    """A few rows that break a rule, in a fixed order."""
    return r.races.where("scheduled_off_utc > decision_cutoff_utc + INTERVAL '21' HOUR").select("race_id", "scheduled_off_utc").orderBy("race_id").limit(5)


@register("""SELECT race_id, ['Newmarket', 'Leopardstown', 'The Flat', 'Wolverhampton', 'Epsom', 'some field', 'Galway Races', NULL][race_id % 8 + 1] AS course FROM races""")
def s21_course_spellings(r):
    """Courses told by a table of spellings, two of which a settings file adds or replaces."""
    names = ["GB / Newm 3rd Apr", "IRE / Leop 5th May", "FR / Wexx 1st Jan", "Wolverhampton Polytrack", "Epsom Downs", "Some  Field 12 Jun", "galway", None]
    rows = r.races.select("race_id", F.element_at(F.array(*map(F.lit, names)), (F.col("race_id") % len(names) + 1).cast("int")).alias("course_name"))
    return lookup.with_course(rows, "course_name", "course", {"wexx": "The Flat", "galway": "Galway Races"}).select("race_id", "course")


@register("""SELECT race_id, CASE WHEN race_id % 2 = 0 THEN 'Market Rasen' ELSE 'Bath' END AS venue, CASE WHEN race_id % 2 = 0 THEN 'Market' ELSE 'Bath' END AS word FROM races""")
def f36_f44_venues(r):
    """A course's name without its meeting's day, and its first word."""
    name = F.concat(F.when(F.col("race_id") % 2 == 0, "Market Rasen ").otherwise("Bath "), F.dayofmonth("race_date"), F.lit("th "), F.date_format("race_date", "MMM"))
    return r.races.select("race_id", text.venue_shown(name).alias("venue"), text.first_word(name).alias("word"))


@register("""SELECT race_id, ['Newmarket', 'Leopardstown', 'wexx', 'Wolverhampton', 'Epsom', 'Southwell', 'some field', 'Kempton', 'Galway'][race_id % 9 + 1] AS course, ['galileo', 'danceri', 'sea_fox', 'mr_moonshine', 'westaway', 'a_b'][race_id % 6 + 1] AS horse FROM races""")
def f15_f16_normalised_names(r):
    """Courses as exchanges and form books write them, and horses with marks and countries."""
    courses = ["GB / Newm 3rd Apr", "IRE / Leop 5th May", "FR / Wexx 1st Jan", "Wolverhampton Polytrack", "Epsom Downs", "Southwell (AW)", "Some  Field 12 Jun", "kemp 7th Oct", "galway"]
    horses = ["Galileo AUS", "Danceri (IRE)", "Sea Fox FR", "Mr MoonshineI (IRE)", "Westaway I (IRE)", "A-B (USA)"]
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("race_id") % len(values) + 1).cast("int"))
    return r.races.select("race_id", text.normalise_course(at(courses)).alias("course"), text.normalise_horse(at(horses)).alias("horse"))


@register("""SELECT race_id, CASE race_id % 5 WHEN 0 THEN true WHEN 2 THEN true WHEN 3 THEN race_id % 4 IN (0, 3) ELSE false END AS won, CASE WHEN race_id % 4 IN (0, 2) THEN 'AW' ELSE 'Turf' END AS surface,
  'bfsp_' || race_id || ['', '_x', '_winner'][race_id % 3 + 1] AS id, CASE race_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS ahead, CASE WHEN race_id % 4 = 2 THEN DATE '1999-02-03' END AS day FROM races""")
def f21_f28_f35_f37_small_texts(r):
    """Win flags, surfaces by going, exchange ids, and days given by a word."""
    at = lambda *values: F.element_at(F.array(*map(F.lit, values)), (F.col("race_id") % len(values) + 1).cast("int"))
    rows = r.races.select("race_id", at("1", "0", " Win", "", "x").alias("flag"), at("1", "2", "F", "1").alias("position"), at("Standard", "Good", "Standard to Slow", None).alias("going"), at("today", " Tomorrow", "1999-02-03", "soon").alias("word"))
    rows = rows.withColumn("id", F.concat(at("bfsp_1.", "bfsp_"), F.col("race_id"), at("_win", "_win_x", "_winner"))).withColumn("on", text.relative_day("word"))
    ahead = F.date_diff("on", F.current_date())
    given = F.lower(F.trim("word")).isin("today", "tomorrow")
    return rows.select("race_id", text.is_win("flag", "position").alias("won"), text.surface_of("going").alias("surface"), settle.clean_id("id").alias("id"), F.when(given, ahead).alias("ahead"), F.when(~given, F.col("on")).alias("day"))


@register(f""", shares AS (SELECT runner_id, unnest([{{'label': 'recent form', 'v': weight_lbs - 120}}, {{'label': 'draw', 'v': CAST(draw AS DOUBLE) - 4}}, {{'label': 'recent form', 'v': CAST(official_rating AS DOUBLE) - 25}}, {{'label': 'age profile', 'v': CAST(age AS DOUBLE) - 6}}]) AS s FROM runners),
  best AS (SELECT runner_id, s.label AS label, max(s.v) AS v FROM shares WHERE s.v > 0 GROUP BY 1, 2),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY runner_id ORDER BY v DESC, label DESC) AS k FROM best)
  SELECT runner_id, coalesce(string_agg(label, ', ' ORDER BY k) FILTER (WHERE k <= 2), '') AS signals FROM runners LEFT JOIN ranked USING (runner_id) GROUP BY 1""")
def f40_m16_top_signals(r):
    """The labels of a runner's largest positive contributions, each once."""
    parts = [("recent form", F.col("weight_lbs") - 120), ("draw", F.col("draw") - 4), ("recent form", F.col("official_rating") - 25), ("age profile", F.col("age") - 6)]
    return r.runners.select("runner_id", scoring.top_signals(parts, 2).alias("signals"))


@register(BETS + """SELECT runner_id, round(profit, 6) AS profit, round(profit_sp, 6) AS profit_sp FROM settled WHERE settled AND date = (SELECT max(date) FROM settled WHERE settled)""")
def l09_settled_bets_of_a_day(r):
    """The bets of the last day that has settled ones."""
    done = settle.settle(bet_log(r), bet_results(r)).where("settled")
    return done.join(F.broadcast(done.agg(F.max("date").alias("date"))), "date").select("runner_id", "profit", "profit_sp")


@register("SELECT CASE WHEN race_id % 3 = 0 THEN 'ire' ELSE 'gb' END AS region, year(race_date) AS year, month(race_date) AS month, count(*) AS races, count(DISTINCT course_name) AS courses FROM races GROUP BY 1, 2, 3")
def d18_partitioned_files(r):
    """Races written as CSV by region, year and month, and read back by those folders."""
    rows = r.races.select("race_id", "course_name", F.when(F.col("race_id") % 3 == 0, "ire").otherwise("gb").alias("region"), F.year("race_date").alias("year"), F.month("race_date").alias("month"))
    back = tables.stored_by(rows, ["region", "year", "month"], "form-files")
    return back.groupBy("region", "year", "month").agg(F.count("*").alias("races"), F.count_distinct("course_name").alias("courses"))


@register("""SELECT runner_id, race_date FROM runners JOIN races USING (race_id) WHERE race_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""")
def s19_log_window(r):
    """Lines of a dated log between two days, as text in and dates out."""
    log = features.runners_with_races(r).select("runner_id", F.date_format("race_date", "yyyy-MM-dd").alias("date"))
    return quality.between_days(log.withColumn("race_date", F.col("date").try_cast("date")), "race_date", "1996-01-01", "1996-12-31").select("runner_id", "race_date")


# --- files, records, queues --------------------------------------------------------------------------------------


@register("""SELECT u.runner_id AS own_id, 'bf_' || u.race_id AS race_id, 'bf_' || u.race_id || '_' || 'horse_' || u.runner_id AS runner_id, CASE WHEN u.race_id % 3 = 0 THEN 'unknown' ELSE a.course_name END AS course_name,
  CASE WHEN u.race_id % 2 = 0 THEN 'trainer_' || u.trainer_id END AS trainer_id, CASE WHEN x.finishing_position > 0 THEN x.finishing_position END AS finishing_position, coalesce(x.finishing_position = 1, false) AS won,
  CASE WHEN x.finishing_position > 0 THEN CAST(x.finishing_position AS VARCHAR) ELSE 'REMOVED' END AS finishing_position_raw, round(x.sp_decimal, 6) AS sp_decimal, a.decision_cutoff_utc
  FROM runners u JOIN races a USING (race_id) JOIN results x USING (runner_id) WHERE u.race_id % 11 <> 0""")
def s05_exchange_records(r):
    """Exchange records whose fields go by several names, made of the runners and split into the four kinds of record."""
    rows = features.with_results(r, "finishing_position", "sp_decimal")
    even, id_ = F.col("race_id") % 2 == 0, F.when(F.col("race_id") % 11 != 0, F.col("race_id").cast("string"))
    place = F.when(F.col("finishing_position") > 0, F.col("finishing_position"))
    fields = {
        "marketId": F.when(even, id_), "id": F.when(~even, id_), "marketStartTime": F.date_format("scheduled_off_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "venue": F.when(even, "").otherwise(F.lit(None)),
        "eventName": F.when(F.col("race_id") % 3 != 0, F.col("course_name")), "runnerName": F.concat(F.lit("Horse "), "runner_id"), "trainer_name": F.when(even, F.concat(F.lit("Trainer "), "trainer_id")),
        "finishing_position": place, "status": F.when(place.isNull(), "REMOVED"), "sp_decimal": F.when(even, 0.0), "bsp": F.col("sp_decimal"),
    }
    lines = rows.select(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("line"))
    made = readers.exchange_records(lines)
    own = F.regexp_extract("horse_id", r"^horse_(.*)$", 1).alias("own_id")
    runners = made["runners"].select("runner_id", "race_id", "trainer_id", own).join(made["races"].select("race_id", "course_name", "decision_cutoff_utc"), "race_id")
    out = runners.join(made["results"].select("runner_id", "finishing_position", "won", "finishing_position_raw", "sp_decimal"), "runner_id")
    return out.join(made["horse_history"].select(F.regexp_replace("history_id", "_hist$", "").alias("runner_id")), "runner_id", "left_semi")


@register("SELECT runner_id, horse_name, weight_lbs FROM runners WHERE race_id % 9 <> 0")
def s04_zipped_lines(r):
    """Runners written as JSON lines to zip files of many members, some of the lines broken, and read back member by member."""
    whole = F.to_json(F.struct("runner_id", "horse_name", "weight_lbs"))
    broken = F.when(F.col("race_id") % 2 == 0, F.substring(whole, 1, 20)).otherwise(F.concat(F.lit("["), whole, F.lit("]")))
    folder = tables.new_path(r.spark, "zips")
    readers.write_zip_lines(r.runners.select(F.when(F.col("race_id") % 9 != 0, whole).otherwise(broken).alias("line")), folder, 5_000)
    types = r.runners.select("runner_id", "horse_name", "weight_lbs").schema
    return readers.read_zip_lines(r.spark, f"{folder}/*.zip").select(F.from_json("line", types).alias("x")).select("x.*")


@register("""SELECT race_id FROM races WHERE race_date BETWEEN DATE '1994-03-01' AND DATE '1996-02-29' AND race_id % 4 IN (0, 1) AND race_id % 5 <> 0""")
def s06_s09_files_to_read(r):
    """The files of a range of days and of two countries that were not read before."""
    token = F.element_at(F.array(*[F.lit(t) for t in ("PricesUK", "pricesire", "pricesaus", "pricesusa")]), (F.col("race_id") % 4 + 1).cast("int"))
    name = F.concat(F.lit("/in/pricesuk/"), F.col("race_id"), F.lit("/dwbf"), token, F.lit("win"), F.date_format("race_date", "ddMMyyyy"), F.lit(".csv"))
    found = r.races.select("race_id", name.alias("file"))
    wanted = files.chosen(found, "1994-03-01", "1996-02-29", ("pricesuk", "pricesire"))
    return files.unread(wanted, found.where("race_id % 5 = 0")).select("race_id")


@register("""SELECT horse_name AS horse, CAST(race_date AS VARCHAR) AS date, course_name AS course, nullif(trainer_name, '') AS trainer, nullif(jockey_name, '') AS jockey FROM runners JOIN races USING (race_id) WHERE race_id % 3 <> 2""")
def s10_s12_raw_form_files(r):
    """Runners written as CSV files of three layouts, one of which lacks a needed column, and read back."""
    rows = features.runners_with_races(r).select("race_id", "horse_name", F.date_format("race_date", "yyyy-MM-dd").alias("day"), "course_name", "trainer_name", "jockey_name")
    names = [{"horse_name": "Horse", "day": "Date", "course_name": "Course", "trainer_name": "Trainer", "jockey_name": "Jockey"}, {"jockey_name": "JOCKEY", "course_name": "course", "day": "date", "trainer_name": "trainer", "horse_name": "horse"}, {"horse_name": "horse", "day": "date"}]
    folder = tables.new_path(r.spark, "form")
    for i, layout in enumerate(names):
        rows.where(F.col("race_id") % 3 == i).select(*[F.col(c).alias(n) for c, n in layout.items()]).write.option("header", True).csv(f"{folder}/{i}")
    return files.raw_form(r.spark, f"{folder}/*/*.csv").select(*readers.RAW)


@register("""SELECT race_id, race_date, CASE race_id % 4 WHEN 0 THEN 7 WHEN 1 THEN NULL WHEN 2 THEN 3 END AS finishing_position, race_id % 4 = 3 AND race_id % 2 = 1 AS won, CASE WHEN race_id % 4 = 1 THEN 'PU' END AS non_completion,
  CASE WHEN race_id % 2 = 0 THEN 1200.5 END AS prize_money_gbp, CAST(CASE WHEN race_id % 3 = 0 THEN 4 END AS INTEGER) AS race_class FROM races WHERE race_id % 7 <> 0""")
def s11_f22_form_values(r):
    """Values of form files as typed columns: days in four ways of writing, places, prizes, classes."""
    day = F.element_at(F.array(F.date_format("race_date", "yyyy-MM-dd"), F.date_format("race_date", "d MMM yyyy"), F.date_format("race_date", "MM/dd/yyyy"), F.date_format("race_date", "yyyy-MM-dd'T'HH:mm:ss")), (F.col("race_id") % 4 + 1).cast("int"))
    pos = F.element_at(F.array(F.lit("7"), F.lit(" pu"), F.lit("3.0"), F.lit("")), (F.col("race_id") % 4 + 1).cast("int"))
    raw = r.races.select(
        "race_id", day.alias("Date"), F.when(F.col("race_id") % 7 == 0, " ").otherwise(F.col("race_id").cast("string")).alias("Horse"), F.lit("Newmarket").alias("track"), pos.alias("Pos"), F.when(F.col("race_id") % 4 == 3, "W").alias("win"),
        F.when(F.col("race_id") % 2 == 0, "\u00a31,200.50").alias("prize"), F.when(F.col("race_id") % 3 == 0, "Class 4").alias("class"),
    )
    out = readers.form_rows(readers.aliased(raw))
    return out.select(F.col("horse_name").cast("long").alias("race_id"), "race_date", "finishing_position", F.coalesce("won", F.lit(False)).alias("won"), "non_completion", "prize_money_gbp", "race_class")


@register("""SELECT race_id, ['Flat', 'Chase', 'Hurdle', 'NH Flat', 'Flat'][race_id % 5 + 1] AS kind, ['GB', 'IE', 'IE'][race_id % 3 + 1] AS country FROM races""")
def f43_kinds_and_countries(r):
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("race_id") % len(values) + 1).cast("int"))
    return r.races.select("race_id", text.race_kind(at(["2m Hcap", "3m Hcap Chs", "2m Nov HRD", "2m INHF", ""])).alias("kind"), text.course_country(at(["York", "Down Royal", "The Curragh"])).alias("country"))


@register("""SELECT runner_id, race_id, CASE race_id % 3 WHEN 0 THEN 'FADE' WHEN 2 THEN 'KEEP' END AS verdict FROM runners WHERE race_id % 2 <> 0""")
def d17_review_queue(r):
    """A queue that gets new rows and loses those that were decided."""
    queue = r.runners.where("race_id % 3 <> 1").select("runner_id", "race_id", F.when(F.col("race_id") % 3 == 0, "FADE").otherwise("KEEP").alias("verdict"))
    grown = dml.enqueued(queue, r.runners.where("race_id % 3 = 1").select("race_id", "runner_id", "horse_name"))
    return dml.without_decided(grown, r.races.where("race_id % 2 = 0"), ["race_id"])


@register("""SELECT 'unmatched' AS sink, runner_id, NULL AS candidates FROM runners WHERE race_id % 4 = 0 UNION ALL SELECT 'ambiguous', runner_id, 2 FROM runners WHERE race_id % 4 = 1
  UNION ALL SELECT * FROM (SELECT 'sample', runner_id, 1 FROM runners WHERE race_id % 4 > 1 ORDER BY runner_id LIMIT 20)""")
def d20_d24_audit_sinks(r):
    """What a match leaves to be looked at, written as CSV and read back; a dry run writes nothing."""
    candidates = r.races.where("race_id % 4 <> 0").select("race_id").unionByName(r.races.where("race_id % 4 = 1").select("race_id"))
    sinks = match.audit(r.runners.select("runner_id", "race_id"), candidates, ["race_id"], "runner_id")
    folder = tables.new_path(r.spark, "audit")
    tables.write_sinks(sinks, folder, dry_run=True)
    tables.write_sinks(sinks, folder)
    read = [r.spark.read.schema(df.schema).option("header", True).csv(f"{folder}/{name}").select(F.lit(name).alias("sink"), "runner_id", (F.col("candidates") if "candidates" in df.columns else F.lit(None).cast("long")).alias("candidates")) for name, df in sinks.items()]
    return reduce(DataFrame.unionByName, read)


REGISTRY = {"draw": {"expected_range": [2, 5], "null_policy": "never null"}, "official_rating": {"expected_range": [None, 30], "null_policy": "impute"}, "trainer_name": {"null_policy": "never null - may be empty"}, "absent": {"expected_range": [0, 1]}}


@register("""SELECT 'draw' AS feature, count(*) FILTER (WHERE draw < 2 OR draw > 5) AS out_of_range, count(*) FILTER (WHERE draw IS NULL) AS forbidden_nulls FROM runners
  UNION ALL SELECT 'official_rating', count(*) FILTER (WHERE official_rating > 30), 0 FROM runners UNION ALL SELECT 'trainer_name', 0, count(*) FILTER (WHERE trainer_name IS NULL) FROM runners""")
def s22_registry_faults(r):
    """Values out of a registered range and nulls against a registered policy."""
    return quality.registry_faults(r.runners, REGISTRY)


@register(SCORES + """, sized AS (SELECT race_date, runner_id, profit, greatest(1, least(500, count(*) OVER () // 3)) AS w FROM bets)
  SELECT runner_id, CASE WHEN count(*) OVER m >= 50 THEN round(avg(profit) OVER m, 6) END AS moving FROM sized WINDOW m AS (ORDER BY race_date, runner_id ROWS BETWEEN w - 1 PRECEDING AND CURRENT ROW)""")
def w08_moving_return(r):
    """The mean profit of the last 500 bets, or a third of all if those are fewer."""
    return scoring.moving_mean(value_bets(r).select("race_date", "runner_id", "profit"), ["race_date", "runner_id"], "profit", "moving").select("runner_id", "moving")


@register()
def m12_retrained_walk_forward(r):
    """For each window a logistic model of the runs before the calibration year, calibrated on that year, measured on the window.

    A window without a winner to learn from or to calibrate by is left out.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = ["official_rating", "weight_lbs", "draw", "field_size", "distance_furlongs"]
    rows = features.with_results(r, "won")
    rows = tables.stored(rows.select("runner_id", "race_id", "race_date", "won", F.col("won").cast("double").alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in names]), "walk-forward")
    parts = []
    for name, start, stop in WINDOWS:  # four windows
        first, last = F.lit(start).cast("date"), F.lit(stop).cast("date")
        day, year_before = F.col("race_date"), F.add_months(first, -12)
        winners = rows.where("won").agg(F.count_if(day < year_before).alias("train"), F.count_if((day >= year_before) & (day < first)).alias("calibrate")).first()
        if not all(winners):
            continue
        vectors = VectorAssembler(inputCols=names, outputCol="x")
        model = LogisticRegression(featuresCol="x", labelCol="y", maxIter=20).fit(vectors.transform(rows.where(day < year_before)))
        scored = model.transform(vectors.transform(rows.where((day >= year_before) & (day < last)))).withColumn("raw", F.element_at(_array("probability"), 2)).select("runner_id", "race_id", "race_date", "won", "raw")
        final = scoring.renormalise(scoring.isotonic(scored.where(day < first), scored.where(day >= first), "raw", "won", "calibrated"), "calibrated", "race_id", "final")
        measured = final.agg(F.count("*").alias("test_rows"), F.count_distinct("race_id").alias("test_races"), scoring.brier("final", "won").alias("brier"))
        parts.append(measured.crossJoin(F.broadcast(scoring.top_pick_rate(final, "final", "race_id", "won", "runner_id").select("top_pick"))).withColumn("test_window", F.lit(name)))  # one row each
    return reduce(DataFrame.unionByName, parts)
