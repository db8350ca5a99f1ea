"""Registered queries of trained models: listwise rankers, their signals, a stack of them, a search over parameters."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from furlong.operators import ranking, scoring, search
from furlong.operators.tables import stored
from furlong.plans import features
from furlong.plans.racing_queries import ORACLES as _ORACLES
from furlong.plans.racing_queries import QUERIES as _QUERIES
from furlong.plans.racing_queries import _array, register

FEATURES = ["official_rating", "weight_lbs", "draw", "age", "field_size", "distance_furlongs"]
#: Training before, early stopping and calibration between, scoring from.
CALIBRATE, TEST = "1998-01-01", "1999-01-01"
#: The text that a feature's contribution is shown as.
LABELS = {"official_rating": "official rating", "weight_lbs": "weight", "draw": "draw", "age": "age profile", "field_size": "race context", "distance_furlongs": "race distance"}
ROUNDS = 12
FOLDS = 2
#: A choice of parameters with fewer bets counts as -1.
LEAST_BETS, MIN_EDGE = 100, 0.05

_known = set(_QUERIES)


def ranker_rows(r) -> DataFrame:
    """Runners with results: id, race, date, whether it won as 0 or 1, price, and the models' features, written."""
    rows = features.with_results(r, "won", "sp_decimal").withColumn("gain", F.col("won").cast("double"))
    kept = ["runner_id", "race_id", "race_date", "won", "sp_decimal", "gain"]
    return stored(ranking.reindexed(rows, kept, FEATURES), "ranker-rows")


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to train on, to stop and calibrate on, to score."""
    date = F.col("race_date")
    return rows.where(date < CALIBRATE), rows.where((date >= CALIBRATE) & (date < TEST)), rows.where(date >= TEST)


def as_lists(rows: DataFrame, ranker: ranking.Ranker, *carried: str) -> DataFrame:
    return ranking.lists(rows, "race_id", "runner_id", "gain", ranker, carried)


def trained(rows: DataFrame, loss: str) -> ranking.Ranker:
    train, valid, _ = split(rows)
    blank = ranking.Ranker(FEATURES, ranking.learned_edges(train, FEATURES))
    return ranking.train(as_lists(train, blank), blank, ranking.Params(loss=loss, rounds=ROUNDS), as_lists(valid, blank))


def ranked(r, loss: str) -> DataFrame:
    rows = ranker_rows(r)
    scored = ranking.scored(split(rows)[2], trained(rows, loss))
    return scoring.softmax(scored, "margin", "race_id", "prob").select("runner_id", "prob")


@register()
def m05_listwise_ranker(r):
    """Boosted trees on race-level lambdas of NDCG, stopped by NDCG@1 of the year before the test; softmax by race."""
    return ranked(r, "lambda")


@register()
def m06_yeti_ranker(r):
    """As m05, with gradients from randomly perturbed orders."""
    return ranked(r, "yeti")


@register()
def m16_feature_importance(r):
    """How many splits use a feature and what they gain."""
    found = trained(ranker_rows(r), "lambda").importances()
    return r.spark.createDataFrame(found, "feature string, splits long, gain double")


@register()
def f40_m16_shapley_signals(r):
    """The labels of the features that raise a runner's score most, by exact Shapley values; each label once."""
    rows = ranker_rows(r)
    model = trained(rows, "lambda")
    found = ranking.contributions(ranking.scored(split(rows)[2], model), model)
    parts = [(LABELS[c], F.col("contributions")[i]) for i, c in enumerate(FEATURES)]
    return found.select("runner_id", "margin", F.lit(ranking.base(model)).alias("base"), scoring.top_signals(parts).alias("signals"))


@register(f""", joined AS (SELECT u.runner_id, u.official_rating, u.weight_lbs, x.rpr FROM runners u JOIN results x USING (runner_id))
SELECT runner_id, CAST(rpr AS DOUBLE) AS rpr, CAST(NULL AS DOUBLE) AS last_year, CAST(official_rating AS DOUBLE) AS official_rating FROM joined""")
def p11_expected_features(r):
    """The features that a model expects, in its order; one that the table lacks is null, one that it doesn't know goes."""
    rows = r.runners.select("runner_id", "official_rating", "weight_lbs").join(r.results.select("runner_id", "rpr"), "runner_id")
    return ranking.reindexed(rows, ["runner_id"], ["rpr", "last_year", "official_rating"])


# --- stacking ------------------------------------------------------------------------------------------

LOSSES = ("lambda", "yeti", "point")


def fold() -> Column:
    """The fold of a race: all its runners are in one."""
    return (F.col("race_id") % FOLDS).cast("int")


@register(f"""SELECT CAST(f AS INTEGER) AS fold, count(*) FILTER (WHERE race_id % {FOLDS} <> f) AS learned_from, count(*) FILTER (WHERE race_id % {FOLDS} = f) AS scored,
  count(DISTINCT race_id) FILTER (WHERE race_id % {FOLDS} = f) AS races, CAST(0 AS BIGINT) AS races_in_both
FROM (SELECT u.runner_id, u.race_id FROM runners u JOIN races a USING (race_id) JOIN results x USING (runner_id) WHERE a.race_date < DATE '{TEST}'), range({FOLDS}) t(f) GROUP BY f""")
def m07_race_folds(r):
    """For each fold: runners that its models learn from and that they score, and races that are in both."""
    rows = ranker_rows(r).where(F.col("race_date") < TEST)
    parts = []
    for k in range(FOLDS):
        learn, score = rows.where(fold() != k), rows.where(fold() == k)
        both = learn.select("race_id").distinct().join(score.select("race_id").distinct(), "race_id").agg(F.count("*").alias("races_in_both"))
        counts = score.agg(F.count("*").alias("scored"), F.count_distinct("race_id").alias("races"))
        parts.append(learn.agg(F.count("*").alias("learned_from")).crossJoin(counts).crossJoin(both).select(F.lit(k).alias("fold"), "learned_from", "scored", "races", "races_in_both"))  # one row each
    return reduce(DataFrame.unionByName, parts)


def stacked(rows: DataFrame, rounds: int = 6) -> DataFrame:
    """Three models and a logistic regression over their probabilities.

    Before the test each race is scored by models of the folds that it isn't in (``fold`` 0, 1, ...), and
    the regression learns from these. Runners of the test (``fold`` null) are scored by models of all folds.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    learn = rows.where(F.col("race_date") < TEST)
    blank = ranking.Ranker(FEATURES, ranking.learned_edges(learn, FEATURES))
    races = [as_lists(learn.where(fold() == k), blank) for k in range(FOLDS)]
    held = [reduce(DataFrame.unionByName, [x for j, x in enumerate(races) if j != k]) for k in range(FOLDS)] + [reduce(DataFrame.unionByName, races)]
    todo = [(part, loss) for part in range(FOLDS + 1) for loss in LOSSES]
    with ThreadPoolExecutor(4) as pool:  # the trainings' jobs share the executors
        models = dict(zip(todo, pool.map(lambda t: ranking.train(held[t[0]], blank, ranking.Params(loss=t[1], rounds=rounds)), todo), strict=True))
    parts = []
    for part in range(FOLDS + 1):
        here = learn.where(fold() == part) if part < FOLDS else rows.where(F.col("race_date") >= TEST)
        for loss in LOSSES:
            here = scoring.softmax(ranking.scored(here, models[part, loss], "margin"), "margin", "race_id", f"p_{loss}").drop("margin")
        parts.append(here.withColumn("fold", F.lit(part if part < FOLDS else None).cast("int")))
    each = stored(reduce(DataFrame.unionByName, parts), "stack")
    vectors = VectorAssembler(inputCols=[f"p_{loss}" for loss in LOSSES], outputCol="_x").transform(each.withColumn("_y", F.col("gain")))
    meta = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=30).fit(vectors.where("fold IS NOT NULL"))
    done = meta.transform(vectors).withColumn("stacked", F.element_at(_array("probability"), 2))
    return scoring.renormalise(done, "stacked", "race_id", "final")


@register()
def m07_out_of_fold_stack(r):
    """Two rankers and a pointwise model under a logistic regression; the runners of the test."""
    return stacked(ranker_rows(r)).where("fold IS NULL").select("runner_id", *[f"p_{loss}" for loss in LOSSES], "final")


# --- search over parameters ---------------------------------------------------------------------------------

SPACE = {
    "learning_rate": search.Range(0.02, 0.4, log=True),
    "num_leaves": search.Range(3, 8, whole=True),
    "min_child_samples": search.Range(10, 100, whole=True),
    "subsample": search.Range(0.6, 1.0),
    "colsample": search.Range(0.5, 1.0),
    "reg_alpha": search.Range(1e-8, 10.0, log=True),
    "reg_lambda": search.Range(1e-8, 10.0, log=True),
    "min_split_gain": search.Range(0.0, 1.0),
}


def bets_of(model: ranking.Ranker, calibrate: DataFrame, test: DataFrame) -> DataFrame:
    """The test's value bets of a model: calibrated on other races, scaled to 1 in a race, edge over ``MIN_EDGE``."""
    return bets_in(model, as_lists(calibrate, model), as_lists(test, model, "sp_decimal"))


def bets_in(model: ranking.Ranker, calibrate: DataFrame, test: DataFrame) -> DataFrame:
    """``bets_of`` over written races, so that none is dealt anew for each model."""
    steps = scoring.isotonic_steps(ranking.shares(calibrate, model), "share", "gain", "n")
    done = ranking.calibrated_shares(test, model, steps, "sp_decimal").withColumn("won", F.col("gain") > 0)
    return done.withColumn("edge", scoring.edge("p", "sp_decimal")).where(F.col("edge") > MIN_EDGE).withColumn("profit", scoring.profit("won", "sp_decimal"))


def objective(bets: DataFrame) -> dict:
    """Number of bets, their return, and the return again or -1 if they are few."""
    found = bets.agg(F.count("*").alias("bets"), F.coalesce(F.avg("profit"), F.lit(0.0)).alias("roi")).first()
    return {"bets": found["bets"], "roi": found["roi"], "objective": found["roi"] if found["bets"] >= LEAST_BETS else -1.0}


def tuned(rows: DataFrame, trials: int = 20, rounds: int = 3_000, patience: int = 100) -> list[dict]:
    """Trials of a ranker's parameters, by the return of the test's value bets.

    A trial trains as in the original: up to ``rounds`` trees, until ``patience`` of them brought nothing for the year before the test.
    """
    train, calibrate, test = split(rows)
    blank = ranking.Ranker(FEATURES, ranking.learned_edges(train, FEATURES))
    races, valid, held = as_lists(train, blank), as_lists(calibrate, blank), as_lists(test, blank, "sp_decimal")

    def trial(chosen: dict) -> dict:
        model = ranking.train(races, blank, ranking.Params(rounds=rounds, **chosen), valid, patience)
        return objective(bets_in(model, valid, held))

    return search.search(SPACE, trial, trials)


@register()
def m14_parzen_search(r):
    """Twenty trials of a ranker's parameters; ``best`` marks the one of the greatest return."""
    found = tuned(ranker_rows(r))
    names = ", ".join(f"{c} {'long' if room.whole else 'double'}" for c, room in SPACE.items())
    out = r.spark.createDataFrame([tuple(t.values()) for t in found], f"trial long, {names}, bets long, roi double, objective double")
    return out.withColumn("best", F.row_number().over(Window.orderBy(F.desc("objective"), "trial")) == 1)  # a row a trial


QUERIES = {k: q for k, q in _QUERIES.items() if k not in _known}
ORACLES = {k: q for k, q in _ORACLES.items() if k not in _known}
