"""Rankers, Shapley values, stacking and the search over parameters, against brute force."""

from __future__ import annotations

import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.operators import ranking, scoring, search
from furlong.plans import model_queries
from furlong.plans.racing_queries import QUERIES as RACING
from furlong.sources.analogue import racing

DATA = "/root/testdata/sf0.001"


def one_race(scores, gains, top=30):
    """Lambda gradients of one race, pair by pair."""
    n = len(scores)
    order = sorted(range(n), key=lambda i: (-scores[i], i))
    place = {i: k for k, i in enumerate(order)}
    worth = [2.0**y - 1 for y in gains]
    best = sum(w / math.log2(2 + k) for k, w in enumerate(sorted(worth, reverse=True)))
    g, h, total = [0.0] * n, [0.0] * n, 0.0
    for i, j in itertools.permutations(range(n), 2):
        if worth[i] <= worth[j] or min(place[i], place[j]) >= top:
            continue
        change = (worth[i] - worth[j]) * abs(1 / math.log2(2 + place[i]) - 1 / math.log2(2 + place[j])) / best
        wrong = 1 / (1 + math.exp(scores[i] - scores[j]))
        g[i] -= wrong * change
        g[j] += wrong * change
        h[i] += wrong * (1 - wrong) * change
        h[j] += wrong * (1 - wrong) * change
        total += 2 * wrong * change
    scale = math.log2(1 + total) / total if total else 0
    return np.array(g) * scale, np.array(h) * scale


@pytest.mark.parametrize("top", [30, 2])
def test_lambda_gradients_pair_by_pair(top):
    draw = np.random.default_rng(3)
    sizes = [1, 2, 5, 9, 9]
    scores, gains, there = np.zeros((5, 9)), np.zeros((5, 9)), np.zeros((5, 9), bool)
    for i, n in enumerate(sizes):
        scores[i, :n], gains[i, :n], there[i, :n] = draw.normal(size=n).round(1), draw.integers(0, 4, n), True
    gains[4] = 0
    g, h = ranking.lambda_gradients(scores, gains, there, top)
    for i, n in enumerate(sizes):
        want = one_race(scores[i, :n], gains[i, :n], top)
        assert np.allclose(g[i, :n], want[0]) and np.allclose(h[i, :n], want[1])
        assert not g[i, n:].any() and not h[i, n:].any()


def test_yeti_gradients_order_by_order():
    draw = np.random.default_rng(4)
    scores, gains, there = draw.normal(size=(3, 6)), draw.integers(0, 3, (3, 6)).astype(float), np.ones((3, 6), bool)
    there[1, 4:] = False
    keys = draw.integers(-(2**62), 2**62, (3, 6))
    g, h = ranking.yeti_gradients(scores, gains, there, keys, 7, 5, 0.8)
    for i in range(3):
        want_g, want_h, n = np.zeros(6), np.zeros(6), int(there[i].sum())
        for p in range(5):
            noisy = scores[i] - np.log(-np.log(ranking.uniform(keys, 7, p)[i]))
            order = sorted(range(n), key=lambda k: -noisy[k])
            for k, (a, b) in enumerate(itertools.pairwise(order)):
                if gains[i, a] < gains[i, b]:
                    a, b = b, a
                weight = (gains[i, a] - gains[i, b]) * 0.8**k / 5
                wrong = 1 / (1 + math.exp(scores[i, a] - scores[i, b]))
                want_g[a], want_g[b] = want_g[a] - weight * wrong, want_g[b] + weight * wrong
                want_h[[a, b]] += weight * wrong * (1 - wrong)
        assert np.allclose(g[i], want_g) and np.allclose(h[i], want_h)
    numbers = ranking.uniform(np.arange(100_000), 1, 2)
    assert abs(numbers.mean() - 0.5) < 0.005 and 0 < numbers.min() and numbers.max() < 1


def some_tree(draw, depth=3, features=4):
    tree = ranking.Tree.empty(depth)
    tree.cover[0] = 1000
    for node in range(2**depth - 1):
        if node == 0 or (tree.cover[node] > 0 and draw.random() < 0.85):
            tree.feature[node], tree.cut[node] = draw.integers(features), draw.integers(1, 5)
            tree.cover[2 * node + 1] = tree.cover[node] * draw.uniform(0.1, 0.9)
            tree.cover[2 * node + 2] = tree.cover[node] - tree.cover[2 * node + 1]
    tree.value[:] = draw.normal(size=len(tree.value))
    return tree


def test_shapley_values_over_all_subsets():
    draw = np.random.default_rng(5)

    def output(tree, row, known, node=0):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = 2 * node + 1, 2 * node + 2
        if f in known:
            return output(tree, row, known, right if row[f] > tree.cut[node] else left)
        return sum(tree.cover[c] * output(tree, row, known, c) for c in (left, right)) / tree.cover[node]

    for _ in range(12):
        tree, bins = some_tree(draw), draw.integers(0, 6, (5, 4))
        got = ranking.shapley(tree, bins, 4)
        for row, shares in zip(bins, got, strict=True):
            for f in range(4):
                others, want = [x for x in range(4) if x != f], 0.0
                for k in range(4):
                    for known in itertools.combinations(others, k):
                        weight = math.factorial(k) * math.factorial(3 - k) / math.factorial(4)
                        want += weight * (output(tree, row, {*known, f}) - output(tree, row, {*known}))
                assert shares[f] == pytest.approx(want)
        assert np.allclose(got.sum(1), tree.value[tree.leaves(bins)] - ranking.expected(tree))


@pytest.fixture(scope="module")
def rows(spark):
    return model_queries.ranker_rows(racing(spark, DATA))


def test_contributions_add_up_and_trees_do_not_depend_on_partitions(spark, rows):
    train, valid, test = model_queries.split(rows)
    blank = ranking.Ranker(model_queries.FEATURES, ranking.learned_edges(train, model_queries.FEATURES))
    races = model_queries.as_lists(train, blank)
    params = ranking.Params(rounds=4, subsample=0.8, colsample=0.7, loss="yeti")
    one, other = ranking.train(races, blank, params), ranking.train(races.repartition(7, "key"), blank, params)
    for a, b in zip(one.trees, other.trees, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value)
    odd = test.withColumn("draw", F.when(F.col("draw") > 3, F.col("draw")))
    got = ranking.contributions(ranking.scored(odd, one), one).toPandas()
    assert np.allclose(got["contributions"].map(sum) + ranking.base(one), got["margin"]) and got["margin"].nunique() > 5
    assert ranking.scored(test.where("false"), one).count() == 0
    best = ranking.train(races, blank, ranking.Params(rounds=6), model_queries.as_lists(valid, blank), patience=2)
    steps = ranking.ndcg_by_rounds(model_queries.as_lists(valid, blank), best)
    assert 1 <= len(best.trees) <= 6 and np.argmax(np.round(steps, 12)) == len(steps) - 1


def test_ndcg_by_rounds_equals_the_metric(spark, rows):
    train, valid, _ = model_queries.split(rows)
    model = model_queries.trained(rows, "lambda")
    scored = ranking.scored(valid, model)
    ranks = scored.withColumn("margin", F.round("margin", 12))
    want = scoring.ndcg(ranks, "margin", "race_id", "gain", "runner_id", 3).first()[0]
    assert ranking.ndcg_by_rounds(model_queries.as_lists(valid, model), model, 3)[-1] == pytest.approx(want, abs=1e-6)


def test_a_race_of_too_many_runners_is_refused(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MOST_RUNNERS", 3)
    df = spark.createDataFrame([(1, i, 0.0, 1.0) for i in range(4)], "race long, id long, gain double, x double")
    with pytest.raises(Exception, match="a race of over 3 runners"):
        ranking.lists(df, "race", "id", "gain", ranking.Ranker(["x"], [np.array([1.0])]))


def test_listwise_beats_the_pointwise_stand_in(spark):
    """NDCG@3 of the winner, on the 59,000 races of the test years; the stand-in learns from one year more."""
    folder = "/root/testdata/sf0.1"
    won = racing(spark, folder).results.select("runner_id", F.col("won").cast("double").alias("gain"))
    race = racing(spark, folder).runners.select("runner_id", "race_id")

    def of(query):
        found = query(spark, folder).join(won, "runner_id").join(race, "runner_id").withColumn("p", F.round("prob", 9))
        return scoring.ndcg(found, "p", "race_id", "gain", "runner_id", 3).first()[0]

    assert of(model_queries.QUERIES["m05_listwise_ranker"]) > of(RACING["m05_ranker_stand_in"])


def test_shapley_signals_are_the_largest_contributions(spark, rows):
    model = model_queries.trained(rows, "lambda")
    found = ranking.contributions(ranking.scored(model_queries.split(rows)[2], model), model).toPandas().set_index("runner_id")
    got = {r["runner_id"]: r["signals"] for r in model_queries.QUERIES["f40_m16_shapley_signals"](spark, DATA).collect()}
    assert set(got) == set(found.index)
    for runner, shares in found["contributions"].items():
        order = sorted((i for i, v in enumerate(shares) if v > 0), key=lambda i: -shares[i])
        labels = got[runner].split(", ") if got[runner] else []
        assert len(labels) == min(3, len(order))
        values = {model_queries.LABELS[c]: v for c, v in zip(model_queries.FEATURES, shares, strict=True)}
        assert [values[x] for x in labels] == [shares[i] for i in order[:3]]


def test_stack_scales_to_one_in_each_race(spark, rows):
    got = model_queries.stacked(rows, rounds=2).toPandas()
    assert len(got) == rows.count() and (got["fold"].isna() == (got["race_date"].astype(str) >= model_queries.TEST)).all()
    assert np.allclose(got.groupby("race_id")["final"].sum(), 1)
    assert ((got["race_id"] % 2 == got["fold"]) | got["fold"].isna()).all()


def test_parzen_search_is_repeatable_and_learns():
    space = {"a": search.Range(1e-4, 1.0, log=True), "b": search.Range(0, 10, whole=True)}

    def objective(p):
        return {"objective": -(math.log10(p["a"]) + 2) ** 2 - 0.1 * (p["b"] - 7) ** 2}

    found = search.search(space, objective, trials=60, seed=1)
    assert found == search.search(space, objective, trials=60, seed=1)
    assert [t["trial"] for t in found] == list(range(60))
    best = max(found, key=lambda t: t["objective"])
    assert best["objective"] > -0.15 and abs(best["b"] - 7) <= 1
    assert np.mean([t["objective"] for t in found[30:]]) > np.mean([t["objective"] for t in found[:8]])
    grid = np.linspace(0, 1, 4001)
    for points in ([], [0.0], [0.2, 0.21, 0.9]):
        assert search.density(grid, np.array(points)).mean() == pytest.approx(1, abs=0.01)
    for room in (*space.values(), search.Range(2.0, 5.0)):
        assert room.low <= room.value(0.0) <= room.value(1.0) <= room.high and room.value(room.inside(3 if room.high > 3 else 0.3)) == pytest.approx(3 if room.high > 3 else 0.3)


def test_objective_of_a_trial_by_sql(spark, rows):
    """Bets, return and the penalty for few bets, recomputed by SQL from the trial's scores."""
    train, calibrate, test = model_queries.split(rows)
    model = model_queries.trained(rows, "lambda")
    bets = model_queries.bets_of(model, calibrate, test)
    probs = bets.select("p", "won", "sp_decimal").toPandas()
    db = duckdb.connect()
    db.register("probs", probs)
    want = db.execute("SELECT count(*) AS bets, coalesce(avg(CASE WHEN won THEN sp_decimal - 1 ELSE -1 END), 0) AS roi FROM probs WHERE sp_decimal > 1 AND p - 1 / sp_decimal > 0.05").fetchone()
    got = model_queries.objective(bets)
    assert (got["bets"], round(got["roi"], 9)) == (want[0], round(want[1], 9)) and want[0] == len(probs)
    assert got["objective"] == (got["roi"] if got["bets"] >= 100 else -1.0)
    assert model_queries.objective(bets.limit(99))["objective"] == -1.0
    assert model_queries.objective(bets.where("false")) == {"bets": 0, "roi": 0.0, "objective": -1.0}
