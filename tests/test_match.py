"""The index of like names and the cascade, against all pairs."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from furlong.operators import match
from furlong.plans import features
from furlong.sources.analogue import racing


def edited(name, rng):
    for _ in range(rng.randint(0, 3)):
        i, kind = rng.randrange(len(name) + 1), rng.random()
        name = name[:i] + rng.choice("aetz") + name[i:] if kind < 0.4 else name[:i] + name[i + 1 :] if kind < 0.7 and len(name) > 1 else name[: max(0, i - 2)] + name[max(0, i - 2) : i][::-1] + name[i:]
    return name


@pytest.mark.parametrize("likeness", [0.85, 0.93, 0.98])
def test_index_of_names_loses_no_like_pair(spark, likeness):
    rng = random.Random(1)
    base = ["".join(rng.choice("aetoinshrdlu czq'é9") for _ in range(rng.randint(1, 12))).strip() or "x" for _ in range(60)]
    left = [(i, i % 2, rng.choice(base)) for i in range(300)] + [(800, 1, None), (801, 1, "")]
    right = [(i, i % 2, edited(rng.choice(base), rng)) for i in range(300)] + [(900, 1, ""), (901, 1, None)]
    got = match.like_pairs(spark.createDataFrame(left, "a int, g int, name string"), spark.createDataFrame(right, "b int, g int, name string"), ["g"], "a", "b", likeness).collect()
    want = {(a, b) for a, g, x in left for b, h, y in right if x and y and g == h and match.jaro_winkler_of(x, y) >= likeness}
    assert want <= {(r["a"], r["b"]) for r in got} and len(got) == len({(r["a"], r["b"]) for r in got})
    assert len(want) > 100 and len(got) < 45_000 / 15  # of 45,000 pairs


def test_cascade_takes_the_row_that_knows_most(spark):
    day = dt.date(2024, 5, 2)
    found = [(1, 0, "red rum", None, "j"), (2, 0, "red rum", "t", "j"), (3, 0, "red rum", "t", "j"), (4, 1, "far cry", "", None), (5, 1, "far cry", None, "j"), (6, -1, "far cry", "t", "j"), (7, 0, "bold movee", "t", "j"), (8, 0, "bold mover", None, None), (9, 0, "bold moverr", "t", "j")]
    found = [(i, day + dt.timedelta(d), "york", n, ["a"], t, j) for i, d, n, t, j in found]
    missing = [(n, day, "york", n, ["b"]) for n in ("red rum", "far cry", "bold move", "zzz", "")]
    missing += [("twice", day, "york", "red rum", ["b"]), ("noday", None, "york", "red rum", ["b"])]
    schema = "day date, course string, name string, card array<string>"
    got = match.cascade(spark.createDataFrame(missing, f"runner_id string, {schema}"), spark.createDataFrame(found, f"row_id int, {schema}, trainer string, jockey string")).collect()
    assert {r["runner_id"]: (r["row_id"], r["match_type"], r["confidence"]) for r in got if r["match_type"] != "fuzzy"} == {"red rum": (2, "exact", 1.0), "twice": (2, "exact", 1.0), "far cry": (5, "day_off", 0.98)}
    # Of like names the likest, then the least row: what is known of a row doesn't count.
    like = {r["runner_id"]: r for r in got if r["match_type"] == "fuzzy"}
    assert set(like) == {"bold move"} and like["bold move"]["row_id"] == 7 and like["bold move"]["score"] == pytest.approx(match.jaro_winkler_of("bold move", "bold movee"))


def test_like_names_of_cards_equal_all_pairs(spark):
    """Garbled names of all runners, by day and course; prints how many pairs are compared."""
    rows = features.runners_with_races(racing(spark, "/root/testdata/sf0.01")).select("runner_id", F.col("race_date").alias("day"), F.col("course_name").alias("course"), F.lower("horse_name").alias("name"))
    garbled = rows.withColumn("name", F.concat(F.substring("name", 1, 4), F.lit("x"), F.expr("substring(name, 5)")))
    on, right = ["day", "course"], rows.withColumnRenamed("runner_id", "row_id").withColumnRenamed("name", "f_name")
    every = garbled.join(right, on)
    pairs = match.like_pairs(garbled, rows.withColumnRenamed("runner_id", "row_id"), on, "runner_id", "row_id", 0.93)
    like = match.jaro_winkler("name", "f_name") >= 0.93
    want, got = ({(r["runner_id"], r["row_id"]) for r in df.where(like).select("runner_id", "row_id").collect()} for df in (every, pairs))
    compared, all_pairs = pairs.count(), every.count()
    print(f"{compared} of {all_pairs} pairs compared")
    assert got == want and len(want) > 1_000 and compared < all_pairs
