"""The scaled auction against brute force and against its own certificate."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinloom.operators import assignment as G

SCORES = "year int, h int, w int, score double"


def solve(spark, data, **options):
    df = spark.createDataFrame(data, SCORES)
    solution = G.auction(df, **options)
    matches = solution.matches.collect()
    assert len({(r["year"], r["h"]) for r in matches}) == len(matches) == len({(r["year"], r["w"]) for r in matches})
    known = {(y, h, w): s for y, h, w, s in data}
    assert all(known[r["year"], r["h"], r["w"]] == r["score"] for r in matches)
    proof = solution.certificate.collect()
    for r in proof:
        assert -1e-6 <= r["bound"] - r["total"] <= r["n_bidders"] * r["epsilon"] + 1e-6, r
    return matches, {r["year"]: r for r in proof}


def optimum(scores, men, women):
    small, large, flip = (men, women, False) if len(men) <= len(women) else (women, men, True)
    return max(
        sum(scores[(b, a) if flip else (a, b)] for a, b in zip(small, order)) for order in itertools.permutations(large, len(small))
    )


def test_common_order_in_few_jobs(spark):
    """Everybody wants the same objects, the worst case of an auction without scaling."""
    data = [(1, i, j, float(i * j)) for i in range(200) for j in range(200)]
    context = spark.sparkContext
    context.setJobGroup("auction", "auction")
    matches, proof = solve(spark, data)
    jobs = len(context.statusTracker().getJobIdsForGroup("auction"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 100
    assert len(matches) == 200 and proof[1]["n_matched"] == 200
    # The optimum pairs equal places.
    assert sum(r["score"] for r in matches) >= sum(i * i for i in range(200)) - 200 * proof[1]["epsilon"]


@pytest.mark.parametrize("options", [{}, {"width": 4, "block": 3}])
def test_small_cohorts_reach_the_optimum(spark, options):
    """Also where lists hold a part of the candidates and blocks a part of the bidders."""
    rng = random.Random(7)
    data, expected = [], {}
    for year, (m, w) in enumerate([(2, 7), (7, 3), (6, 6), (1, 1), (5, 7)]):
        scores = {(i, j): float(rng.randint(-20, 20)) for i in range(m) for j in range(w)}
        data += [(year, i, j, s) for (i, j), s in scores.items()]
        expected[year] = optimum(scores, range(m), range(w))
    # Whole scores and an epsilon below 1 / n: the result is the optimum itself.
    matches, _ = solve(spark, data, epsilon=0.1, **options)
    totals = {}
    for r in matches:
        totals[r["year"]] = totals.get(r["year"], 0.0) + r["score"]
    assert totals == expected


def test_prices_without_owner_go(spark):
    """More objects than bidders: coarse rounds leave prices, which the other side then bids away."""
    rng = random.Random(1)
    matches, proof = solve(spark, [(1, i, j, float(j) + rng.random()) for i in range(20) for j in range(60)])
    assert proof[1]["n_matched"] == 20
    assert min(r["w"] for r in matches) >= 38


def test_outside_option_and_gaps(spark):
    rng = random.Random(3)
    data = [(1, i, j, rng.random() - 0.7) for i in range(12) for j in range(9) if rng.random() < 0.6]
    matches, _ = solve(spark, data, outside=0.0, epsilon=0.001)
    assert matches and all(r["score"] > 0 for r in matches)
    none = spark.createDataFrame([], SCORES)
    assert G.assign_one_to_one(none).collect() == []
    assert [tuple(r) for r in G.assign_one_to_one(spark.createDataFrame([(1, 5, 6, 0.0)], SCORES)).collect()] == [(1, 5, 6, 0.0)]


def test_text_ids(spark):
    df = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 5.0), ("b", "y", 4.0)], "h string, w string, score double").withColumn("year", F.lit(1))
    assert sorted((r["h"], r["w"]) for r in G.assign_one_to_one(df).collect()) == [("a", "x"), ("b", "y")]


def test_bound_is_above_every_assignment(spark):
    """Whatever the prices, the dual value is no less than the best total."""
    rng = random.Random(9)
    scores = {(i, j): rng.uniform(0, 9) for i in range(5) for j in range(6)}
    offers = spark.createDataFrame([(1, i, j, s, 0.1) for (i, j), s in scores.items()], "year int, bidder int, item int, value double, epsilon double")
    for _ in range(3):
        prices = spark.createDataFrame([(1, j, rng.uniform(0, 5)) for j in range(6)], "year int, item int, price double")
        assert G.dual_bound(offers, prices, ["year"]).first()["bound"] >= optimum(scores, range(5), range(6)) - 1e-9
