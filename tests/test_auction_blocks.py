"""Blocks of bidders are large, and bounded by their offers."""

from __future__ import annotations

import inspect
import random

import pytest
from pyspark.sql import functions as F

from kinloom.operators import assignment as G

OFFERS = "year int, bidder int, item int, score double, base double, epsilon double, range double, number long, offered long"


@pytest.mark.parametrize("number, offered, alone", [(5000, 60_000, True), (20_000, 60_000, False), (5000, 5000 * 1000, False)])
def test_blocks(spark, number, offered, alone):
    block = inspect.signature(G.auction).parameters["block"].default
    rows = [(1, b, i, float(b * i), 1.0, 0.1, 9.0, number, offered) for b in range(4) for i in range(4)]
    market = G._Market(spark.createDataFrame(rows, OFFERS), ["year"], 1024, block, 4)
    assert {r["alone"] for r in market.lists.select("alone").collect()} == {alone}


def test_many_offers_per_bidder_make_more_blocks(spark, monkeypatch):
    """The result holds its certificate when the number of offers decides."""
    monkeypatch.setattr(G, "DENSE", 1)
    rng = random.Random(11)
    data = [(1, i, j, rng.random()) for i in range(30) for j in range(40)]
    df = spark.createDataFrame(data, "year int, h int, w int, score double")
    solved = G.auction(df, block=200)
    matches, (proof,) = solved.matches.collect(), solved.certificate.collect()
    assert len(matches) == 30 == len({r["h"] for r in matches}) == len({r["w"] for r in matches})
    assert -1e-6 <= proof["bound"] - proof["total"] <= proof["n_bidders"] * proof["epsilon"] + 1e-6
    assert solved.matches.where(F.col("score").isNull()).isEmpty()
