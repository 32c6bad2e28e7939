"""Short lists of the auction."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kinloom.operators import assignment as G


def test_lists_of_large_cohorts_are_short(spark):
    """What a round moves are short lists; who uses up a list gets all the offers."""
    rng = random.Random(4)
    df = spark.createDataFrame([(1, i, j, rng.random()) for i in range(40) for j in range(60)], "year int, h int, w int, score double")
    offers = df.select("year", F.col("h").alias("bidder"), F.col("w").alias("item"), "score", F.lit(1.0).alias("base"), F.lit(1e-4).alias("epsilon"), F.lit(1.0).alias("range"), F.lit(40).alias("number"))
    market = G._Market(offers, ["year"], 1024, 10, 0)
    assert market.lists.count() == 40 * G.SHORT
    solved = G.auction(df, block=10)
    proof = solved.certificate.first()
    assert proof["n_matched"] == 40 and proof["bound"] - proof["total"] <= 40 * proof["epsilon"] + 1e-9
