"""Pairs are numbered while narrow; vectors come last."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kinloom.functions import arrays as A
from kinloom.operators import ranking as R
from kinloom.operators.ordered import numbered


def test_pair_vector_rounds_as_expressions_do(spark):
    rng = random.Random(5)
    ties = [0.03125, 0.12345, -0.12345, 0.00005, -0.00004, 1e-9, 123456.00005, 1e17, float("inf"), float("nan"), -0.0, 0.0]
    rows = [(i, [rng.choice(ties) if rng.random() < 0.3 else rng.uniform(-3, 3) for _ in range(8)], [rng.choice([1.0, -1.0, 0.5, rng.random()]) for _ in range(8)]) for i in range(300)]
    rows += [(1000, None, [1.0]), (1001, [1.0, 2.0], [1.0]), (1002, [], []), (1003, [None, 1.0], [2.0, 3.0])]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>").repartition(3)
    z = F.concat(F.zip_with("a", "b", lambda p, q: F.abs(p - q)), F.zip_with("a", "b", lambda p, q: p * q))
    both = df.select("id", A.pair_vector(F.col("a"), F.col("b")).alias("fast"), F.transform(z, lambda v: F.round(v, 4)).alias("slow"))
    for r in both.collect():
        assert repr(r["fast"]) == repr(r["slow"]), r


def test_pairs_are_numbered_while_narrow(spark):
    """Vectors are found by a key of the member, several vectors make rows with numbers of their own, and no shuffle carries z."""
    scores = spark.createDataFrame([(2000, h, w, float(10 * h + w)) for h in range(6) for w in range(10, 14)], "year int, h long, w long, score double")
    truth = scores.where("w = 11").select("year", "h", F.col("w").alias("true_w"), F.col("score").alias("true_score"))
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 4.0]), (1, [0.25, 8.0])], "id long, vec array<float>")
    out = R.scored_pair_table(scores, truth, k=2, vectors=vectors, vector_key=lambda member: member % 3)
    got = out.select("id", "h", "w", "z").collect()
    # Key 2 has no vector; key 1 has two.
    expected = sum({0: 1, 1: 2, 2: 1}[h % 3] * {0: 1, 1: 2, 2: 1}[w % 3] for h in range(6) for w in (11, 12, 13))
    assert sorted(r["id"] for r in got) == list(range(expected))
    assert all((r["z"] is None) == (r["h"] % 3 == 2 or r["w"] % 3 == 2) for r in got)
    assert all(len(r["z"]) == 4 for r in got if r["z"])


def test_numbered_counts_where_rows_lie(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2]), rng.random()) for _ in range(500)]
    got = numbered(spark.createDataFrame(rows, "g int, v double"), ["g"], [F.desc("v")], "rn", slices=7).collect()
    for g in (None, 1, 2):
        mine = sorted(((r["rn"], r["v"]) for r in got if r["g"] == g))
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted((v for _, v in mine), reverse=True)
