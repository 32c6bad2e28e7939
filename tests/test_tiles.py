"""Top candidates are bounded and scored by tiles of blocks (F9, F35)."""

import numpy as np
from pyspark.sql import functions as F

from kinloom.operators import candidates as N

SCHEMA = "year int, id long, vec array<double>"


def side(spark, start, n=300):
    rng = np.random.default_rng(start)
    rows = [(1 + i % 2, start + i, rng.normal(size=4).round(1).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_blocks_stay_whole_in_tiles_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 40)
    blocks = N._near_blocks(side(spark, 0).select(F.col("year").cast("string").alias("_c"), "id", "vec"), 4, 8)
    tiled = N._tiled(blocks)
    assert tiled.count() == 300
    per_block = tiled.groupBy("_c", "b").agg(F.count_distinct("t").alias("tiles"), F.count("*").alias("n")).collect()
    assert all(r["tiles"] == 1 for r in per_block)
    per_tile = tiled.groupBy("_c", "t").agg(F.count("*").alias("n")).collect()
    # Few groups for the tasks, none much larger than a tile.
    assert max(r["n"] for r in per_tile) < 40 + max(r["n"] for r in per_block)
    assert len(per_tile) < len(per_block) / 2


def test_several_tiles_give_what_whole_scoring_gives(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 40)
    left, right = side(spark, 0), side(spark, 1000)
    weights = [0.5] * 4 + [-0.25] * 4 + [-1.0] * 4 + [1.0] * 4
    top, report = N.top_candidates(left, right, weights, 0.5, k=6, block=8)
    whole = N.score_cohorts(left, right, None, weights, 0.5, k=6, block=64)
    assert {(r["year"], r["h"]): r["top"] for r in top.collect()} == {(r["year"], r["h"]): r["top"] for r in whole.collect()}
    assert all(r["n_scored"] <= r["n_block_pairs"] for r in report.collect())
