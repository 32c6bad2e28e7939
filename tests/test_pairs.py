"""Candidates, ranking, assignment and metrics."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.functions import arrays as A
from kinloom.operators import assignment as G
from kinloom.operators import candidates as N
from kinloom.operators import metrics as M
from kinloom.operators import ranking as R

SCORES = "year int, h int, w int, score double"


def table(spark, data, schema=SCORES):
    return spark.createDataFrame(data, schema)


# -- candidates -----------------------------------------------------------------------


@pytest.mark.parametrize("pool,k,expected", [([5], 4, 0), ([5, 6, 7], 4, 4), (list(range(10)), 4, 4)])
def test_negatives_for_small_and_large_pools(spark, pool, k, expected):
    positives = table(spark, [(1, 1, pool[0])], "year int, h int, w int")
    members = table(spark, [(1, w) for w in pool], "year int, w int")
    drawn = [r["neg_w"] for r in N.sample_negatives(positives, members, k, seed=3).collect()]
    assert len(drawn) == expected and pool[0] not in drawn and set(drawn) <= set(pool)
    if len(pool) > k:
        assert len(set(drawn)) == k


def test_negatives_are_spread_evenly(spark):
    positives = table(spark, [(1, h, h % 50) for h in range(2000)], "year int, h int, w int")
    members = table(spark, [(1, w) for w in range(50)], "year int, w int")
    drawn = N.sample_negatives(positives, members, 4, seed=1)
    assert drawn.where("neg_w = true_w").isEmpty()
    per_man = drawn.groupBy("h").agg(F.count_distinct("neg_w").alias("n"))
    assert [tuple(r) for r in per_man.select("n").distinct().collect()] == [(4,)]
    counts = [r["count"] for r in drawn.groupBy("neg_w").count().collect()]
    assert len(counts) == 50 and min(counts) > 110 and max(counts) < 210  # 160 expected


def test_one_truth_per_man(spark, rows):
    pairs = table(spark, [(1, 1, 5), (1, 1, 7), (1, 2, 6)], "year int, h int, w int")
    assert rows(N.one_truth(pairs)) == [(1, 1, 7), (1, 2, 6)]


def test_cohort_scoring_equals_brute_force_over_several_blocks(spark):
    rng = np.random.default_rng(0)
    left = [(y, i, rng.normal(size=5).tolist()) for y in (1, 2) for i in range(13)]
    right = [(y, i, rng.normal(size=5).tolist()) for y in (1, 2) for i in range(100, 117)]
    weights = rng.normal(size=20).tolist()
    schema = "year int, id int, vec array<double>"
    truth = table(spark, [(y, i, 100 + i) for y in (1, 2) for i in range(13)], "year int, h int, true_w int")
    out = N.score_cohorts(table(spark, left, schema), table(spark, right, schema), truth, weights, 0.5, k=4, block=4)
    got = {(r["year"], r["h"]): r for r in out.collect()}
    assert len(got) == 26
    for y, h, hv in left:
        a = np.array(hv)
        scored = []
        for y2, w, wv in right:
            if y2 == y:
                b = np.array(wv)
                scored.append((float(np.concatenate([a, b, abs(a - b), a * b]) @ weights + 0.5), w))
        best = sorted(scored, key=lambda s: (-s[0], s[1]))
        r = got[(y, h)]
        assert [t["w"] for t in r["top"]] == [w for _, w in best[:4]]
        assert np.allclose([t["score"] for t in r["top"]], [s for s, _ in best[:4]])
        assert r["rank_of_truth"] == [w for _, w in best].index(100 + h) + 1
        assert r["n_pool"] == 17


def test_box_bounds_hold_and_are_reached():
    rng = np.random.default_rng(5)
    for _ in range(200):
        w = rng.normal(size=4) * rng.integers(0, 2, 4)
        x, y = np.sort(rng.normal(size=2)), np.sort(rng.normal(size=2))
        gx, gy = np.meshgrid(np.linspace(*x, 201), np.linspace(*y, 201))
        t = np.linspace(max(x[0], y[0]), min(x[1], y[1]), 4001) if max(x[0], y[0]) <= min(x[1], y[1]) else x[:1] * np.nan
        gx, gy = np.append(gx, t), np.append(gy, t)
        top = np.nanmax(w[0] * gx + w[1] * gy + w[2] * abs(gx - gy) + w[3] * gx * gy)
        bound = N.box_bounds((x[None, :1], x[None, 1:]), (y[None, :1], y[None, 1:]), w)[0]
        assert top <= bound <= top + 1e-4


def test_top_candidates_equal_whole_scoring_and_skip_blocks(spark):
    """Clustered vectors, ties by repeated vectors, a cohort with few members, and a blocking key."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 6)) * 10

    def side(start):
        rows = [(1, start + i, (centres[i % 12] + rng.normal(size=6) * 0.1).round(1).tolist(), i % 2) for i in range(480)]
        return rows + [(2, start + 1000 + i, rng.normal(size=6).tolist(), None) for i in range(3)]

    schema = "year int, id long, vec array<double>, key int"
    left, right = table(spark, side(0), schema), table(spark, side(5000) + [(3, 1, [0.0] * 6, 1)], schema)
    weights = [0.0] * 12 + [-1.0] * 6 + [0.01] * 6
    top, report = N.top_candidates(left, right, weights, 0.5, k=4, block=16)
    whole = N.score_cohorts(left, right, None, weights, 0.5, k=4, block=200)
    assert {(r["year"], r["h"]): r["top"] for r in top.collect()} == {(r["year"], r["h"]): r["top"] for r in whole.collect()}
    counts = {r["year"]: (r["n_block_pairs"], r["n_scored"]) for r in report.collect()}
    assert counts.keys() == {1, 2} and counts[1][1] < 0.3 * counts[1][0]

    keyed, _ = N.top_candidates(left, right, weights, 0.5, k=4, block=16, keys=["key"])
    got = {(r["year"], r["key"], r["h"]): r["top"] for r in keyed.collect()}
    for key in (0, 1, None):
        same = F.col("key").eqNullSafe(F.lit(key))
        part = N.score_cohorts(left.where(same), right.where(same), None, weights, 0.5, k=4)
        for r in part.collect():
            assert got.pop((r["year"], key, r["h"])) == r["top"]
    assert not got
    empty, none = N.top_candidates(left.limit(0), right, weights, k=4)
    assert empty.collect() == [] and none.collect() == []


def test_pair_features_and_linear_score(spark):
    df = spark.range(1).select(
        A.pair_features(F.array(F.lit(1.0), F.lit(-2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("f")
    )
    row = df.select("f", A.linear_score(F.col("f"), [1.0] * 8, 0.5)).first()
    assert row[0] == [1.0, -2.0, 3.0, 4.0, 2.0, 6.0, 3.0, -8.0] and row[1] == 9.5


# -- ranking --------------------------------------------------------------------------


def test_rank_of_truth_counts_unscored_members(spark, rows):
    scores = table(spark, [(1, 1, 10, 5.0), (1, 1, 11, -1.0), (1, 2, 10, 2.0)])
    truth = table(spark, [(1, 1, 11), (1, 2, 12), (1, 3, 99)], "year int, h int, true_w int")
    pool = table(spark, [(1, w) for w in (10, 11, 12, 13)], "year int, w int")
    got = R.rank_of_truth(scores, truth, pool, 0.0, exact_ties=True)
    # h=1: 10 and the two unscored members stand before -1. h=2: truth 12 is unscored (0); 10 and, by id, 11 before it.
    assert rows(got, "h", "rank_of_truth", "n_pool") == [(1, 4, 4), (2, 3, 4)]


def test_gap_of_positives_and_negatives(spark, rows):
    scores = table(spark, [(1, 1, 10, 5.0), (1, 1, 11, 3.0), (1, 1, 12, 1.0), (1, 2, 10, 4.0)])
    truth = table(spark, [(1, 1, 11), (1, 2, 10)], "year int, h int, true_w int")
    got = rows(R.score_gap(scores, truth), "h", "w", "label", "score_gap")
    assert got == [(1, 10, 0, 2.0), (1, 11, 1, -2.0), (1, 12, 0, -2.0), (2, 10, 1, 4.0)]


# -- assignment -----------------------------------------------------------------------


def best_total(scores: dict, men, women) -> float:
    best = 0.0
    small, large = (men, women) if len(men) <= len(women) else (women, men)
    flip = small is women
    for order in itertools.permutations(large, len(small)):
        total = sum(scores.get((b, a) if flip else (a, b), 0.0) for a, b in zip(small, order))
        best = max(best, total)
    return best


def test_auction_reaches_the_optimum_on_small_cohorts(spark):
    rng = random.Random(5)
    data, expected = [], {}
    for year, (m, w) in enumerate([(2, 3), (3, 2), (5, 5), (6, 4), (4, 6), (6, 6), (1, 1)]):
        scores = {(i, j): round(rng.uniform(0, 10), 2) for i in range(m) for j in range(w)}
        data += [(year, i, j, s) for (i, j), s in scores.items()]
        expected[year] = best_total(scores, range(m), range(w))
    table_ = table(spark, data)
    got = G.assign_one_to_one(table_, "auction", epsilon=0.0005)
    assert got.groupBy("year", "h").count().where("count > 1").isEmpty()
    assert got.groupBy("year", "w").count().where("count > 1").isEmpty()
    totals = {r["year"]: r["t"] for r in got.groupBy("year").agg(F.sum("score").alias("t")).collect()}
    for year, total in expected.items():
        assert totals[year] >= total - 0.0005 * 6 - 1e-9
    forced = G.assign_auction(table_, epsilon=0.01, outside=None).groupBy("year").count()
    assert {r["year"]: r["count"] for r in forced.collect()} == {0: 2, 1: 2, 2: 5, 3: 4, 4: 4, 5: 6, 6: 1}


def test_greedy_takes_the_best_pair_first(spark, rows):
    scores = table(spark, [(1, 1, 1, 9.0), (1, 1, 2, 8.0), (1, 2, 1, 8.5), (1, 2, 2, 1.0), (2, 5, 5, 1.0)])
    got = G.assign_one_to_one(scores, "greedy")
    assert rows(got, "year", "h", "w") == [(1, 1, 1), (1, 2, 2), (2, 5, 5)]


# -- metrics --------------------------------------------------------------------------


def test_areas_with_ties(spark):
    tied = table(spark, [(1, 0.5), (0, 0.5), (0, 0.5), (0, 0.5)], "label int, score double")
    assert M.roc_auc(tied).first()[0] == 0.5
    assert M.average_precision(tied).first()[0] == 0.25
    one = table(spark, [(1, 0.5)], "label int, score double")
    assert M.roc_auc(one).first()[0] is None


def test_areas_equal_brute_force(spark):
    rng = random.Random(2)
    data = [(int(rng.random() < 0.3), round(rng.random(), 1)) for _ in range(200)]
    out = M.pair_metrics(table(spark, data, "label int, score double")).first()
    pos, neg = [s for l, s in data if l], [s for l, s in data if not l]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for t in sorted({s for _, s in data}, reverse=True):
        hits, all_ = sum(p >= t for p in pos), sum(s >= t for _, s in data)
        ap += (hits - seen) / len(pos) * hits / all_
        seen = hits
    assert abs(out["roc_auc"] - auc) < 1e-12 and abs(out["pr_auc"] - ap) < 1e-12


def test_recall_is_pooled_over_matched_rows(spark, rows):
    assignment = table(spark, [(1, 1, 1), (1, 2, 2), (2, 1, 9)], "year int, h int, w int")
    truth = table(spark, [(1, 1, 1), (2, 1, 1)], "year int, h int, true_w int")
    got = {r["level"]: r["recall"] for r in M.assignment_recall(assignment, truth).where("level <> 'year'").collect()}
    assert got == {"pooled": 1 / 3, "mean": 0.25}


def test_outcomes_and_flat_gap_range(spark, rows):
    schema = "year int, id int, husband_id string, label int, hungarian_correct boolean, rank_of_true_wife int, score_gap double"
    pairs = table(
        spark,
        [
            (1, 0, "a", 1, True, 1, 2.0), (1, 1, "b", 1, False, 3, 2.0), (1, 2, "c", 1, False, 1, 2.0),
            (1, 3, "d", 0, None, None, 2.0), (1, 4, "a", 0, None, None, None),
        ],
        schema,
    )
    assert rows(M.classify_outcome(pairs), "husband_id", "outcome") == [
        ("a", "correct"), ("b", "wrong-wife"), ("c", "collision"), ("d", "negative-only")
    ]
    assert {r["position"] for r in M.gap_distribution(pairs).collect()} == {0.5}
    m = M.cohort_metrics(pairs).first()
    assert (m["n_pairs"], m["n_positives"], m["top1_recall"]) == (5, 3, 2 / 3)
    assert abs(m["mrr"] - (1 + 1 / 3 + 1) / 3) < 1e-12
