"""Hexagon layout, surfaces, rule scoring, directives."""

from __future__ import annotations

import math
import random

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.operators import embedding as Z
from kinloom.operators import explore as Q
from kinloom.operators import hexgrid as H
from kinloom.operators import rules as A
from kinloom.operators import surface as U


def points(spark, n, clusters, seed=0):
    rng = random.Random(seed)
    data = [(i, rng.random(), rng.random(), rng.choice(clusters)) for i in range(n)]
    return spark.createDataFrame(data, "id int, x double, y double, cluster int")


def test_nearest_cell_is_the_assigned_cell(spark):
    pts = points(spark, 300, [0])
    cells = [(r["q"], r["r"], r["cx"], r["cy"]) for r in H.hex_grid(spark).collect()]
    for p in H.hex_assign(pts).collect():
        best = min(cells, key=lambda c: (p["x"] - c[2]) ** 2 + (p["y"] - c[3]) ** 2)
        assert (p["q"], p["r"]) == best[:2]


@pytest.mark.parametrize("n,clusters", [(400, [0, 1, 2]), (900, [0] * 8 + [1]), (6000, [0, 0, 1, 2])])
def test_packing_places_every_point_within_capacity(spark, n, clusters):
    # 6000 points need 500 cells, more than the unit square has
    packed = H.hex_pack(points(spark, n, clusters), capacity=12)
    cells = packed.groupBy("q", "r").agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("k"))
    assert packed.count() == n and packed.select("id").distinct().count() == n
    assert cells.where("n > 12 or k > 1").isEmpty()


@pytest.mark.parametrize("n,clusters", [(700, [0, 0, 0, 1, 1, 2, 3]), (260, [0, 1, 2, 3, 4, 5])])
def test_contested_cells_go_to_the_larger_cluster(spark, n, clusters):
    """Large to small, each cluster takes the nearest cells left: what the claims must end in."""
    pts = points(spark, n, clusters, seed=4)
    cells = {(r["q"], r["r"]): (r["cx"], r["cy"]) for r in H.hex_grid(spark, 0.04, 0.3).collect()}
    xy = {}
    for p in pts.collect():
        xy.setdefault(p["cluster"], []).append((p["x"], p["y"], p["id"]))
    free, want = set(cells), {}
    for c in sorted(xy, key=lambda c: (-len(xy[c]), c)):
        mx, my = (sum(p[i] for p in xy[c]) / len(xy[c]) for i in (0, 1))
        near = sorted(free, key=lambda z: ((cells[z][0] - mx) ** 2 + (cells[z][1] - my) ** 2, z))
        members = sorted(xy[c], key=lambda p: ((p[0] - mx) ** 2 + (p[1] - my) ** 2, p[2]))
        for i, p in enumerate(members):
            want[p[2]] = near[i // 12]
        free -= set(near[: -(-len(members) // 12)])
    assert {r["id"]: (r["q"], r["r"]) for r in H.hex_pack(pts, capacity=12).collect()} == want
    assert H.hex_pack(pts.limit(0)).count() == 0


def test_neighbours_are_symmetric(spark):
    pairs = {tuple(r) for r in H.cell_neighbors(H.cell_ids(H.hex_grid(spark))).collect()}
    assert pairs == {(b, a) for a, b in pairs}


def test_surface_far_from_cells_is_zero_and_exact_on_a_cell(spark):
    cells = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 2), (1, 1.0, 1.0, 0.5, 1)], "cell_id int, cx double, cy double, height double, lead int")
    out = {(r["gx"], r["gy"]): r for r in U.idw_raster(cells, size=(41, 31), pad_min=0.0, pad_share=0.0).collect()}
    assert abs(out[0, 0]["height"] - 1.0) < 1e-4 and out[0, 0]["lead"] == 2
    assert out[20, 15]["height"] == 0.0 and len(out) == 41 * 31


def test_raster_equals_brute_force(spark):
    """Crowded and lonely cells: the nearest ones, wherever they lie, in the order of distance and id."""
    rng = np.random.default_rng(8)
    xy = np.concatenate([rng.uniform(0, 0.2, (150, 2)), rng.uniform(0, 1, (12, 2))])
    height, lead = rng.uniform(0, 1, len(xy)), rng.integers(0, len(U.fixed.CHANNELS), len(xy))
    data = [(i, *map(float, p), float(h), int(k)) for i, (p, h, k) in enumerate(zip(xy, height, lead))]
    cells = spark.createDataFrame(data, "cell_id int, cx double, cy double, height double, lead int")
    out = {(r["gx"], r["gy"]): r for r in U.idw_raster(cells, size=(31, 21), pad_min=0.0).collect()}
    low, high = xy.min(axis=0), xy.max(axis=0)
    pad = (high - low) * 0.04
    low, high = low - pad, high + pad
    grid = (xy - low) / (high - low) * np.array([30, 20])
    step = ((high - low) / np.array([30, 20])).mean()
    cutoff = max(2.0, 3 * U.fixed.HEX_RADIUS / step)
    for (gx, gy), row in out.items():
        d2 = ((grid - np.array([gx, gy])) ** 2).sum(axis=1)
        near = np.lexsort((np.arange(len(d2)), d2))[:12]
        if d2[near[0]] > cutoff**2:
            assert row["height"] == 0.0 and row["lead"] == 0
            continue
        weights = 1 / (d2[near] + U.fixed.IDW_EPS)
        votes = [weights[lead[near] == c].sum() for c in range(len(U.fixed.CHANNELS))]
        assert abs(row["height"] - (weights * height[near]).sum() / weights.sum()) < 1e-9
        assert row["lead"] == int(np.argmax(votes))
    assert U.idw_raster(cells.limit(0), size=(5, 4)).agg(F.sum("height")).first()[0] == 0.0


def test_farthest_landmarks_are_within_twice_the_best_radius(spark):
    rng = np.random.default_rng(3)
    points_ = np.concatenate([rng.normal(size=(12, 2)), rng.normal(size=(4, 2)) + 9])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points_)], "id int, vec array<double>")
    chosen = [r["landmark"] for r in Z.farthest_landmarks(df, "id", 3, settle_every=2).collect()]

    def radius(centres):
        return max(min(np.linalg.norm(p - points_[c]) for c in centres) for p in points_)

    best = min(radius(c) for c in itertools.combinations(range(len(points_)), 3))
    assert len(set(chosen)) == 3 and radius(chosen) <= 2 * best + 1e-9
    same = spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, None)], "id int, vec array<double>")
    assert [r["landmark"] for r in Z.farthest_landmarks(same, "id", 3).collect()] == [1]
    assert Z.farthest_landmarks(same.limit(0), "id", 3).collect() == []


def test_smoothing_keeps_a_constant(spark):
    grid = spark.range(12).select(F.col("id").cast("int").alias("gx"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("gy"))
    out = U.gaussian_smooth(grid.withColumn("height", F.lit(3.0)), (12, 8))
    assert out.count() == 96 and out.where(F.abs(F.col("height") - 3.0) > 1e-9).isEmpty()


def test_levels_are_clamped_and_distinct(spark):
    assert len(U.level_percents(15)) == 11 and len(U.level_percents(2)) == 7
    flat = spark.createDataFrame([(1.0,)] * 10, "height double")
    assert [tuple(r) for r in U.percentile_levels(flat).collect()] == [(0, 1.0)]


def test_density_needs_five_points(spark):
    assert U.density_2d(points(spark, 4, [0]), bins=5).count() == 0
    assert U.density_2d(points(spark, 5, [0]), bins=5).count() == 25


def test_flat_dimension_is_only_centred(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 4.0],)], "vec array<double>")
    assert sorted(r["scaled"] for r in Z.standardize(df).collect()) == [[0.0, -1.0], [0.0, 1.0]]


def test_landmark_projection_keeps_planar_distances(spark):
    rng = np.random.default_rng(4)
    flat = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(flat)], "id int, vec array<double>")
    out = Z.project_2d(df, "id", method="landmark", n_landmarks=20, digits=8).orderBy("id").collect()
    xy = np.array([[r["x"], r["y"]] for r in out])
    a = np.linalg.norm(flat[:, None] - flat[None], axis=2)
    b = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    assert np.allclose(a, b, atol=1e-5)


# -- rules ----------------------------------------------------------------------------

PROFILE = "birth_year int, banner_id int, community_id int"


def candidate(spark, t, c, score):
    names = [n.split()[0] for n in PROFILE.split(", ")]
    schema = ", ".join([f"t_{n} int" for n in names] + [f"c_{n} int" for n in names]) + ", score double"
    return spark.createDataFrame([(*t, *c, score)], schema)


@pytest.mark.parametrize(
    "t,c,score,expected,reason",
    [
        ((1800, 1, 1), (1802, 1, 1), None, 10, "same banner (1); same community; close age (Δ=2y)"),
        ((1800, 1, 1), (1830, 2, 2), None, 3, "different banner; large age gap (Δ=30y)"),
        ((None, None, None), (None, 2, None), None, 5, "default heuristic"),
        ((1800, None, None), (1808, 2, None), 2.5, 6, "reasonable age (Δ=8y); pre-score +2.50"),  # 6.5 -> 6
        ((1800, None, None), (1801, 2, None), 2.5, 8, "close age (Δ=1y); pre-score +2.50"),  # 7.5 -> 8
        ((0, 1, 1), (1800, 1, 2), None, 7, "same banner (1)"),  # birth year 0 is unknown
    ],
)
def test_rule_score_and_reason(spark, t, c, score, expected, reason):
    df = candidate(spark, t, c, score)
    got = df.select(A.rule_score("t", "c", F.col("score")), A.rule_reason("t", "c", F.col("score"))).first()
    assert tuple(got) == (expected, reason)


def test_one_sided_candidates_are_discounted(spark):
    df = spark.createDataFrame(
        [(1, "h", "a", 4, None, 2.0), (1, "h", "b", 8, 6, 2.0)],
        "year int, h string, w string, target_score int, candidate_score int, score double",
    )
    out = {r["w"]: r for r in A.final_ranking(df).collect()}
    s = 1 / (1 + math.exp(-2))
    assert out["a"]["final_score"] == round(4 * 0.85 * s, 4) and out["b"]["final_score"] == round(7 * s, 4)
    assert [r["w"] for r in A.choose(A.final_ranking(df)).collect()] == ["b"]
    assert A.choose(A.final_ranking(df.where("w = 'a'"))).isEmpty()


def test_answers_with_every_defect(spark, rows):
    text = (
        '{"evaluations":[{"candidate_id":"a","score":7.9,"reason":"first"},{"candidate_id":"a","score":99,"reason":"last"},'
        '{"candidate_id":"b","score":-3,"reason":null},{"candidate_id":"c","score":"x","reason":"' + "r" * 600 + '"},{"score":3}]}'
    )
    answers = spark.createDataFrame([(1, text), (2, "no json"), (3, '{"evaluations":[],"scores":[{"candidate_id":"a","score":4.7}]}')], "h int, answer string")
    asked = spark.createDataFrame([(h, w) for h in (1, 2, 3, 4) for w in "abcd"], "h int, w string")
    got = {(r["h"], r["w"]): (r["score"], r["reason"]) for r in A.parse_evaluations(answers, asked, ["h"]).collect()}
    assert got[1, "a"] == (10, "last") and got[1, "b"] == (1, "") and got[1, "c"] == (5, "r" * 500)
    assert got[1, "d"] == (5, "no LLM output") and got[2, "a"] == (5, "fallback")
    assert got[3, "a"] == (4, "") and got[4, "a"] == (5, "no LLM output") and len(got) == 16


def test_directives_are_folded_in_order_with_clamping(spark):
    rng = random.Random(9)
    said, plain = [], {"a": 9.0, "P7": 1.0}
    for seq in range(300):
        who = rng.choice(["a", "P7", "all"])
        verb = rng.choice(["boost", "boost", "penalize", "penalise"]) if seq < 200 else "penalise"
        said.append((1, seq, f"please {verb.upper()} @c-{who} now"))
        for c in plain:
            if who in (c, "all"):
                step = 0.5 if verb == "boost" else -0.5
                plain[c] = min(10.0, max(0.0, plain[c] + step))
    said.append((1, 300, "eliminate @c-7 @c-a"))
    directives = A.parse_directives(spark.createDataFrame(said, "s int, seq int, text string"))
    cards = spark.createDataFrame([(1, "a", 9.0), (1, "P7", 1.0), (1, "q", None)], "s int, candidate_id string, target_score double")
    for per_slice in (7, 1000):
        got = {r["candidate_id"]: r for r in A.apply_directives(cards, directives, ["s"], per_slice=per_slice).collect()}
        assert got["a"]["target_score"] == plain["a"] and got["P7"]["target_score"] == plain["P7"]
        assert got["q"]["target_score"] is None and got["a"]["eliminated"] and not got["P7"]["eliminated"]


def test_parse_directives(spark):
    df = spark.createDataFrame([("Penalize @c-P12 and @c-7 @c-P12",), ("nothing",)], "text string")
    got = [(r["verb"], r["ids"]) for r in A.parse_directives(df).collect()]
    assert got == [("penalise", ["P12", "7"]), ("", [])]


def test_attribution_sums_to_the_score_or_stays_unscaled(spark):
    pairs = spark.createDataFrame([(0, 3.0, 0.5, 2, False, "regular"), (1, 3.0, None, 0, False, "catchup")], "id int, score double, score_gap double, patri_path_count int, same_lineage boolean, era string")
    out = Q.pair_attribution(pairs, {"banner_match": 10.0 / 3.0})
    first = [r for r in out.where("id = 0").orderBy("position").collect()]
    assert len(first) == 9 and abs(sum(r["scaled"] for r in first[:7]) - 3.0) < 1e-9
    second = out.where("id = 1 and not is_total").collect()
    total = sum(r["value"] for r in second)
    if total == 0:
        assert all(r["scaled"] == r["value"] for r in second)


def test_nulls_sort_last_both_ways(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "a int")
    assert [r[0] for r in Q.sort_nulls_last(df, "a", "asc").collect()] == [1, 2, None]
    assert [r[0] for r in Q.sort_nulls_last(df, "a", "desc").collect()] == [2, 1, None]
