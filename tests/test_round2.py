"""Rows without a year, large ids, ties, long lines, cohorts of pairs, directives to all."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.operators import assignment as G
from kinloom.operators import candidates as N
from kinloom.operators import cleaning as C
from kinloom.operators import edges as E
from kinloom.operators import kinship as K
from kinloom.operators import rules as U

PANEL = "PERSON_ID string, YEAR int, SEX int, MARITAL_STATUS int, WIFE_1_ID string, HUSBAND_ID string, FATHER_ID string, MOTHER_ID string, BIRTHYEAR int, HOUSEHOLD_ID string, UNIQUE_VILLAGE_ID int, REGION int"


@pytest.fixture
def undated(spark):
    rows = [
        ("m", None, 2, 2, "w", None, "wrong", "wrong", 1700, "h0", 99, 98),
        ("m", 1800, 2, 1, None, None, "f", "g", 1775, "h1", 7, 5),
        ("m", 1802, 2, 2, "w", None, "f", "g", 1775, "h1", 7, 5),
        *[(p, 1790, s, 1, None, None, None, None, None, "h1", 7, 5) for p, s in (("f", 2), ("g", 1), ("wrong", 2))],
        ("w", 1800, 1, None, None, None, None, None, None, "h1", 7, 5),
    ]
    return spark.createDataFrame(rows, PANEL)


def test_rows_without_year_come_last(undated):
    edges = {(r["rel"], r["src"], r["dst"]): r["t"] for r in E.build_edges(undated).collect()}
    assert edges[("r_hw", "m", "w")] == 1801
    assert ("r_fs", "f", "m") in edges and ("r_fs", "wrong", "m") not in edges
    assert edges[("r_fs", "f", "m")] == 1775
    assert ("r_cb", "m", "5") in edges and ("r_cb", "m", "98") not in edges
    assert all(t is not None for t in edges.values())
    births = {r["person"]: r["birth"] for r in E.first_birth_year(undated).collect()}
    assert births["m"] == 1775


def test_events_without_year_are_counted(spark):
    rows = [("m", None, 2, 2, "w", None, None, None, None, None, None, None), ("w", 1800, 1, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, PANEL)
    assert E.marriage_edges(df).collect() == []
    counted = {r["method"]: (r["n_undated"], r["n_events"]) for r in E.undated_events(E.marriage_events(df)).collect()}
    assert counted == {2: (1, 1), 3: (1, 1)}


def test_score_cohorts_large_ids_and_ties(spark):
    big = 1_152_921_504_606_846_979
    schema = "year int, id long, vec array<double>"
    left = spark.createDataFrame([(1, big, [0.3, 0.7]), (1, big + 2, [0.1, 0.2])], schema)
    right = spark.createDataFrame([(1, big + k, [0.25, 0.9]) for k in range(3)], schema)
    truth = spark.createDataFrame([(1, big, big + 1)], "year int, h long, true_w long")
    weights = list(np.linspace(-1, 1, 8))
    for block in (1, 2, 1024):
        out = {r["h"]: r for r in N.score_cohorts(left, right, truth, weights, 0.5, k=2, block=block).collect()}
        assert (out[big]["true_w"], out[big]["rank_of_truth"], out[big]["n_pool"]) == (big + 1, 2, 3)
        assert [x["w"] for x in out[big]["top"]] == [big, big + 1]
        assert out[big]["top"][1]["score"] == out[big]["true_score"]
        assert out[big + 2]["true_w"] is None and out[big + 2]["rank_of_truth"] is None


def test_long_line_and_cycle(spark):
    parents = [(str(i), str(i - 1)) for i in range(1, 200)] + [("a", "b"), ("b", "c"), ("c", "a"), ("z", "a")]
    nodes = [(str(i),) for i in range(200)] + [(x,) for x in "abcz"]
    table = spark.createDataFrame(parents, "id string, parent string")
    roots = {r["id"]: r["root"] for r in K.root_ancestor(table, spark.createDataFrame(nodes, "id string")).collect()}
    assert {roots[str(i)] for i in range(200)} == {"0"}
    assert {roots[x] for x in "abcz"} == {"a"}


def test_validate_pairs_per_cohort(spark):
    names = C.PAIR_COLUMNS
    rows = [(year, i) for year in (1, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "year int, id int").select(
        "year",
        "id",
        *[F.lit(1.0).alias(c) for c in ("score", "score_gap")],
        F.lit(1).alias("label"),
        F.lit(1).alias("rank_of_true_wife"),
        F.lit(True).alias("hungarian_correct"),
        F.array(F.lit(1.0)).alias("z"),
        *[F.lit("x").alias(c) for c in names if c not in ("id", "score", "score_gap", "label", "rank_of_true_wife", "hungarian_correct", "z")],
    )
    assert {r["n_bad"] for r in C.validate_pairs(df).collect()} == {0}
    report = {r["rule"]: r["n_bad"] for r in C.validate_pairs(df.drop("z").where("year = 1 or id <> 1")).collect()}
    assert report["missing_column:z"] == 1 and report["id_range"] == 1 and report["id_duplicates"] == 0


def test_directive_to_all_without_key(spark):
    cards = spark.createDataFrame([("1", 5.0), ("2", 5.0)], "candidate_id string, target_score double")
    orders = spark.createDataFrame([(0, "boost @c-all"), (1, "penalise @c-2")], "seq int, text string")
    done = {r["candidate_id"]: r["target_score"] for r in U.apply_directives(cards, U.parse_directives(orders)).collect()}
    assert done == {"1": 5.5, "2": 5.0}


def test_assignment_matches_everybody_whatever_the_sign(spark):
    rows = [(1, 0, 0, -1.0), (1, 0, 1, -2.0), (1, 1, 0, -3.0), (1, 1, 1, 0.5), (2, 0, 0, -9.0)]
    scores = spark.createDataFrame(rows, "year int, h long, w long, score double")
    got = sorted((r["year"], r["h"], r["w"], r["score"]) for r in G.assign_one_to_one(scores).collect())
    assert got == [(1, 0, 0, -1.0), (1, 1, 1, 0.5), (2, 0, 0, -9.0)]
    assert G.assign_one_to_one(scores, outside=0.0).count() == 1
    assert G.assign_one_to_one(scores.limit(0)).collect() == []


def test_learning_curve_of_one_moment(spark):
    """All events at the same second: ranges of the order still cut them."""
    from datetime import datetime

    from kinloom.operators import live as X

    at = datetime(2024, 1, 1)
    rows = [(1, "a", str(i), "w", at, i) for i in range(500)]
    log = spark.createDataFrame(rows, "year int, ablation string, husband_id string, wife_id string, ts timestamp, seq long")
    truth = spark.createDataFrame([(str(i), "w" if i % 2 else "x") for i in range(0, 500, 5)], "husband_id string, true_wife_id string")
    got = {r["seq"]: (r["n_accepted"], r["n_eligible"], r["n_correct"]) for r in X.learning_curve(log, truth).collect()}
    assert got == {i: (i + 1, i // 5 + 1, (i // 5 + 1) // 2) for i in range(500)}


def test_kin_violations(spark, undated):
    rows = [("f1", "c", "r_fs", 1), ("f2", "c", "r_fs", 1), ("x", "x", "r_fd", 1), ("c", "f1", "r_sib", 1), ("c", "f2", "r_sib", 1)]
    edges = spark.createDataFrame(rows, "src string, dst string, rel string, t int")
    assert K.kin_violations(edges).first().asDict() == {"several_fathers": 1, "own_father": 1, "several_families": 1}
    assert set(K.kin_violations(E.build_edges(undated)).first().asDict().values()) == {0}
