"""Cleaning and edge extraction on hand-written registers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kinloom.functions import scalars as S
from kinloom.operators import cleaning as C
from kinloom.operators import edges as E
from kinloom.operators import explore as Q
from kinloom.operators import features as X

SCHEMA = (
    "PERSON_ID string, YEAR int, SEX int, MARITAL_STATUS int, WIFE_1_ID string, HUSBAND_ID string, "
    "FATHER_ID string, MOTHER_ID string, BIRTHYEAR int, HOUSEHOLD_ID string, UNIQUE_VILLAGE_ID int, REGION int"
)


def panel(spark, *people):
    """Rows as dicts; everything not named is null."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(p.get(n) for n in names) for p in people], SCHEMA)


def person(pid, year=1800, **more):
    return {"PERSON_ID": pid, "YEAR": year, **more}


def test_latest_known_value_is_per_column(spark, rows):
    df = spark.createDataFrame([("p1", 1800, 1, None), ("p1", 1801, None, 2)], "p string, y int, a int, b int")
    assert rows(X.latest_as_of(df, "p", ["y"], ["a", "b"])) == [("p1", 1, 2)]
    assert rows(X.latest_as_of(df, "p", ["y"], ["a", "b"], F.col("y") <= 1800)) == [("p1", 1, None)]


def test_normalize_id_texts_and_doubles(spark, rows):
    df = spark.createDataFrame([(" 12.0 ",), ("7.00",), ("nan",), ("<NA>",), ("x1",), (None,)], "a string")
    assert rows(df.select(S.normalize_id(F.col("a")))) == [("12",), ("7",), ("x1",), (None,), (None,), (None,)]
    big = spark.createDataFrame([(12345678.0,), (float("nan"),), (1.5,)], "a double")
    out = C.normalize_ids(big.withColumnRenamed("a", "PERSON_ID"))
    assert rows(out) == [("1.5",), ("12345678",), (None,)]


def test_coerce_numeric_never_raises(spark, rows):
    df = spark.createDataFrame([("12",), ("x",), ("1d",), ("NaN",), ("",), ("-3.5e1",)], "YEAR string")
    assert rows(C.coerce_numeric(df)) == [(-35.0,), (12.0,), (None,), (None,), (None,), (None,)]


def test_missing_codes_in_both_forms(spark, rows):
    df = spark.createDataFrame([(-99, "-9", "NA"), (5, "ok", "")], "a int, b string, c string")
    assert rows(C.null_missing_codes(df)) == [(5, "ok", None), (None, None, None)]


def test_null_status_between_hides_the_transition(spark, rows):
    df = panel(
        spark,
        person("a", 1800, SEX=2, MARITAL_STATUS=1), person("a", 1801, SEX=2),
        person("a", 1802, SEX=2, MARITAL_STATUS=2, WIFE_1_ID="w"),
        person("b", 1800, SEX=2, MARITAL_STATUS=1), person("b", 1803, SEX=2, MARITAL_STATUS=2, WIFE_1_ID="v"),
        person("c", 1800, MARITAL_STATUS=1), person("c", 1803, MARITAL_STATUS=2),
    )
    assert rows(E.status_transitions(df), "person", "partner", "year") == [("b", "v", 1801)]


def test_partner_by_sex_takes_husband_for_every_code_but_male(spark, rows):
    df = spark.createDataFrame([(2,), (1,), (0,)], "s int")
    out = df.select("s", S.pick_partner(F.col("s"), F.lit("w"), F.lit("h")))
    assert rows(out) == [(0, "h"), (1, "h"), (2, "w")]


def test_couple_reported_twice_is_one_edge_at_the_earliest_year(spark, rows):
    df = panel(
        spark,
        person("1", 1805, SEX=2, MARITAL_STATUS=2, WIFE_1_ID="2"),
        person("2", 1803, SEX=1, MARITAL_STATUS=2, HUSBAND_ID="1"),
        person("3", 1803, SEX=2, WIFE_1_ID="nobody"),
    )
    assert rows(E.marriage_edges(df)) == [("1", "2", "r_hw", 1803)]


def test_first_row_is_tested_after_it_is_picked(spark, rows):
    df = panel(spark, person("a", 1800, SEX=2, MARITAL_STATUS=1), person("a", 1801, SEX=2, MARITAL_STATUS=2))
    assert rows(E.first_observation_in_state(df)) == []


def test_in_law_rows_rank_last(spark, rows):
    df = panel(
        spark,
        person("a", 1805, SEX=1, MARITAL_STATUS=2, FATHER_ID="F2"),
        person("a", 1810, SEX=1, MARITAL_STATUS=1, FATHER_ID="F1"),
        person("b", 1805, SEX=1, MARITAL_STATUS=2, FATHER_ID="F3"),
        person("c", 1805, SEX=2, MARITAL_STATUS=2, FATHER_ID="F4"),
        person("c", 1810, SEX=2, MARITAL_STATUS=1, FATHER_ID="F5"),
    )
    assert rows(E.reference_rows(df), "person", "father") == [("a", "F1"), ("b", "F3"), ("c", "F4")]


def family(spark):
    return panel(
        spark,
        person("f", SEX=2), person("m", SEX=1),
        person("a", SEX=2, FATHER_ID="f", MOTHER_ID="m", BIRTHYEAR=1801),
        person("b", SEX=1, FATHER_ID="f", MOTHER_ID="x", BIRTHYEAR=1805),
        person("c", FATHER_ID="f"),
    )


def test_parent_edges_split_by_sex_and_default_birth(spark, rows):
    refs, people = E.reference_rows(family(spark)), C.distinct_ids(family(spark), "PERSON_ID")
    fathers = E.parent_child_edges(refs, "father", people, "r_fs", "r_fd")
    assert rows(fathers) == [("f", "a", "r_fs", 1801), ("f", "b", "r_fd", 1805)]
    mothers = E.parent_child_edges(refs, "mother", people, "r_ms", "r_md")
    assert rows(mothers) == [("m", "a", "r_ms", 1801)]
    assert rows(E.unknown_sex_drops(refs, people)) == [("father", 1), ("mother", 0)]


def test_siblings_as_membership_give_all_pairs(spark, rows):
    refs, people = E.reference_rows(family(spark)), C.distinct_ids(family(spark), "PERSON_ID")
    links = E.sibling_links(refs, people)
    pairs = E.siblings_of(links, ["a", "b", "c"])
    assert rows(pairs, "src", "dst", "t") == [
        ("a", "b", 1805), ("a", "c", 1801), ("b", "a", 1805), ("b", "c", 1805), ("c", "a", 1801), ("c", "b", 1805)
    ]
    # c has no birth year: its own row counts as 1749
    assert rows(E.sibling_summary(links)) == [("a", 2, 1805, 3606), ("b", 2, 1805, 3610), ("c", 2, 1805, 3606)]
    counts = dict(rows(E.edge_counts(E.build_edges(family(spark)))))
    assert counts["r_sib"] == 6 and counts["r_fs"] == 1 and counts["r_hw"] == 0


def test_banner_takes_the_first_row_then_drops_nulls(spark, rows):
    df = panel(
        spark, person("a", 1800, REGION=None), person("a", 1801, REGION=5), person("b", 1800, REGION=4),
        person("x", 1800, HOUSEHOLD_ID="h"), person("x", 1801, HOUSEHOLD_ID="h", UNIQUE_VILLAGE_ID=7),
    )
    assert rows(E.membership_edges_first_row(df)) == [("b", "4", "r_cb", 0)]
    assert rows(E.membership_edges_static_first(df)) == [("h", "7", "r_hc", 0)]


def test_household_edges_are_not_deduplicated(spark, rows):
    df = panel(spark, person("a", 1800, HOUSEHOLD_ID="h"), person("a", 1800, HOUSEHOLD_ID="h"))
    assert len(rows(E.membership_edges_timed(df))) == 2


def test_second_wife_makes_no_edge(spark, rows):
    df = panel(spark, person("a", SEX=2), person("b", SEX=1)).withColumn("WIFE_2_ID", F.lit("b"))
    assert rows(E.marriage_edges(df)) == []


def test_profile_with_unknown_sex_keeps_the_other_columns(spark, rows):
    people = Q.profiles(panel(spark, person("1", BIRTHYEAR=1790, REGION=3), person("2", 1801, SEX=2), person("2", 1802, SEX=1)))
    assert rows(people, "id", "sex", "birth_year") == [("1", "?", 1790), ("2", "M", None)]
    asked = spark.createDataFrame([("P1",), ("2",), ("P9",)], "id string")
    assert rows(Q.get_profiles(asked, people), "id", "sex", "banner_id") == [("2", "M", None), ("P1", "?", 3), ("P9", "?", None)]


def test_empty_panel_gives_empty_edges(spark):
    empty = panel(spark, person("a")).where(F.lit(False))
    out = E.build_edges(empty)
    assert out.columns == ["src", "dst", "rel", "t"] and out.count() == 0


def test_year_gaps_and_checks(spark, rows):
    df = spark.createDataFrame([(y,) for y in range(1750, 1770) if y != 1760], "y int")
    assert rows(C.check_year_gaps(df, "y", 1750, 1769)) == [(1760,)]
    with pytest.raises(C.CheckFailed, match="1760"):
        C.check_year_gaps(df, "y", 1750, 1769, raise_on_error=True)
    bad = spark.createDataFrame(
        [(0, "a", "b", 1, float("nan"), 0.1, [1.0]), (2, "c", None, 0, 1.0, 0.1, [])],
        "id int, husband_id string, wife_id string, label int, score double, score_gap double, z array<double>",
    )
    report = {r["rule"]: r["n_bad"] for r in C.validate_pairs(bad).collect()}
    assert report["not_finite:score"] == 1 and report["null:wife_id"] == 1
    assert report["id_range"] == 1 and report["empty_vector:z"] == 1
    with pytest.raises(C.CheckFailed):
        C.validate_pairs(bad, raise_on_error=True)
