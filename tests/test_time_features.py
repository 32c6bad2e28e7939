"""As-of views, covariates, features, and the sliced ordered operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinloom.functions import scalars as S
from kinloom.operators import features as X
from kinloom.operators import macro as M
from kinloom.operators import ordered as O
from kinloom.operators import temporal as T


def edges(spark, data):
    return spark.createDataFrame(data, "src string, dst string, rel string, t int")


@pytest.fixture(scope="module")
def random_edges(spark):
    rng = random.Random(3)
    data = []
    for rel in ("r_hw", "r_fs", "r_hh"):
        data += [(str(rng.randrange(40)), str(rng.randrange(40)), rel, rng.randrange(1749, 1910)) for _ in range(80)]
    data += [(str(i), f"f{i % 5}", "r_sib", rng.randrange(1749, 1910)) for i in range(40)]
    return edges(spark, data)


def test_static_edges_stay_and_the_bound_is_strict(spark, rows):
    e = edges(spark, [("a", "b", "r_hh", t) for t in (0, 1849, 1850, 1851)])
    assert rows(T.as_of(e, 1850), "t") == [(0,), (1849,)]


def test_views_grow_with_the_year(random_edges):
    from kinloom.operators.edges import edge_counts

    a = {r["rel"]: r["n_edges"] for r in edge_counts(T.as_of(random_edges, 1800)).collect()}
    b = {r["rel"]: r["n_edges"] for r in edge_counts(T.as_of(random_edges, 1850)).collect()}
    assert all(a[r] <= b[r] for r in a)


def test_many_years_equal_single_years(spark, random_edges, rows):
    from kinloom.operators.edges import edge_counts

    years = spark.createDataFrame([(1780,), (1850,)], "year int")
    got = {(y, r): n for y, r, n in rows(T.as_of_many(random_edges, years))}
    for year in (1780, 1850):
        for r in edge_counts(T.as_of(random_edges, year)).collect():
            assert got.get((year, r["rel"]), 0) == r["n_edges"]


def test_mask_removes_exactly_the_pair(spark, random_edges):
    one = random_edges.where("rel = 'r_hw'").orderBy("src", "dst", "t").first()
    n = random_edges.where((F.col("rel") == "r_hw") & (F.col("src") == one["src"]) & (F.col("dst") == one["dst"])).count()
    hidden = spark.createDataFrame([(one["src"], one["dst"])], "h string, w string")
    assert T.mask_pairs(random_edges, hidden).count() == random_edges.count() - n


def test_ablation_keeps_the_catalogue(spark):
    from kinloom.operators.edges import edge_counts

    e = edges(spark, [("a", "b", "r_ms", 1), ("a", "b", "r_fs", 1)])
    counts = {r["rel"]: r["n_edges"] for r in edge_counts(T.ablate_relations(e)).collect()}
    assert counts["r_ms"] == 0 and counts["r_fs"] == 1 and len(counts) == 9


def test_buckets_are_disjoint_and_outside_years_have_none(spark, rows):
    e = edges(spark, [("a", str(t), "r_hw", t) for t in (1700, 1749, 1855, 1856, 1879, 1880, 1909, 1910)])
    got = {y: b for y, b in rows(T.cohort_split(e), "year", "bucket")}
    assert got == {1700: None, 1749: "train", 1855: "train", 1856: "val", 1879: "val", 1880: "test", 1909: "test", 1910: None}


def test_degrees_as_of_match_a_plain_count(spark, random_edges, rows):
    asked = spark.createDataFrame([(str(i), y) for i in range(40) for y in (1800, 1870)], "id string, year int")
    got = {r[:3]: r[3] for r in rows(T.degrees_as_of(random_edges, asked, "any"), "id", "year", "rel", "degree")}
    all_rows = [tuple(r) for r in random_edges.collect()]
    sib = [r for r in all_rows if r[2] == "r_sib"]
    plain = [r for r in all_rows if r[2] != "r_sib"]
    plain += [(a[0], b[0], "r_sib", max(a[3], b[3])) for a in sib for b in sib if a[1] == b[1] and a[0] != b[0]]
    for i in range(40):
        for y in (1800, 1870):
            for rel in ("r_hw", "r_fs", "r_hh", "r_sib"):
                n = sum((s == str(i)) + (d == str(i)) for s, d, r, t in plain if r == rel and t < y)
                assert got.get((str(i), y, rel), 0) == n


def test_midpoint_floors_and_halves_go_to_even(spark):
    r = spark.range(1).select(
        S.floor_midpoint(F.lit(1800), F.lit(1803)), S.floor_midpoint(F.lit(-2), F.lit(-1)),
        S.half_even_int(F.lit(6.5)), S.half_even_int(F.lit(7.5)),
    ).first()
    assert tuple(r) == (1801, -2, 6, 8)


def test_macro_covariates_without_gaps(spark):
    prices = spark.createDataFrame([(1800, 2.0), (1803, 4.0)], "YEAR int, grain_price double")
    events = spark.createDataFrame([(1801, 3)], "YEAR int, disaster_count long")
    out = {r["YEAR"]: r for r in M.macro_table(prices, events, 1799, 1804).collect()}
    assert sorted(out) == list(range(1799, 1805))
    assert [out[y]["grain_price_yoy"] for y in sorted(out)] == [0.0, 0.0, 0.0, 0.0, 2.0, 0.0]
    assert [out[y]["disaster_flag"] for y in sorted(out)] == [0, 0, 1, 0, 0, 0]
    assert out[1799]["era_id"] == 1
    assert abs(sum(r["cohort_year_z"] for r in out.values())) < 1e-9


def test_era_ids_are_clamped_at_the_first_boundary(spark):
    years = spark.createDataFrame([(y,) for y in (1700, 1736, 1795, 1796, 1850, 1909, 2000)], "y int")
    assert [r[0] for r in years.select(S.era_id(F.col("y"))).collect()] == [0, 0, 0, 1, 2, 6, 6]


def test_constant_columns_do_not_divide_by_zero(spark, rows):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert rows(M.zscore(df, "x", "z"), "z") == [(0.0,), (0.0,)]
    assert rows(X.minmax_scale(df, ["x"]), "x_01") == [(0.0,), (0.0,)]
    assert rows(X.minmax_scale(df, ["x"], flat="zero"), "x_01") == [(0.0,), (0.0,)]
    assert rows(X.masked_zscore(df, ["x"]), "x_z") == [(0.0,), (0.0,)]
    one = spark.createDataFrame([(7.0,), (None,)], "x double")
    assert rows(X.masked_zscore(one, ["x"]), "x_z") == [(0.0,), (7.0,)]


def test_vocab_reserves_zero_or_counts_the_unknown(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,), (None,)], "v string")
    assert rows(X.fit_vocab(df, "v", 64), "value", "code") == [("a", 1), ("b", 2)]
    assert rows(X.fit_vocab(df, "v", 2), "value", "code") == [("a", 1)]
    assert rows(X.fit_vocab(df, "v", 64, count_unknown=True), "value", "code") == [("<UNK>", 1), ("a", 2), ("b", 3)]
    assert rows(X.encode(df, "v", X.fit_vocab(df, "v", 2), "c"), "c") == [(0,), (0,), (0,), (0,), (1,), (1,)]


def test_missing_is_not_zero(spark, rows):
    df = spark.createDataFrame([(0,), (None,)], "x int")
    assert rows(X.missing_mask(df, ["x"]), "x_present") == [(False,), (True,)]


# -- a hot group: a third and more of all rows under one key ---------------------------


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(50), i, rng.randrange(10)) for i in range(600)]
    data += [(None, 1, 1000 + i, i) for i in range(5)]
    return spark.createDataFrame(data, "g string, t int, i int, v int").persist()


def test_sliced_numbers_equal_a_window(hot, rows):
    w = Window.partitionBy("g").orderBy("t", "i")
    assert rows(O.numbered(hot, ["g"], ["t", "i"]), "g", "i", "rn") == rows(
        hot.withColumn("rn", F.row_number().over(w)), "g", "i", "rn"
    )


@pytest.mark.parametrize("slice_by", [None, ["t"]])
def test_sliced_sums_equal_a_window(hot, rows, slice_by):
    w = Window.partitionBy("g").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    got = O.running_sums(hot, ["g"], ["t", "i"], {"s": F.col("v")}, slice_by=slice_by)
    assert rows(got, "g", "i", "s") == rows(hot.withColumn("s", F.sum("v").over(w)), "g", "i", "s")


def test_sliced_lag_equals_a_window(hot, rows):
    w = Window.partitionBy("g").orderBy("t", "i")
    got = O.lagged(hot, ["g"], ["t", "i"], ["v"], "p").select("g", "i", F.col("p")["v"])
    assert rows(got) == rows(hot.select("g", "i", F.lag("v").over(w)))


def test_percentiles_equal_the_exact_function(hot, rows):
    got = [r["value"] for r in O.exact_percentiles(hot, "i", [0, 12.5, 50, 99, 100]).orderBy("level").collect()]
    assert got == hot.select(F.percentile("i", F.array(*[F.lit(p) for p in (0.0, 0.125, 0.5, 0.99, 1.0)]))).first()[0]
