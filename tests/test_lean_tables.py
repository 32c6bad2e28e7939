"""Settled tables are small, and what is moved or bid for nothing is left out."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from kinloom.operators import assignment as G
from kinloom.operators import kinship as K
from kinloom.operators import ranking as R
from kinloom.session import settle

EDGES = "src string, dst string, rel string, t int"


def test_settled_rows_are_parquet(spark, rows):
    df = spark.createDataFrame([(1, "a", [1.5, None]), (None, None, None)], "i int, s string, v array<double>").repartition(2, "i")
    kept = settle(df)
    assert kept.inputFiles() and all(".parquet" in f for f in kept.inputFiles())
    assert kept.schema == df.schema and rows(kept) == rows(df)
    assert rows(settle(df.where("i > 5"))) == []


def test_other_rows_are_settled_too(spark, rows):
    """Equal names and types that Parquet cannot tell apart are kept by a checkpoint."""
    twice = spark.range(3).select("id", "id")
    assert not settle(twice).inputFiles() and sorted(map(tuple, settle(twice).collect())) == [(0, 0), (1, 1), (2, 2)]
    maps = spark.sql("SELECT map('a', 1) AS m")
    assert not settle(maps).inputFiles() and settle(maps).first()["m"] == {"a": 1}


def test_settling_leaves_the_session_as_it_was(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    settle(spark.range(5).groupBy((F.col("id") % 2).alias("k")).count())
    assert spark.conf.get(key) == before


def test_prices_that_nobody_bid_are_dropped(spark, monkeypatch):
    """A coarse step passes on the prices of objects that had a bid in it, and no others."""
    rng = random.Random(7)
    df = spark.createDataFrame([(1, i, j, rng.random()) for i in range(40) for j in range(60)], "year int, h int, w int, score double")
    given, held, run = [], [], G._Market.run

    def spy(self, market, epsilon, rounds=None):
        given.append(0 if market is None else market.count())
        out = run(self, market, epsilon, rounds)
        held.append(out.where(F.col("bidder").isNotNull()).count())
        return out

    monkeypatch.setattr(G._Market, "run", spy)
    solved = G.auction(df, block=10)
    assert given[:5] == [0, *held[:4]]
    proof = solved.certificate.first()
    assert proof["n_matched"] == 40 and proof["bound"] - proof["total"] <= 40 * proof["epsilon"] + 1e-9


def test_who_gains_nothing_at_the_first_prices_makes_no_list(spark):
    rows = [(1, b, i, 1.0, 0.0, 0.1, 1.0, 3) for b in (1, 2, 3) for i in (7, 8)]
    offers = spark.createDataFrame(rows, "year int, bidder int, item int, score double, base double, epsilon double, range double, number int")
    market = spark.createDataFrame([(1, 7, 1.0, 1, 1.0, 0.0), (1, 8, 2.0, None, 1.0, 0.0)], "year int, item int, price double, bidder int, score double, base double")
    made = G._Market(offers, ["year"], 4, 10, 0, market)
    assert {r["bidder"] for r in made.lists.collect()} == {1}  # it holds 7; the others gain nothing by either


def family(spark):
    """Twelve people in families of three, three households, partners across."""
    rng = random.Random(3)
    rows = [(str(p), f"f{p // 3}", "r_sib", 1) for p in range(12)] + [(f"f{p // 3}", str(p), "r_fs", 1) for p in range(12)]
    rows += [(str(p), f"g{h}", "r_hh", 1) for p in range(12) for h in rng.sample(range(3), 2)]
    rows += [(str(p), str((p + 5) % 12), "r_hw", 1) for p in range(6)] + [(f"f{k}", "f0", "r_sib", 1) for k in (1, 2)]
    pairs = [(str(a), str(b)) for a in range(12) for b in range(12)] + [("1", "2"), ("1", None), ("x", "2")]
    return spark.createDataFrame(pairs, "h string, w string"), spark.createDataFrame(rows, EDGES)


def test_households_listed_or_joined(spark, rows, monkeypatch):
    pairs, edges = family(spark)
    listed = rows(K.kin_path_count(pairs, edges))
    monkeypatch.setattr(K, "LISTED", 1)
    assert rows(K.kin_path_count(pairs, edges)) == listed and len(listed) == 147


def test_motifs_of_portions(spark, rows, monkeypatch):
    pairs, edges = family(spark)
    whole = rows(K.match_motifs(pairs, edges))
    monkeypatch.setattr(K, "PORTION", 20)
    assert rows(K.match_motifs(pairs, edges)) == whole
    assert sum(r[2] for r in whole) and sum(r[4] for r in whole)


def test_pair_table_keeps_its_columns(spark, rows):
    """Lineages by number and by text; several roots of a member make several rows."""
    scores = spark.createDataFrame([(2000, h, w, float(10 * h + w)) for h in range(4) for w in range(10, 14)], "year int, h long, w long, score double")
    truth = scores.where("w = 11").selectExpr("year", "h", "w AS true_w", "score AS true_score")
    roots = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (11, "a"), (13, "b")], "id long, root string")
    edges = spark.createDataFrame([("0", "11", "r_fs", 1), ("9", "1", "r_sib", 1), ("1", "g", "r_hh", 1), ("13", "g", "r_hh", 1)], EDGES)
    assignment = spark.createDataFrame([(2000, 0, 11), (2000, 1, 12)], "year int, h long, w long")
    made = R.scored_pair_table(scores, truth, k=2, assignment=assignment, roots=roots, edges=edges)
    at = made.columns.index("hungarian_correct")
    assert made.columns[at : at + 5] == ["hungarian_correct", *R.LOOKED_UP]
    assert made.count() == 4 * 3 + 3  # two roots of member 1
    got = {(r["h"], r["w"]): (r["hungarian_correct"], r["lineage_wife"] != "L_unknown", r["patri_path_count"]) for r in made.collect()}
    assert got[0, 11] == (True, True, 1) and got[1, 11] == (False, True, 0) and got[1, 13] == (None, True, 1)
    text = R.scored_pair_table(scores, truth, k=2, roots=roots.withColumn("id", F.col("id").cast("string")), edges=edges)
    columns = ["year", "h", "w", "same_lineage", "patri_path_count"]
    assert rows(text, *columns) == rows(made, *columns)
