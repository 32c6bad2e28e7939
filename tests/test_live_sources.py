"""Streams against their batch operators, files, and the registry."""

from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from kinloom.operators import live as X
from kinloom.operators import metrics as M
from kinloom.sources import files

LOG = "year int, ablation string, husband_id string, wife_id string, source string, ts timestamp, seq long"
START = dt.datetime(2024, 1, 1)


def accept(minute, seq, husband, wife, year=1):
    return (year, "ablated", husband, wife, "auto", START + dt.timedelta(minutes=minute), seq)


@pytest.fixture
def truth(spark):
    return spark.createDataFrame([("a", "1"), ("b", "2")], "husband_id string, true_wife_id string")


def test_curve_counts_eligible_only(spark, truth):
    log = spark.createDataFrame([accept(0, 0, "x", "9"), accept(1, 1, "a", "1"), accept(90, 2, "b", "9"), accept(91, 3, "a", "1")], LOG)
    got = [(r["n_accepted"], r["n_eligible"], r["n_correct"], r["recall_at_1"]) for r in X.learning_curve(log, truth).orderBy("seq").collect()]
    assert got == [(1, 0, 0, None), (2, 1, 1, 1.0), (3, 2, 1, 0.5), (4, 3, 2, 2 / 3)]


def test_reset_keeps_what_follows(spark):
    log = spark.createDataFrame([accept(0, 0, "a", "1"), accept(1, 1, "a", "r"), accept(2, 2, "b", "1")], LOG)
    marked = log.withColumn("is_reset", F.col("wife_id") == "r")
    assert [r["seq"] for r in X.since_last_reset(marked).collect()] == [2]
    assert X.since_last_reset(marked.where("seq <> 1")).count() == 2


def test_replay_stops_at_done(spark):
    e = spark.createDataFrame([("t", 1, "start"), ("t", 2, "done"), ("t", 3, "stage"), ("u", 1, "start")], "topic string, seq int, type string")
    assert [(r["topic"], r["seq"]) for r in X.replay(e).collect()] == [("t", 1), ("t", 2), ("u", 1)]
    assert X.replay(e, "t").count() == 2


def test_gzip_register_and_cohort_document(spark, tmp_path, rows):
    with gzip.open(tmp_path / "r.csv.gz", "wt") as f:
        f.write("PERSON_ID,YEAR\n 1.0,1800\n2,x\n")
    raw = files.read_panel(spark, str(tmp_path / "r.csv.gz"), "PERSON_ID string, YEAR string", partitions=2)
    assert rows(raw) == [(" 1.0", "1800"), ("2", "x")]
    doc = {
        "year": 1882, "n_pairs": 2, "ablation": "ablated", "k_clusters": 1,
        "pairs": [
            {"id": 0, "husband_id": "P1", "wife_id": "P2", "label": 1, "score": 1.5, "score_gap": 0.5, "rank_of_true_wife": 1, "hungarian_correct": True, "z": [0.5]},
            {"id": 1, "husband_id": "P1", "wife_id": "P3", "label": 0, "score": 1.0, "score_gap": -0.5, "rank_of_true_wife": None, "hungarian_correct": None, "z": [0.25]},
        ],
        "mds_coords": [[0.1, 0.2], [0.3, 0.4]], "clusters": [0, 0], "train_ref_coords": [[1.0, 2.0]],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=2))
    flat = files.read_cohort_json(spark, str(tmp_path / "c.json"))
    assert rows(flat, "year", "id", "wife_id", "x", "cluster") == [(1882, 0, "P2", 0.1, 0), (1882, 1, "P3", 0.3, 0)]
    assert rows(files.read_reference_points(spark, str(tmp_path / "c.json")), "x", "y") == [(1.0, 2.0)]


def test_cohort_sink_replaces_only_its_cohorts(spark, tmp_path):
    path = str(tmp_path / "c")
    one = spark.createDataFrame([(1, "ablated", 5), (2, "ablated", 6)], "year int, ablation string, id int")
    files.write_cohort(one, path)
    files.write_cohort(spark.createDataFrame([(2, "ablated", 9)], one.schema), path)
    assert sorted((r["year"], r["id"]) for r in spark.read.parquet(path).collect()) == [(1, 5), (2, 9)]


def test_comparison_lines(spark):
    a = spark.createDataFrame([(0.5, 1.0)], "roc_auc double, log_loss double")
    b = spark.createDataFrame([(0.75, 0.5)], "roc_auc double, log_loss double")
    out = {r["metric"]: r["line"] for r in M.comparison_lines(M.compare_runs(a, b, ["roc_auc", "log_loss"])).collect()}
    assert out["roc_auc"] == "| roc_auc (↑ better) | 0.5000 | 0.7500 | +0.2500 |"
    assert out["log_loss"].startswith("| log_loss (↓ better)") and out["log_loss"].endswith("-0.5000 |")


def test_registry_matches_its_sql(spark):
    """A few registered queries against DuckDB on the smallest tables; tests/oracle.py runs all."""
    from tests import oracle

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = oracle.connect(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 180
    for name in ("cohort_topk_recall", "marriage_edges", "sibling_edges", "kin_path_count", "roc_auc", "macro_table"):
        state, text = oracle.compare(spark, con, queries[name], sql[name], sf)
        assert state == "ok", (name, text)
    assert entry.entry(spark).count() > 0
