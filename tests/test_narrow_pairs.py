"""The pair table is stored narrow and made once; the vectors are found by those who read z."""

from __future__ import annotations

from kinloom.operators import ranking as R

SCORES = "year int, h long, w long, score double"


def tables(spark):
    scores = spark.createDataFrame([(2000, h, w, float(10 * h + w)) for h in range(6) for w in range(10, 14)], SCORES)
    truth = scores.where("w = 11").selectExpr("year", "h", "w AS true_w", "score AS true_score")
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 4.0]), (1, [0.25, 8.0]), (1, [0.25, 8.0])], "id long, vec array<float>")
    return scores, truth, vectors


def test_vectors_may_come_later(spark, rows):
    """Also with several equal vectors of an id and with members that have none."""
    scores, truth, vectors = tables(spark)
    options = {"k": 2, "vectors": vectors, "vector_key": lambda member: member % 3}
    whole = R.scored_pair_table(scores, truth, **options)
    narrow = R.scored_pair_table(scores, truth, **options, attach=False)
    assert "z" not in narrow.columns and set(R.PAIR_KEYS) <= set(narrow.columns)
    later = R.with_pair_vectors(narrow, vectors)
    assert later.columns == whole.columns
    # Pairs that differ in their vectors alone may swap numbers.
    columns = [c for c in whole.columns if c != "id"]
    assert rows(later, *columns) == rows(whole, *columns)
    assert sorted(r["id"] for r in later.collect()) == sorted(r["id"] for r in whole.collect()) == list(range(whole.count()))


def test_who_does_not_read_z_joins_no_vector(spark):
    scores, truth, vectors = tables(spark)
    narrow = R.scored_pair_table(scores, truth, k=2, vectors=vectors, vector_key=lambda member: member % 3, attach=False).localCheckpoint()
    pairs = R.with_pair_vectors(narrow, vectors)
    plan = pairs.groupBy("year").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "vec" not in plan
    assert "Join" in pairs.select("z")._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_made_once_for_kin_paths(spark, rows, monkeypatch):
    scores, truth, _ = tables(spark)
    edges = spark.createDataFrame([("0", "11", "r_fs", 1900), ("9", "1", "r_sib", 1900), ("9", "11", "r_sib", 1900)], "src string, dst string, rel string, t int")
    made = []
    settle = R.settle
    monkeypatch.setattr(R, "settle", lambda df: made.append(df.columns) or settle(df))
    got = R.scored_pair_table(scores, truth, k=2, edges=edges)
    assert len(made) == 1 and "score_gap" in made[0]
    plain = R.scored_pair_table(scores, truth, k=2)
    assert rows(got, *plain.columns) == rows(plain)
    assert len(made) == 1
