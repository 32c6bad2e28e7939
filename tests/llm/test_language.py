from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.llm.language import Settings, fit, identify, label_texts, learn, marginals


def brute_marginals(scores, transitions):
    """One chain, plain forward-backward in log space."""
    n, size = scores.shape
    a = np.zeros((n, size))
    b = np.zeros((n, size))
    before = np.zeros(size)
    for t in range(n):
        a[t] = scores[t] + np.logaddexp.reduce(before[:, None] + transitions, axis=0)
        before = a[t]
    for t in range(n - 2, -1, -1):
        b[t] = np.logaddexp.reduce(transitions + scores[t + 1] + b[t + 1], axis=1)
    g = a + b
    return np.exp(g - np.logaddexp.reduce(g, axis=1, keepdims=True))


def test_marginals_match_brute_force():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 7, 130, 32, 33, 400])
    scores = rng.normal(size=(lengths.sum(), 3)) * 4
    transitions = rng.normal(size=(3, 3)) * 2
    got = marginals(scores, lengths, transitions)
    start = 0
    for n in lengths:
        assert np.allclose(got[start : start + n], brute_marginals(scores[start : start + n], transitions), atol=1e-8)
        start += n


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return learn(docs)


def test_held_out_accuracy(docs, model):
    rows = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_code_switched_words(docs, model):
    by = {lang: docs.where((F.col("lang") == lang) & (F.length("text") > 600)).orderBy("doc_id").first()["text"][:400] for lang in ("en", "de")}
    found = label_texts([by["en"] + " " + by["de"]], model).iloc[0]
    assert 1 <= found.n_switches <= 12
    assert found.score < 0.8


def test_odd_rows(make, model):
    text = "der die und nicht mit"
    docs = make([(None, None), (1, ""), (2, "123 -- 45"), (3, text), (3, text), (4, "x"), (5, (text + " ") * 30_000)])
    docs = docs.withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(3))
    rows = identify(docs, model).collect()
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["n_letter_words"]) for r in rows)
    assert [x for x in got if x[1] == "und"] == [("1", "und", 0), ("2", "und", 0), ("None", "und", 0)]
    assert [x[2] for x in got if x[0] in "35"] == [5, 5, 150_000]
    assert {x[1] for x in got if x[0] in "35"} == {"de"}


def test_nothing_to_learn(make):
    docs = make([(1, "abc", None), (3, None, "en")])
    assert learn(docs) is None
    assert {r["lang_pred"] for r in identify(docs, None).collect()} == {"und"}
    assert identify(make([]), None).collect() == []
    assert fit([("en", "123")]) is None
    one = fit([("en", "the cat and the dog")] * 3, Settings(sequences=5, steps=2))
    assert label_texts(["a dog"], one).iloc[0].lang_pred == "en"
