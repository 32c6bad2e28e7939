from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_near import brute_components, brute_fingerprint


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark, corpus, tmp_path):
    docs = corpus.withColumn("size", F.lit("clash")).withColumn("kept", F.lit(1))
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES[:-1]:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    raw = {r["doc_id"]: r["text"] for r in corpus.collect()}
    assert kept["language"] == {i: t for i, t in raw.items() if any(c.isalpha() for c in t)}
    last = {}
    for i in sorted(kept["language"]):
        last[kept["language"][i]] = i
    assert kept["exact"] == {i: t for t, i in last.items()}
    ids = sorted(kept["exact"])
    fps = np.array([brute_fingerprint(kept["exact"][i]) for i in ids], np.uint64)
    assert set(kept["near"]) == set(brute_components(ids, fps))
    assert set(kept["mix"]) <= set(kept["near"])
    sizes = {r["doc_id"]: len(r["text"].split()) for r in docs.collect()}
    mixed = [r["doc_id"] for r in docs.collect()]
    assert max(mixed.count(i) for i in set(mixed)) <= 3
    total = sum(len(t.split()) for t in kept["near"].values())
    assert abs(sum(sizes[i] for i in mixed) - total) < 0.1 * total
    out = P.STAGES[-1][1](spark, docs, "").collect()
    assert len(out) == len(mixed)
    for r in out:
        assert r["decoded_sha256"] == hashlib.sha256(kept["mix"][r["doc_id"]].encode()).hexdigest()


def test_odd_rows(spark, make):
    texts = "der die das und nicht mit von zu auf ist "
    data = [(None, None, None, None), (1, "", "de", "a"), (2, "12 34", "de", "a"), (3, texts, "de", "a"), (3, texts, "de", "a"), (3, texts + "ein", "de", "b")]
    data += [(None, texts * 2, "de", None), (None, texts * 2, "de", None), (9, texts * 3000, "de", "c")]
    docs = make(data)
    kept = P.keep_languages(spark, docs, "")
    assert kept.count() == 6
    once = P.drop_copies(spark, docs, "")
    assert sorted((repr(r["doc_id"]), len(r["text"] or "")) for r in once.collect()) == sorted(
        [("1", 0), ("2", 5), ("3", len(texts)), ("3", len(texts) + 3), ("None", 2 * len(texts)), ("9", 3000 * len(texts))]
    )
    near = P.drop_near_copies(spark, docs, "").collect()
    assert len({(r["doc_id"], r["text"]) for r in near}) == len(near) < 7
    assert P.mix_sources(spark, docs, "").columns == docs.columns
    empty = make([])
    for _, stage in P.STAGES:
        assert stage(spark, empty, "").collect() == []


def test_run(spark):
    rows = P.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and set(rows[0].asDict()) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
