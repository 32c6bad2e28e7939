from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinloom.llm.sharding import PRIME, SHARDS, permuted, round_keys, shard, sides


def brute_place(x: int, n: int, seed: int) -> int:
    a, b = sides(n)
    while True:
        left, right = divmod(x, b)
        for i, (k, y) in enumerate(round_keys(seed)):
            once = (right + k) % PRIME
            f = (once * once % PRIME + once * (y % 65_536) + y) % PRIME
            left, right = right, (left + f) % (a, b)[i % 2]
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), n, 5)).collect()]
    assert got == [brute_place(i, n, 5) for i in range(n)]
    assert sorted(got) == list(range(n))


def test_shards_of_corpus(corpus):
    rows = shard(corpus).collect()
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    order = sorted(texts)
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["row_number"])] == order
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        place = brute_place(r["row_number"], len(rows), 20240229)
        assert (r["shard"], r["slot"]) == (place % SHARDS, place // SHARDS)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_odd_rows(make):
    docs = make([(None, None), (3, ""), (3, ""), (3, None), (4, "ü" * 50_000), (5, "x")] + [(9, "same")] * 20)
    docs = docs.withColumn("row_number", F.lit(1)).withColumn("shard", F.lit("x")).withColumn("place", F.lit(0))
    rows = shard(docs, shards=4).collect()
    assert len(rows) == 26
    assert sorted(r["row_number"] for r in rows) == list(range(26))
    assert {(r["shard"], r["slot"]) for r in rows} == {(i % 4, i // 4) for i in range(26)}
    assert [r["size"] for r in rows if r["doc_id"] is None] == [16]
    assert [r["size"] for r in rows if r["doc_id"] == 4] == [100_016]


def test_empty(make):
    assert shard(make([])).collect() == []
