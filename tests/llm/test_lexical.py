from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from kinloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k):
    """Every document scored for every item."""
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counted = [(doc_id, c) for doc_id, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counted:
            m = 50 + (50 * sum(c.values()) * n) // total
            score = 0
            for t in set(terms(text)):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id if doc_id is not None else 0, doc_id))
        for rank, (score, _, _, doc_id) in enumerate(sorted(scored)[:k], 1):
            out.append((item_id, rank, doc_id, -score))
    return sorted(out, key=repr)


def rows(found):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    base = "/root/testdata/sf0.001"
    return spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/benchmark.parquet")


@pytest.mark.parametrize("bucket, part_rows, block", [(4096, 32_768, 1 << 19), (16, 40, 60)])
def test_equals_brute_force(tables, monkeypatch, bucket, part_rows, block):
    docs, items = tables
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    got = rows(lexical.search(docs, items, 10, bucket, part_rows))
    plain_docs = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == brute(plain_docs, [(r.item_id, r.text) for r in items.collect()], 10)


def test_edge_rows(spark):
    docs = [
        (3, "Alpha beta, gamma"),
        (1, "alpha BETA gamma"),
        (1, "alpha BETA gamma"),
        (None, "alpha beta gamma"),
        (2, None),
        (4, ""),
        (5, "... !!"),
        (6, "Ünïcode x1 alpha " * 3000),
        (7, "delta"),
        (8, "Ä ä KK"),
    ]
    items = [(1, "alpha alpha gamma"), (2, None), (3, "?!"), (4, "ünïcode x1"), (5, "zzz"), (1, "alpha alpha gamma"), (6, "ä kK")]
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, score string")
    it = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, rank int")
    assert rows(lexical.search(df, it, 5)) == brute(docs, list(dict.fromkeys(items)), 5)
    assert lexical.search(df.limit(0), it).collect() == []
    assert lexical.search(df, it.limit(0)).collect() == []


def test_pruning_loses_nothing_and_prunes():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 40, 3000)
    tids = np.concatenate([rng.choice(400, s, replace=False) for s in sizes]).astype(np.int64)
    imps = rng.integers(1, 900_000, len(tids))
    starts = np.cumsum(sizes) - sizes
    norms = np.sqrt(np.add.reduceat(imps.astype(float) ** 2, starts))
    bucket = lexical.Bucket(tids, imps, sizes, norms)
    query = rng.choice(400, 30, replace=False)
    weights = np.sort(rng.integers(1, 9000, 30))[::-1]
    at = np.searchsorted(bucket.coords, query)
    every = bucket.scores(np.arange(3000), at, weights)
    least = int(np.sort(every)[-20])
    left = bucket.survivors(at, weights, least)
    assert set(np.flatnonzero(every >= least)) <= set(left) and len(left) < 300
