from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.llm.exact import FuseFilter, by_hash, dedup


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 10, 100, 1000, 50_000])
def test_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    made = FuseFilter.of(keys)
    assert made.holds(keys).all()
    others = rng.integers(2**63, 2**64, 100_000, dtype=np.uint64)
    assert made.holds(others).mean() < 1e-3
    if n == 50_000:
        assert made.table.nbytes < 2.6 * n


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]  # None == None where all are null
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("batches", [1, 3])
def test_odd_rows(make, batches):
    data = [(None, "n"), (None, None), (1, None), (2, ""), (3, "a"), (4, "a"), (4, "a"), (4, "b"), (5, "b "), (6, "B")]
    data += [(100 + i, "hot") for i in range(60)] + [(300, "long " * 40_000), (301, "long " * 40_000), (302, "long " * 40_000 + "x")]
    docs = make(data).withColumn("sha", F.lit("clash")).withColumn("batch", F.lit("x")).withColumn("kept", F.lit(0))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in dedup(docs, by_hash(batches)).collect()), key=repr)
    assert got == brute(data)


def test_null_ids_across_batches(make):
    data = [(None, "t"), (None, "u"), (None, "u"), *[(i, "t") for i in range(8)]]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in dedup(make(data), by_hash()).collect()), key=repr)
    assert got == brute(data)


def test_empty(make):
    assert dedup(make([]), by_hash()).collect() == []


def test_corpus(corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in dedup(corpus, by_hash()).collect()), key=repr)
    assert got == brute(rows)


def test_many_texts_without_an_id(spark, make):
    """Rows without an id, and many texts under one id, are fetched by their digests."""
    from kinloom.llm.exact import by_hash, dedup

    data = [(None, f"text {i % 150}") for i in range(300)] + [(7, f"text {i}") for i in range(100, 260)]
    found = dedup(make(data), by_hash()).collect()
    sizes = {}
    for _, text in data:
        sizes[text] = sizes.get(text, 0) + 1
    import hashlib

    by_sha = {hashlib.sha256(t.encode()).hexdigest(): (n, 7 if int(t.split()[1]) >= 100 else None) for t, n in sizes.items()}
    assert len(found) == len(data)
    assert all((r["group_size"], r["keep_id"]) == by_sha[r["text_sha256"]] for r in found)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in found)
