from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from kinloom.llm.near import blocks_for, components, link_entries, linked, near_duplicates, spanning_links


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits=4):
    """Smallest id reachable; fps as a numpy array, ids not null."""
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= bits) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return [min(groups[root(i)]) for i in range(len(ids))]


def flipped(rng, fp, k):
    for b in rng.choice(64, k, replace=False):
        fp ^= 1 << int(b)
    return fp


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    ids = sorted(texts)
    fps = np.array([brute_fingerprint(texts[i]) for i in ids], np.uint64)
    assert [got[i]["fingerprint"] for i in ids] == [f"{x:016x}" for x in fps.tolist()]
    assert [got[i]["component_id"] for i in ids] == brute_components(ids, fps)


@pytest.mark.parametrize("large", [16, 4096])
def test_links_of_crowded_fingerprints(spark, large):
    """Balls, chains across balls and far points; with small entries dealt to several tasks too."""
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(6):
        centre = int(rng.integers(2**63))
        ball = [flipped(rng, centre, int(rng.integers(1, 5))) for _ in range(150)]
        fps |= {centre, *ball}
        walk = centre
        for _ in range(15):
            walk = flipped(rng, walk, 4)
            fps.add(walk)
    fps |= {int(x) for x in rng.integers(0, 2**63, 300)} | {0, 1, 2**64 - 1}
    fps = np.array(sorted(fps), np.uint64)
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r["node"]: r["label"] for r in components(linked(nodes, len(fps), large=large)).collect()}
    signed = fps.view(np.int64).tolist()
    want = brute_components(signed, fps)
    assert [found.get(x, x) for x in signed] == want


def test_spanning_links_are_few():
    rng = np.random.default_rng(5)
    fps = np.array([flipped(rng, 12345, int(rng.integers(0, 5))) for _ in range(2000)], np.uint64)
    fps = np.unique(fps)
    i, j = spanning_links(fps, 4)
    assert len(i) < 2 * len(fps)
    assert (np.bitwise_count(fps[i] ^ fps[j]) <= 4).all()


def test_entry_across_batches():
    fps = np.arange(50, dtype=np.int64)
    keys = np.repeat([1, 2, 3], [5, 40, 5]).astype(np.int64)
    frames = [pd.DataFrame({"key": keys[i : i + 7], "fp": fps[i : i + 7]}) for i in range(0, 50, 7)]
    out = pd.concat(list(link_entries(iter(frames), 64, 20)))
    late = out[out.key.notna()]
    assert sorted(late.a) == list(range(5, 45))
    joined = out[out.key.isna()]
    assert set(joined.a) | set(joined.b) == set(range(5)) | set(range(45, 50))


def test_odd_rows(make):
    long = "some words that go on and on " * 20_000
    data = [(None, None), (5, ""), (6, " \n "), (1, "a"), (2, "A"), (2, "a"), (3, "a b c d"), (4, "\ta  B c\nD"), (7, "Ä b c d"), (8, "ä b c d")]
    data += [(20, long), (21, long)] + [(100 + i, "the same text as all others here") for i in range(40)]
    docs = make(data).withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1)).withColumn("component_id", F.lit(2))
    got = sorted((repr(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in near_duplicates(docs).collect())
    want = sorted((repr(i), f"{brute_fingerprint(t):016x}") for i, t in data)
    assert [x[:2] for x in got] == want
    component = {}
    for i, _, c in got:
        component.setdefault(i, c)
    assert component["None"] == component["5"] == component["6"] == 5
    assert component["1"] == component["2"] == 1
    assert component["3"] == component["4"] == 3
    assert component["20"] == component["21"] == 20
    assert {c for i, _, c in got if i.startswith("1") and len(i) == 3} == {100}


def test_empty(make):
    assert near_duplicates(make([])).collect() == []


def test_blocks():
    assert blocks_for(1000, 4) == 7
    assert blocks_for(10**10, 4) > 7
