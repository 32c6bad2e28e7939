from __future__ import annotations

import random

import numpy as np
import pytest

from kinloom.llm import minhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = (text or "").translate(UPPER).encode().split()
    if not words:
        return frozenset()
    if len(words) < 2:
        return frozenset([tuple(words)])
    return frozenset(zip(words, words[1:]))


def brute(docs):
    """All pairs, then the smallest id of each component."""
    sets = [shingles(text) for _, text in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(
        ((doc_id, len(sets[i]), least.get(top(i)), doc_id == least.get(top(i))) for i, (doc_id, _) in enumerate(docs)), key=repr
    )


def rows(found):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()), key=repr)


def family(rng, n, words, changed, first):
    """Variants of one text at random distances, so that links are not transitive."""
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changed)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append((first + i, " ".join(own)))
    rng.shuffle(out)
    return out


def test_corpus_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    expected = brute(plain)
    assert rows(minhash.near_duplicates(docs)) == expected
    assert sum(not r[3] for r in expected) > 5


@pytest.mark.parametrize("size", [512, 6])
def test_families_equal_brute_force(spark, make, size):
    """Chains, variants that only meet through others, and entries that are dealt to several tasks."""
    rng = random.Random(8)
    docs = []
    for k in range(14):
        docs += family(rng, 14, rng.randint(30, 120), rng.randint(3, 16), 1000 * k)
    assert rows(minhash.near_duplicates(make(docs), size=size)) == brute(docs)


def test_edge_rows(spark, make):
    docs = [
        (1, None),
        (2, ""),
        (3, " \n\t"),
        (4, "One"),
        (5, "one"),
        (6, "one two"),
        (6, "one two"),
        (7, "ONE  two\n"),
        (8, "one two one two one"),
        (9, "long word " * 30_000),
        (10, "word long " * 40_000),
        (11, "Ä ä"),
        (12, "ä ä"),
    ]
    assert rows(minhash.near_duplicates(make(docs).withColumnRenamed("lang", "node"))) == brute(docs)
    assert minhash.near_duplicates(make([])).collect() == []
    null = {(r.component_id, r.kept) for r in minhash.near_duplicates(make([(None, "a b c"), (None, "a b c")])).collect()}
    assert null == {(None, True)}
    mixed = rows(minhash.near_duplicates(make([(None, "a b c"), (5, "a b c")])))
    assert mixed == [(5, 2, 5, True), (None, 2, 5, False)]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(300 + i, 300 + (i + 7) % 31) for i in range(31)]
    names = {n: bytes([rng.randrange(256) for _ in range(4)]) + n.to_bytes(2, "big") for e in edges for n in e}
    links = spark.createDataFrame([(bytearray(names[a]), bytearray(names[b])) for a, b in edges], "a binary, b binary")
    got = {bytes(r.node): bytes(r.label) for r in minhash.star_components(links).collect()}
    groups = [range(61), range(100, 140), range(300, 331)]
    for group in groups:
        own = [names[n] for n in group if n in names]
        assert {got[n] for n in own if n in got} == {min(n for n in own if n in got)}


def test_chance_to_miss():
    """Pairs at the threshold meet in a band and pass the signature check."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 450).astype(np.uint64)
        a, b = np.unique(pool[:405]), np.unique(pool[45:])
        x, y = (np.frombuffer(minhash.minima(s), "<u4") for s in (a, b))
        assert minhash.similar(a.tobytes(), b.tobytes(), 80)
        assert (x == y).sum() >= minhash.AGREE and (x == y).reshape(-1, minhash.ROWS).all(axis=1).any()
    assert not minhash.similar(a.tobytes(), b.tobytes(), 81)
