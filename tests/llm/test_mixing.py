from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.llm.mixing import mix, rounded


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return {**capped, **share}
        capped.update({s: most * sizes[s] for s in above})


def check(rows, texts_by_source):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {s: sum(words(t) for t in texts) for s, texts in texts_by_source.items()}
    want = brute_targets(sizes)
    taken, parts = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in rows:
        s = r["source"]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["copies"] * r["size"] + r["part_words"]
        taken[s] += r["taken"]
        parts[s] += r["part_words"] > 0
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
        assert parts[s] <= 1


def by_source(docs):
    out = {}
    for r in docs.collect():
        out.setdefault(r["source"], []).append(r["text"])
    return out


@pytest.mark.parametrize("group_rows", [3, 4096])
def test_corpus(corpus, group_rows):
    rows = mix(corpus, group_rows=group_rows).collect()
    assert len(rows) == corpus.count()
    check(rows, by_source(corpus))
    again = mix(corpus.repartition(5), group_rows=group_rows).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_odd_rows(make):
    data = [(None, None, None, "b"), (None, "x y", None, "b"), (1, "", None, None), (2, "one two", None, None), (2, "one two", None, None)]
    data += [(3, "w " * 50_000, None, "hot")] + [(10 + i, "a few words " * (i % 7), None, "hot") for i in range(60)]
    data += [(100 + i, "tiny", None, "a") for i in range(3)] + [(200, None, None, "nothing")]
    docs = make(data).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1)).withColumn("number", F.lit(1))
    rows = mix(docs, group_rows=8).collect()
    assert len(rows) == len(data)
    check(rows, by_source(docs))


def test_nothing(make):
    assert mix(make([])).collect() == []
    (row,) = mix(make([(1, None, None, "a")])).collect()
    assert (row["taken"], row["target"]) == (0, 0.0)


def test_rounding_keeps_sum_and_mean():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 50, 40)
    start = sizes * 0.37
    total = np.zeros(40)
    for _ in range(3000):
        out = rounded(sizes, start, rng.random(40))
        assert out.sum() == pytest.approx(start.sum())
        assert ((out > 0) & (out < sizes)).sum() <= 1
        total += out
    assert np.abs(total / 3000 / sizes - 0.37).max() < 0.05
