from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kinloom.llm import periods


def brute(words, least=6, times=4):
    """Every period on its own, straight from the definition."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i + q - start
            if i > start and size >= max(least, times * q):
                own = words[start : start + size]
                if not any(own[r:] == own[:-r] for r in range(1, q)):
                    found.append((start, size, q))
            i += 1
    return sorted(found)


def random_words(rng):
    n = rng.randint(0, 90)
    words = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        for i in range(a, n):
            words[i] = words[a + (i - a) % p]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        words = random_words(rng)
        assert periods.runs_of(words) == brute(words)
    for _ in range(500):
        words = [rng.randrange(2) for _ in range(rng.randint(0, 40))]
        assert periods.runs_of(words, 2, 2) == brute(words, 2, 2)


def test_screen_loses_no_run():
    rng = random.Random(6)
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randint(1, 12))]
        got = periods.batch_runs([[str(w).encode() for w in words] for words in texts])
        assert got == [brute(words) for words in texts]


def test_squares_of_a_very_long_text():
    unit = [f"w{i}" for i in range(3000)]
    words = [w.encode() for w in ["x", *unit * 5, "y", *["z"] * 9]]
    assert periods.batch_runs([words]) == [[(1, 15000, 3000), (15002, 9, 1)]]


def reference(doc_id, text):
    """The contract in plain Python."""
    words = [w for w in (text or "").encode().split()]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    return {
        "doc_id": doc_id,
        "n_runs": len(runs),
        "start": top[0],
        "length": top[1],
        "period": top[2],
        "exponent_milli": 1000 * top[1] // top[2] if runs else None,
        "runs_sha256": hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    }


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("periods"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") < 2500)
    edge = [
        (10**9, None),
        (10**9 + 1, ""),
        (10**9 + 2, " \n\t "),
        (10**9 + 3, "a b " * 9),
        (10**9 + 3, "a b " * 9),
        (10**9 + 4, "x  x\nx\tx x x"),
        (10**9 + 5, "é é " * 7),
        (10**9 + 6, "p q p q p q p q r r r r r r r"),
        (10**9 + 7, "a a a a a"),
    ]
    docs.select("doc_id", "text").union(spark.createDataFrame(edge, "doc_id long, text string")).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_query_equals_the_contract(spark, small):
    got = periods.op12_periodic_runs(spark, small).toPandas().astype(object)
    got = got.where(got.notna(), None)
    expected = [reference(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    names = list(expected[0])
    plain = [tuple(int(v) if isinstance(v, float) else v for v in r) for r in got[names].itertuples(index=False)]
    assert sorted(plain, key=repr) == sorted((tuple(r.values()) for r in expected), key=repr)
    assert sum(r["n_runs"] > 0 for r in expected) > 5


def test_columns_nulls_and_empty_table(spark):
    docs = spark.createDataFrame(
        [(None, "a a a a a a", "clash", "clash"), (1, None, "x", "y")], "doc_id long, text string, runs string, id string"
    )
    rows = {r.doc_id: r for r in periods.periodic_runs(docs).collect()}
    assert [tuple(x) for x in rows[None].runs] == [(0, 6, 1)] and rows[None].collapsed == "a"
    assert rows[1].n_words == 0 and rows[1].runs == [] and rows[1].collapsed == ""
    assert periods.periodic_runs(docs.limit(0)).collect() == []
    assert periods.with_planted_periods(docs).where("doc_id IS NULL").first().text == "a a a a a a"
