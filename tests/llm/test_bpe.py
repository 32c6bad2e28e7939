from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from kinloom.llm.bpe import RANKS, Settings, Vocabulary, decoded, encode, merged_by_heap, op7_byte_bpe, round_trip


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    None,
    "",
    " ",
    "a",
    "the quick brown fox's  jumps\n\n over   12345 dogs!!! ",
    "I'll we've don't it's I'd",
    "Ünïcödé straße 東京都 привет мир \U0001f600\U0001f680 é",
    "  x　y\x0b\x0cz\x85",
    "<|endoftext|> ###$$$%%% \t\t\n \n",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa abababababababab " + "x" * 300,
    "donaudampfschifffahrtsgesellschaft " * 40,
    "1234567890" * 30,
]


@pytest.mark.parametrize("table", [0, 50, 1 << 16])
def test_matches_the_library(spark, make, library, table):
    docs = make(list(enumerate(TEXTS)) + [(4, TEXTS[4])]).withColumn("ids", F.lit("clash")).withColumn("word", F.lit(1))
    vocabulary = Vocabulary(spark, settings=Settings(table_words=table))
    rows = encode(docs, vocabulary).select("doc_id", "ids", decoded(F.col("ids"), vocabulary).alias("back")).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        assert r["ids"] == library.encode_ordinary(text), text
        assert bytes(r["back"]).decode() == text


def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op7_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def check(spark, make, library, texts):
    with Vocabulary(spark, settings=Settings(table_words=50)) as vocabulary:
        found = encode(make(list(enumerate(texts))), vocabulary)
        rows = found.select("doc_id", "ids", decoded(F.col("ids"), vocabulary).alias("back")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["back"]).decode() == texts[r["doc_id"]]


def test_very_long_words_and_texts(spark, make, library):
    rng = random.Random(2)
    letters = "".join(rng.choice("abcdeth") for _ in range(1_000_000))
    texts = [
        letters,
        "x" * 200_000,
        "word " * 100_000,
        "short " + "0123456789" * 5_000 + " end",
        "a" + " " * 3_000 + "\n" * 2_000 + "b",
        "東京都" * 2_000 + " and " + "ab" * 499,
        "!?" * 700,
    ]
    check(spark, make, library, texts)


def test_every_code_point(spark, make, library):
    points = [*range(1, 0xD800), *range(0xE000, 0x110000)]
    step = 4096
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}b" for c in points[i : i + step : 3]) for i in range(0, len(points), step)]
    check(spark, make, library, texts)


def test_heap_equals_library(library):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    rng = random.Random(1)
    for _ in range(3000):
        word = "".join(rng.choice("abcdefghinorstué") for _ in range(rng.randint(1, 30)))
        assert merged_by_heap(word.encode(), ranks) == library.encode_ordinary(word)


def test_vocabularies_stay_apart(spark, make, tmp_path):
    """A second vocabulary, with single bytes only, does not change the first one's ids."""
    path = tmp_path / "bytes"
    path.write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(256)))
    docs = make([(1, "hello worlds")])
    with Vocabulary(spark) as first, Vocabulary(spark, str(path)) as second:
        late = round_trip(docs, first)
        assert [r["ids"] for r in encode(docs, second).collect()] == [list(b"hello worlds")]
        assert [r["ids"] for r in encode(docs, first).collect()] == [[675, 1913, 13401]]
    assert late.first()["n_tokens"] == 3


def test_empty_table_and_bad_file(spark, make, tmp_path):
    assert encode(make([]), Vocabulary(spark)).collect() == []
    path = tmp_path / "ranks"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        Vocabulary(spark, str(path))
