from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinloom.llm.token_counts import TOKENIZER, TokenCache, count_tokens, counter, fetch, op9_token_cache, tokenizer_text


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def brute(library, rows):
    out = []
    for doc_id, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False))
        out.append((doc_id, len((text or "").encode()), n, n > 512))
    return sorted(out, key=repr)


def collected(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_tokens", "over_limit")) for r in df.collect()), key=repr)


DATA = [(None, "a null id"), (None, None), (1, None), (2, ""), (3, "x <|endoftext|> y"), (3, "x <|endoftext|> y"), (3, "other")]
DATA += [(4, "Ünï \U0001f600 \n\n\t z"), (5, "word " * 60_000), (6, "word " * 512), (7, "word " * 513)] + [(50 + i, "hot text") for i in range(40)]


def test_counts_and_cache(spark, make, library, tmp_path):
    cache = TokenCache(spark, str(tmp_path / "cache"))
    docs = make(DATA).withColumn("sha", F.lit("clash")).withColumn("n_tokens", F.lit(0)).withColumn("_rep", F.lit(0))
    assert collected(count_tokens(docs, cache)) == brute(library, DATA)
    stored = spark.read.parquet(cache.path).count()
    assert stored == len({t or "" for _, t in DATA})
    # A second batch encodes only what is new.
    more = [(100, "hot text"), (101, "new text"), (102, None)]
    assert collected(count_tokens(make(more), cache)) == brute(library, more)
    assert spark.read.parquet(cache.path).count() == stored + 1
    # A stored count is used, not computed again.
    key = spark.read.parquet(cache.path).first()["tokenizer"]
    odd = spark.range(1).select(F.unhex(F.sha2(F.lit("odd"), 256)).alias("sha"), F.lit(77).cast("long").alias("n_tokens"))
    cache.append(odd, key)
    assert collected(count_tokens(make([(1, "odd")]), cache)) == [(1, 3, 77, False)]


def test_other_tokenizer_is_another_key(spark, make, library, tmp_path):
    cache = TokenCache(spark, str(tmp_path / "cache"))
    docs = make([(1, "some text")])
    count_tokens(docs, cache).collect()
    other = tmp_path / "other.json"
    other.write_text(tokenizer_text(TOKENIZER) + "\n")
    count_tokens(docs, cache, str(other)).collect()
    assert spark.read.parquet(cache.path).select("tokenizer").distinct().count() == 2


def test_empty(spark, make, tmp_path):
    assert count_tokens(make([]), TokenCache(spark, str(tmp_path / "cache"))).collect() == []


def test_query(spark, library, corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    assert collected(op9_token_cache(spark, "/root/testdata/sf0.001")) == brute(library, rows)


def test_counter_on_every_code_point(library):
    """Pieces are cut as the library cuts them, whatever the character."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{x}b 1{x}2 {x} {x}{x}.{x}\n" for x in chars]
    texts = ["".join(texts[i : i + 64]) for i in range(0, len(texts), 64)]
    count = counter(tokenizer_text(TOKENIZER))
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = count(texts)
    assert [i for i, (a, b) in enumerate(zip(got, want)) if a != b] == []


def test_counter_on_special_strings_and_space(library):
    texts = ["<|endoftext|>", "a<|endoftext|> <|endoftext|><|endoftext|>b", "<|endoftext", "  \n\n  x   \t y  ", "it's  I'LL 'sx", ""]
    assert counter(tokenizer_text(TOKENIZER))(texts) == [len(library.encode(t, add_special_tokens=False)) for t in texts]


def test_texts_under_one_id_are_not_compared_in_pairs(spark, make):
    data = [(None if i % 2 else 7, f"text {i}") for i in range(600)]
    docs = make(data)
    misses = docs.select(F.unhex(F.sha2("text", 256)).alias("sha"), F.col("doc_id").alias("rep"))
    got = fetch(docs, misses)
    assert sorted(r["text"] for r in got.collect()) == sorted(t for _, t in data)
    joins = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "HashJoin [" in x]
    assert joins and all("_rep#" in x and "sha#" in x.split("], [")[0] for x in joins), joins
