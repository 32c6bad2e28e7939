from __future__ import annotations

import re

from pyspark.sql import functions as F

from kinloom.llm.quality import Rule, quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts(make):
    texts = [
        None,
        "",
        " \t\n ",
        "one two",
        "a b c a b c a b c",
        "a a a a a",
        "x\nx\n\n\ny\nx \n",
        "café \U0001f600\U0001f600 a|b <i>#1</i> $5 %",
        " ".join(f"w{i % 70}" for i in range(400)),
        " ".join(f"w{i}" for i in range(60)) + " z\x0bq",
    ]
    docs = make(list(enumerate(texts))).withColumn("n_words", F.lit("clash")).withColumn("w", F.lit(1)).withColumn("kept", F.lit(0))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in quality(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_verdict(make):
    good = " ".join(f"the word{i} and" for i in range(30))
    marked = " ".join(f"the wo{i}%%% and###" for i in range(30))
    docs = make([(1, good), (1, good), (2, marked), (None, None)])
    got = sorted((str(r["doc_id"]), r["kept"], list(r["failed_rules"])) for r in quality(docs).collect())
    assert got[0] == got[1] == ("1", True, [])
    assert got[2][1:] == (False, ["symbols"])
    assert got[3][1] is False
    only = quality(docs, (Rule("long", "n_words", high=10),)).where("doc_id = 1").first()
    assert not only["kept"] and list(only["failed_rules"]) == ["long"]
    assert quality(make([])).collect() == []


def test_corpus(corpus):
    rows = {r["doc_id"]: r for r in quality(corpus).collect()}
    for doc in corpus.orderBy("n_chars").limit(120).collect():
        assert tuple(rows[doc["doc_id"]][c] for c in COLUMNS) == brute(doc["text"])
