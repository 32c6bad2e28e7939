from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from kinloom.llm.spans import RUN_WORDS, without_repeats


def sentences(text):
    return re.findall(r"(?s).+?(?:[.!?][\x09-\x0D\x20]+|\n[\x09-\x0D\x20]*|\Z)", text or "")


def brute(rows, most=40):
    """Every run of sentences (``most`` at most) with enough words. Texts with a loss: {(doc_id, text): (n, removed, rest)}."""
    seen, gone = {}, {}
    for doc_id, text in sorted(set(rows), key=lambda r: r[0]):
        parts = [re.findall(r"[^\x20\x09-\x0D]+", s) for s in sentences(text)]
        for i in range(len(parts)):
            words = []
            for j in range(i, min(len(parts), i + most)):
                words = words + parts[j]
                if len(words) >= RUN_WORDS:
                    seen.setdefault(" ".join(words).lower(), []).append((doc_id, text, i, j))
    for places in seen.values():
        for doc_id, text, i, j in places[1:]:
            gone.setdefault((doc_id, text), set()).update(range(i, j + 1))
    out = {}
    for key, lost in gone.items():
        s = sentences(key[1])
        out[key] = (len(s), len(lost), "".join(x for i, x in enumerate(s) if i not in lost))
    return out


def check(docs, rows):
    found = without_repeats(docs).collect()
    got = [(r["doc_id"], r["n_sentences"], r["n_removed"], r["text"]) for r in found]
    lost = brute(rows)
    assert sorted(got, key=repr) == sorted(((k[0], *lost[k]) for k in rows if k in lost), key=repr)
    return found


def test_corpus(corpus):
    short = corpus.where(F.length("text") < 8000)
    assert len(check(short, [(r["doc_id"], r["text"]) for r in short.collect()])) > 10


PASSAGE = " ".join(f"This is sentence number {i} of the passage." for i in range(8)) + " "


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n)) + ". "


def test_odd_rows(make):
    long = " ".join(f"Sentence {i} has its own words {i * 7} here." for i in range(1500)) + " "
    lone = words("w", 60).strip()
    data = [
        (1, None), (2, ""), (3, "\n\n"), (4, "Short. Text."), (5, "Short. Text."),
        (10, "Own start. " + PASSAGE + "Own end."), (11, "Other start! " + PASSAGE.upper() + "Other end."),
        (12, PASSAGE + PASSAGE), (12, "Another text with the same id. " + PASSAGE), (13, "  " + PASSAGE.replace(" ", "\t")),
        (20, lone), (21, lone + "\nmore"), (30, long + PASSAGE), (31, long),
    ]
    data += [(100 + i, f"Text {i}. " + PASSAGE) for i in range(40)]
    docs = make(data).withColumn("doc", F.lit("clash")).withColumn("gone", F.lit(1)).withColumn("h1", F.lit(1))
    got = check(docs, data)
    ids = {r["doc_id"] for r in got}
    assert not ids & {1, 2, 3, 4, 5, 10, 20}
    assert {11, 12, 13, 21, 31, 139} <= ids
    assert [r["text"] for r in got if r["doc_id"] == 11] == ["Other start! Other end."]
    assert {tuple(r["first_doc_ids"]) for r in got if r["doc_id"] == 21} == {(20,)}


def test_sentences_between_other_neighbours(make):
    data = [
        (1, words("a", 9) + words("mid", 40) + words("b", 9)),
        (2, words("c", 9) + words("mid", 40) + words("d", 9)),
        (3, words("e", 30) + words("p", 60) + words("q", 40) + words("f", 30)),
        (4, words("g", 30) + words("p", 60) + words("q", 40) + words("h", 30)),
        (5, words("i", 30) + words("r", 30) + words("s", 5) + words("j", 30)),
        (6, words("k", 30) + words("r", 30) + words("s", 5) + words("l", 30)),
        (7, words("m", 30) + words("t", 5) + words("u", 30) + words("n", 30)),
        (8, words("o", 30) + words("t", 5) + words("u", 30) + words("x", 30)),
    ]
    removed = {r["doc_id"]: r["n_removed"] for r in check(make(data), data)}
    assert removed == {2: 1, 4: 2, 6: 2, 8: 2}


def test_random_texts_equal_all_runs(make):
    rng = random.Random(3)
    pool = [words(f"s{i}x", rng.randint(1, 14)) for i in range(30)]
    data = [(i, "".join(rng.choice(pool) if rng.random() < 0.7 else words(f"u{i}y{k}", 3) for k in range(rng.randint(0, 20)))) for i in range(40)]
    for i in range(12):
        a = rng.randrange(20)
        data.append((100 + i, words(f"z{i}", 4) + "".join(pool[a : a + 6]) + words(f"v{i}", 4)))
    check(make(data), data)


def test_empty(make):
    assert without_repeats(make([])).collect() == []
    assert without_repeats(make([(1, PASSAGE)])).collect() == []
