"""Repeated passages: runs of consecutive sentences found more than once in the corpus.

Every run of two or more sentences counts that has ``RUN_WORDS`` words, and so does a single
sentence with as many. A sentence that any repeated run covers is also covered by a repeated one
that is shortest from its first sentence or shortest up to its last: in a longer run the
shortest one from a sentence ends inside, or the shortest one up to the last sentence holds it.
So these, and the single sentences, are hashed; that finds what all runs would find.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import documents, register, settled, shipped, stored, text_or_empty

#: A sentence ends after . ! or ? with white space, or after a line break; it keeps that space.
SENTENCE = r"(?s).+?(?:[.!?][\x09-\x0D\x20]+|\n[\x09-\x0D\x20]*|\z)"
RUN_WORDS = 25  # words that a run needs


def sentences_of(text):
    """The sentences of a text; joined without anything between they are the text again."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def shortest_runs(sizes: np.ndarray, words: int) -> np.ndarray:
    """(first, last) of the runs to hash, from the number of words of each sentence."""
    n = len(sizes)
    before = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(n)
    # From each sentence: the first end that gives enough words, one sentence later at least.
    last = np.maximum(np.searchsorted(before, before[:-1] + words, "left") - 1, at + 1)
    # Up to each sentence: the last beginning that does, one sentence earlier at least.
    first = np.minimum(np.searchsorted(before, before[1:] - words, "right") - 1, at - 1)
    runs = np.concatenate(
        [
            np.stack([at, last], axis=1)[last < n],
            np.stack([first, at], axis=1)[first >= 0],
            np.stack([at, at], axis=1)[sizes >= words],
        ]
    )
    return np.unique(runs, axis=0)


def hashed(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    import xxhash

    sentence = re.compile(SENTENCE.replace(r"\z", r"\Z").encode())
    for batch in batches:
        rows, firsts, sizes, digests = [], [], [], []
        for place, text in enumerate(batch["text"]):
            cut = [s.split() for s in sentence.findall(text.lower().encode("utf-8", "surrogatepass"))]
            runs = shortest_runs(np.array([len(s) for s in cut], np.int64), words)
            if not len(runs):
                continue
            joined = [b" ".join(s) for s in cut]
            rows += [place] * len(runs)
            firsts.append(runs[:, 0])
            sizes.append(runs[:, 1] - runs[:, 0] + 1)
            digests += [xxhash.xxh3_128_digest(b" ".join(filter(None, joined[a : b + 1]))) for a, b in runs.tolist()]
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        none = [np.empty(0, np.int64)]
        yield pd.DataFrame(
            {
                "id": batch["id"].to_numpy()[rows],
                "doc": batch["doc"].to_numpy()[rows],
                "at": np.concatenate(firsts or none),
                "n": np.concatenate(sizes or none),
                "h1": both[:, 0],
                "h2": both[:, 1],
            }
        )


def runs(docs: DataFrame, words: int = RUN_WORDS) -> DataFrame:
    """One row for each run to hash: doc_id, doc (hash of id and text), at, n, h1, h2.

    Case and white space do not count. The two halves of a 128-bit hash stand for its words.
    """
    text = text_or_empty()
    picked = docs.select(F.col("doc_id").cast("string").alias("id"), F.xxhash64("doc_id", text).alias("doc"), text.alias("text"))
    made = picked.mapInPandas(lambda b: hashed(b, words), "id string, doc long, at int, n int, h1 long, h2 long")
    return made.withColumn("doc_id", F.col("id").cast(docs.schema["doc_id"].dataType)).drop("id")


def repeated_spans(docs: DataFrame, words: int = RUN_WORDS) -> DataFrame:
    """Every run that is found more than once, apart from its first place: doc_id, doc, at, n, first_doc_id.

    The first place is the smallest (doc_id, sentence). The runs are written once. Counts are
    combined before the shuffle; hot runs are joined back by their hashes, where skew is split
    at run time.
    """
    keys = ["h1", "h2"]
    every = stored(runs(docs, words))
    again = stored(every.groupBy(*keys).count().where(F.col("count") > 1).drop("count"))
    places = stored(every.join(again, keys))
    place = F.struct("doc_id", "doc", "at")
    first = settled(places.groupBy(*keys).agg(F.min(place).alias("first")))
    return (
        places.join(first, keys)
        .where(~place.eqNullSafe(F.col("first")))
        .select("doc_id", "doc", "at", "n", F.col("first.doc_id").alias("first_doc_id"))
    )


def without_repeats(docs: DataFrame, words: int = RUN_WORDS) -> DataFrame:
    """The documents that lose sentences, with the text that is left.

    A sentence goes if a run of ``words`` words that covers it (two sentences or more, or one
    alone) stands anywhere before; shorter repeated runs stay.

    Returns doc_id, n_sentences, n_removed, spans (ranges of removed sentences), first_doc_ids
    (where the removed runs stand first) and text. Documents that lose none are not returned:
    null, empty and short texts, and any text without a repeated run. Rows that repeat doc_id
    and text are the same document; rows with equal ids and different texts are not. Columns
    other than ``doc_id`` and ``text`` are not looked at; an empty table gives no row.
    """
    found = repeated_spans(docs, words)
    # A document's own spans: their number is bounded by its sentences.
    per = settled(
        found.groupBy("doc").agg(
            F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)))).alias("gone"),
            F.sort_array(F.collect_set("first_doc_id")).alias("first_doc_ids"),
        )
    )
    texts = docs.select("doc_id", F.xxhash64("doc_id", text_or_empty()).alias("doc"), text_or_empty().alias("text"))
    cut = texts.join(per.hint("shuffle_hash"), "doc").select("doc_id", "first_doc_ids", "gone", sentences_of(F.col("text")).alias("s"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("s") - 1), F.col("gone"))
    ordered = cut.select("*", F.sort_array("gone").alias("g"), kept.alias("kept"))
    starts = F.filter("g", lambda x, i: (i == 0) | (F.get("g", i - 1) != x - 1))
    ends = F.filter("g", lambda x, i: (i == F.size("g") - 1) | (F.get("g", i + 1) != x + 1))
    return ordered.select(
        "doc_id",
        F.size("s").cast("long").alias("n_sentences"),
        F.size("g").cast("long").alias("n_removed"),
        F.arrays_zip(starts.alias("first"), ends.alias("last")).alias("spans"),
        "first_doc_ids",
        F.array_join(F.transform("kept", lambda i: F.get("s", i)), "").alias("text"),
    )


shipped(__name__)

_SQL = rf"""
WITH s AS (SELECT doc_id, p, unnest(p) AS x, unnest(range(len(p))) AS i FROM
     (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SENTENCE}') AS p FROM documents)),
w AS (SELECT doc_id, i, x, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '') AS ws FROM s),
c AS (SELECT doc_id, i, x, lower(array_to_string(ws, ' ')) AS t, len(ws) AS k,
      sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY i) AS cum FROM w),
z AS (SELECT a.doc_id, a.i, min(b.i) AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i > a.i AND b.i <= a.i + {RUN_WORDS}
      AND b.cum - a.cum + a.k >= {RUN_WORDS} GROUP BY a.doc_id, a.i
      UNION SELECT b.doc_id, max(a.i), b.i FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i > a.i AND b.i <= a.i + {RUN_WORDS}
      AND b.cum - a.cum + a.k >= {RUN_WORDS} GROUP BY b.doc_id, b.i
      UNION SELECT doc_id, i, i FROM c WHERE k >= {RUN_WORDS}),
r AS (SELECT z.doc_id, z.i, z.last, string_agg(c.t, ' ' ORDER BY c.i) FILTER (WHERE c.t <> '') AS run
      FROM z JOIN c ON c.doc_id = z.doc_id AND c.i BETWEEN z.i AND z.last GROUP BY z.doc_id, z.i, z.last),
n AS (SELECT *, count(*) OVER (PARTITION BY run) AS m, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM r),
gone AS (SELECT DISTINCT c.doc_id, c.i FROM n JOIN c ON c.doc_id = n.doc_id AND c.i BETWEEN n.i AND n.last WHERE m > 1 AND nth > 1)
SELECT c.doc_id, count(*) AS n_sentences, count(gone.i) AS n_removed,
       coalesce(string_agg(c.x, '' ORDER BY c.i) FILTER (WHERE gone.i IS NULL), '') AS text
FROM c LEFT JOIN gone ON gone.doc_id = c.doc_id AND gone.i = c.i GROUP BY c.doc_id HAVING count(gone.i) > 0"""


@register("op8_sentence_spans", _SQL)
def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_sentences", "n_removed", "text")
