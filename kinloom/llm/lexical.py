"""Ranked lexical search with norm buckets (LEMP).

A document is a vector of impacts over the terms that any query uses, a query a vector of term
weights, and a score is their inner product. Documents are ordered by the length of their
vectors and cut into buckets. For a query with k-th best score t, a bucket of greatest length l
is left out where |query| * l < t (Cauchy-Schwarz), and with it all shorter ones. Inside a
bucket the heaviest coordinates of the query come first: what the others can still add is at
most the product of the two remaining lengths, so most documents fall after a few coordinates.
Survivors are scored again, exactly, in integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.llm.common import documents, register, settled, shipped, stored, text_or_empty
from kinloom.plans.registry import table

K = 50
BUCKET = 4096  # documents of a bucket
PART = 32_768  # documents of a task, about
BLOCK_TERMS = 1 << 19  # query terms that meet a part of the documents in one task, about

# Everything in ASCII but letters and digits parts terms; A-Z count as a-z. Other characters
# have bytes from 128 on only, and belong to terms.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)
LENGTH = ""  # no term: stands for the number of all terms of a text


def term_rows(batches: Iterator[pd.DataFrame], with_length: bool) -> Iterator[pd.DataFrame]:
    """One row for each text (row, id, text in bytes): its distinct terms and how often each occurs."""
    for batch in batches:
        terms, counts = [], []
        for text in batch["text"]:
            words = bytes(text).translate(FOLD).split()
            found = Counter(words)
            if with_length and words:
                found[LENGTH.encode()] = len(words)
            terms.append([t.decode("utf-8", "replace") for t in found])
            counts.append([*found.values()])
        yield pd.DataFrame({"row": batch["row"], "id": batch["id"], "terms": terms, "counts": counts})


def with_rows(df: DataFrame, key: str) -> DataFrame:
    """``key`` and text in bytes, with a number for each row that a repeated read gives again."""
    return df.select(F.col(key).cast("long").alias("id"), F.encode(text_or_empty(), "UTF-8").alias("text")).withColumn(
        "row", F.monotonically_increasing_id()
    )


def impact(tf: Column, m: Column) -> Column:
    """floor(10^9 tf / (1000 tf + 20 m))."""
    top = F.lit(1_000_000_000).cast("long") * tf
    return F.call_function("div", top, F.lit(1000).cast("long") * tf + F.lit(20).cast("long") * m)


def vocabulary(item_terms: DataFrame) -> DataFrame:
    """(term, tid) of every term that a query uses; tid -1 stands for the length."""
    used = item_terms.select("term").distinct().withColumn("tid", F.monotonically_increasing_id())
    length = item_terms.sparkSession.createDataFrame([(LENGTH, -1)], "term string, tid long")
    return stored(used.union(length))


def document_vectors(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(row, id, n, v) of every text with a term: n its terms, v its (tid, tf) among the queries' terms."""
    rows = with_rows(docs, "doc_id")
    made = rows.mapInPandas(
        lambda batches: term_rows(batches, True), "row long, id long, terms array<string>, counts array<int>"
    )
    single = made.select("row", "id", F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    known = single.select("row", "id", F.col("x.terms").alias("term"), F.col("x.counts").alias("tf")).join(words, "term")
    whole = known.groupBy("row", "id").agg(F.collect_list(F.struct("tid", "tf")).alias("v"))
    return stored(
        whole.select(
            "row",
            "id",
            F.filter("v", lambda x: x["tid"] < 0)[0]["tf"].cast("long").alias("n"),
            F.filter("v", lambda x: x["tid"] >= 0).alias("v"),
        )
    )


def query_vectors(item_terms: DataFrame, words: DataFrame, vectors: DataFrame, n_docs: int) -> DataFrame:
    """(row, tids, weights) of every query; a term that no document holds, or that weighs 0, is left out."""
    frequent = vectors.select(F.explode("v.tid").alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    ratio = F.lit(2 * n_docs + 2).cast("double") / (F.lit(2).cast("long") * F.col("df") + 1)
    weights = frequent.select("tid", F.floor(F.lit(1000.0) * F.log(ratio)).alias("w")).where("w > 0")
    mine = item_terms.select("row", "term").join(words, "term").join(weights, "tid")
    return mine.groupBy("row").agg(F.collect_list(F.struct("tid", "w")).alias("q")).select(
        "row", F.col("q.tid").alias("tids"), F.col("q.w").alias("weights")
    )


class Bucket:
    """The vectors of some documents, by document and by coordinate."""

    def __init__(self, tids: np.ndarray, imps: np.ndarray, sizes: np.ndarray, norms: np.ndarray):
        self.coords, self.at = np.unique(tids, return_inverse=True)
        self.imps, self.sizes, self.norms = imps, sizes, norms
        self.starts = np.cumsum(sizes) - sizes
        by = np.argsort(self.at, kind="stable")
        self.list_docs = np.repeat(np.arange(len(sizes)), sizes)[by]
        self.list_imps = imps[by].astype(np.float64)
        self.list_starts = np.searchsorted(self.at[by], np.arange(len(self.coords) + 1))

    def survivors(self, tids: np.ndarray, weights: np.ndarray, least: int) -> np.ndarray:
        """Documents whose score may reach ``least``. ``weights`` fall; all coordinates lie in the bucket.

        The margin of 1e-9 keeps rounding on the safe side.
        """
        if least <= 0:
            return np.arange(len(self.sizes))
        rest = np.sqrt(np.append(np.cumsum((weights[::-1].astype(np.float64)) ** 2)[::-1], 0.0))
        enough = least * (1 - 1e-9)
        alive = np.flatnonzero(self.norms * rest[0] >= enough)
        done, squares = np.zeros(len(self.sizes)), np.zeros(len(self.sizes))
        f, step = 0, 4
        while len(alive) > 16 and f < len(tids):
            for c in range(f, min(f + step, len(tids))):
                part = slice(self.list_starts[tids[c]], self.list_starts[tids[c] + 1])
                seen, imps = self.list_docs[part], self.list_imps[part]
                done[seen] += weights[c] * imps
                squares[seen] += imps * imps
            f, step = min(f + step, len(tids)), step * 2
            left = np.sqrt(np.maximum(self.norms[alive] ** 2 * (1 + 1e-9) - squares[alive], 0.0))
            alive = alive[done[alive] + rest[f] * left >= enough]
        return alive

    def scores(self, docs: np.ndarray, tids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of ``docs``, in integers."""
        heavy = np.zeros(len(self.coords), np.int64)
        heavy[tids] = weights
        sizes = self.sizes[docs]
        first = np.cumsum(sizes) - sizes
        cells = np.repeat(self.starts[docs] - first, sizes) + np.arange(sizes.sum())
        return np.add.reduceat(heavy[self.at[cells]] * self.imps[cells], first)


def best(score: np.ndarray, has: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; equal ones by id, rows without an id last."""
    if len(score) > 4 * k:
        # Only scores that reach the k-th can be among them.
        places = np.flatnonzero(score >= np.partition(score, -k)[-k])
    else:
        places = np.arange(len(score))
    order = np.lexsort((ids[places], ~has[places], -score[places]))
    return places[order[:k]]


FOUND = "row long, has boolean, id long, score long"


def search_part(docs: pd.DataFrame, queries: pd.DataFrame, k: int, bucket: int) -> pd.DataFrame:
    """The k best documents of a part for each query; buckets come by falling length."""
    found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    if len(docs) and len(queries):
        docs = docs.iloc[np.argsort(-docs["norm"].to_numpy(), kind="stable")]
        norms, has, ids = docs["norm"].to_numpy(), docs["has"].to_numpy(bool), docs["id"].to_numpy(np.int64)
        asked = []
        for row, tids, weights, least in zip(queries["row"], queries["tids"], queries["weights"], queries["least"]):
            heavy = np.argsort(-np.asarray(weights, np.int64), kind="stable")
            asked.append((row, np.asarray(tids, np.int64)[heavy], np.asarray(weights, np.int64)[heavy], int(least)))
        top = {a[0]: (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), a[3]) for a in asked}
        for start in range(0, len(docs), bucket):
            # A query is over where Cauchy-Schwarz prunes the bucket: later ones are shorter.
            asked = [a for a in asked if math.sqrt(float((a[2].astype(float) ** 2).sum())) * norms[start] >= top[a[0]][3] * (1 - 1e-9)]
            if not asked:
                break
            own = docs.iloc[start : start + bucket]
            here = Bucket(
                np.concatenate(own["tids"].to_list()).astype(np.int64),
                np.concatenate(own["imps"].to_list()).astype(np.int64),
                own["tids"].map(len).to_numpy(np.int64),
                norms[start : start + bucket],
            )
            for row, tids, weights, _ in asked:
                score, known, id_, least = top[row]
                at = np.minimum(np.searchsorted(here.coords, tids), len(here.coords) - 1)
                inside = here.coords[at] == tids
                if not inside.any():
                    continue
                alive = here.survivors(at[inside], weights[inside], least)
                if not len(alive):
                    continue
                exact = here.scores(alive, at[inside], weights[inside])
                alive, exact = alive[exact > 0], exact[exact > 0]
                score = np.append(score, exact)
                known, id_ = np.append(known, has[start + alive]), np.append(id_, ids[start + alive])
                kept = best(score, known, id_, k)
                score, known, id_ = score[kept], known[kept], id_[kept]
                top[row] = score, known, id_, max(least, int(score[-1])) if len(score) == k else least
        found = [(row, *t[:3]) for row, t in top.items() if len(t[0])]
    if not found:
        return pd.DataFrame({"row": [], "has": [], "id": [], "score": []}).astype(
            {"row": "int64", "has": "bool", "id": "int64", "score": "int64"}
        )
    return pd.DataFrame(
        {
            "row": np.repeat([f[0] for f in found], [len(f[1]) for f in found]),
            "has": np.concatenate([f[2] for f in found]),
            "id": np.concatenate([f[3] for f in found]),
            "score": np.concatenate([f[1] for f in found]),
        }
    )


def search(docs: DataFrame, items: DataFrame, k: int = K, bucket: int = BUCKET, part_rows: int = PART) -> DataFrame:
    """The ``k`` documents with the highest score above 0 for each item: item_id, rank, doc_id, score.

    Equal scores rank by doc_id; documents without one come last. Null and empty texts have no
    terms: such documents count for nothing, such items return nothing. Repeated rows of
    documents are documents of their own; items that repeat id and text are asked once, items
    that share an id and differ in text are asked one by one. Ids are integers. Other columns
    are not looked at; without documents or items there is no row.

    Documents are dealt to parts by falling length of their vectors (ties by row, so copies
    spread). The longest part goes first; its k-th best scores are what the others start from.
    Items meet the parts in blocks of terms; a task holds one part and one block.
    """
    asked = stored(
        items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
        .dropDuplicates()
        .withColumn("row", F.monotonically_increasing_id())
    )
    in_bytes = asked.select("row", F.lit(None).cast("long").alias("id"), F.encode("text", "UTF-8").alias("text"))
    item_terms = stored(
        in_bytes.mapInPandas(lambda b: term_rows(b, False), "row long, id long, terms array<string>, counts array<int>")
        .select("row", F.explode("terms").alias("term"))
    )
    words = vocabulary(item_terms)
    vectors = document_vectors(docs, words)
    n_docs, total = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0).cast("long"))).first()
    queries = settled(query_vectors(item_terms, words, vectors, n_docs))
    n_terms = queries.agg(F.coalesce(F.sum(F.size("tids")), F.lit(0))).first()[0]
    blocks, parts = max(1, -(-n_terms // BLOCK_TERMS)), max(1, -(-n_docs // part_rows))

    m = F.lit(50).cast("long") + F.call_function("div", F.lit(50 * n_docs).cast("long") * F.col("n"), F.lit(max(1, total)).cast("long"))
    weighed = vectors.where(F.size("v") > 0).withColumn("m", m).select(
        "row",
        F.col("id").isNotNull().alias("has"),
        F.coalesce("id", F.lit(0).cast("long")).alias("id"),
        F.col("v.tid").alias("tids"),
        F.transform("v", lambda x: impact(x["tf"], F.col("m"))).alias("imps"),
    )
    square = F.aggregate("imps", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    ranged = weighed.withColumn("norm", F.sqrt(square)).repartitionByRange(parts, F.desc("norm"), "row")
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()))
    last = ranged.agg(F.max("part")).first()[0]
    if last is None:
        last = 0

    def wave(chosen: DataFrame, low: int, high: int, known: DataFrame) -> DataFrame:
        block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        left = chosen.withColumn("block", block)
        right = known.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn(
            "part", F.explode(F.sequence(F.lit(low), F.lit(high)))
        )
        keys = ["part", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
            lambda own, queries: search_part(own, queries, k, bucket), FOUND
        )

    none = F.lit(0).cast("long")
    first = settled(wave(ranged.where(F.col("part") == 0), 0, 0, queries.withColumn("least", none)))
    found = first
    if last > 0:
        reached = first.groupBy("row").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("c")).where(F.col("c") == k)
        seeded = queries.join(reached, "row", "left").select("row", "tids", "weights", F.coalesce("low", none).alias("least"))
        found = first.union(wave(ranged.where(F.col("part") > 0), 1, last, seeded))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.desc("has"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("row", "item_id"), "row").select(
        "item_id", "rank", F.when(F.col("has"), F.col("id")).alias("doc_id"), "score"
    )


shipped(__name__)

_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t FROM benchmark),
s AS (SELECT count(*) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
tf AS (SELECT doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY doc_id, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY t),
p AS (SELECT i.item_id, tf.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (50 + (50 * tf.n * s.n) // s.l)))) AS BIGINT) AS score
      FROM i JOIN tf USING (t) JOIN w USING (t), s GROUP BY i.item_id, tf.doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""


@register("op11_norm_buckets", _SQL)
def op11_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
