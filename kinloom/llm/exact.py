"""Exact duplicates across snapshots, screened by static binary-fuse filters.

Each batch of documents, once taken in, is an immutable snapshot. Its distinct digests are
dealt into buckets, and each bucket gets a filter that is built once. Digests of a later batch
are tested against the filters of all earlier snapshots; only those that pass are joined with
the exact buckets, and only their texts are compared byte by byte.
"""

from __future__ import annotations

import itertools
import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import documents, register, settled, shipped, text_or_empty

BATCHES = 3


class FuseFilter(NamedTuple):
    """A 3-wise binary-fuse filter with 16-bit fingerprints (about 2.25 bytes a key).

    A key that was put in always passes; another passes about once in 65,536 times.
    """

    seed: int
    segment: int  # slots of a segment, a power of two
    starts: int  # slots at which a key's first segment may begin
    table: np.ndarray

    @staticmethod
    def of(keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 4 if n < 2 else min(1 << 18, 1 << max(2, int(math.floor(math.log(n) / math.log(3.33) + 2.25))))
        factor = 0.0 if n < 2 else max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(n))
        segments = max(1, -(-int(n * factor) // segment) - 2)
        starts = segments * segment
        for seed in itertools.count(1):
            mixed, slots = places(keys, seed, segment, starts)
            table = peeled(mixed, slots, (segments + 2) * segment)
            if table is not None:
                return FuseFilter(seed, segment, starts, table)
            if seed % 20 == 0:
                # More room: sooner or later distinct keys can be peeled.
                segments += 1 + segments // 8
                starts = segments * segment
        raise AssertionError("seeds do not end")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        mixed, slots = places(keys.astype(np.uint64), self.seed, self.segment, self.starts)
        return np.bitwise_xor.reduce(self.table[slots], axis=1) == prints(mixed)


def places(keys: np.ndarray, seed: int, segment: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixed keys, and their slots in three neighbouring segments."""
    x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(33)
    first = ((x >> np.uint64(32)) * np.uint64(starts)) >> np.uint64(32)
    base, mask = first - first % np.uint64(segment), np.uint64(segment - 1)
    second = base + np.uint64(segment) + ((first ^ (x >> np.uint64(18))) & mask)
    third = base + np.uint64(2 * segment) + ((first ^ x) & mask)
    return x, np.stack([first, second, third], axis=1).astype(np.int64)


def prints(mixed: np.ndarray) -> np.ndarray:
    return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)


def peeled(mixed: np.ndarray, slots: np.ndarray, size: int) -> np.ndarray | None:
    """The table of fingerprints, or None where the slots cannot be peeled.

    All slots with one key left are peeled at once, round by round; the table is then filled
    from the last round back. Keys of one round do not share the slots they are peeled at.
    """
    n = len(mixed)
    left = np.bincount(slots.ravel(), minlength=size)
    total = np.bincount(slots.ravel(), weights=np.repeat(np.arange(n), 3), minlength=size).astype(np.int64)
    rounds, found, ready = [], 0, np.flatnonzero(left == 1)
    while len(ready):
        keys, which = np.unique(total[ready], return_index=True)
        at = ready[which]
        rounds.append((keys, at))
        found += len(keys)
        touched = slots[keys].ravel()
        np.subtract.at(left, touched, 1)
        np.subtract.at(total, touched, np.repeat(keys, 3))
        touched = np.unique(touched)
        ready = touched[left[touched] == 1]
    if found < n:
        return None
    table, marks = np.zeros(size, np.uint16), prints(mixed)
    for keys, at in reversed(rounds):
        table[at] = marks[keys] ^ np.bitwise_xor.reduce(table[slots[keys]], axis=1)
    return table


def key_of(digests: pd.Series) -> np.ndarray:
    """The first eight bytes of each digest as a number."""
    return np.frombuffer(b"".join(bytes(d)[:8] for d in digests), ">u8").astype(np.uint64)


FILTER_SCHEMA = "snapshot int, bucket int, seed long, segment long, starts long, slots binary"


def build_filter(group: pd.DataFrame) -> pd.DataFrame:
    f = FuseFilter.of(key_of(group["sha"]))
    row = (group["batch"].iloc[0], group["bucket"].iloc[0], f.seed, f.segment, f.starts, f.table.tobytes())
    return pd.DataFrame([row], columns=["snapshot", "bucket", "seed", "segment", "starts", "slots"])


PASSED_SCHEMA = "sha binary, n_bytes long, batch int, top string, snapshot int"


def screen_bucket(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The digests of a bucket that pass the filter of an earlier snapshot."""
    out = []
    if len(incoming):
        keys = key_of(incoming["sha"])
        for f in filters.itertuples():
            made = FuseFilter(f.seed, f.segment, f.starts, np.frombuffer(f.slots, np.uint16))
            passed = incoming[made.holds(keys) & (incoming["batch"] > f.snapshot).to_numpy()]
            out.append(passed[["sha", "n_bytes", "batch", "top"]].assign(snapshot=f.snapshot))
    if not out:
        return pd.DataFrame(columns=["sha", "n_bytes", "batch", "top", "snapshot"])
    return pd.concat(out, ignore_index=True)


def snapshot_filters(groups: DataFrame) -> DataFrame:
    """One static filter for each snapshot and bucket of ``groups``."""
    return groups.groupBy("batch", "bucket").applyInPandas(build_filter, FILTER_SCHEMA)


def handle(name: str) -> Column:
    """What a text is fetched by: its doc_id, or a word for all rows without one."""
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def screen(groups: DataFrame, filters: DataFrame) -> DataFrame:
    """(digest, batch, earlier snapshot whose filter it passes). Co-grouped by bucket: a bucket
    holds distinct digests, so its size is set by the number of buckets and not by copies."""
    picked = groups.select("sha", "n_bytes", "batch", handle("top").alias("top"), "bucket")
    return picked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(screen_bucket, PASSED_SCHEMA)


def dedup(docs: DataFrame, batch: Column, bucket_rows: int = 100_000) -> DataFrame:
    """Class of every document among equal texts, over batches that arrive in turn.

    ``batch`` (a column, 0, 1, ...) tells in which batch a row arrives; the result does not
    depend on it. Returns doc_id, keep_id (largest doc_id of the class), group_size, kept and
    text_sha256. Null counts as empty text. Rows that repeat doc_id and text all carry the
    same verdict; a null doc_id stays only where its class has no other. Columns other than
    ``doc_id`` and ``text`` are not looked at; an empty table gives no row.

    Copies within a batch are grouped first (digest and length, combined before the shuffle),
    so hot texts are one row each from there on. The last join brings the verdict back to the
    rows by digest; its skew is split at run time.
    """
    rows = settled(
        docs.select(
            "doc_id",
            F.unhex(F.sha2(text_or_empty(), 256)).alias("sha"),
            F.octet_length(text_or_empty()).cast("long").alias("n_bytes"),
            batch.cast("int").alias("batch"),
        )
    )
    grouped = settled(
        rows.groupBy("sha", "n_bytes", "batch").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("copies"))
    )
    buckets = max(64, -(-grouped.count() // bucket_rows))
    grouped = grouped.withColumn("bucket", F.pmod(F.xxhash64("sha"), F.lit(buckets)).cast("int"))
    last = grouped.agg(F.max("batch")).first()[0]
    filters = settled(snapshot_filters(grouped.where(F.col("batch") < F.lit(last or 0))))
    passed = screen(grouped.where(F.col("batch") > 0), filters)

    # Positives meet their exact bucket; what the filter let through by chance ends here.
    older = grouped.select("sha", "n_bytes", F.col("batch").alias("snapshot"), handle("top").alias("old_top"))
    met = settled(passed.join(older, ["sha", "n_bytes", "snapshot"]))
    asked = met.select("sha", "batch", "top").union(met.select("sha", "snapshot", "old_top")).distinct()
    # A text is fetched by id and digest: rows without an id, or many texts under one, are no hot
    # key. The small side is hashed, so the texts are shuffled but not sorted. At most one row
    # for each digest and batch is asked for.
    texts = docs.select(handle("doc_id").alias("top"), text_or_empty().alias("text"))
    fetched = (
        texts.withColumn("sha", F.unhex(F.sha2("text", 256)))
        .join(asked.hint("shuffle_hash"), ["top", "sha"])
        .groupBy("sha", "batch")
        .agg(F.first("text").alias("text"))
    )
    compared = (
        fetched.groupBy("sha")
        .agg(F.sort_array(F.collect_list(F.struct("batch", "text"))).alias("found"))
        .select("sha", F.explode("found").alias("x"), F.get("found", 0).alias("oldest"))
        .where(F.col("x.text") == F.col("oldest.text"))
        .select("sha", F.col("x.batch").alias("batch"), F.col("oldest.batch").alias("root"))
    )
    rooted = settled(
        grouped.join(settled(compared), ["sha", "batch"], "left").select(
            "sha", "n_bytes", "batch", "top", "copies", F.coalesce("root", "batch").alias("root")
        )
    )
    totals = rooted.groupBy("sha", "n_bytes", "root").agg(F.max("top").alias("keep_id"), F.sum("copies").alias("group_size"))
    classes = settled(rooted.select("sha", "n_bytes", "batch", "root").join(totals, ["sha", "n_bytes", "root"]).drop("root"))
    return rows.join(classes, ["sha", "n_bytes", "batch"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def by_hash(batches: int = BATCHES) -> Column:
    """The batch of a document for a corpus that does not say when its rows arrived."""
    return F.pmod(F.xxhash64(F.col("doc_id")), F.lit(batches))


shipped(__name__)


@register(
    "op2_fuse_filter_dedup",
    """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)
def op2_fuse_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir), by_hash())
