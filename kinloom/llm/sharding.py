"""Shards by a keyed permutation of global row numbers.

A Feistel network on Z_a x Z_b (a * b just above the number of rows) permutes the pairs;
walking a cycle until it re-enters the row numbers makes it a permutation of those alone.
Row number i goes to place p(i): shard p(i) mod k, slot p(i) div k. So anybody who knows
the seed and the number of rows can compute the shard and slot of a row, without a lookup.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import documents, register, settled, text_or_empty
from kinloom.session import shuffle_width

SHARDS = 40
ROUNDS = 8
SEED = 20240229

# Round functions work modulo this prime (2^31 - 1), so that a square fits into a long.
PRIME = 2_147_483_647


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Two numbers below the prime for each round, from a linear congruence."""
    keys, x = [], seed % PRIME
    for _ in range(ROUNDS):
        x = (x * 48_271 + 11) % PRIME
        y = (x * 69_621 + 7) % PRIME
        keys.append((x, y))
        x = y
    return keys


def sides(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def permuted(number: Column, n: int, seed: int = SEED) -> Column:
    """The place of row ``number`` among ``n`` rows: a permutation of 0 .. n-1.

    Fewer than a = sqrt(n) pairs lie outside, so hardly any walk takes a second step. A walk
    has room for 64 steps, or for all pairs outside where these are fewer; should it still
    end outside, the query fails rather than give a wrong place.
    """
    a, b = sides(n)
    keys = F.array(
        *[
            F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y"), F.lit((a, b)[i % 2]).cast("long").alias("m"))
            for i, (x, y) in enumerate(round_keys(seed))
        ]
    )

    def mixed(value: Column, key: Column) -> Column:
        once = (value + key["x"]) % PRIME
        return ((once * once) % PRIME + once * (key["y"] % 65_536) + key["y"]) % PRIME

    def encrypted(value: Column) -> Column:
        pair = F.aggregate(
            keys,
            F.struct(_div(value, b).alias("l"), (value % b).alias("r")),
            lambda acc, key: F.struct(acc["r"].alias("l"), ((acc["l"] + mixed(acc["r"], key)) % key["m"]).alias("r")),
        )
        return pair["l"] * b + pair["r"]

    steps = min(64, a * b - n + 1)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.lit(n).cast("long"),
        lambda at, i: F.when((i > 1) & (at < n), at).otherwise(encrypted(F.when(i == 1, number).otherwise(at))),
    )
    return walked


def numbered_rows(rows: DataFrame, *order: str) -> DataFrame:
    """Add ``row_number`` (0, 1, ... without gaps, in the given order).

    ``rows`` must be stored: sampling the ranges reads it too. Ranges are sorted apart; the
    driver sees one count per range. Rows equal in ``order`` are told apart by their place
    in the stored table, so that a third of all rows being equal still makes even ranges.
    """
    spark = rows.sparkSession
    told_apart = rows.withColumn("_place", F.monotonically_increasing_id())
    ranged = settled(
        told_apart.repartitionByRange(shuffle_width(spark), *order, "_place")
        .sortWithinPartitions(*order, "_place")
        .withColumn("_range", F.spark_partition_id())
    )
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    starts, total = [], 0
    for i in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(i, 0)
    first = F.array(*[F.lit(x).cast("long") for x in starts]) if starts else F.array(F.lit(0).cast("long"))
    # monotonically_increasing_id holds the partition in its upper 31 bits, the place in the lower 33.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("row_number", F.get(first, F.col("_range")) + place).drop("_range", "_place")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Size, checksum, row number, shard and slot of every document; law ``rows``.

    Row numbers follow doc_id (null first), then size, checksum and hash of the text; rows
    equal in all of these are interchangeable. A null text counts as empty (16 bytes,
    checksum 0). Shards differ by one row at most, slots have no gap, an empty table gives
    no row. Documents are read once; only numbers are shuffled, and there is no Python.
    """
    narrow = settled(
        docs.select(
            "doc_id",
            (F.octet_length(text_or_empty()) + 16).cast("long").alias("size"),
            F.crc32(text_or_empty()).alias("text_crc32"),
            F.xxhash64(text_or_empty()).alias("_hash"),
        )
    )
    rows = numbered_rows(narrow, "doc_id", "size", "text_crc32", "_hash").drop("_hash")
    n = narrow.count()
    placed = rows.withColumn("place", permuted(F.col("row_number"), n, seed))
    checked = placed.withColumn(
        "place", F.when(F.col("place") < n, F.col("place")).otherwise(F.raise_error(F.lit("the walk ended outside")).cast("long"))
    )
    return checked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        _div(F.col("place"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


@register("op5_feistel_shards")
def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
