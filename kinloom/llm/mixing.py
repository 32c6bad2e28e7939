"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source has the same wanted number of copies, target / size of the source.
Its whole part is given; of the rest, pairs of documents exchange words at random, without
changing the words of the source, until one of the two holds none or a whole copy. What is
left of a group goes on to the next level of a reduction tree, so in the end all but one
document of a source have whole copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.llm.common import WORD, documents, register, settled, shipped, text_or_empty

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
GROUP_ROWS = 4096  # documents that one task of the tree rounds
SEED = 17


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(number, source, source_size, target): shares of all words by weight, capped at ``most`` x size.

    Sources follow code points, null last; their weights repeat. With the level L solving
    sum(min(cap, L x weight)) = all words, target = min(cap, L x weight): that is where capping
    and resharing the excess ends. One row per source goes through the windows, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    # Ordered by one constant partition: as many rows as there are sources.
    named = per.withColumn("number", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    ratio = named.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    ratio = ratio.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.partitionBy(F.lit(0)).orderBy("ratio", "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    left_words = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ratio.withColumn("level", left_words / left_weight)
    # The first source that is not capped sets the level for itself and all after it.
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "number", "level"))).over(everything)["level"]
    return level.withColumn("found", found).select(
        "number",
        "source",
        "source_size",
        "docs",
        F.when(F.col("found").isNull() | (F.col("found") * F.col("weight") >= F.col("cap")), F.col("cap"))
        .otherwise(F.col("found") * F.col("weight"))
        .alias("target"),
    )


def rounded(sizes: np.ndarray, words: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Words (0 .. size) of documents after pairwise exchange in the given order.

    The sum stays; each document's mean over the draws is its input. At most one document is
    left with neither 0 nor its size.
    """
    out, held = words.tolist(), -1
    size = sizes.tolist()
    for i, draw in enumerate(draws.tolist()):
        if not 0 < out[i] < size[i]:
            continue
        if held < 0:
            held = i
            continue
        a, b = out[held], out[i]
        to_held = min(size[held] - a, b)
        to_i = min(a, size[i] - b)
        if draw * (to_held + to_i) < to_i:
            # With this chance the held one gains, so that neither changes on average.
            if to_held == b:
                out[held], out[i] = a + b, 0.0
            else:
                out[held], out[i] = float(size[held]), b - to_held
        elif to_i == a:
            out[held], out[i] = 0.0, a + b
        else:
            out[held], out[i] = a - to_i, float(size[i])
        held = next((k for k in (held, i) if 0 < out[k] < size[k]), -1)
    return np.array(out)


ROUND_SCHEMA = "doc_id string, number int, size long, base long, words double, leaf long, place long"


def rounder(seed: int, level: int):
    """A function that rounds the documents of a group, in the order of their hashes."""

    def round_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "doc_id", "size", "words"], kind="stable", na_position="first")
        number, leaf = int(group["number"].iloc[0]), int(group["leaf"].iloc[0])
        draws = np.random.default_rng([seed, level, number, leaf]).random(len(group))
        words = rounded(group["size"].to_numpy(np.int64), group["words"].to_numpy(float), draws)
        return group.assign(words=words)

    return round_group


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, seed: int = SEED, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and part_words of every document.

    ``copies`` whole copies and ``part_words`` words of one more are taken; part_words is above
    0 in one document per source at most, so a source misses its target by less than a word.
    Null counts as empty text; a document without words takes none. Repeated rows are documents
    of their own, a null source is a source, an empty table gives no row, and the result hangs
    on the rows and the seed alone, not on their order or partitioning. Other columns are not
    looked at. A source of any size is dealt to groups of about ``group_rows`` documents.
    """
    sizes = settled(docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size")))
    goals = settled(targets(sizes, weights, most))
    joined = sizes.withColumnRenamed("source", "own").join(goals, F.col("own").eqNullSafe(F.col("source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate).cast("long")
    place = F.xxhash64("doc_id", "size", F.lit(seed))
    leaf = F.pmod(F.xxhash64(place), F.ceil(F.col("docs") / group_rows))
    given = joined.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        "number",
        "size",
        whole.alias("base"),
        ((rate - whole) * F.col("size")).alias("words"),
        leaf.alias("leaf"),
        place.alias("place"),
    )
    partial = (F.col("words") > 0) & (F.col("words") < F.col("size"))
    groups = goals.agg(F.max(F.ceil(F.col("docs") / group_rows))).first()[0] or 1
    done, level = [], 0
    while True:
        part = settled(given.groupBy("number", "leaf").applyInPandas(rounder(seed, level), ROUND_SCHEMA))
        if groups <= 1:
            done.append(part)
            break
        done.append(part.where(~partial))
        groups, level = -(-groups // group_rows), level + 1
        given = part.where(partial).withColumn("leaf", F.call_function("div", F.col("leaf"), F.lit(group_rows).cast("long")))
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    full = F.col("words") >= F.col("size")
    part_words = F.when(full | (F.col("words") <= 0), F.lit(0)).otherwise(F.round("words")).cast("long")
    goal = goals.select("number", "source", "source_size", "target")
    return every.join(goal, "number").select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("base") + F.when(full & (F.col("size") > 0), 1).otherwise(0)) + part_words).alias("taken"),
        (F.col("base") + F.when(full & (F.col("size") > 0), 1).otherwise(0)).alias("copies"),
        part_words.alias("part_words"),
        "source",
    )


shipped(__name__)


@register("op6_pivotal_mix")
def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "part_words")
