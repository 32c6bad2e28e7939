"""From raw documents to encoded training text, in five stages.

Each stage reads what the one before has kept; all but the last return the columns of
``documents``. Rows that repeat a doc_id and its text count as one document from the exact
dedup on; rows that share a doc_id and differ in text are documents of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import bpe, exact, language, mixing, near
from kinloom.llm.common import text_or_empty
from kinloom.session import ensure_checkpoint_dir, prepare

KEY = "__key"


def key_of() -> Column:
    """Tells documents apart: the id, padded so that it sorts by number, and the digest of the text."""
    number = F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit(""))
    return F.concat(number, F.lit("|"), F.sha2(text_or_empty(), 256))


def with_verdicts(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Documents, one row per key, joined with rows of verdicts that hold their key.

    Dropping repeated rows and the join share one shuffle of the texts.
    """
    return docs.withColumn(KEY, key_of()).dropDuplicates([KEY]).join(verdicts.hint("merge"), KEY)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and those in which no language stands out."""
    return language.in_a_language(docs, language.learn(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the one with the largest doc_id."""
    found = exact.dedup(docs, exact.by_hash()).where("kept")
    number = F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit(""))
    stay = found.select(F.concat(number, F.lit("|"), F.col("text_sha256")).alias(KEY)).distinct()
    return with_verdicts(docs, stay).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash links, however indirectly, keep the one with the smallest doc_id."""
    found = near.near_duplicates(docs.select(key_of().alias("doc_id"), "text"))
    stay = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(KEY)).distinct()
    return with_verdicts(docs, stay).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and drop documents so that sources come near their target weights.

    Texts stay whole: the one document of a source of which a part would be taken gets a whole
    copy if that part is half of it or more.
    """
    keyed = docs.select(key_of().alias("doc_id"), "text", "source").dropDuplicates(["doc_id"])
    mixed = mixing.mix(keyed)
    copies = F.col("copies") + F.when((F.col("part_words") > 0) & (F.col("part_words") * 2 >= F.col("size")), 1).otherwise(0)
    taken = mixed.select(F.col("doc_id").alias(KEY), copies.cast("int").alias("__copies")).where("__copies > 0")
    every = with_verdicts(docs, taken).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return every.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text and decode it again.

    The driver has held four stages by now, so its word table is smaller than the operator's
    default: more words are folded where they stand, with the same result.
    """
    with bpe.Vocabulary(spark, settings=bpe.Settings(table_words=1 << 17)) as vocabulary:
        return bpe.round_trip(docs, vocabulary)


STAGES = [
    ("language", keep_languages),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("mix", mix_sources),
    ("bpe", encode),
]

# SimHash, the random field and byte pairs have no SQL; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder."""
    prepare(spark)
    base = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
