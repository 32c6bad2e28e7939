"""What the text operators share: the word pattern, registration, and safe column access."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.plans.registry import table
from kinloom.session import ensure_checkpoint_dir, prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# A word is a run of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for an empty text."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def settled(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the written rows.

    The copy outlives lost executors. Spark deletes it when its reader is gone and
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and continue from there.

    For tables with long arrays or texts, read in part or joined by their size: Parquet keeps
    them small, and Spark knows how large the files are.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shipped(module: str) -> None:
    """Send the functions of ``module`` to the tasks by value: executors need no copy of the package."""
    register_pickle_by_value(sys.modules[module])
