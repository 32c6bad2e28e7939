"""Token counts kept in a cache of digests.

The key is (digest of the content, digest of the tokenizer). Documents are joined with the
stored counts; only distinct contents that have none are encoded, and their counts appended.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import documents, register, settled, shipped, text_or_empty
from kinloom.session import ensure_checkpoint_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MAX_TOKENIZER_BYTES = 64 << 20
LIMIT = 512

CACHE_SCHEMA = "tokenizer string, sha binary, n_tokens long"


class TokenCache:
    """Stored counts: a Parquet folder in a place that all executors reach.

    Appends are committed by job. Two writers may store the same count twice, so readers
    take one row per key.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def counts(self, tokenizer: str) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], "sha binary, n_tokens long")
        stored = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path).where(F.col("tokenizer") == tokenizer)
        return stored.groupBy("sha").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, tokenizer: str) -> None:
        counts.select(F.lit(tokenizer).alias("tokenizer"), "sha", "n_tokens").write.mode("append").parquet(self.path)


def tokenizer_text(path: str) -> str:
    with open(path, "rb") as file:
        raw = file.read(MAX_TOKENIZER_BYTES + 1)
    if len(raw) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} is larger than {MAX_TOKENIZER_BYTES} bytes")
    return raw.decode()


def counter(definition: str, most_pieces: int = 300_000) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts as the library does.

    Of a tokenizer that only splits texts by the byte-level pattern before it merges, the
    library encodes each distinct piece once and texts add up their pieces; any other
    tokenizer encodes whole texts. Special strings are cut out first, as the library does;
    each is one token.
    """
    import regex
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def whole(texts: list[str]) -> list[int]:
        return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    settings = json.loads(definition)
    split, added = settings.get("pre_tokenizer") or {}, settings.get("added_tokens") or []
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    bare = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
    if settings.get("normalizer") or not (plain and bare):
        return whole
    pieces_of = regex.compile(public_tokenizers.PATTERN).findall
    # Longer special strings first, so that none hides one that begins with it.
    special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
    known: dict[str, int] = {}

    def by_pieces(texts: list[str]) -> list[int]:
        cut = []
        for text in texts:
            if special and special.search(text):
                parts = special.split(text)
                cut.append((len(parts) - 1, [p for part in parts for p in pieces_of(part)]))
            else:
                cut.append((0, pieces_of(text)))
        if len(known) > most_pieces:
            known.clear()
        new = list({p for _, pieces in cut for p in pieces}.difference(known))
        known.update(zip(new, whole(new)))
        return [n + sum(map(known.__getitem__, pieces)) for n, pieces in cut]

    return by_pieces


def encoded_counts(batches: Iterator[pd.DataFrame], definition: str, chars_at_once: int = 500_000) -> Iterator[pd.DataFrame]:
    """Counts of the distinct texts of a task, some at a time."""
    count = counter(definition)
    done: set[bytes] = set()
    for batch in batches:
        shas, counts, part, chars = [], [], [], 0
        for sha, text in [*zip(batch["sha"], batch["text"]), (None, None)]:
            if part and (text is None or chars + len(text) > chars_at_once):
                counts += count(part)
                part, chars = [], 0
            if text is not None and sha not in done:
                done.add(sha)
                shas.append(sha)
                part.append(text)
                chars += len(text)
        yield pd.DataFrame({"sha": pd.Series(shas, dtype=object), "n_tokens": pd.Series(counts, dtype="int64")})


def fetch(docs: DataFrame, misses: DataFrame) -> DataFrame:
    """sha and text of the rows that ``misses`` (sha, rep) asks for.

    A doc_id may stand for many texts, so the digest is a key of the join, too. The join brings
    equal rows together, and a task encodes them once.
    """

    def handle(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit("null"))

    texts = docs.select(handle("doc_id").alias("_rep"), text_or_empty().alias("text"))
    texts = texts.withColumn("sha", F.unhex(F.sha2("text", 256)))
    wanted = misses.select("sha", handle("rep").alias("_rep"))
    return texts.join(wanted.hint("shuffle_hash"), ["_rep", "sha"]).select("sha", "text")


def count_tokens(docs: DataFrame, cache: TokenCache, path: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    Tokens are those the tokenizers library gives for the file at ``path``: no truncation, no
    padding, nothing added; the file's special strings are found in texts as by default. A null
    text counts as empty. Repeated rows are counted row by row and encoded once; an empty table
    gives no row; columns other than ``doc_id`` and ``text`` are not looked at.

    One row of each missing content is chosen by doc_id and digest; its text is fetched by a
    join that hashes the small side, so texts are shuffled once.
    """
    definition = tokenizer_text(path)
    tokenizer = hashlib.sha256(definition.encode()).hexdigest()
    rows = settled(
        docs.select(
            "doc_id",
            F.unhex(F.sha2(text_or_empty(), 256)).alias("sha"),
            F.octet_length(text_or_empty()).cast("long").alias("n_bytes"),
        )
    )
    distinct = rows.groupBy("sha").agg(F.min("doc_id").alias("rep"))
    misses = distinct.join(cache.counts(tokenizer), "sha", "left_anti")
    fetched = fetch(docs, misses)
    counted = fetched.mapInPandas(lambda batches: encoded_counts(batches, definition), "sha binary, n_tokens long")
    cache.append(counted, tokenizer)
    # One row per content is stored first: then the join with the rows is plain, and a content
    # that many rows share is split over tasks at run time.
    counts = settled(distinct.select("sha").join(cache.counts(tokenizer), "sha"))
    return rows.join(counts, "sha").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


shipped(__name__)


@register("op9_token_cache")
def op9_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each call, so that no earlier call spares it work."""
    cache = TokenCache(spark, f"{ensure_checkpoint_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    return count_tokens(documents(spark, sf_dir), cache)
