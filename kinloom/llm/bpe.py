"""Byte-level BPE in Spark: ranked merges folded over the bytes of words by higher-order functions.

The rank table and a table of frequent words, merged once, reach the tasks as literals (values
of session variables). Words outside the table are folded where they stand, so every word of
every text is encoded by the same rule and no text is shuffled.

A fold takes n * n small steps for n bytes. Texts with a match of more than ``LONG`` characters
are encoded by a heap of merges in tasks, in time n log n.
"""

from __future__ import annotations

import base64
import heapq
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import documents, register, shipped, text_or_empty
from kinloom.session import shuffle_width

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
# White space as Unicode has it, as the tokenizer's own pattern engine takes it. These are fixed values.
ASCII_SPACE = r"\x09-\x0D\x20"
SPACE = ASCII_SPACE + r"[\x80-\u3000&&[\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]"

BUCKETS = 1 << 17  # small maps of the word table
LONG = 20_000  # characters of a match beyond which a text is encoded by a heap


class Settings(NamedTuple):
    """Bounds of the word table. They decide what is looked up and what is folded, not the result."""

    max_rank_bytes: int = 64 << 20
    sample_docs: int = 40_000  # expected number of documents whose words are counted
    table_words: int = 1 << 19
    table_word_bytes: int = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def pattern(spark: SparkSession) -> str:
    """The tokenizer's pattern for the JVM, with the letters and numbers that its Unicode version lacks.

    Contractions stand behind words, since nothing else begins with a quote. A class asks for
    rare characters last, and of high code points only.
    """
    letters, numbers = (f"[\\x{{500}}-\\x{{10FFFF}}&&[{c}]]" if c else "" for c in unknown(spark))
    other = rf"[^{ASCII_SPACE}\p{{L}}\p{{N}}]&&[\x00-\x7F[^{SPACE}{letters}{numbers}]]"
    word, number = rf"[\p{{L}}{letters}]", rf"[\p{{N}}{numbers}]"
    return rf" ?{word}+|'(?:s|t|re|ve|m|ll|d)| ?{number}+| ?[{other}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def bucket_of(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def constant(table: DataFrame, name: str) -> Column:
    """The only value of a table of one row and one column, as a literal.

    It is kept in the session variable ``name``, so plans show its name and tasks hold its value
    once. A plan holds the value from the time it is built.
    """
    (field,) = table.schema.fields
    spark = table.sparkSession
    table.createOrReplaceTempView(name)
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {field.dataType.simpleString()}")
    spark.sql(f"SET VARIABLE {name} = (SELECT {field.name} FROM {name})")
    spark.catalog.dropTempView(name)
    return F.expr(f"session.{name}")


def ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in sorted(points):
        out = [*out[:-1], (out[-1][0], x)] if out and out[-1][1] == x - 1 else [*out, (x, x)]
    return out


def unknown(spark: SparkSession) -> list[str]:
    """The letters and the numbers that the JVM does not take for such, as ranges for a character class."""
    import regex

    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
    kinds = ["".join(regex.findall(rf"\p{{{k}}}+", every)) for k in "LN"]
    rows = spark.createDataFrame([tuple(kinds)], "L string, N string")
    left = rows.select(*(F.regexp_replace(k, rf"\p{{{k}}}", "") for k in "LN")).first()
    return ["".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges([ord(c) for c in rest])) for rest in left]


ID_BITS, PLACE_BITS = 20, 23
NONE = (1 << ID_BITS) - 1  # stands for "no such token"


class PairRanks(NamedTuple):
    """Rank of the token that two neighbours make, as arrays with one look-up per pair.

    A pair belongs to a group, and the group's shift moves its pairs to slots of their own. All
    products stay far below 2^63.
    """

    keys: list[int]  # left << ID_BITS | right of the pair in a slot, -1 in a free slot
    ranks: list[int]
    shifts: list[int]

    @staticmethod
    def of(ranks: dict[bytes, int]) -> PairRanks:
        pairs = {
            (left, right): rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        }
        groups: list[list[tuple[int, int]]] = [[] for _ in range(max(1, len(pairs) // 2))]
        slots = 2 * len(pairs) + 3
        for pair in pairs:
            groups[PairRanks.group(*pair, len(groups))].append(pair)
        keys, values, shifts = [-1] * slots, [NONE] * slots, [0] * len(groups)
        for g in sorted(range(len(groups)), key=lambda g: -len(groups[g])):
            base = [PairRanks.slot(*pair, slots) for pair in groups[g]]
            if len(set(base)) < len(base):
                raise ValueError("two pairs of a group share a slot")
            shift = 0
            while any(keys[(b + shift) % slots] >= 0 for b in base):
                shift += 1
            shifts[g] = shift
            for pair, b in zip(groups[g], base):
                keys[(b + shift) % slots], values[(b + shift) % slots] = pair[0] << ID_BITS | pair[1], pairs[pair]
        return PairRanks(keys, values, shifts)

    @staticmethod
    def group(left, right, groups: int):
        return (left * 1_299_709 + right * 15_485_863) % groups

    @staticmethod
    def slot(left, right, slots: int):
        return (left * 32_452_843 + right * 49_979_687) % slots


def merged_by_heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: neighbours wait in a heap by rank and place; stale entries are passed over."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    # A part is known by where it begins; end 0 marks one that is gone.
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, middle, end = heapq.heappop(heap)
        if ends[i] != middle or ends[middle] != end:
            continue
        ends[i], ends[middle] = end, 0
        if end < n:
            before[end] = i
            rank = ranks.get(piece[i : ends[end]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end, ends[end]))
        left = before[i]
        if left >= 0:
            rank = ranks.get(piece[left:end])
            if rank is not None:
                heapq.heappush(heap, (rank, left, i, end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return ids


def encoded_by_heap(batches: Iterator[pd.DataFrame], ranks: dict[bytes, int], most_known: int = 200_000) -> Iterator[pd.DataFrame]:
    import regex

    pieces_in = regex.compile(public_tokenizers.PATTERN).findall
    known: dict[str, list[int]] = {}
    for batch in batches:
        found = []
        for text in batch["text"]:
            ids: list[int] = []
            for piece in pieces_in(text):
                own = known.get(piece)
                if own is None:
                    own = merged_by_heap(piece.encode(), ranks)
                    if len(piece) <= 64 and len(known) < most_known:
                        known[piece] = own
                ids += own
            found.append(ids)
        yield pd.DataFrame({"id": batch["id"], "ids": found})


class Vocabulary:
    """Ranks of a tiktoken file as literals; every byte must have a rank.

    The literals are session variables with names of their own; as a context manager, a
    vocabulary drops them in the end. Plans built by then keep the values.
    """

    def __init__(self, spark: SparkSession, path: str = RANKS, settings: Settings = Settings()):
        with open(path, "rb") as file:
            raw = file.read(settings.max_rank_bytes + 1)
        if len(raw) > settings.max_rank_bytes:
            raise ValueError(f"{path} is larger than {settings.max_rank_bytes} bytes")
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"no rank for the bytes {missing}")
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token

        self.spark, self.settings, self.ranks = spark, settings, ranks
        self.own, self.names = uuid.uuid4().hex, []

        def table(name: str, value: list, kind: str) -> Column:
            return self.constant(spark.createDataFrame([(value,)], f"{name} {kind}"))

        if len(tokens) >= NONE:
            raise ValueError(f"ids must be below {NONE}")
        pairs = PairRanks.of(ranks)
        self.pair_keys = table("pair_keys", pairs.keys, "array<long>")
        self.pair_ranks = table("pair_ranks", pairs.ranks, "array<int>")
        self.pair_shifts = table("pair_shifts", pairs.shifts, "array<long>")
        self.groups, self.slots = len(pairs.shifts), len(pairs.keys)
        # Bytes as characters U+0000 to U+00FF, so that strings of them can be joined.
        self.bytes = table("bytes", [t.decode("latin-1") for t in tokens], "array<string>")
        self.pattern = pattern(spark)
        # A byte is found by its checksum; the smallest modulus that keeps the 256 apart serves.
        sums = [zlib.crc32(bytes([b])) for b in range(256)]
        self.modulus = next(m for m in range(256, 1 << 20) if len({x % m for x in sums}) == 256)
        single = [0] * self.modulus
        for b, x in enumerate(sums):
            single[x % self.modulus] = ranks[bytes([b])]
        self.single = table("single", single, "array<long>")

    def __enter__(self) -> Vocabulary:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {name}")
        self.names = []

    def constant(self, table: DataFrame) -> Column:
        name = f"kinloom_bpe_{table.columns[0]}_{self.own}"
        self.names.append(name)
        return constant(table, name)

    def byte_id(self, byte: Column) -> Column:
        return F.get(self.single, (F.crc32(byte) % self.modulus).cast("int"))

    def pair_rank(self, left: Column, right: Column) -> Column:
        """Rank of the token that two ids (longs) make; NONE if there is none or one is null."""
        shift = F.get(self.pair_shifts, PairRanks.group(left, right, self.groups).cast("int"))
        slot = ((PairRanks.slot(left, right, self.slots) + shift) % self.slots).cast("int")
        same = F.get(self.pair_keys, slot) == F.shiftleft(left, ID_BITS).bitwiseOR(right)
        return F.when(same, F.get(self.pair_ranks, slot)).otherwise(F.lit(NONE)).cast("long")

    def pieces_of(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def word_table(self, docs: DataFrame) -> Column:
        """The frequent words of a bounded sample with their ids, as a literal."""
        s = self.settings
        share = min(1.0, s.sample_docs / max(1, docs.count()))
        draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
        words = (
            docs.where(draw < share)
            .select(F.explode(self.pieces_of(text_or_empty())).alias("word"))
            .where(F.octet_length("word") <= s.table_word_bytes)
            .groupBy("word")
            .count()
            .orderBy(F.desc("count"), "word")
            .limit(s.table_words)
            # The top words come out of one task; their merges are spread again.
            .repartition(8 * shuffle_width(self.spark), "word")
        )
        merged = words.select((-F.col("count")).alias("rare"), "word", merged_ids(F.encode("word", "UTF-8"), self).alias("ids"))
        # Spark searches a map from its start, so words are spread over small maps, frequent ones first.
        entries = F.sort_array(F.collect_list(F.struct("rare", "word", "ids")))
        maps = merged.groupBy(bucket_of(F.col("word")).alias("bucket")).agg(
            F.map_from_arrays(F.transform(entries, lambda e: e["word"]), F.transform(entries, lambda e: e["ids"])).alias("m")
        )
        every = self.spark.range(BUCKETS).join(maps, F.col("id") == F.col("bucket"), "left")
        # One row of bounded size: at most table_words words of table_word_bytes bytes.
        row = every.agg(F.collect_list(F.struct("id", F.coalesce("m", F.create_map().cast("map<string, array<int>>")).alias("m"))).alias("all"))
        in_order = F.array_sort("all", lambda a, b: F.when(a["id"] < b["id"], -1).otherwise(1))
        return self.constant(row.select(F.transform(in_order, lambda x: x["m"]).alias("words")))


def merged_ids(word: Column, vocabulary: Vocabulary) -> Column:
    """Ids of a word (binary): the pair of lowest rank, the leftmost of equals, is merged first.

    A fold over as many steps as the word has bytes. Its state has one number for each part:
    the rank of the part with its right neighbour, where the part begins, and its id, from the
    high bits to the low ones; so the smallest number is the next merge. A merge changes two
    numbers. A step takes time in proportion to the parts left, so a word of n bytes costs
    n * n small operations at worst; words have less than 2^23 bytes.
    """
    length = F.octet_length(word)
    low = F.lit((1 << ID_BITS) - 1).cast("long")

    def number(rank: Column, place: Column, part: Column) -> Column:
        return F.shiftleft(rank, ID_BITS + PLACE_BITS).bitwiseOR(F.shiftleft(place, ID_BITS)).bitwiseOR(part)

    def place_of(x: Column) -> Column:
        return F.shiftright(x, ID_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long"))

    def merge(state: Column) -> Column:
        def joined(best: Column) -> Column:
            made = F.shiftright(best, ID_BITS + PLACE_BITS)

            def changed(x: Column, i: Column) -> Column:
                part = x.bitwiseAND(low)
                merged = number(vocabulary.pair_rank(made, F.get(state, i + 2).bitwiseAND(low)), place_of(x), made)
                before = number(vocabulary.pair_rank(part, made), place_of(x), part)
                return F.when(x == best, merged).when(F.get(state, i + 1) == best, before).otherwise(x)

            # The right one of the two merged parts goes.
            return F.filter(F.transform(state, changed), lambda x, i: (i == 0) | (F.get(state, i - 1) != best))

        end = F.lit(NONE << (ID_BITS + PLACE_BITS)).cast("long")
        return let(F.array_min(state), lambda best: F.when(best >= end, state).otherwise(joined(best)))

    single = F.transform(F.sequence(F.lit(1), length), lambda i: vocabulary.byte_id(F.substring(word, i, F.lit(1))))
    start = let(
        single,
        lambda ids: F.transform(ids, lambda x, i: number(vocabulary.pair_rank(x, F.get(ids, i + 1)), i.cast("long"), x)),
    )
    folded = F.aggregate(F.sequence(F.lit(2), length), start, lambda state, _: merge(state))
    ids = F.transform(folded, lambda x: x.bitwiseAND(low).cast("int"))
    return (
        F.when(length == 0, F.array().cast("array<int>"))
        .when(length == 1, F.array(vocabulary.byte_id(word).cast("int")))
        .otherwise(ids)
    )


def very_long(text: Column) -> Column:
    """May the text hold a match of more than ``LONG`` characters: that many without a space, or all white space."""
    run = F.regexp_like(text, F.lit(f"[^ ]{{{LONG}}}")) | F.regexp_like(text, F.lit(f"[{SPACE}]{{{LONG}}}"))
    return (F.octet_length(text) >= LONG) & run


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; a null text has no ids.

    Each match of the pattern is merged apart, special strings are ordinary text. A narrow
    projection, and tasks of their own for texts with a very long match: repeated rows are
    encoded row by row, an empty table gives no row, and columns other than ``doc_id`` and
    ``text`` are not looked at.
    """
    table, ranks = vocabulary.word_table(docs), vocabulary.ranks
    ids = F.flatten(
        F.transform(
            "_pieces",
            lambda piece: F.coalesce(
                F.try_element_at(F.get(table, bucket_of(piece)), piece),
                let(F.encode(piece, "UTF-8"), lambda word: merged_ids(word, vocabulary)),
            ),
        )
    )
    late = very_long(text_or_empty())
    plain = docs.where(~late).select("doc_id", vocabulary.pieces_of(text_or_empty()).alias("_pieces"))
    others = docs.where(late).select(F.col("doc_id").cast("string").alias("id"), text_or_empty().alias("text"))
    heaped = others.mapInPandas(lambda batches: encoded_by_heap(batches, ranks), "id string, ids array<int>")
    return plain.select("doc_id", ids.alias("ids")).union(
        heaped.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "ids")
    )


def decoded(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes of ids, joined."""
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(vocabulary.bytes, i)), ""), "ISO-8859-1")


def round_trip(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Number and digest of the ids of every text, and the digest of the bytes they decode to."""
    # An array in JSON reads [1,2,3].
    joined = F.btrim(F.to_json("ids"), F.lit("[]"))
    return encode(docs, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), vocabulary), 256).alias("decoded_sha256"),
    )


shipped(__name__)


@register("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Vocabulary(spark) as vocabulary:
        return round_trip(documents(spark, sf_dir), vocabulary)
