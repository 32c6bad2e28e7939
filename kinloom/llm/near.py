"""Near duplicates by SimHash, searched with tables of pivot distances.

For each fingerprint the Hamming distances to many reference fingerprints (pivots) are kept.
If two fingerprints differ in k bits, no such distance differs by more than k: pairs are
discarded by their largest coordinate difference, and only survivors are compared.

On 64 random bits one pivot lets more than half of all pairs pass, so pivots cannot say where
to look. Candidates therefore meet in tables of bit blocks: if at most k bits differ, all but
k of r blocks are equal, so every linked pair meets under one choice of r - k blocks. That
loses no pair and needs no all-pairs comparison.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import documents, register, settled, shipped, text_or_empty

WIDTH = 4  # words of a shingle
SEED = 42
BITS = 4  # fingerprints link at so many differing bits or fewer
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

# Pivots: one fixed pseudo-random number after the other.
PIVOTS = np.array([(i * 0x9E3779B97F4A7C15 ^ (i * 0xC2B2AE3D27D4EB4F) >> 7) & 0xFFFFFFFFFFFFFFFF for i in range(1, 25)], np.uint64)

SMALL = 8  # entries of a table up to which all pairs are looked at in one go
LARGE = 4096  # entries beyond which a table entry is dealt to several tasks


def shingle_hashes(text: bytes, width: int = WIDTH) -> list[int]:
    import xxhash

    joined = b" ".join(text.translate(LOWER).split())
    if not joined:
        return []
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    if len(starts) < width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]


def majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per run of ``hashes``, the bits set in more than half of them; 0 for an empty run."""
    out = np.zeros(len(lengths), np.uint64)
    filled = np.flatnonzero(lengths)
    if not len(filled):
        return out
    # Four counters of 16 bits share a number, so a run is summed in parts of 60,000.
    starts, parts, at = [], [], 0
    for n in lengths[filled].tolist():
        parts.append(-(-n // 60_000))
        starts.extend(range(at, at + n, 60_000))
        at += n
    first_part = np.cumsum([0, *parts[:-1]])
    half = lengths[filled].astype(np.int64)
    fingerprint = np.zeros(len(filled), np.uint64)
    lanes = np.uint64(0x0001000100010001)
    for b in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(b)) & lanes, starts)
        for lane in range(4):
            count = np.add.reduceat(((sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64), first_part)
            fingerprint |= (2 * count > half).astype(np.uint64) << np.uint64(b + 16 * lane)
    out[filled] = fingerprint
    return out


def fingerprint_batches(batches: Iterator[pd.DataFrame], width: int = WIDTH) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found, hashes, lengths = [], [], []

        def flush() -> None:
            found.append(majority(np.array(hashes, np.uint64), np.array(lengths)))
            hashes.clear()
            lengths.clear()

        for text in batch["text"]:
            own = shingle_hashes(bytes(text), width)
            hashes += own
            lengths.append(len(own))
            if len(hashes) > 500_000:
                flush()
        flush()
        yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": np.concatenate(found).view(np.int64)})


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fingerprint (a long) of every whole text."""
    picked = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.encode(text_or_empty(), "UTF-8").alias("text"))
    made = picked.mapInPandas(lambda batches: fingerprint_batches(batches, width), "doc_id string, fp long")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def blocks_for(n: int, bits: int) -> int:
    """Blocks so that chance brings each of ``n`` fingerprints less than one candidate; bits + 3 at least."""
    r = bits + 3
    while r < 24 and math.comb(r, bits) * n / 2 ** (64 * (r - bits) / r) > 1:
        r += 1
    return r


def table_keys(fp: Column, r: int, bits: int) -> Column:
    """The keys of a fingerprint: for each choice of r - bits blocks, its number and the blocks' bits."""
    edges = [64 * i // r for i in range(r + 1)]
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(r), r - bits)):
        key, shift = F.lit(0).cast("long"), 0
        for i in chosen:
            size = edges[i + 1] - edges[i]
            block = F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
            key, shift = key.bitwiseOR(F.shiftleft(block, shift)), shift + size
        # Up to 48 bits are a key of their own; more are mixed, which only adds candidates.
        keys.append(F.shiftleft(F.lit(number).cast("long"), 48).bitwiseOR(key) if shift <= 48 else F.xxhash64(F.lit(number), key))
    return F.array(*keys)


def near_pairs(fps: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs (i, j) differ in ``bits`` bits at most: pivots first, then the pairs left."""
    keep = np.arange(len(i))
    for pivot in PIVOTS:
        if not len(keep):
            break
        far = np.bitwise_count(fps ^ pivot).astype(np.int8)
        keep = keep[np.abs(far[i[keep]] - far[j[keep]]) <= bits]
    return keep[np.bitwise_count(fps[i[keep]] ^ fps[j[keep]]) <= bits]


def spanning_links(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join everything linked within one table entry, not all of its pairs.

    Stars first: each fingerprint not yet in one becomes the centre of those near it, compared
    with all members directly and without pivots. Then
    members of different components are compared through the pivot table, those of the
    largest component only with the others.
    """
    n = len(fps)
    component, seen = np.arange(n), np.zeros(n, bool)
    left, right = [], []
    for c in range(n):
        if seen[c]:
            continue
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[c]) <= bits)
        seen[near] = True
        labels, which = np.unique(component[near], return_index=True)
        if len(labels) > 1:
            # A new member is a component of its own, an old one stands for its component.
            other = near[which][labels != component[c]]
            left.append(np.full(len(other), c))
            right.append(other)
            component[np.isin(component, labels)] = labels[0]
    labels, sizes = np.unique(component, return_counts=True)
    if len(labels) > 1:
        table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
        rest = np.flatnonzero(component != labels[sizes.argmax()])
        for start in range(0, len(rest), 256):
            rows = rest[start : start + 256]
            i, j = np.nonzero(np.abs(table[rows, None, 0] - table[None, :, 0]) <= bits)
            i = rows[i]
            for p in range(1, len(PIVOTS)):
                kept = np.abs(table[i, p] - table[j, p]) <= bits
                i, j = i[kept], j[kept]
            kept = (component[i] != component[j]) & (np.bitwise_count(fps[i] ^ fps[j]) <= bits)
            i, j = i[kept], j[kept]
            if len(i):
                # One link for each pair of components is enough.
                _, which = np.unique(np.stack([component[i], component[j]], axis=1), axis=0, return_index=True)
                left.append(i[which])
                right.append(j[which])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


LINK_SCHEMA = "key long, a long, b long"


def link_entries(batches: Iterator[pd.DataFrame], bits: int, large: int | None) -> Iterator[pd.DataFrame]:
    """Links within the entries (equal keys) of a stream that is sorted by key.

    Rows with a key are not links: they are the members of an entry of more than ``large``,
    left for a pass that deals it to several tasks.
    """

    def links(keys: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        left, right = [], []
        small = np.repeat(np.where(sizes <= SMALL, sizes, 1), sizes)
        place = np.arange(len(keys)) - np.repeat(starts, sizes)
        for k in range(1, SMALL):
            i = np.flatnonzero(place + k < small)
            if not len(i):
                break
            kept = near_pairs(fps, i, i + k, bits)
            left.append(i[kept])
            right.append(i[kept] + k)
        for at in np.flatnonzero(sizes > SMALL):
            own = slice(starts[at], starts[at] + sizes[at])
            i, j = spanning_links(fps[own], bits)
            left.append(i + starts[at])
            right.append(j + starts[at])
        if not left:
            return pd.DataFrame({"key": [], "a": [], "b": []}, dtype="int64")
        signed = fps.view(np.int64)
        a, b = signed[np.concatenate(left)], signed[np.concatenate(right)]
        made = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
        return made.assign(key=pd.Series([None] * len(made), dtype="Int64", index=made.index))[["key", "a", "b"]]

    def put_off(keys: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        signed = fps.view(np.int64)
        return pd.DataFrame({"key": pd.Series(keys, dtype="Int64"), "a": signed, "b": signed})

    keys, fps, open_entry = np.empty(0, np.int64), np.empty(0, np.uint64), None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not len(batch):
                continue
            keys = np.concatenate([keys, batch["key"].to_numpy(np.int64)])
            fps = np.concatenate([fps, batch["fp"].to_numpy(np.int64).view(np.uint64)])
        if open_entry is not None:
            end = int(np.searchsorted(keys != open_entry, True)) if len(keys) else 0
            if end:
                yield put_off(keys[:end], fps[:end])
                keys, fps = keys[end:], fps[end:]
            if len(keys):
                open_entry = None
        if not len(keys):
            continue
        # The last entry may go on in the next batch.
        last = len(keys) if batch is None else int(np.argmax(keys == keys[-1]))
        whole_keys, whole_fps, keys, fps = keys[:last], fps[:last], keys[last:], fps[last:]
        if large is not None and len(whole_keys):
            starts = np.flatnonzero(np.append(True, whole_keys[1:] != whole_keys[:-1]))
            sizes = np.diff(np.append(starts, len(whole_keys)))
            over = np.repeat(sizes > large, sizes)
            if over.any():
                yield put_off(whole_keys[over], whole_fps[over])
                whole_keys, whole_fps = whole_keys[~over], whole_fps[~over]
        if len(whole_keys):
            yield links(whole_keys, whole_fps)
        if large is not None and len(keys) > large:
            open_entry = keys[0]
            yield put_off(keys, fps)
            keys, fps = keys[:0], fps[:0]


def linked(nodes: DataFrame, n: int, bits: int = BITS, large: int = LARGE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``nodes.fp``: enough to join all that are near."""
    keyed = nodes.select("fp", F.explode(table_keys(F.col("fp"), blocks_for(n, bits), bits)).alias("key"))
    streamed = keyed.repartition("key").sortWithinPartitions("key", "fp")
    first = settled(streamed.mapInPandas(lambda b: link_entries(b, bits, large), LINK_SCHEMA))
    links = first.where(F.col("key").isNull()).select("a", "b")
    # Entries that are too large for one task: their members are cut into parts, and each pair
    # of parts is a task of its own.
    late = first.where(F.col("key").isNotNull()).select("key", F.col("a").alias("fp"))
    sizes = late.groupBy("key").count()
    if not sizes.isEmpty():
        dealt = late.join(sizes, "key").withColumn("parts", F.ceil(F.col("count") * 2 / large))
        own = F.pmod(F.xxhash64("fp"), F.col("parts"))
        pairs = dealt.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        tasks = pairs.select(
            F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp"
        )
        more = tasks.repartition("key").sortWithinPartitions("key", "fp")
        links = links.union(more.mapInPandas(lambda b: link_entries(b, bits, None), LINK_SCHEMA).select("a", "b"))
    return links.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; label is the smallest node of its component.

    Each round takes the smallest label among the neighbours, then the label of the label;
    it ends when a round changes nothing. Every round is written, so no lineage grows.
    """
    both = settled(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a")))
    labels = settled(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("label")))
    while True:
        heard = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, F.col("node") == F.col("src")).select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("new")
        )
        jump = lower.select(F.col("node").alias("at"), F.col("new").alias("root"))
        moved = settled(
            lower.join(jump, F.col("new") == F.col("at")).select("node", "old", F.least("new", "root").alias("label"))
        )
        labels = moved.select("node", "label")
        if moved.where(F.col("label") != F.col("old")).isEmpty():
            return labels


def near_duplicates(docs: DataFrame, bits: int = BITS, width: int = WIDTH, large: int = LARGE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    Fingerprints link at ``bits`` differing bits or fewer; component_id is the smallest doc_id
    that links reach. Texts without a word (null, empty) have fingerprint 0 and are linked
    like others. Rows that repeat a doc_id are rows of their own; a null doc_id gives no
    component_id unless its component has another. An empty table gives no row; columns other
    than ``doc_id`` and ``text`` are not looked at.

    Equal fingerprints are one node from the first shuffle on, so copies are never paired.
    """
    rows = settled(fingerprints(docs, width))
    nodes = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("root")))
    labels = components(linked(nodes, nodes.count(), bits, large))
    reached = nodes.join(labels, F.col("fp") == F.col("node"))
    smallest = reached.groupBy("label").agg(F.min("root").alias("smallest"))
    joined = reached.select("fp", "label").join(smallest, "label").select("fp", "smallest")
    classes = settled(
        nodes.join(settled(joined), "fp", "left").select("fp", F.coalesce("smallest", "root").alias("component_id"))
    )
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


shipped(__name__)


@register("op4_simhash_pivots")
def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
