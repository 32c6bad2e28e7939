"""Near duplicates by MinHash: universal hash minima, banding, signatures, full sets, stars.

A document is the set of its word shingles; equal sets are one node. Each node has ``HASHES``
minima under universal hash functions. Nodes that agree in all minima of a band meet in an
entry; with 32 bands of 4, two sets of similarity 0.8 miss each other with a chance of 5e-8,
more similar ones less. Pairs whose signatures agree in too few places are discarded, the
others are confirmed on their full sets. Components come from alternating large-star and
small-star rounds.

Within an entry every member is first compared with one of them. Where the rest does not end up
in one component, all pairs of different components are looked at in tasks of bounded size,
and only the links that join components leave the task: pairs are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import documents, register, settled, shipped, stored, text_or_empty
from kinloom.llm.near import shingle_hashes

WIDTH = 2  # words of a shingle
PERCENT = 80  # similarity from which two sets link
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
# Of 128 places, sets of similarity 0.8 agree in 102 on average; in fewer than 72 once in 10^9.
AGREE = 72
MEMBERS = 512  # members of an entry that one task compares; larger entries are dealt to several

def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random numbers of 64 bits (SplitMix64)."""
    z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


# h(x) = (a x + b) mod 2^64 with odd a, read from the highest bit.
FACTORS, SHIFTS = stream(1, HASHES) | np.uint64(1), stream(2, HASHES)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def minima(shingles: np.ndarray) -> bytes:
    """The upper halves of the least value under each hash function."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[start : start + 1024, None] * FACTORS + SHIFTS).min(axis=0))
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def signed(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Size, node (digest of the set) and signature of each text; a text without words has no node."""
    import xxhash

    for batch in batches:
        sizes, nodes, sigs = [], [], []
        for text in batch["text"]:
            own = shingle_set(bytes(text), width)
            sizes.append(len(own))
            nodes.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            sigs.append(minima(own) if len(own) else None)
        yield pd.DataFrame({"id": batch["id"], "sha": batch["sha"], "n": sizes, "node": nodes, "sig": sigs})


def handle(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, sha, n, node, sig) of every row."""
    text = text_or_empty()
    picked = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.encode(text, "UTF-8").alias("text")
    )
    made = picked.mapInPandas(lambda b: signed(b, width), "id string, sha binary, n long, node binary, sig binary")
    return stored(made.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "sha", "n", "node", "sig"))


def entries(nodes: DataFrame) -> DataFrame:
    """(key, node, centre) of all entries with two nodes or more.

    The centre is the node with the most fellow members in all its entries (the smallest of
    equals): the one that the others are copies of agrees with them in most bands.
    """
    keys = [F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)]
    banded = nodes.select("node", F.explode(F.array(*keys)).alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = stored(banded.join(shared, "key"))
    fellows = members.groupBy("node").agg(F.sum("c").alias("f"))
    centres = members.join(fellows, "node").groupBy("key").agg(F.min_by("node", F.struct(-F.col("f"), "node")).alias("centre"))
    return stored(members.select("key", "node").join(centres, "key"))


def sets_of(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    seen: set[bytes] = set()
    for batch in batches:
        nodes, sets = [], []
        for node, text in zip(batch["node"], batch["text"]):
            if node not in seen:
                seen.add(node)
                nodes.append(node)
                sets.append(shingle_set(bytes(text), width).tobytes())
        yield pd.DataFrame({"node": pd.Series(nodes, dtype=object), "shingles": pd.Series(sets, dtype=object)})


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of ``nodes`` (node, rep, sha), cut anew from the text of one row of each.

    Id and digest together tell a text, so rows without an id are no hot key. Rows that repeat
    both are cut once per task and dropped after.
    """
    texts = docs.select(handle(F.col("doc_id")).alias("rep"), text_or_empty().alias("t"))
    found = texts.withColumn("sha", F.unhex(F.sha2("t", 256))).join(nodes, ["rep", "sha"])
    cut = found.select("node", F.encode("t", "UTF-8").alias("text")).mapInPandas(
        lambda b: sets_of(b, width), "node binary, shingles binary"
    )
    return stored(cut.dropDuplicates(["node"]))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def similar(a: bytes, b: bytes, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = common(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def agreeing(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """The pairs whose signatures agree in ``least`` places or more."""
    for batch in batches:
        if len(batch):
            a, b = (np.frombuffer(b"".join(batch[c]), "<u4").reshape(-1, HASHES) for c in ("sa", "sb"))
            batch = batch[(a == b).sum(axis=1) >= least]
        yield batch[["a", "b"]]


def confirmed(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kept = [similar(x, y, percent) for x, y in zip(batch["xa"], batch["xb"])]
        yield batch.loc[np.array(kept, bool), ["a", "b"]]


PAIR = "a binary, b binary"


def confirm(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among ``pairs``: signatures first, then full sets."""
    sig = nodes.select("node", "sig")
    signed_pairs = pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sa"}), "a").join(
        sig.withColumnsRenamed({"node": "b", "sig": "sb"}), "b"
    )
    left = settled(signed_pairs.mapInPandas(lambda x: agreeing(x, AGREE), PAIR))
    whole = left.join(sets.withColumnsRenamed({"node": "b", "shingles": "xb"}), "b").join(
        sets.withColumnsRenamed({"node": "a", "shingles": "xa"}), "a"
    )
    return settled(whole.select("a", "b", "xa", "xb").mapInPandas(lambda x: confirmed(x, percent), PAIR))


def joining_links(members: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between members of different components, enough to join all that are linked.

    Members with ``side`` 0 are of one component; the others are compared with them and, where
    there are none, with one another, on full sets: one member's shingles are marked, and every
    other set counts its marks.
    """
    members = members.sort_values("side", ascending=False, kind="stable")
    n, outside = len(members), int((members["side"] == 1).sum())
    nodes = members["node"].to_list()
    sizes = members["shingles"].map(len).to_numpy() // 8
    starts = np.append(0, np.cumsum(sizes))
    shingles, codes = np.unique(np.frombuffer(b"".join(members["shingles"]), np.uint64), return_inverse=True)
    marks = np.zeros(len(shingles), np.int32)
    component = pd.factorize(members["label"])[0]
    a, b = [], []
    for i in range(min(outside, n - 1)):
        low = i + 1 if outside == n else outside
        if (component[low:] == component[i]).all():
            continue
        own = codes[starts[i] : starts[i + 1]]
        marks[own] = 1
        both = np.add.reduceat(marks[codes[starts[low] :]], starts[low:n] - starts[low])
        marks[own] = 0
        near = 100 * both >= percent * (sizes[i] + sizes[low:] - both)
        found = np.flatnonzero(near & (component[low:] != component[i])) + low
        labels, which = np.unique(component[found], return_index=True)
        for j in found[which].tolist():
            a.append(nodes[i])
            b.append(nodes[j])
        component[np.isin(component, labels)] = component[i]
    return pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})


def late_links(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, size: int) -> DataFrame:
    """Links that the comparison with centres has not seen.

    An entry is open if its members other than the centre lie in different components. Entries
    with the same members are looked at once. The members of its largest component need not be
    compared with one another, only the others with them and among themselves. Both sides are
    cut into parts of about ``size``; each pair of parts is a task of its own.
    """
    known = labels.withColumnRenamed("label", "l")
    rest = members.where("node <> centre").join(known, "node", "left")
    rest = settled(rest.select("key", "node", F.coalesce("l", "node").alias("label")))
    groups = rest.groupBy("key", "label").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")
    )
    per = groups.groupBy("key").agg(
        F.max(F.struct("n", "label")).alias("top"),
        F.count(F.lit(1)).alias("labels"),
        F.sum("n").alias("members"),
        F.bit_xor("x").alias("x"),
        F.bit_xor("y").alias("y"),
    )
    opened = per.where("labels > 1").groupBy("members", "x", "y").agg(F.min(F.struct("key", "top")).alias("e"))
    opened = settled(opened.select("e.key", F.col("e.top.label").alias("main"), F.col("e.top.n").alias("n"), "members"))
    dealt = rest.join(opened, "key").withColumn("side", (F.col("label") != F.col("main")).cast("int"))
    inner = F.ceil(F.col("n") / size).cast("int")
    outer = F.ceil((F.col("members") - F.col("n")) / size).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, inner).otherwise(outer)).cast("int")

    def tasks(kind: int, others: Column, pair: Column) -> Column:
        """(kind, part, part) of the tasks in which a member takes part."""
        return F.transform(F.sequence(F.lit(0), others - 1), lambda o: F.struct(F.lit(kind).alias("kind"), *pair(o)))

    among = tasks(1, F.col("outer"), lambda o: (F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    across = tasks(0, F.col("inner"), lambda o: (F.col("mine").alias("i"), o.alias("j")))
    met = tasks(0, F.col("outer"), lambda o: (o.alias("i"), F.col("mine").alias("j")))
    placed = dealt.select("key", "node", "label", "side", mine.alias("mine"), inner.alias("inner"), outer.alias("outer"))
    every = F.when(F.col("side") == 0, met).otherwise(F.concat(across, among))
    spread = placed.select("key", "node", "label", "side", F.explode(every).alias("task"))
    whole = spread.join(sets, "node")
    return settled(whole.groupBy("key", "task").applyInPandas(lambda group: joining_links(group, percent), PAIR))


def star_components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node, the label being the smallest node of its component.

    Large-star joins the larger neighbours of a node to its smallest one, small-star the smaller
    ones and the node itself. Both alternate until the graph is a set of stars. Every round is
    written, so no lineage grows.
    """
    edges = settled(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = settled(edges.join(lowest, "v").select("u", F.col("m").alias("v")).distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        smaller = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settled(smaller.union(lowest.select("u", F.col("m").alias("v"))).distinct())
        centres = edges.select(F.col("v").alias("u")).distinct()
        if edges.groupBy("u").count().where("count > 1").isEmpty() and edges.join(centres, "u", "left_semi").isEmpty():
            break
    return settled(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(centres.select("u", "u")))


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, size: int = MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Rows link when their sets of ``width``-word shingles (A-Z lower-cased, words end at ASCII
    white space; fewer words are one shingle) have a similarity of ``percent`` / 100 or more,
    which the bands are laid out for from 80 on. component_id is the smallest doc_id that links
    reach, kept says that it is the row's own. A null, empty or blank text has an empty set and
    links with nothing. Rows that repeat a doc_id are rows of their own; a null doc_id gives no
    component_id unless its component has another, and is kept where there is none. Columns other
    than ``doc_id`` and ``text`` are not looked at; an empty table gives no row.
    """
    rows = signatures(docs, width)
    nodes = stored(
        rows.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("root"),
            F.first("sig").alias("sig"),
            F.min(F.struct(handle(F.col("doc_id")).alias("rep"), "sha")).alias("pick"),
        )
        .select("node", "root", "sig", "pick.rep", "pick.sha")
    )
    members = entries(nodes)
    sharing = members.select("node").distinct()
    sets = full_sets(docs, stored(sharing.join(nodes, "node").select("node", "rep", "sha")), width)
    pairs = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = confirm(pairs, nodes, sets, percent)
    labels = star_components(links)
    late = late_links(members, sets, labels, percent, size)
    if not late.isEmpty():
        stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = star_components(stars.union(late))
    reached = nodes.select("node", "root").join(labels, "node")
    smallest = reached.groupBy("label").agg(F.min("root").alias("least"))
    joined = settled(reached.select("node", "label").join(smallest, "label").select("node", "least"))
    classes = settled(nodes.select("node", "root").join(joined, "node", "left").select("node", F.coalesce("least", "root").alias("least")))
    found = rows.select("doc_id", "n", "node").join(classes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


shipped(__name__)


@register("op13_minhash_stars")
def op13_minhash_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
