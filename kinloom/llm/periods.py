"""Periodic runs of words, found with a suffix automaton and a link-cut tree of last occurrences.

The automaton of a word sequence has a suffix-link tree; the nodes above a prefix stand for its
suffixes. When word i is appended, all of them last occur at i: an access on the link-cut tree
recolours the path to the root, one segment of equal colour after the other. A segment with
previous end j whose longest suffix has at least p = i - j words says that the last p words
also end at j: a square of period p, and every primitively rooted square that ends at i shows
in exactly one segment. Squares of one period at consecutive ends are one run.

The tree work is done where a run may be. A run of period q and 4 q words or more repeats
each of its sequences of ``GRAM`` words within q places, for 3 q - 3 places on end, and the
distances to the previous place of each sequence are found for a whole batch by one sort.
Stretches that qualify, with the words before them, are searched; the screen loses no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import documents, register, shipped, text_or_empty, words_of

LEAST = 6  # words of a run at least
TIMES = 4  # periods of a run at least
GRAM = 4  # words of the sequences that the screen looks at

Run = tuple[int, int, int]  # start, length, period


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(longest length, suffix link) of every state and the state of every prefix; state 0 is the root."""
    length, link, step = [0], [-1], [{}]
    at, prefixes = 0, []
    for n, word in enumerate(words, 1):
        new = len(length)
        length.append(n)
        link.append(0)
        step.append({})
        p = at
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p >= 0:
            q = step[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                link[q] = link[new] = clone
                while p >= 0 and step[p].get(word) == q:
                    step[p][word] = clone
                    p = link[p]
        at = new
        prefixes.append(new)
    return length, link, prefixes


class LastOccurrences:
    """The suffix-link tree with the last end of every state's words, as a link-cut tree.

    Preferred paths are splay trees by depth. All states of a path have the same last end; it is
    kept at the root of the path's splay tree.
    """

    def __init__(self, length: list[int], link: list[int]):
        # Nodes from 1 on, so that 0 is no node.
        self.length = [0, *length]
        self.up = [0, *(p + 1 for p in link)]
        n = len(self.up)
        self.left, self.right, self.end = [0] * n, [0] * n, [0] * n

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        if not p or (left[p] != x and right[p] != x):
            return
        while p and (left[p] == x or right[p] == x):
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == x):
                self._rotate(p)
                self._rotate(x)
            elif inner:
                self._rotate(x)
                self._rotate(x)
            else:
                self._rotate(x)
                break
            p = up[x]

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            left[p] = inner = right[x]
            right[x] = p
        else:
            right[p] = inner = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        up[p], up[x] = x, g
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:
            self.end[x] = self.end[p]

    def append(self, state: int, i: int) -> list[int]:
        """Recolour the path above ``state`` to ``i``; the periods of squares that end there."""
        up, right, end, length = self.up, self.right, self.end, self.length
        squares, below, x = [], 0, state + 1
        while x:
            self._splay(x)
            before = end[x]
            if before and i - before <= length[x]:
                squares.append(i - before)
            deeper = right[x]
            if deeper:
                # The part below keeps its colour and becomes a path of its own.
                end[deeper] = before
            right[x] = below
            below, x = x, up[x]
        end[below] = i
        self._splay(state + 1)
        return squares


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of ``words``: maximal stretches with smallest period q and max(least, times * q) words.

    ``times`` is 2 at least. Memory and time grow with the words, nearly in proportion.
    """
    length, link, prefixes = suffix_automaton(words)
    tree = LastOccurrences(length, link)
    since: dict[int, list[int]] = {}  # period: first and last end of squares on end
    found: list[Run] = []

    def close(period: int, ends: list[int]) -> None:
        start = ends[0] - 2 * period
        if ends[1] - start >= max(least, times * period):
            found.append((start, ends[1] - start, period))

    for i, state in enumerate(prefixes, 1):
        for period in tree.append(state, i):
            ends = since.get(period)
            if ends and ends[1] == i - 1:
                ends[1] = i
            else:
                if ends:
                    close(period, ends)
                since[period] = [i, i]
    for period, ends in since.items():
        close(period, ends)
    return sorted((start, n, period) for start, n, period in found)


def stretches(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the stretches of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    first, last = edges[::2], edges[1::2] - 1
    long = last - first + 1 >= least
    return first[long], last[long]


def windows(ids: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words that hold every run with the defaults; ``doc`` rises and tells documents apart."""
    n = len(ids)
    begin, end = [], []
    for q in range(1, GRAM):
        if n > q:
            same = (ids[q:] == ids[:-q]) & (doc[q:] == doc[:-q])
            first, last = stretches(same, max(LEAST, TIMES * q) - q)
            begin.append(first)
            end.append(last + q + 1)
    if n >= GRAM:
        m = n - GRAM + 1
        mixed = doc[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(GRAM):
            mixed = (mixed ^ ids[k : k + m].astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
            mixed ^= mixed >> np.uint64(29)
        order = np.argsort(mixed, kind="stable")
        again = mixed[order[1:]] == mixed[order[:-1]]
        # Distance to the previous place of the same sequence; equal hashes of others only add work.
        distance = np.full(m, n, np.int64)
        distance[order[1:][again]] = (order[1:] - order[:-1])[again]
        inside = doc[:m] == doc[GRAM - 1 :]
        distance[~inside] = n
        low, repeated = GRAM, int((distance < n).sum())
        longest = int(np.bincount(doc).max())
        while low * TIMES <= longest and 3 * low - GRAM + 1 <= repeated:
            first, last = stretches(distance < 2 * low, 3 * low - GRAM + 1)
            # The run begins at most one period before its first repeated sequence.
            begin.append(first - 2 * low)
            end.append(last + GRAM)
            low *= 2
    if not begin:
        return []
    starts, ends = np.concatenate(begin), np.concatenate(end)
    if not len(starts):
        return []
    # A window stays in the document in which its stretch lies.
    bounds = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    inside = bounds[np.searchsorted(bounds, ends - 1, "right") - 1]
    starts = np.maximum(starts, inside)
    order = np.lexsort((ends, starts))
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    apart = np.flatnonzero(np.append(True, (starts[1:] >= ends[:-1])))
    return [(int(a), int(b)) for a, b in zip(starts[apart], np.append(ends[apart[1:] - 1], ends[-1]))]


def batch_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, given as its words."""
    numbers: dict[bytes, int] = {}
    sizes = np.array([len(words) for words in texts], np.int64)
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for words in texts for w in words), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    first = np.cumsum(sizes) - sizes
    out: list[list[Run]] = [[] for _ in texts]
    for a, b in windows(ids, doc):
        d = int(doc[a])
        out[d] += [(a - int(first[d]) + start, n, period) for start, n, period in runs_of(ids[a:b].tolist())]
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, n, period in runs:
        gone[start + period] += 1
        gone[start + n] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(words, keep) if k]


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
FOUND = f"id string, n_words long, runs {RUNS}, collapsed string"


def search(batches: Iterator[pd.DataFrame], words_at_once: int = 400_000) -> Iterator[pd.DataFrame]:
    """Runs and collapsed texts; texts are taken together up to a number of words."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for id_, text in zip(batch["id"], batch["text"]):
            ids.append(id_)
            texts.append(bytes(text).split())
            held += len(texts[-1])
            if held > words_at_once:
                yield results(ids, texts)
                ids, texts, held = [], [], 0
        if ids:
            yield results(ids, texts)


def results(ids: list[str | None], texts: list[list[bytes]]) -> pd.DataFrame:
    runs = batch_runs(texts)
    return pd.DataFrame(
        {
            "id": pd.Series(ids, dtype=object),
            "n_words": [len(words) for words in texts],
            "runs": [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs],
            "collapsed": [b" ".join(collapsed(w, r)).decode("utf-8", "replace") for w, r in zip(texts, runs)],
        }
    )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start) and the collapsed text of every row.

    A run is a stretch of words with smallest period q and max(6, 4 q) words or more that no
    neighbouring word extends. The collapsed text has the words that no run holds after its
    first period, joined by one space. Words end at ASCII white space. Null and empty texts
    have no words and an empty collapsed text; repeated rows are rows of their own, a null
    doc_id stays null. Columns other than ``doc_id`` and ``text`` are not looked at; an empty
    table gives no row. A text is searched in one task, with memory in proportion to it.
    """
    picked = docs.select(F.col("doc_id").cast("string").alias("id"), F.encode(text_or_empty(), "UTF-8").alias("text"))
    return picked.mapInPandas(search, FOUND).select(
        F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", "runs", "collapsed"
    )


def longest_run(runs: Column) -> Column:
    """The run with the greatest length / period; equal ones by start, then period. Null without runs."""

    def better(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(a.isNull() | (right > left), b).otherwise(a)

    # Runs come by start and period, so a later one has to be strictly better.
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, every tenth document (by CRC-32 of its id) made periodic from some word on.

    With h the CRC-32, g = floor(h / 10) and n words, words from a = g mod n on repeat the
    p = 1 + floor((n - a) / (3 + g mod 8)) words there. Rows without a doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.call_function("div", h, F.lit(10).cast("long"))
    # Only chosen texts are cut into words.
    words = words_of(text_or_empty())
    n = F.size("w").cast("long")
    a = F.col("g") % n
    p = F.lit(1) + F.call_function("div", n - a, F.lit(3) + F.col("g") % 8)
    tail = F.transform(F.slice("w", (F.col("a") + 1).cast("int"), F.size("w")), lambda _, i: F.get("head", i % F.col("p").cast("int")))
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    cut = docs.select("doc_id", text_or_empty().alias("text"), g.alias("g"), F.when(chosen, words).alias("w"))
    placed = cut.select("doc_id", "text", "w", F.when(n > 0, a).alias("a"), F.when(n > 0, p).alias("p"))
    headed = placed.withColumn("head", F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int")))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return headed.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


shipped(__name__)


@register("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs as one row of figures and digests for each document."""
    found = periodic_runs(with_planted_periods(documents(spark, sf_dir)))
    top = longest_run(F.col("runs"))
    lines = F.array_join(
        F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), ""
    )
    return found.select("doc_id", "runs", "collapsed", top.alias("top")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.call_function("div", F.lit(1000).cast("long") * F.col("top.length"), F.col("top.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
