"""Candidate pools, within-cohort negatives and exact scoring of whole cohorts."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom import fixed
from kinloom.functions import arrays as A
from kinloom.operators.ordered import numbered
from kinloom.session import settle


def cohort_pool(pairs: DataFrame) -> DataFrame:
    """Distinct right-side ids per cohort year."""
    return pairs.select("year", "w").distinct()


def one_truth(pairs: DataFrame) -> DataFrame:
    """One true partner per (year, h): the last by id when a cohort lists several."""
    return pairs.groupBy("year", "h").agg(F.max("w").alias("true_w"))


def indexed_pool(pool: DataFrame, seed: int | None = None) -> DataFrame:
    """pool(year, w, pos) with pos 0.. per year, in id order or in a seeded hash order."""
    order = [F.col("w")] if seed is None else [F.xxhash64(F.lit(seed), F.col("w")), F.col("w")]
    return numbered(pool, ["year"], order, "pos", start=0)


def _drawn(positives: DataFrame, indexed: DataFrame, slots: Column, k: int) -> DataFrame:
    """Pool members at the slots of each positive; slots skip the positive's own place."""
    sizes = indexed.groupBy("year").agg(F.count("*").alias("n"))  # one row per year
    own = indexed.select("year", F.col("w").alias("_tw"), F.col("pos").alias("_own"))
    placed = (
        positives.join(sizes, "year")
        .join(own.withColumnRenamed("year", "_y"), (F.col("year") == F.col("_y")) & (F.col("w") == F.col("_tw")), "left")
        .drop("_y", "_tw")
        .withColumn("m", F.col("n") - F.col("_own").isNotNull().cast("int"))
        .where(F.col("m") > 0)
    )
    drawn = placed.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_slot", slots)
    drawn = drawn.where(F.col("_slot").isNotNull()).withColumn(
        "pos", F.when(F.col("_slot") >= F.col("_own"), F.col("_slot") + 1).otherwise(F.col("_slot"))
    )
    members = indexed.withColumnRenamed("w", "neg_w")
    return drawn.join(members, ["year", "pos"]).select("year", "h", F.col("w").alias("true_w"), "neg_w", "i")


def sample_negatives(
    positives: DataFrame, pool: DataFrame, k: int = fixed.NEGATIVES_PER_POSITIVE, seed: int = 0
) -> DataFrame:
    """k members of the same cohort other than the own partner, per positive.

    The pool is numbered per year; each positive cuts the other m places into k equal
    strata, draws one place per stratum and turns the circle by a random step, so the
    places are distinct and every member is drawn with probability k/m. A pool smaller
    than k is drawn with replacement, a pool of nobody else gives no rows. The join is
    on (year, place), so no positive is ever paired with the whole cohort.
    """
    indexed = indexed_pool(pool, seed)
    m, i = F.col("m"), F.col("i")
    draw = F.xxhash64(F.lit(seed), F.col("year"), F.col("h"), F.col("w"), i)
    turn = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("year"), F.col("h"), F.col("w")), m)
    low = F.floor(i * m / F.lit(k))
    high = F.floor((i + 1) * m / F.lit(k))
    stratified = F.pmod(low + F.pmod(draw, F.greatest(high - low, F.lit(1))) + turn, m)
    slots = F.when(m >= k, stratified).otherwise(F.pmod(draw, m)).cast("bigint")
    return _drawn(positives, indexed, slots, k)


def first_k_candidates(positives: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Hash-free variant: the next k members after the own partner, in circular id order."""
    indexed = indexed_pool(pool)
    own = F.coalesce(F.col("_own"), F.lit(0))
    slots = F.when(F.col("i") < F.col("m"), F.pmod(own + F.col("i"), F.col("m"))).cast("bigint")
    return _drawn(positives, indexed, slots, k)


def training_examples(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """examples(year, h, w, label): positives 1, sampled negatives 0."""
    ones = positives.select("year", "h", "w", F.lit(1).alias("label"))
    zeros = negatives.select("year", "h", F.col("neg_w").alias("w"), F.lit(0).alias("label"))
    return ones.unionByName(zeros)


def batch_years(pairs: DataFrame, k: int = fixed.BATCH_YEARS, seed: int | None = 0) -> DataFrame:
    """Shuffled cohort years in batches of k (years in order when ``seed`` is None)."""
    years = pairs.select("year").distinct()
    order = [F.col("year")] if seed is None else [F.xxhash64(F.lit(seed), F.col("year")), F.col("year")]
    placed = numbered(years, [], order, "place", start=0)
    return placed.select("year", F.floor(F.col("place") / k).cast("int").alias("batch"))


# -- exact scoring of a cohort --------------------------------------------------------


def _block_scores(hm: np.ndarray, hw: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Scores of one block of left rows against one block of right rows.

    Features are added one by one in the order of ``arrays.linear_score``, so both give the
    same number to the last bit.
    """
    a, b, c, d = np.split(weights, 4)
    from_left = np.zeros(len(hm))
    for i, x in enumerate(a):
        from_left = from_left + hm[:, i] * x
    out = np.repeat(from_left[:, None], len(hw), axis=1)
    for i, x in enumerate(b):
        out += (hw[:, i] * x)[None, :]
    room, columns = np.empty_like(out), np.ascontiguousarray(hw.T)
    for i, x in enumerate(c):
        np.subtract(hm[:, i][:, None], columns[i][None, :], out=room)
        np.abs(room, out=room)
        room *= x
        out += room
    for i, x in enumerate(d):
        np.multiply(hm[:, i][:, None], columns[i][None, :], out=room)
        room *= x
        out += room
    out += bias
    return out


def score_cohorts(
    left: DataFrame,
    right: DataFrame,
    truth: DataFrame | None,
    weights: Sequence[float],
    bias: float = 0.0,
    k: int = 10,
    block: int = 1024,
) -> DataFrame:
    """Exact top-k candidates and rank of the true partner over the whole cohort.

    ``left``/``right`` have (year, id, vec); the score is linear in
    [a, b, |a-b|, a*b]. Both sides are cut into blocks of about ``block`` rows. Every
    left block meets every right block of its year in one task, which returns for each
    left row only its k best and the number of members that beat the true partner. Of the
    block results a window keeps k per left row, so no list is longer: all M x W scores are
    computed, as the definition demands, but never emitted, shuffled or held together.
    Ties go by id: an equal score beats the true partner if its id is smaller.

    Returns (year, h, top: array of (score, w), true_w, true_score, rank_of_truth, n_pool).
    """
    w = np.asarray(weights, dtype="float64")
    if len(w) % 4:
        raise ValueError("weights must hold four equally long parts")
    n_left = left.groupBy("year").agg(F.ceil(F.count("*") / block).cast("int").alias("nl"))
    n_right = right.groupBy("year").agg(F.ceil(F.count("*") / block).cast("int").alias("nr"))
    blocks = n_left.join(n_right, "year")  # one row per year

    men = left.select("year", F.col("id").alias("h"), A.as_doubles(F.col("vec")).alias("hv"))
    women = right.select("year", F.col("id").alias("w"), A.as_doubles(F.col("vec")).alias("wv"))
    if truth is None:
        men = men.withColumn("true_w", F.lit(None).cast(women.schema["w"].dataType)).withColumn(
            "true_score", F.lit(None).cast("double")
        )
    else:
        named = truth.select("year", "h", "true_w")
        partner = women.select("year", F.col("w").alias("true_w"), F.col("wv").alias("_tv"))
        men = men.join(named, ["year", "h"], "left").join(partner, ["year", "true_w"], "left")
        features = A.pair_features(F.col("hv"), F.col("_tv"))
        men = men.withColumn(
            "true_score", F.when(F.col("_tv").isNotNull(), A.linear_score(features, list(w), bias))
        ).drop("_tv")

    known = men.select("year", "h", "true_w", "true_score")
    # Fresh names for the block keys: both sides may come from the same table.
    men = men.join(blocks, "year").select(
        F.col("year").alias("ly"), "h", "hv", "true_score",
        # As text: a missing partner would turn a column of numbers into floats.
        F.col("true_w").cast("string").alias("true_w"),
        F.pmod(F.xxhash64("h"), F.col("nl")).cast("int").alias("lb"),
        F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("lr"),
    )
    women = women.join(blocks, "year").select(
        F.col("year").alias("ry"), F.col("w").alias("w"), "wv",
        F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("rl"),
        F.pmod(F.xxhash64("w"), F.col("nr")).cast("int").alias("rb"),
    )
    id_type = women.schema["w"].dataType
    schema = T.StructType(
        [
            T.StructField("year", men.schema["ly"].dataType),
            T.StructField("h", men.schema["h"].dataType),
            T.StructField("w", id_type),
            T.StructField("score", T.DoubleType()),
            T.StructField("n_better", T.LongType()),
            T.StructField("n_seen", T.LongType()),
        ]
    )

    def score_block(key: tuple, lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame(columns=schema.names)
        rp = rp.sort_values("w", kind="stable").reset_index(drop=True)
        scores = _block_scores(np.stack(lp["hv"].to_list()), np.stack(rp["wv"].to_list()), w, bias)
        ids = rp["w"].to_numpy()
        true_scores = lp["true_score"].to_numpy(dtype="float64")[:, None]
        # Place of the true partner among the sorted ids; members before it win ties.
        kind = ids.dtype.type if ids.dtype.kind in "iu" else str
        at = np.array([0 if t is None else np.searchsorted(ids, kind(t)) for t in lp["true_w"]])[:, None]
        own = np.array([None if t is None else kind(t) for t in lp["true_w"]], dtype=object)[:, None]
        others = ids.astype(object)[None, :] != own
        ahead = np.arange(len(ids))[None, :] < at
        better = (((scores > true_scores) | ((scores == true_scores) & ahead)) & others).sum(axis=1)
        take = min(k, len(ids))
        order = np.argsort(-scores, axis=1, kind="stable")[:, :take]
        rows = np.repeat(np.arange(len(lp)), take)
        first = np.tile(np.arange(take) == 0, len(lp))
        return pd.DataFrame(
            {
                "year": lp["ly"].to_numpy()[rows],
                "h": lp["h"].to_numpy()[rows],
                "w": ids[order.ravel()],
                "score": scores[rows, order.ravel()],
                "n_better": np.where(first, better[rows], 0),
                "n_seen": np.where(first, len(ids), 0),
            },
            columns=schema.names,
        )

    met = settle(
        men.groupBy("ly", "lb", "lr")
        .cogroup(women.groupBy("ry", "rl", "rb"))
        .applyInPandas(score_block, schema)
    )
    order = Window.partitionBy("year", "h").orderBy(F.desc("score"), "w")
    kept = met.where(F.col("w").isNotNull()).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    tops = kept.groupBy("year", "h").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_r", "score", "w"))), lambda x: F.struct(x["score"].alias("score"), x["w"].alias("w"))
        ).alias("top")
    )
    counts = met.groupBy("year", "h").agg(F.sum("n_better").alias("n_better"), F.sum("n_seen").alias("n_pool"))
    out = tops.join(counts, ["year", "h"]).join(known, ["year", "h"], "left")
    return out.select(
        "year", "h", "top", "true_w", "true_score",
        F.when(F.col("true_score").isNotNull() & ~F.isnan("true_score"), F.col("n_better") + 1).alias("rank_of_truth"),
        "n_pool",
    )


# -- exact top k by bounds on blocks ---------------------------------------------------


def box_bounds(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], weights: np.ndarray
) -> np.ndarray:
    """The score without bias that no pair from two boxes exceeds; one row per pair of boxes.

    Each dimension adds ax + by + c|x-y| + dxy. On either side of x = y that has its maximum over a
    box in a corner, where the diagonal enters or leaves it, or, if d < 0, at the vertex on the
    diagonal; so the bound is the exact maximum of every dimension, plus room for rounding.
    """
    a, b, c, d = np.split(weights, 4)
    (x0, x1), (y0, y1) = left, right

    def part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return a * x + b * y + c * np.abs(x - y) + d * x * y

    best = np.maximum.reduce([part(x, y) for x in (x0, x1) for y in (y0, y1)])
    low, high = np.maximum(x0, y0), np.minimum(x1, y1)
    vertex = np.divide(-(a + b), 2 * d, out=np.zeros_like(d), where=d < 0)
    for t in (low, high, np.clip(vertex, low, np.maximum(low, high))):
        best = np.where(low <= high, np.maximum(best, part(t, t)), best)
    x, y = np.maximum(np.abs(x0), np.abs(x1)), np.maximum(np.abs(y0), np.abs(y1))
    size = np.abs(a) * x + np.abs(b) * y + np.abs(c) * (x + y) + np.abs(d) * x * y
    return best.sum(axis=1) + 1e-12 * size.sum(axis=1)


def _near_blocks(side: DataFrame, d: int, block: int, most: int = 20) -> DataFrame:
    """``side`` (_c, id, vec) with its block ``b``: rows on the same side of the same hyperplanes.

    A cohort of n rows uses log2(n / block) + 2 hyperplanes, at most ``most``, through the mean of
    its projections. A block of more than ``block`` rows is dealt by hash. Blocks only decide how
    much is skipped, never the result.
    """
    planes = np.random.default_rng(0).normal(size=(most, d))
    axes = F.array(*[F.array(*[F.lit(float(x)) for x in plane]) for plane in planes])
    cast = side.select("_c", "id", A.as_doubles(F.col("vec")).alias("vec"))
    projected = cast.withColumn("_p", F.transform(axes, lambda axis: A.dot(axis, F.col("vec"))))
    means = projected.groupBy("_c").agg(
        F.array(*[F.avg(F.col("_p")[i]) for i in range(most)]).alias("_m"),
        F.least(F.lit(most), F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / block)) + 2)).cast("int").alias("_bits"),
    )
    bits = F.zip_with("_p", "_m", lambda p, m: F.when(p > m, "1").otherwise("0"))
    coded = projected.join(means, "_c").select("_c", "id", "vec", F.array_join(F.slice(bits, 1, F.col("_bits")), "").alias("_code"))
    pieces = coded.groupBy("_c", "_code").agg(F.ceil(F.count("*") / block).alias("_pieces"))
    piece = F.pmod(F.xxhash64("id"), F.col("_pieces")).cast("string")
    return coded.join(pieces, ["_c", "_code"]).select("_c", "id", "vec", F.concat_ws(".", "_code", piece).alias("b"))


# Rows of a tile: neighbouring blocks whose rows travel and are scored together.
TILE = 2048


def _tiled(blocks: DataFrame) -> DataFrame:
    """Rows of ``_near_blocks`` with the number of their block in the cohort (``b``) and its tile (``t``)."""
    sizes = blocks.groupBy("_c", "b").agg(F.count("*").alias("_rows"))
    order = Window.partitionBy("_c").orderBy("b")
    before = F.coalesce(F.sum("_rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.select("_c", "b", F.row_number().over(order).alias("_no"), F.floor(before / TILE).cast("int").alias("t"))
    return blocks.join(placed, ["_c", "b"]).select("_c", "id", "vec", F.col("_no").alias("b"), "t")


def _boxes(blocks: DataFrame, d: int, tag: str) -> DataFrame:
    """Least and greatest value of each dimension and the number of rows of every block."""
    ends = [F.array(*[f(F.col("vec")[i]) for i in range(d)]).alias(f"{tag}{n}") for f, n in ((F.min, "lo"), (F.max, "hi"))]
    keys = [F.col("_c").alias(f"{tag}c"), F.col("t").alias(f"{tag}t"), F.col("b").alias(f"{tag}b")]
    return blocks.groupBy(*keys).agg(*ends, F.count("*").alias(f"{tag}n"))


def top_candidates(
    left: DataFrame,
    right: DataFrame,
    weights: Sequence[float],
    bias: float = 0.0,
    k: int = 10,
    block: int = 1024,
    keys: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """The k best right members of every left member, exact, without scoring hopeless blocks.

    ``left``/``right`` have (year, id, vec) and the blocking ``keys``, if any; only members that
    agree in year and keys meet (missing values agree). Scores and ties are those of
    ``score_cohorts``. Near vectors share a block. Least and greatest values of each dimension bound
    the scores of a pair of blocks. Each left block first meets the right blocks of highest bound
    that hold k members; its worst k-th score then rules out all right blocks bounded below it.
    Vectors travel only to where blocks are scored with theirs. A bound that is no number rules out
    nothing; a score that is none comes last. Ids are unique within a cohort. Blocks are small, so that
    bounds are tight; tasks bound and score pairs of tiles, which are ``TILE`` rows of neighbouring
    blocks, so a vector travels once to each tile that has a block for it.

    Returns ((year, keys, h, top: array of (score, w)), (year, keys, n_block_pairs, n_scored)).
    A member of a cohort without right members has no row.
    """
    w = np.asarray(weights, dtype="float64")
    if len(w) % 4:
        raise ValueError("weights must hold four equally long parts")
    d, names = len(w) // 4, ["year", *keys]
    # Cohorts as text: one column that also stands for missing keys.
    cohort = F.to_json(F.struct(*names))
    cohorts = left.select(cohort.alias("_c"), *names).distinct()
    men = settle(_tiled(_near_blocks(left.select(cohort.alias("_c"), "id", "vec"), d, block)))
    women = settle(_tiled(_near_blocks(right.select(cohort.alias("_c"), "id", "vec"), d, block)))

    def bound(key: tuple, lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame(columns=["_c", "lt", "lb", "rt", "rb", "rn", "bound"])
        rlo, rhi = np.stack(rp["rlo"].to_list()), np.stack(rp["rhi"].to_list())
        bounds = [box_bounds((llo, lhi), (rlo, rhi), w) + bias for llo, lhi in zip(lp["llo"], lp["lhi"])]
        rights = {c: np.tile(rp[c].to_numpy(), len(lp)) for c in ("rb", "rn")}
        each = {"_c": key[0], "lt": key[1], "lb": np.repeat(lp["lb"].to_numpy(), len(rp)), "rt": key[2]}
        return pd.DataFrame({**each, **rights, "bound": np.concatenate(bounds)})

    left_tiles = men.select(F.col("_c").alias("rc"), F.col("t").alias("rl")).distinct()
    right_tiles = women.select(F.col("_c").alias("lc"), F.col("t").alias("lr")).distinct()
    pairs = (
        _boxes(men, d, "l").join(right_tiles, "lc").groupBy("lc", "lt", "lr")
        .cogroup(_boxes(women, d, "r").join(left_tiles, "rc").groupBy("rc", "rl", "rt"))
        .applyInPandas(bound, "_c string, lt int, lb int, rt int, rb int, rn long, bound double")
    )
    best = Window.partitionBy("_c", "lb").orderBy(F.desc("bound"), "rb").rowsBetween(Window.unboundedPreceding, -1)
    pairs = settle(pairs.withColumn("_first", F.coalesce(F.sum("rn").over(best), F.lit(0)) < k))

    schema = T.StructType(
        [
            T.StructField("_c", T.StringType()),
            T.StructField("lb", T.IntegerType()),
            T.StructField("h", left.schema["id"].dataType),
            T.StructField("w", right.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def score_tiles(key: tuple, lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame(columns=schema.names)
        rp = rp.sort_values("w", kind="stable").reset_index(drop=True)
        ids, blocks, vectors = rp["w"].to_numpy(), rp["rb"].to_numpy(), np.stack(rp["wv"].to_list())
        made = []
        for lb, mine in lp.groupby("lb", sort=False):
            at = np.flatnonzero(np.isin(blocks, mine["rbs"].iloc[0]))
            scores = _block_scores(np.stack(mine["hv"].to_list()), vectors[at], w, bias)
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(mine)), order.shape[1])
            data = {"_c": key[0], "lb": lb, "h": mine["h"].to_numpy()[rows], "w": ids[at[order.ravel()]]}
            made.append(pd.DataFrame({**data, "score": scores[rows, order.ravel()]}, columns=schema.names))
        return pd.concat(made, ignore_index=True)

    # Fresh names: both sides may come from the same table.
    lefts = men.select(F.col("_c").alias("lc"), F.col("b").alias("lb"), F.col("id").alias("h"), F.col("vec").alias("hv"))
    rights = women.select(F.col("_c").alias("rc"), F.col("b").alias("rb"), F.col("id").alias("w"), F.col("vec").alias("wv"))

    def scored(which: DataFrame) -> DataFrame:
        to_left = which.groupBy(F.col("_c").alias("lc"), "lb", "lt", F.col("rt").alias("lr")).agg(F.collect_list("rb").alias("rbs"))
        to_right = which.select(F.col("_c").alias("rc"), "rb", F.col("lt").alias("rl"), "rt").distinct()
        met = (
            lefts.join(to_left, ["lc", "lb"]).groupBy("lc", "lt", "lr")
            .cogroup(rights.join(to_right, ["rc", "rb"]).groupBy("rc", "rl", "rt"))
        )
        return settle(met.applyInPandas(score_tiles, schema))

    worth = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    order = Window.partitionBy("_c", "h").orderBy(F.desc(worth), F.isnan("score"), "w")
    first = scored(pairs.where("_first"))
    kth = first.withColumn("_r", F.row_number().over(order)).groupBy("_c", "lb", "h").agg(
        F.max(F.when(F.col("_r") == k, worth)).alias("kth")
    )
    least = kth.groupBy("_c", "lb").agg(F.min(F.coalesce("kth", F.lit(float("-inf")))).alias("least"))
    hopeless = (F.col("bound") < F.col("least")) & ~F.isnan("bound")
    chosen = settle(pairs.join(least, ["_c", "lb"]).withColumn("_second", ~F.col("_first") & ~hopeless))
    every = first.unionByName(scored(chosen.where("_second")))
    kept = every.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    tops = kept.groupBy("_c", "h").agg(F.sort_array(F.collect_list(F.struct("_r", "score", "w"))).alias("top"))
    tops = tops.withColumn("top", F.transform("top", lambda x: F.struct(x["score"].alias("score"), x["w"].alias("w"))))
    report = chosen.groupBy("_c").agg(
        F.count("*").alias("n_block_pairs"), F.count_if(F.col("_first") | F.col("_second")).alias("n_scored")
    )
    return tops.join(cohorts, "_c").select(*names, "h", "top"), report.join(cohorts, "_c").select(*names, "n_block_pairs", "n_scored")


def pair_vectors(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs with the feature vector [a, b, |a-b|, a*b] of their two members."""
    a = left.select("year", F.col("id").alias("h"), A.as_doubles(F.col("vec")).alias("_a"))
    b = right.select("year", F.col("id").alias("w"), A.as_doubles(F.col("vec")).alias("_b"))
    return (
        pairs.join(a, ["year", "h"])
        .join(b, ["year", "w"])
        .withColumn("features", A.pair_features(F.col("_a"), F.col("_b")))
        .drop("_a", "_b")
    )


def fit_pair_scorer(
    examples: DataFrame,
    left: DataFrame,
    right: DataFrame,
    validation: DataFrame,
    reg_params: Sequence[float] = (0.0, 0.01, 0.1),
    max_iter: int = 20,
) -> dict:
    """Logistic pair scorer; the setting with the best validation top-1 recall wins.

    Returns weights, bias, reg_param and recall (plain numbers, sized by the feature
    vector); use them with ``score_cohorts`` or ``arrays.linear_score``.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    # Only the cohorts that are judged are scored.
    judged = validation.select("year").distinct()
    left_judged, right_judged = left.join(judged, "year", "left_semi"), right.join(judged, "year", "left_semi")
    # The joined examples are written once: every setting and every step of a fit reads them.
    joined = settle(pair_vectors(examples, left, right).select(F.col("label").cast("double").alias("label"), "features"))
    train = joined.select("label", array_to_vector("features").alias("features"))
    best: dict | None = None
    for reg in reg_params:
        model = LogisticRegression(regParam=reg, maxIter=max_iter).fit(train)
        weights, bias = [float(c) for c in model.coefficients], float(model.intercept)
        scored = score_cohorts(left_judged, right_judged, validation, weights, bias, k=1)
        recall = scored.agg(
            F.avg(F.when(F.col("rank_of_truth").isNotNull(), (F.col("rank_of_truth") == 1).cast("int")))
        ).first()[0]
        recall = 0.0 if recall is None else float(recall)
        if best is None or recall > best["recall"]:
            best = {"weights": weights, "bias": bias, "reg_param": reg, "recall": recall}
    return best


# -- bounded selections that are features themselves ----------------------------------


def limit_left_entities(
    pairs: DataFrame, budget: int = fixed.PAIR_BUDGET, per_left: int = 1 + fixed.HARD_NEGATIVES, seed: int | None = 0
) -> DataFrame:
    """Distinct (h, w) of a cohort, sampled down to the pair budget (in id order without a seed)."""
    couples = pairs.select("h", "w").distinct()
    order = [F.col("h"), F.col("w")]
    if seed is not None:
        order = [F.md5(F.concat_ws("|", F.lit(seed), F.col("h"), F.col("w"))), *order]
    return couples.orderBy(*order).limit(max(1, budget // per_left))


def reference_sample(pairs: DataFrame, n: int = fixed.REFERENCE_SAMPLE, seed: int = 42) -> DataFrame:
    """n training positives in a seeded hash order."""
    train = pairs.where(F.col("bucket") == "train")
    key = F.xxhash64(F.lit(seed), F.col("h"), F.col("w"), F.col("year"))
    return train.orderBy(key, "h", "w", "year").limit(n)


# The functions that run in Python tasks travel with them, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
