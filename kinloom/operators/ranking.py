"""Ranking of candidates and the scored-pair table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom import fixed
from kinloom.functions import arrays as A
from kinloom.functions import scalars as S
from kinloom.operators.kinship import kin_path_count
from kinloom.operators.ordered import numbered
from kinloom.session import settle

LEFT = ("year", "h")
# Which vector (id, copy) each member of a pair has.
PAIR_KEYS = ("_hk", "_hc", "_wk", "_wc")


def best_first(score: str = "score", other: str = "w") -> list[Column]:
    return [F.desc(score), F.col(other)]


def rank_candidates(scores: DataFrame, keys: Sequence[str] = LEFT) -> DataFrame:
    """Full rank of every candidate per left entity; a hot entity is split over slices."""
    return numbered(scores, list(keys), best_first(), "rank")


def top_k_per_left(scores: DataFrame, k: int, keys: Sequence[str] = LEFT) -> DataFrame:
    """k best per left entity; every map task passes on at most k rows per entity."""
    window = Window.partitionBy(*keys).orderBy(*best_first())
    return scores.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _with_truth(scores: DataFrame, truth: DataFrame) -> DataFrame:
    return scores.join(truth.select("year", "h", "true_w"), ["year", "h"])


def true_scores(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Score of the true partner per left entity.

    A truth table that already carries ``true_score`` needs no join.
    """
    if "true_score" in truth.columns:
        known = truth.select("year", "h", "true_w", "true_score")
        return known.where(F.col("true_score").isNotNull())
    return (
        _with_truth(scores, truth)
        .where(F.col("w") == F.col("true_w"))
        .select("year", "h", "true_w", F.col("score").alias("true_score"))
    )


def rank_of_truth(
    scores: DataFrame,
    truth: DataFrame,
    pool: DataFrame | None = None,
    default_score: float = 0.0,
    exact_ties: bool = False,
) -> DataFrame:
    """Rank of the true partner without sorting: members that beat it, plus one.

    Equal scores are ordered by id, as in ``rank_candidates``. With ``pool`` (year, w)
    the whole cohort takes part: members without a score count with ``default_score``,
    by counting, not by building the missing pairs; a truth outside the pool is left out.
    Unscored members tied with the truth stand behind it, or by id with ``exact_ties``
    (which numbers the pool).
    """
    if pool is None:
        known = true_scores(scores, truth)
    else:
        members = pool.select("year", F.col("w").alias("true_w"))
        if "true_score" not in truth.columns:
            found = true_scores(scores, truth).select("year", "h", "true_score")
            truth = truth.join(found, ["year", "h"], "left")
        known = (
            truth.select("year", "h", "true_w", "true_score")
            .join(members, ["year", "true_w"], "left_semi")
            .withColumn("_scored", F.col("true_score").isNotNull().cast("int"))
            .withColumn("true_score", F.coalesce("true_score", F.lit(float(default_score))))
        )
    ahead = (F.col("score") > F.col("true_score")) | (
        (F.col("score") == F.col("true_score")) & (F.col("w") < F.col("true_w"))
    )
    counted = (
        scores.select("year", "h", "w", "score")
        .join(known.select("year", "h", "true_w", "true_score"), ["year", "h"])
        .groupBy("year", "h")
        .agg(
            F.count_if(ahead).alias("n_better"),
            F.count("*").alias("n_scored"),
            F.count_if(F.col("w") < F.col("true_w")).alias("_scored_before"),
        )
    )
    if pool is None:
        return known.join(counted, ["year", "h"]).select(
            "year", "h", "true_w", "true_score",
            (F.col("n_better") + 1).alias("rank_of_truth"),
            F.col("n_scored").alias("n_pool"),
        )
    sizes = pool.groupBy("year").agg(F.count("*").alias("n_pool"))  # one row per year
    joined = (
        known.join(counted, ["year", "h"], "left")
        .join(sizes, "year")
        .na.fill(0, ["n_better", "n_scored", "_scored_before"])
    )
    default = F.lit(float(default_score))
    unscored = F.col("n_pool") - F.col("n_scored") - (1 - F.col("_scored"))
    filled = F.when(default > F.col("true_score"), unscored)
    if exact_ties:
        placed = numbered(pool, ["year"], ["w"], "_pos", start=0).withColumnRenamed("w", "true_w")
        joined = joined.join(placed, ["year", "true_w"])
        filled = filled.when(default == F.col("true_score"), F.col("_pos") - F.col("_scored_before"))
    return joined.select(
        "year", "h", "true_w", "true_score",
        (F.col("n_better") + filled.otherwise(0) + 1).cast("bigint").alias("rank_of_truth"),
        "n_pool",
    )


def hard_negatives(scores: DataFrame, truth: DataFrame, k: int = fixed.HARD_NEGATIVES) -> DataFrame:
    """k best-scored wrong candidates per left entity that has a true partner."""
    wrong = _with_truth(scores, truth).where(F.col("w") != F.col("true_w"))
    return top_k_per_left(wrong, k).withColumnRenamed("rank", "neg_rank")


def score_gap(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Label and gap per scored pair of an entity whose true partner is scored.

    Positive: score minus the best wrong score (0 when there is none). Negative: score
    minus the score of the true partner.
    """
    pairs = _with_truth(scores, truth)
    right = F.col("w") == F.col("true_w")
    sides = pairs.groupBy("year", "h").agg(
        F.max(F.when(~right, F.col("score"))).alias("_best_wrong"),
        F.max(F.when(right, F.col("score"))).alias("_true"),
    ).where(F.col("_true").isNotNull())
    gap = F.when(right, F.col("score") - F.coalesce("_best_wrong", F.lit(0.0))).otherwise(
        F.col("score") - F.col("_true")
    )
    return pairs.join(sides, ["year", "h"]).select(
        "year", "h", "w", "score", right.cast("int").alias("label"), gap.alias("score_gap")
    )


def mutual_best(scores: DataFrame, left: Sequence[str] = ("year", "h"), right: Sequence[str] = ("year", "w")) -> DataFrame:
    """Pairs that are each other's best; equal scores go to the smaller id."""
    window_l = Window.partitionBy(*left).orderBy(F.desc("score"), *[c for c in right if c not in left])
    window_r = Window.partitionBy(*right).orderBy(F.desc("score"), *[c for c in left if c not in right])
    best_l = scores.withColumn("_l", F.row_number().over(window_l)).where(F.col("_l") == 1).drop("_l")
    best_r = scores.withColumn("_r", F.row_number().over(window_r)).where(F.col("_r") == 1)
    keys = list(dict.fromkeys([*left, *right]))
    return best_l.join(best_r.select(*keys), keys, "left_semi")


def list_matches(pairs: DataFrame, positives_only: bool = True, limit: int = 300) -> DataFrame:
    """The match list: filtered, best score first, with the kind of pair."""
    shown = pairs.where(F.col("label") == 1) if positives_only else pairs
    return shown.withColumn("pair_type", S.pair_type(F.col("label"))).orderBy(
        F.desc("score"), "id", *[c for c in ("year",) if c in pairs.columns]
    ).limit(limit)


# What lineages and kin paths add to the pairs, in this order.
LOOKED_UP = ("lineage_husband", "lineage_wife", "same_lineage", "patri_path_count")


def _with_lineage(pairs: DataFrame, roots: DataFrame, side: str, name: str, buckets: int) -> DataFrame:
    """The lineage of one side. Whole numbers are equal where their texts (``_ht``, ``_wt``) are."""
    kinds = [df.schema[c].dataType for df, c in ((pairs, side), (roots, "id"))]
    whole = all(isinstance(k, T.IntegralType) for k in kinds) or all(isinstance(k, T.StringType) for k in kinds)
    key, found = (F.col(f"_{side}t"), F.col("id").cast("string")) if whole else (F.col(side), F.col("id"))
    tags = roots.select(found.alias("_id"), S.lineage_tag(F.col("root"), buckets).alias(name))
    return pairs.join(tags, key == F.col("_id"), "left").drop("_id").withColumn(name, F.coalesce(name, F.lit("L_unknown")))


def scored_pair_table(
    scores: DataFrame,
    truth: DataFrame,
    k: int = fixed.HARD_NEGATIVES,
    assignment: DataFrame | None = None,
    roots: DataFrame | None = None,
    path_counts: DataFrame | None = None,
    prefix: str = "P",
    number_pairs: bool = True,
    edges: DataFrame | None = None,
    vectors: DataFrame | None = None,
    buckets: int = fixed.LINEAGE_BUCKETS,
    vector_key: Callable[[Column], Column] | None = None,
    attach: bool = True,
) -> DataFrame:
    """True pairs and k hard negatives per left entity, in the published pair layout.

    ``assignment`` (year, h, w) gives ``hungarian_correct``; ``roots`` (id, root) the
    lineages, tagged with ``buckets``; ``path_counts`` (year, h, w, patri_path_count) the kin
    paths, which ``edges`` (ids as text) count for the pairs of the table itself; ``vectors``
    (id, vec) the vector ``z`` = [|a - b|, a * b] of every pair. ``vector_key`` tells which id
    of ``vectors`` a member uses (its own by default). Pairs are numbered while they are
    narrow; the vectors come last, so no shuffle carries ``z``. Without ``attach`` the table names
    the vectors (``PAIR_KEYS``) instead, to be stored narrow; ``with_pair_vectors`` makes ``z`` from it.
    """
    known = true_scores(scores, truth).select("year", "h", "true_w", "true_score")
    pairs = scores.select("year", "h", "w", "score").join(known, ["year", "h"])
    right = F.col("w") == F.col("true_w")
    ahead = (F.col("score") > F.col("true_score")) | (
        (F.col("score") == F.col("true_score")) & (F.col("w") < F.col("true_w"))
    )
    # Rank, best wrong score and the positive row come from one aggregate over the pairs.
    pos = (
        pairs.groupBy("year", "h", "true_w", "true_score")
        .agg(
            (F.count_if(ahead) + 1).cast("int").alias("rank_of_true_wife"),
            F.max(F.when(~right, F.col("score"))).alias("_best_wrong"),
        )
        .select(
            "year", "h", F.col("true_w").alias("w"), F.lit(1).alias("label"), F.lit(0).alias("neg_rank"),
            F.col("true_score").alias("score"),
            (F.col("true_score") - F.coalesce("_best_wrong", F.lit(0.0))).alias("score_gap"),
            "rank_of_true_wife",
        )
    )
    # A condition that says nothing about missing values keeps both reading the same shuffle.
    neg = top_k_per_left(pairs.where(F.coalesce(~right, F.lit(False))), k).select(
        "year", "h", "w", F.lit(0).alias("label"), F.col("rank").alias("neg_rank"), "score",
        (F.col("score") - F.col("true_score")).alias("score_gap"),
        F.lit(None).cast("int").alias("rank_of_true_wife"),
    )
    sides = [pos, neg]
    if assignment is not None:
        # Both lie by year and left entity here, so only the assignment moves.
        matched = assignment.select("year", "h", F.col("w").alias("_aw"))
        correct = F.when(F.col("label") == 1, F.coalesce(F.col("_aw") == F.col("w"), F.lit(False)))
        sides = [s.join(matched, ["year", "h"], "left").withColumn("hungarian_correct", correct).drop("_aw") for s in sides]
    out = sides[0].unionByName(sides[1])
    if edges is not None:
        # Many joins follow, so the pairs are made once.
        out = settle(out)
    # Lineages and kin paths look up the members by the same texts: the left ones first, then the
    # right ones, so the pairs move once for each.
    out = out.withColumns({"_ht": F.col("h").cast("string"), "_wt": F.col("w").cast("string")})
    if roots is not None:
        out = _with_lineage(out, roots, "h", "lineage_husband", buckets)
    if path_counts is not None:
        out = out.join(path_counts, ["year", "h", "w"], "left").withColumn(
            "patri_path_count", F.coalesce("patri_path_count", F.lit(0)).cast("int")
        )
    if edges is not None:
        out = kin_path_count(out.drop("patri_path_count"), edges, "_ht", "_wt")
        out = out.withColumn("patri_path_count", F.col("patri_path_count").cast("int"))
    if roots is not None:
        out = _with_lineage(out, roots, "w", "lineage_wife", buckets)
        out = out.withColumn("same_lineage", S.same_lineage(F.col("lineage_husband"), F.col("lineage_wife")))
    made = [c for c in out.columns if c not in ("_ht", "_wt", *LOOKED_UP)]
    out = out.select(*made, *[c for c in LOOKED_UP if c in out.columns])
    if vectors is not None:
        # A member with several vectors makes as many rows, which are numbered, too.
        counts = vectors.groupBy("id").agg(F.count("*").cast("int").alias("_n"))
        for side in ("h", "w"):
            key = F.col(side) if vector_key is None else vector_key(F.col(side))
            found = counts.select(F.col("id").alias(f"_{side}k"), "_n")
            out = out.withColumn("_k", key).join(found, F.col("_k") == F.col(f"_{side}k"), "left").drop("_k")
            each = F.sequence(F.lit(1), F.coalesce("_n", F.lit(1)))
            out = out.withColumn(f"_{side}c", F.explode(each)).drop("_n")
    out = (
        out.withColumn("score", F.round("score", 4))
        .withColumn("score_gap", F.round("score_gap", 4))
        .withColumn("era", S.era_of_year(F.col("year")))
        .withColumn("husband_id", F.concat(F.lit(prefix), F.col("h").cast("string")))
        .withColumn("wife_id", F.concat(F.lit(prefix), F.col("w").cast("string")))
    )
    if number_pairs:
        out = numbered(out, ["year"], ["h", F.desc("label"), "neg_rank"], "id", start=0, dear=edges is not None)
    return out if vectors is None or not attach else with_pair_vectors(out, vectors)


def _copies(vectors: DataFrame) -> DataFrame:
    """Vectors numbered per id: id, copy, vec."""
    return vectors.select("id", "vec", F.row_number().over(Window.partitionBy("id").orderBy("vec")).alias("copy"))


def with_pair_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``z`` for a pair table made with ``attach=False``, whose key columns it takes away.

    Each (id, copy) is there once, and grouping by it tells Spark so: who does not read ``z``
    pays for neither join.
    """
    own = _copies(vectors).groupBy("id", "copy").agg(F.first("vec").alias("vec"))
    out = pairs
    for side in ("h", "w"):
        mine = own.select(F.col("id").alias(f"_{side}i"), F.col("copy").alias(f"_{side}o"), F.col("vec").alias(f"_{side}v"))
        out = out.join(mine, (F.col(f"_{side}k") == F.col(f"_{side}i")) & (F.col(f"_{side}c") == F.col(f"_{side}o")), "left")
    z = A.pair_vector(F.col("_hv"), F.col("_wv")).alias("z")
    return out.select(*[c for c in pairs.columns if c not in PAIR_KEYS], z)
