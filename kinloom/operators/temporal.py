"""Cohort split, masking, ablation and as-of views of timed edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom import fixed


def bucket_of_year(
    year: Column,
    train_end: int = fixed.TRAIN_END_YEAR,
    val_end: int = fixed.VAL_END_YEAR,
    low: int = fixed.MIN_YEAR,
    high: int = fixed.MAX_YEAR,
) -> Column:
    """train / val / test by year; NULL outside [low, high]."""
    return (
        F.when((year < low) | (year > high), F.lit(None).cast("string"))
        .when(year <= train_end, "train")
        .when(year <= val_end, "val")
        .when(year.isNotNull(), "test")
    )


def cohort_split(edges: DataFrame, rel: str = "r_hw", **bounds: int) -> DataFrame:
    """pairs(h, w, year, bucket) from the edges of one relation."""
    return edges.where(F.col("rel") == rel).select(
        F.col("src").alias("h"),
        F.col("dst").alias("w"),
        F.col("t").alias("year"),
        bucket_of_year(F.col("t"), **bounds).alias("bucket"),
    )


def bucket_summary(pairs: DataFrame) -> DataFrame:
    """Pairs per (bucket, year), per bucket and in total, in one pass."""
    inside = pairs.where(F.col("bucket").isNotNull())
    return inside.rollup("bucket", "year").agg(
        F.count("*").alias("n_pairs"), F.grouping_id().cast("int").alias("level")
    )


def bucket_pair_set(pairs: DataFrame, buckets: Sequence[str] = ("val", "test")) -> DataFrame:
    """Distinct (h, w) of the given buckets."""
    return pairs.where(F.col("bucket").isin(list(buckets))).select("h", "w").distinct()


def exclusion_set(pairs: DataFrame, year: int) -> DataFrame:
    """Pairs to hide while the training cohort ``year`` is scored."""
    hidden = F.col("bucket").isin("val", "test") | (
        (F.col("bucket") == "train") & (F.col("year") == year)
    )
    return pairs.where(hidden).select("h", "w").distinct()


def restrict_years(pairs: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """Keep an inclusive year window per bucket; buckets not named are dropped."""
    keep = F.lit(False)
    for bucket, (low, high) in windows.items():
        keep = keep | ((F.col("bucket") == bucket) & F.col("year").between(low, high))
    return pairs.where(keep)


def ablate_relations(
    edges: DataFrame, relations: Sequence[str] = fixed.MATERNAL_RELATIONS
) -> DataFrame:
    """Edges without whole relations; ``edges.edge_counts`` still lists them with zero."""
    return edges.where(~F.col("rel").isin(list(relations)))


def mask_pairs(edges: DataFrame, pairs: DataFrame, rel: str = "r_hw") -> DataFrame:
    """Edges without the given pairs of one relation; other relations are not shuffled."""
    hidden = pairs.select(F.col("h").alias("_h"), F.col("w").alias("_w"))
    kept = edges.where(F.col("rel") == rel).join(
        hidden, (F.col("src") == F.col("_h")) & (F.col("dst") == F.col("_w")), "left_anti"
    )
    return edges.where(F.col("rel") != rel).unionByName(kept)


def as_of(edges: DataFrame, year: int, hidden: DataFrame | None = None) -> DataFrame:
    """Edges visible strictly before ``year``; static edges have time 0 and stay."""
    seen = edges.where(F.col("t") < year)
    return seen if hidden is None else mask_pairs(seen, hidden)


def as_of_many(edges: DataFrame, cohorts: DataFrame, year: str = "year") -> DataFrame:
    """Visible edges per (cohort year, relation) for many years at once.

    Edges are counted per (relation, t) before the range join, so both sides are bounded
    by the calendar. A sibling membership adds an edge in both directions to every older
    member, so it counts 2 * (members born earlier), same-year members once per pair.
    """
    plain = edges.where(F.col("rel") != "r_sib").groupBy("rel", "t").agg(F.count("*").alias("n"))
    members = edges.where(F.col("rel") == "r_sib").groupBy("dst", "t").agg(F.count("*").alias("m"))
    pairs = _pairs_by_later_birth(members)
    counts = plain.unionByName(pairs.groupBy("rel", "t").agg(F.sum("n").alias("n")))
    years = cohorts.select(F.col(year).alias("year")).distinct()
    return (
        years.join(counts, F.col("t") < F.col("year"))
        .groupBy("year", "rel")
        .agg(F.sum("n").cast("bigint").alias("n_visible"))
    )


def _pairs_by_later_birth(members: DataFrame) -> DataFrame:
    """Directed sibling pairs per (father, later birth) from member counts per birth year."""
    older = Window.partitionBy("dst").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    return members.withColumn("_older", F.coalesce(F.sum("m").over(older), F.lit(0))).select(
        "dst",
        F.lit("r_sib").alias("rel"),
        "t",
        (F.col("m") * (F.col("m") - 1) + 2 * F.col("m") * F.col("_older")).alias("n"),
    )


def degrees_as_of(edges: DataFrame, requests: DataFrame, side: str | Mapping[str, str]) -> DataFrame:
    """Degree per requested (id, year) and relation, counting edges with t < year.

    ``side``: ``in`` (the id is the destination), ``out`` (the source) or ``any`` (both
    ends), for all relations or as a mapping that also says which relations count. One pass
    over the edges gives all ends. Edges are first counted per (id, relation, t), so one id joins at most one row
    per year and relation of the calendar, whatever its degree. Sibling memberships count
    each sibling edge as the directed pair list would.
    """
    requests = requests.select("id", "year").distinct()
    if isinstance(side, str):
        incoming, outgoing = F.lit(side in ("in", "any")), F.lit(side in ("out", "any"))
    else:
        edges = edges.where(F.col("rel").isin(list(side)))
        incoming = F.col("rel").isin([r for r, s in side.items() if s in ("in", "any")])
        outgoing = F.col("rel").isin([r for r, s in side.items() if s in ("out", "any")])
        side = side.get("r_sib", "any")
    ends = F.array(F.when(incoming, F.col("dst")), F.when(outgoing, F.col("src")))
    plain = edges.where(F.col("rel") != "r_sib")
    touched = plain.select(F.explode(F.array_compact(ends)).alias("id"), "rel", "t")
    counts = touched.groupBy("id", "rel", "t").agg(F.count("*").alias("n"))
    seen = (
        requests.join(counts, "id")
        .where(F.col("t") < F.col("year"))
        .groupBy("id", "year", "rel")
        .agg(F.sum("n").cast("bigint").alias("degree"))
    )
    links = edges.where(F.col("rel") == "r_sib")
    asked = requests.join(
        links.select(F.col("src").alias("id"), F.col("dst").alias("_g"), F.col("t").alias("_own")), "id"
    ).where(F.col("_own") < F.col("year"))
    born = links.groupBy(F.col("dst").alias("_g"), "t").agg(F.count("*").alias("n"))
    groups = (
        asked.select("_g", "year")
        .distinct()
        .join(born, "_g")
        .where(F.col("t") < F.col("year"))
        .groupBy("_g", "year")
        .agg(F.sum("n").alias("members"))
    )
    both = 2 if side == "any" else 1
    siblings = asked.join(groups, ["_g", "year"]).select(
        "id",
        "year",
        F.lit("r_sib").alias("rel"),
        ((F.col("members") - 1) * both).cast("bigint").alias("degree"),
    )
    return seen.unionByName(siblings.where(F.col("degree") > 0))


def macro_at(
    cohorts: DataFrame, macro: DataFrame, low: int, high: int, year: str = "year", macro_year: str = "YEAR"
) -> DataFrame:
    """Covariates of the year before each cohort, clamped to the range of the table."""
    wanted = F.greatest(F.lit(low), F.least(F.col(year) - 1, F.lit(high)))
    values = macro.withColumnRenamed(macro_year, "_macro_year")
    return (
        cohorts.withColumn("macro_year", wanted.cast("int"))
        .join(values, F.col("macro_year") == F.col("_macro_year"), "left")
        .drop("_macro_year")
    )
