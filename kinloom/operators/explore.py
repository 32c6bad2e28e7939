"""Interactive queries on the scored-pair table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom import fixed
from kinloom.functions import scalars as S
from kinloom.operators.edges import PANEL, Panel
from kinloom.operators.ordered import first_row


def get_pair(pairs: DataFrame, year: int, pair_id: int) -> DataFrame:
    """One pair by cohort year and id; no row when the id is out of range."""
    return pairs.where((F.col("year") == year) & (F.col("id") == pair_id))


def filter_pairs(pairs: DataFrame, era: str | None = None, correct: bool | None = None) -> DataFrame:
    """Optional filters; an unknown correctness counts as false."""
    return pairs.where(_matches(era, correct))


def _matches(era: str | None, correct: bool | None) -> Column:
    keep = F.lit(True)
    if era is not None:
        keep = keep & F.coalesce(F.col("era") == era, F.lit(False))
    if correct is not None:
        keep = keep & (F.coalesce(F.col("hungarian_correct"), F.lit(False)) == F.lit(correct))
    return keep


def cells_with_match(placed: DataFrame, era: str | None = None, correct: bool | None = None) -> DataFrame:
    """Per cell: does any of its pairs pass the filters."""
    return placed.groupBy("q", "r").agg(F.bool_or(_matches(era, correct)).alias("has_match"))


def cell_pairs(placed: DataFrame, cells: Sequence[tuple[int, int]]) -> DataFrame:
    """Pairs of one cell, or of two cells side by side."""
    wanted = placed.sparkSession.createDataFrame([tuple(c) for c in cells], "q int, r int")
    return placed.join(wanted, ["q", "r"], "left_semi")


def sort_nulls_last(df: DataFrame, key: str, direction: str = "asc", tie: Sequence[str] = ()) -> DataFrame:
    """Sorted with nulls at the end in both directions."""
    order = F.asc_nulls_last(key) if direction == "asc" else F.desc_nulls_last(key)
    return df.orderBy(order, *tie)


CHANNEL_COLUMNS = (
    ("confidence", "conf_mean"),
    ("score gap", "mean_score_gap"),
    ("patri paths", "patri_path_mean"),
    ("same lineage", "same_lin_frac"),
    ("positives", "pos_ratio"),
)


def leading_channel(cells: DataFrame, channels: Sequence[tuple[str, str]] = CHANNEL_COLUMNS) -> DataFrame:
    """Name of the aggregate with the greatest absolute value (the first one wins a tie)."""
    values = [(name, F.abs(F.coalesce(F.col(c), F.lit(0.0)))) for name, c in channels]
    top = F.greatest(*[v for _, v in values])
    lead = F.lit(values[-1][0])
    for name, value in reversed(values[:-1]):
        lead = F.when(value == top, name).otherwise(lead)
    return cells.withColumn("leading_channel", lead)


def box_select(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    return points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def hide_accepted(pairs: DataFrame, accepted: DataFrame, left: str = "h", right: str = "w") -> DataFrame:
    taken = accepted.select(F.col(left).alias("_h"), F.col(right).alias("_w"))
    return pairs.join(taken, (F.col(left) == F.col("_h")) & (F.col(right) == F.col("_w")), "left_anti")


def bipartite_summary(pairs: DataFrame, group: Sequence[str] = ("year",), scale: float = 6.0) -> DataFrame:
    """Distinct members of both sides, edges, and the mean edge width (0.6 to 2.2)."""
    width = 0.6 + 1.6 * S.clamp(F.col("score") / scale, 0.0, 1.0)
    return pairs.groupBy(*group).agg(
        F.count_distinct("h").alias("n_left"),
        F.count_distinct("w").alias("n_right"),
        F.count("*").alias("n_edges"),
        F.avg(width).alias("mean_width"),
    )


def profiles(df: DataFrame, p: Panel = PANEL) -> DataFrame:
    """One profile per person: the first whole row, sex decoded.

    A person whose sex is unknown keeps the other columns and gets ``?``.
    """
    keep = [p.sex, p.birth, p.region, p.village, p.household]
    first = first_row(df.where(F.col(p.person).isNotNull()), [p.person], p.row_order, keep)
    sex = F.when(F.col(p.sex) == fixed.MALE, "M").when(F.col(p.sex) == fixed.FEMALE, "F").otherwise("?")
    return first.select(
        F.col(p.person).alias("id"),
        sex.alias("sex"),
        F.col(p.birth).cast("int").alias("birth_year"),
        F.col(p.region).cast("int").alias("banner_id"),
        F.col(p.village).cast("int").alias("community_id"),
        F.col(p.household).cast("string").alias("household_id"),
    )


def get_profiles(requests: DataFrame, people: DataFrame, column: str = "id") -> DataFrame:
    """Profiles of the requested ids (a leading P is ignored for the lookup, kept in the
    answer); an unknown id gets a blank profile."""
    known = people.select(*[F.col(c).alias(f"_{c}") for c in people.columns])
    asked = requests.select(F.col(column).alias("id"))
    found = asked.join(known, F.regexp_replace("id", "^P", "") == F.col("_id"), "left")
    return found.select(
        "id",
        F.coalesce("_sex", F.lit("?")).alias("sex"),
        *[F.col(f"_{c}").alias(c) for c in people.columns if c not in ("id", "sex")],
    )


def pair_attribution(pairs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Seven additive components per pair, scaled to sum to the score, and the two totals.

    Long form (keys of the pair, position, label, value, scaled, is_total).
    """
    w = {**fixed.RULE_WEIGHTS, **(weights or {})}
    score = F.coalesce(F.col("score"), F.lit(0.0)).cast("double")
    gap = F.coalesce(F.col("score_gap"), F.lit(0.0)).cast("double")
    paths = F.coalesce(F.col("patri_path_count"), F.lit(0)).cast("double")
    era = F.coalesce(F.col("era"), F.lit("regular"))
    era_value = F.lit(0.0)
    for name, value in fixed.ERA_BONUS.items():
        era_value = F.when(era == name, F.lit(value)).otherwise(era_value)
    parts = [
        ("bias", F.lit(fixed.BIAS)),
        ("paternal lineage", w["paternal_lineage"] * (fixed.PATERNAL_PER_PATH * paths)),
        ("sibling overlap", w["sibling_overlap"] * F.when(paths >= 2, fixed.SIBLING_BONUS).otherwise(0.0)),
        ("household share", w["household_share"] * F.when(paths >= 3, fixed.HOUSEHOLD_BONUS).otherwise(0.0)),
        ("banner match", F.lit(w["banner_match"] * fixed.BANNER_BONUS)),
        ("macro era", w["macro_era"] * era_value),
        (
            "endogamy penalty",
            F.when(F.coalesce(F.col("same_lineage"), F.lit(False)), fixed.ENDOGAMY_PENALTY).otherwise(0.0),
        ),
    ]
    total = parts[0][1]
    for _, value in parts[1:]:
        total = total + value
    ratio = F.when(total != 0, score / total).otherwise(1.0)
    rows = [(label, value, value * ratio, False) for label, value in parts]
    rows += [("FINAL (logit)", score, score, True), ("score gap", gap, gap, True)]
    table = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(label).alias("label"),
                value.alias("value"),
                scaled.alias("scaled"),
                F.lit(is_total).alias("is_total"),
            )
            for i, (label, value, scaled, is_total) in enumerate(rows)
        ]
    )
    keys = [c for c in ("year", "id", "h", "w", "husband_id", "wife_id") if c in pairs.columns]
    return pairs.select(*keys, F.inline(table))


def merge_weights(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Defaults with the known names overridden; unknown names are ignored, nulls keep the default."""
    new = overrides.select(F.col("name").alias("_name"), F.col("value").cast("double").alias("_value"))
    return defaults.join(new, F.col("name") == F.col("_name"), "left").select(
        "name", F.coalesce("_value", "value").alias("value")
    )


def default_weights(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(k, float(v)) for k, v in fixed.RULE_WEIGHTS.items()], "name string, value double"
    )
