"""Flat-top hexagon layout: grid, assignment, packing and cell analytics.

Cells are addressed by (q, r): column and row, odd columns shifted down by half a row.
The grid over the unit square depends only on the radius (a few hundred cells at 0.04).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom import fixed
from kinloom.operators.ordered import numbered, running_sums, sliced, with_scalar
from kinloom.session import settle


def unit_scaled(df: DataFrame, x: str = "x", y: str = "y", reference: DataFrame | None = None) -> DataFrame:
    """x and y scaled to [0, 1] by the range of ``reference`` (default: the rows themselves)."""
    source = df if reference is None else reference
    one = source.agg(
        F.struct(
            F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")
        )
    )
    span = F.col("_span")

    def scaled(c: str, lo: str, hi: str) -> Column:
        width = span[hi] - span[lo]
        return (F.col(c) - span[lo]) / F.when(width == 0, 1.0).otherwise(width)

    spanned = with_scalar(df, "_span", one)
    return spanned.withColumns({x: scaled(x, "x0", "x1"), y: scaled(y, "y0", "y1")}).drop("_span")


def cluster_centroids(points: DataFrame, k: int | None = None, cluster: str = "cluster") -> DataFrame:
    """Mean x, y per cluster 0..k-1; the middle of the square for an empty one."""
    means = points.groupBy(F.col(cluster).cast("int").alias("cluster")).agg(
        F.avg("x").alias("_x"), F.avg("y").alias("_y"), F.count("*").alias("_n")
    )
    if k is None:
        top = means.agg(F.coalesce(F.max("cluster"), F.lit(0))).scalar()
        one = points.sparkSession.range(1)
        every = one.select(F.explode(F.sequence(F.lit(0), top.cast("int"))).alias("cluster"))
    else:
        every = points.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    return every.join(means, "cluster", "left").select(
        "cluster",
        F.coalesce("_x", F.lit(0.5)).alias("x"),
        F.coalesce("_y", F.lit(0.5)).alias("y"),
        F.coalesce("_n", F.lit(0)).alias("n_points"),
    )


def cell_centre(q: Column, r: Column, radius: float) -> tuple[Column, Column]:
    row = math.sqrt(3.0) * radius
    shift = F.when(F.pmod(q, F.lit(2)) == 1, row / 2).otherwise(0.0)
    return q * F.lit(1.5 * radius), r * F.lit(row) + shift


def hex_grid(spark: SparkSession, radius: float = fixed.HEX_RADIUS, margin: float | None = None) -> DataFrame:
    """Cells whose centre lies within ``margin`` (default one radius) of the unit square."""
    margin = radius if margin is None else margin
    columns, rows = 1.5 * radius, math.sqrt(3.0) * radius
    first_q, first_r = -math.ceil(margin / columns) - 1, -math.ceil(margin / rows) - 1
    last_q = math.ceil((1 + margin) / columns) + 1
    last_r = math.ceil((1 + margin) / rows) + 1
    q = spark.range(first_q, last_q + 1).select(F.col("id").cast("int").alias("q"))
    cells = q.select("q", F.explode(F.sequence(F.lit(first_r), F.lit(last_r))).alias("r"))
    cx, cy = cell_centre(F.col("q"), F.col("r"), radius)
    cells = cells.select("q", "r", cx.alias("cx"), cy.alias("cy"))
    low, high = -margin, 1 + margin
    return cells.where(F.col("cx").between(low, high) & F.col("cy").between(low, high))


def cell_ids(cells: DataFrame) -> DataFrame:
    """Number the cells of a unit-square grid column by column (a few hundred rows)."""
    return cells.withColumn("cell_id", F.row_number().over(Window.orderBy("q", "r")) - 1)


def hex_of(x: Column, y: Column, radius: float = fixed.HEX_RADIUS) -> Column:
    """(q, r) of the cell with the nearest centre, by cube rounding."""
    qf = x * F.lit(2.0 / 3.0 / radius)
    rf = (y * F.lit(math.sqrt(3.0) / 3.0) - x / 3.0) / F.lit(radius)
    sf = -qf - rf
    q, r, s = F.round(qf), F.round(rf), F.round(sf)
    dq, dr, ds = F.abs(q - qf), F.abs(r - rf), F.abs(s - sf)
    fix_q = (dq > dr) & (dq > ds)
    fix_r = ~fix_q & (dr > ds)
    q_int = F.when(fix_q, -r - s).otherwise(q).cast("int")
    r_axial = F.when(fix_r, -q - s).otherwise(r).cast("int")
    row = r_axial + F.floor((q_int - F.pmod(q_int, F.lit(2))) / 2).cast("int")
    return F.struct(q_int.alias("q"), row.cast("int").alias("r"))


def hex_assign(points: DataFrame, radius: float = fixed.HEX_RADIUS) -> DataFrame:
    """Nearest cell of every point: constant work per row, no scan over cells."""
    placed = points.withColumn("_c", hex_of(F.col("x"), F.col("y"), radius))
    return placed.withColumn("q", F.col("_c")["q"]).withColumn("r", F.col("_c")["r"]).drop("_c")


def _squared(x: str, y: str) -> Column:
    """Squared distance of (x, y) to a centroid."""
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    return dx * dx + dy * dy


def hex_pack(
    points: DataFrame,
    radius: float = fixed.HEX_RADIUS,
    capacity: int = fixed.HEX_CAPACITY,
    cluster: str = "cluster",
    key: str = "id",
) -> DataFrame:
    """Place every point so that a cell holds at most ``capacity`` points of one cluster.

    Points of a cluster are ordered by distance to their centroid (ties by ``key``) and cut into
    blocks of ``capacity``; a missing cluster counts as cluster 0. Every cluster claims as many
    cells as it has blocks, the nearest to its centroid first (ties by q, r). A cell claimed by
    several clusters goes to the one with most points (ties: the smaller number); the others give
    it up for good and claim cells farther out. This goes on until no cell is claimed twice, so
    no block would win a cell nearer than its own. Block b of a cluster gets its b-th nearest
    cell. The grid grows beyond the unit square until there is a cell for every block, so no point
    is left out; no points give no rows.

    What a larger cluster holds only grows, so there are at most as many rounds as clusters; their
    number is bounded by the clustering (``k_max``). Wishes are sorted once, a round numbers
    those that are left.
    """
    spark = points.sparkSession
    pts = points.withColumn("_cl", F.coalesce(F.col(cluster).cast("int"), F.lit(0)))
    centroids = settle(
        pts.groupBy("_cl").agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.count("*").alias("_n"))
    ).withColumn("_blocks", F.ceil(F.col("_n") / capacity))
    ranked = numbered(pts.join(centroids, "_cl").withColumn("_d", _squared("x", "y")), ["_cl"], ["_d", key], "_rn", start=0)

    n_blocks = centroids.agg(F.coalesce(F.sum("_blocks"), F.lit(0))).first()[0]
    area = 1.5 * math.sqrt(3.0) * radius * radius
    side = math.sqrt(1.3 * n_blocks * area)
    cells = hex_grid(spark, radius, max(radius, (side - 1.0) / 2 + 2 * radius))

    fields = ["_cl", "_mx", "_my", "_n", "_blocks"]
    centres = centroids.agg(F.collect_list(F.struct(*fields))).scalar()
    wishes = cells.select("*", F.inline(centres)).withColumn("_d", _squared("cx", "cy"))
    # The smallest claim on a cell wins.
    wishes = wishes.select("_cl", "_blocks", "_d", "q", "r", "cx", "cy", F.struct(-F.col("_n"), "_cl").alias("_claim"))
    wishes = sliced(wishes, ["_cl"], ["_d", "q", "r"])
    left = wishes
    while True:
        places = running_sums(left, ["_cl"], ["_d", "q", "r"], {"_block": F.lit(1)}, slice_by=["_slice"])
        claims = settle(places.where(F.col("_block") <= F.col("_blocks")))
        holders = claims.groupBy("q", "r").agg(F.min("_claim").alias("_holder"), F.count("*").alias("_n_claims"))
        if holders.where("_n_claims > 1").isEmpty():
            break
        kept = F.col("_holder").isNull() | (F.col("_claim") <= F.col("_holder"))
        left = wishes.join(holders, ["q", "r"], "left").where(kept).drop("_holder", "_n_claims")
    cell_of_block = claims.select("_cl", (F.col("_block") - 1).alias("_block"), "q", "r", "cx", "cy")
    placed = ranked.withColumn("_block", F.floor(F.col("_rn") / capacity)).join(cell_of_block, ["_cl", "_block"])
    return placed.select(*points.columns, "q", "r", "cx", "cy")


def cell_aggregates(placed: DataFrame, grid: DataFrame) -> DataFrame:
    """Per cell: points, mean gap, positive share, mean paths, same-lineage share; empty cells 0."""
    per_cell = placed.groupBy("q", "r").agg(
        F.count("*").alias("n_points"),
        F.avg(F.coalesce("score_gap", F.lit(0.0))).alias("mean_score_gap"),
        F.avg(F.when(F.col("label") == 1, 1.0).otherwise(0.0)).alias("pos_ratio"),
        F.avg(F.coalesce("patri_path_count", F.lit(0))).alias("patri_path_mean"),
        F.avg(F.when(F.col("same_lineage"), 1.0).otherwise(0.0)).alias("same_lin_frac"),
        F.min("cluster").alias("cluster"),
    )
    values = ["mean_score_gap", "pos_ratio", "patri_path_mean", "same_lin_frac"]
    return grid.join(per_cell, ["q", "r"], "left").select(
        *grid.columns,
        "cluster",
        F.coalesce("n_points", F.lit(0)).cast("bigint").alias("n_points"),
        *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values],
        F.coalesce("mean_score_gap", F.lit(0.0)).alias("conf_mean"),
        F.col("n_points").isNull().alias("empty"),
    )


def cluster_summary(cells: DataFrame) -> DataFrame:
    """Cells and points per cluster, and its cells in order; ``cluster_cells`` has them as rows."""
    used = cells.where(~F.col("empty"))
    return used.groupBy("cluster").agg(
        F.count("*").alias("n_cells"),
        F.sum("n_points").alias("n_points"),
        F.sort_array(F.collect_list("cell_id")).alias("cell_ids"),
    )


def cluster_cells(cells: DataFrame) -> DataFrame:
    """The cells of each cluster, one row per cell: a cluster may have as many as it likes."""
    return cells.where(~F.col("empty")).select("cluster", "cell_id", "q", "r")


# Neighbour offsets (column step, row step) of even and odd columns.
EVEN_STEPS = ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (0, 1))
ODD_STEPS = ((1, 1), (1, 0), (0, -1), (-1, 0), (-1, 1), (0, 1))


def cell_neighbors(cells: DataFrame) -> DataFrame:
    """Up to six neighbours per cell."""

    def steps(table: Sequence[tuple[int, int]]) -> Column:
        return F.array(*[F.struct(F.lit(a).alias("dq"), F.lit(b).alias("dr")) for a, b in table])

    offsets = F.when(F.pmod("q", F.lit(2)) == 0, steps(EVEN_STEPS)).otherwise(steps(ODD_STEPS))
    around = cells.select("cell_id", "q", "r", F.explode(offsets).alias("s")).select(
        "cell_id", (F.col("q") + F.col("s.dq")).alias("q"), (F.col("r") + F.col("s.dr")).alias("r")
    )
    other = cells.select("q", "r", F.col("cell_id").alias("neighbor_id"))
    return around.join(other, ["q", "r"]).select("cell_id", "neighbor_id")


def cluster_borders(cells: DataFrame) -> DataFrame:
    """Adjacent non-empty cells of different clusters, each unordered pair once."""
    used = cells.where(~F.col("empty") & F.col("cluster").isNotNull())
    a = used.select("cell_id", F.col("cluster").alias("cluster_a"))
    b = used.select(F.col("cell_id").alias("neighbor_id"), F.col("cluster").alias("cluster_b"))
    return (
        cell_neighbors(used)
        .where(F.col("cell_id") < F.col("neighbor_id"))
        .join(a, "cell_id")
        .join(b, "neighbor_id")
        .where(F.col("cluster_a") != F.col("cluster_b"))
        .select(F.col("cell_id").alias("a"), F.col("neighbor_id").alias("b"), "cluster_a", "cluster_b")
    )


def outlier_cells(cells: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Non-empty cells whose positive share is more than ``sigmas`` deviations off the mean."""
    used = cells.where(~F.col("empty"))
    one = used.agg(F.struct(F.avg("pos_ratio").alias("m"), F.stddev_pop("pos_ratio").alias("s")))
    limit = F.col("_stats")["s"] * sigmas
    found = with_scalar(used, "_stats", one).withColumn("deviation", F.col("pos_ratio") - F.col("_stats")["m"])
    return found.where((limit > 0) & (F.abs("deviation") > limit)).drop("_stats")
