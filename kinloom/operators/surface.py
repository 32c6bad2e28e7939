"""Surfaces over the hexagon layout: channels, interpolation, smoothing, levels, density."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom import fixed
from kinloom.functions import scalars as S
from kinloom.operators.features import minmax_scale
from kinloom.operators.ordered import exact_percentiles
from kinloom.session import settle


def channel_values(cells: DataFrame) -> DataFrame:
    """Confidence and kin scaled to [0, 1], endogamy clamped, for non-empty cells."""
    used = cells.where(~F.col("empty"))
    scaled = minmax_scale(used, ["conf_mean", "patri_path_mean"], flat="zero")
    return scaled.select(
        "cell_id", "cx", "cy",
        F.col("conf_mean_01").alias("confidence"),
        F.col("patri_path_mean_01").alias("patrilineal"),
        S.clamp(F.coalesce("same_lin_frac", F.lit(0.0)), 0.0, 1.0).alias("endogamy"),
    )


def weighted_height(channels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Greatest weighted channel and its number (the first channel wins a tie)."""
    weights = {c: 1.0 for c in fixed.CHANNELS} | (weights or {})
    values = [F.col(c) * F.lit(float(weights[c])) for c in fixed.CHANNELS]
    height = F.greatest(*values)
    lead = F.lit(len(values) - 1)
    for i in reversed(range(len(values) - 1)):
        lead = F.when(values[i] == height, F.lit(i)).otherwise(lead)
    return channels.withColumn("height", height).withColumn("lead", lead)


def raster_size(width: float = 800, height: float = 600, margin: float = 40) -> tuple[int, int]:
    inner_w, inner_h = max(1.0, width - 2 * margin), max(1.0, height - 2 * margin)
    rows = math.floor(fixed.RASTER_WIDTH * inner_h / inner_w + 0.5)
    return fixed.RASTER_WIDTH, max(fixed.RASTER_MIN_HEIGHT, rows)


def nearest_cells(points: DataFrame, cells: DataFrame, k: int, cutoff: float, side: float, reach: float) -> DataFrame:
    """The k nearest cells of every point: ``points`` (gx, gy) with ``_n``, an array by distance and cell id.

    Both lie in square buckets of length ``side``. A point looks through its own bucket, then
    ring after ring around it; after ring r it knows all cells within r * side. It is done with
    k cells within that bound, or all there are, or with none within ``cutoff`` (then its array
    does not matter), and all are done beyond ``reach``. Only points that are not done join the
    next ring.
    """
    total = cells.count()
    kind = cells.select("cell_id", "height", "lead").schema
    found = "array<struct<d2:double,cell_id:{},height:{},lead:{}>>".format(*[f.dataType.simpleString() for f in kind])
    bucketed = settle(
        cells.select(
            F.floor(F.col("gx") / side).alias("_bx"), F.floor(F.col("gy") / side).alias("_by"),
            F.struct("gx", "gy", "cell_id", "height", "lead").alias("_c"),
        )
    )
    waiting, done, ring = points.select("gx", "gy", F.array().cast(found).alias("_n")), None, 0
    while True:
        steps = [(x, y) for x in range(-ring, ring + 1) for y in range(-ring, ring + 1) if max(abs(x), abs(y)) == ring]
        around = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps]))
        asked = waiting.select("gx", "gy", around.alias("_s")).select(
            F.col("gx").alias("_px"), F.col("gy").alias("_py"),
            (F.floor(F.col("gx") / side) + F.col("_s.x")).alias("_bx"), (F.floor(F.col("gy") / side) + F.col("_s.y")).alias("_by"),
        )
        x, y = F.col("_c.gx") - F.col("_px"), F.col("_c.gy") - F.col("_py")
        met = asked.join(bucketed, ["_bx", "_by"]).select(
            "_px", "_py", F.struct((x * x + y * y).alias("d2"), "_c.cell_id", "_c.height", "_c.lead").alias("_m")
        )
        order = Window.partitionBy("_px", "_py").orderBy("_m.d2", "_m.cell_id")
        best = met.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
        lists = best.groupBy(F.col("_px").alias("gx"), F.col("_py").alias("gy")).agg(F.collect_list("_m").alias("_new"))
        merged = waiting.join(lists, ["gx", "gy"], "left").select(
            "gx", "gy", F.slice(F.array_sort(F.concat("_n", F.coalesce("_new", F.array().cast(found)))), 1, k).alias("_n")
        )
        known = ring * side
        full = (F.size("_n") >= total) | (F.size("_n") >= k) & (F.get("_n", k - 1)["d2"] <= known * known)
        empty = F.lit(known >= cutoff) & F.coalesce(F.get("_n", 0)["d2"] > cutoff * cutoff, F.lit(True))
        judged = settle(merged.withColumn("_done", F.lit(known > reach) | F.coalesce(full, F.lit(False)) | empty))
        ended = judged.where("_done").drop("_done")
        done = ended if done is None else done.unionByName(ended)
        waiting = judged.where(~F.col("_done")).drop("_done")
        if waiting.isEmpty():
            return done
        ring += 1


def idw_raster(
    cells: DataFrame,
    radius: float = fixed.HEX_RADIUS,
    size: tuple[int, int] | None = None,
    neighbours: int = fixed.IDW_NEIGHBOURS,
    pad_share: float = 0.04,
    pad_min: float = 1.0,
) -> DataFrame:
    """Inverse-distance surface over a grid: raster(gx, gy, height, lead).

    ``cells`` has (cell_id, cx, cy, height, lead), the non-empty cells of a grid, however many.
    Every grid point takes its nearest ones (``nearest_cells``). A point with no cell within
    three radii is 0. Only the bounding box and the number of cells reach the driver.
    """
    width, rows = size or raster_size()
    box = cells.agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy"), F.count("*")).first()
    n_cells = box[4]

    def padded(low: float | None, high: float | None) -> tuple[float, float]:
        if low is None:
            return 0.0, 1.0
        pad = max(pad_min, (high - low) * pad_share)
        low, high = low - pad, high + pad
        return low, low + 1 if high - low < 1e-6 else high

    (x0, x1), (y0, y1) = padded(box[0], box[1]), padded(box[2], box[3])
    on_grid = cells.select(
        "cell_id",
        ((F.col("cx") - x0) / (x1 - x0) * (width - 1)).alias("gx"),
        ((F.col("cy") - y0) / (y1 - y0) * (rows - 1)).alias("gy"),
        "height",
        "lead",
    )
    per_step = ((x1 - x0) / (width - 1) + (y1 - y0) / (rows - 1)) * 0.5
    cutoff = max(2.0, 3.0 * radius / max(1e-6, per_step))
    grid = cells.sparkSession.range(width).select(
        F.col("id").cast("int").alias("gx"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("gy")
    )
    # Buckets of about as many cells as are wanted, unless these lie far apart.
    side = min(cutoff, max(0.25, math.sqrt(neighbours * width * rows / max(1, n_cells))))
    near = nearest_cells(grid, on_grid, neighbours, cutoff, side, math.hypot(width, rows)).withColumn("_cut2", F.lit(cutoff * cutoff))

    def weight(n: Column) -> Column:
        return F.lit(1.0) / (n["d2"] + fixed.IDW_EPS)

    zero = F.lit(0.0)
    total = F.aggregate("_n", zero, lambda acc, n: acc + weight(n))
    heights = F.aggregate("_n", zero, lambda acc, n: acc + weight(n) * n["height"])

    def votes_for(channel: int) -> Column:
        return F.aggregate(
            "_n", zero, lambda acc, n: acc + F.when(n["lead"] == channel, weight(n)).otherwise(0.0)
        )

    votes = [votes_for(i) for i in range(len(fixed.CHANNELS))]
    most = F.greatest(*votes)
    lead = F.lit(len(votes) - 1)
    for i in reversed(range(len(votes) - 1)):
        lead = F.when(votes[i] == most, F.lit(i)).otherwise(lead)
    inside = F.coalesce(F.get("_n", 0)["d2"] <= F.col("_cut2"), F.lit(False))
    return near.select(
        "gx", "gy",
        F.when(inside, heights / total).otherwise(0.0).alias("height"),
        F.when(inside, lead).otherwise(0).cast("int").alias("lead"),
    )


def _blur(df: DataFrame, axis: str, value: str, size: int, sigma: float) -> DataFrame:
    reach = max(1, math.ceil(3 * sigma))
    taps = F.array(
        *[
            F.struct(F.lit(i).alias("o"), F.lit(math.exp(-(i * i) / (2 * sigma * sigma))).alias("w"))
            for i in range(-reach, reach + 1)
        ]
    )
    spread = df.withColumn("_t", F.explode(taps)).withColumn(axis, F.col(axis) + F.col("_t.o"))
    spread = spread.where(F.col(axis).between(0, size - 1))
    return spread.groupBy("gx", "gy").agg(
        (F.sum(F.col(value) * F.col("_t.w")) / F.sum("_t.w")).alias(value)
    )


def gaussian_smooth(raster: DataFrame, size: tuple[int, int], value: str = "height", sigma: float = fixed.SMOOTH_SIGMA) -> DataFrame:
    """Separable blur with renormalised edges: every point sends its value to the taps around it."""
    across = _blur(raster.select("gx", "gy", value), "gx", value, size[0], sigma)
    return _blur(across, "gy", value, size[1], sigma)


def level_percents(n: int) -> list[float]:
    """n percentiles evenly between the lowest and the highest level percentile."""
    n = fixed.LEVELS_DEFAULT if n < fixed.LEVELS_MIN else min(n, fixed.LEVELS_MAX)
    low, high = fixed.LEVEL_LOW_PERCENTILE, fixed.LEVEL_HIGH_PERCENTILE
    return [low + i * (high - low) / max(1, n - 1) for i in range(n)]


def percentile_levels(
    df: DataFrame, column: str = "height", n: int = fixed.LEVELS_DEFAULT, approximate: bool = False, accuracy: int = 10000
) -> DataFrame:
    """Contour levels at evenly spaced percentiles, near-equal ones kept once."""
    percents = level_percents(n)
    if approximate:
        found = df.agg(F.percentile_approx(column, [p / 100 for p in percents], accuracy).alias("levels"))
    else:
        values = exact_percentiles(df, column, percents)
        found = values.agg(F.collect_list("value").alias("levels"))  # at most 11 values
    kept = F.aggregate(
        F.array_sort("levels"),
        F.array().cast("array<double>"),
        lambda acc, v: F.when(
            (F.size(acc) == 0) | (v - F.element_at(acc, -1) > fixed.LEVEL_GAP), F.concat(acc, F.array(v))
        ).otherwise(acc),
    )
    return found.select(F.posexplode(kept).alias("level", "value"))


def density_2d(points: DataFrame, bins: int = 40, bandwidth: float = 1.5, least_points: int = 5) -> DataFrame:
    """Blurred counts of points in [0, 1]^2 per bin (outside points are left out); empty below 5 points."""
    inside = points.where(F.col("x").between(0.0, 1.0) & F.col("y").between(0.0, 1.0))
    cell = [F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("int").alias(g) for c, g in (("x", "gx"), ("y", "gy"))]
    counts = inside.select(*cell).groupBy("gx", "gy").agg(F.count("*").cast("double").alias("density"))
    enough = points.agg(F.count("*")).scalar() >= least_points
    grid = points.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("gx"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("gy")
    )
    full = grid.join(counts, ["gx", "gy"], "left").na.fill(0.0, ["density"])
    return gaussian_smooth(full, (bins, bins), "density", bandwidth).where(enough)
