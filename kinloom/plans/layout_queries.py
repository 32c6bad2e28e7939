"""Queries: vectors, clusters, hexagon layout, surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.operators import embedding as Z
from kinloom.operators import hexgrid as H
from kinloom.operators import surface as U
from kinloom.plans import views as V
from kinloom.plans.registry import query, rounded, table
from kinloom.session import settle

UNIT = "WITH" + V.POINTS_SQL
CLUSTERS = 10  # labels of the embeddings


def unit_points(spark, sf):
    return H.unit_scaled(V.points(spark, sf))


def grid(spark):
    return H.cell_ids(H.hex_grid(spark))


def placed(spark, sf):
    return H.hex_assign(unit_points(spark, sf))


def cell_stats(spark, sf):
    """One row per cell (a few hundred); settled, since the surfaces read it many times."""
    return settle(H.cell_aggregates(placed(spark, sf), grid(spark)))


# -- vectors --------------------------------------------------------------------------


@query("standardize", """
WITH d AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i)),
s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd FROM d GROUP BY i)
SELECT vec_id, CAST(d.i - 1 AS INTEGER) AS dim, round((v - m) / sd, 4) AS value FROM d JOIN s ON s.i = d.i""")
def _standardize(spark, sf):
    out = Z.standardize(table(spark, sf, "embeddings"), "embedding")
    return rounded(out.select("vec_id", F.posexplode("scaled").alias("dim", "value")))


@query("pca")
def _pca(spark, sf):
    out = Z.pca(table(spark, sf, "embeddings"), 10, "embedding")
    return rounded(out.select("vec_id", F.posexplode("pcs").alias("dim", "value")))


@query("project_2d")
def _project_2d(spark, sf):
    return Z.project_2d(table(spark, sf, "embeddings"), "vec_id", "embedding").select("vec_id", "x", "y")


@query("project_2d_landmark")
def _project_2d_landmark(spark, sf):
    out = Z.project_2d(table(spark, sf, "embeddings"), "vec_id", "embedding", "landmark", 50)
    return out.select("vec_id", "x", "y")


@query("kmeans_auto")
def _kmeans_auto(spark, sf):
    return Z.kmeans_auto(table(spark, sf, "embeddings"), "embedding", k_max=6).select("vec_id", "cluster")


@query("pairwise_distance", """
WITH m AS (SELECT vec_id AS landmark, embedding AS lv FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 20)
SELECT e.vec_id, m.landmark, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(lv[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(lv[i] AS DOUBLE))))), 4) AS distance
FROM embeddings e, m""")
def _pairwise_distance(spark, sf):
    e = table(spark, sf, "embeddings")
    return rounded(Z.pairwise_distance(e, Z.landmarks_of(e, "vec_id", 20, "embedding"), "vec_id", "embedding"))


@query("quantize_coords", "WITH" + V.POINTS_SQL + "SELECT id, round(x, 2) AS x, round(y, 2) AS y FROM points")
def _quantize_coords(spark, sf):
    return Z.quantize_coords(V.points(spark, sf), ("x", "y"), 2).select("id", "x", "y")


# -- layout ---------------------------------------------------------------------------


@query("unit_scaled", UNIT + "SELECT id, round(x, 4) AS x, round(y, 4) AS y FROM unit")
def _unit_scaled(spark, sf):
    return rounded(unit_points(spark, sf).select("id", "x", "y"))


@query("cluster_centroids", UNIT + """
SELECT CAST(k AS INTEGER) AS cluster, round(coalesce(avg(x), 0.5), 4) AS x, round(coalesce(avg(y), 0.5), 4) AS y, count(id) AS n_points
FROM range(0, 12) r(k) LEFT JOIN unit ON cluster = k GROUP BY k""")
def _cluster_centroids(spark, sf):
    return rounded(H.cluster_centroids(unit_points(spark, sf), 12))


@query("hex_grid", UNIT + "SELECT CAST(cell_id AS INTEGER) AS cell_id, CAST(q AS INTEGER) AS q, CAST(r AS INTEGER) AS r, round(cx, 4) AS cx, round(cy, 4) AS cy, n_points FROM cell_stats")
def _hex_grid(spark, sf):
    """The grid with the number of points in each cell."""
    held = placed(spark, sf).groupBy("q", "r").agg(F.count("*").alias("n_points"))
    return rounded(grid(spark).join(held, ["q", "r"], "left").na.fill(0, ["n_points"]).select("cell_id", "q", "r", "cx", "cy", "n_points"))


@query("hex_assign", UNIT + "SELECT id, CAST(q AS INTEGER) AS q, CAST(r AS INTEGER) AS r FROM placed")
def _hex_assign(spark, sf):
    return placed(spark, sf).select("id", "q", "r")


def _pack_sql(clusters: int) -> str:
    """Packing as a serial choice: clusters from large to small take the nearest cells left."""
    taken, steps = "SELECT CAST(NULL AS INTEGER) AS place, CAST(NULL AS BIGINT) AS q, CAST(NULL AS BIGINT) AS r, CAST(NULL AS BIGINT) AS block WHERE false", []
    for k in range(1, clusters + 1):
        steps.append(f"""t{k} AS MATERIALIZED (
  SELECT {k} AS place, q, r, block FROM (
    SELECT c.q, c.r, b.blocks, row_number() OVER (ORDER BY (c.cx - b.mx) * (c.cx - b.mx) + (c.cy - b.my) * (c.cy - b.my), c.q, c.r) - 1 AS block
    FROM wide c JOIN centres b ON b.place = {k} ANTI JOIN ({taken}) t ON t.q = c.q AND t.r = c.r)
  WHERE block < blocks)""")
        taken = " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(1, k + 1))
    return UNIT + f""",
centres AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY n DESC, cl) AS place FROM (
    SELECT coalesce(cluster, 0) AS cl, avg(x) AS mx, avg(y) AS my, count(*) AS n, ceil(count(*) / 12.0) AS blocks FROM unit GROUP BY 1)),
side AS (SELECT greatest(0.04, (sqrt(1.3 * sum(blocks) * (1.5 * sqrt(3.0) * 0.04 * 0.04)) - 1.0) / 2 + 0.08) AS margin FROM centres),
wide AS MATERIALIZED (
  SELECT q, r, cx, cy FROM side, (
    SELECT q, r, CAST(q AS DOUBLE) * 0.06 AS cx, r * (sqrt(3.0) * 0.04) + CASE WHEN abs(q) % 2 = 1 THEN sqrt(3.0) * 0.04 / 2 ELSE 0 END AS cy
    FROM range(-200, 220) a(q), range(-200, 220) b(r))
  WHERE cx BETWEEN -margin AND 1 + margin AND cy BETWEEN -margin AND 1 + margin),
{", ".join(steps)},
ranked AS (
  SELECT u.id, u.cluster, b.place, (row_number() OVER (PARTITION BY b.place ORDER BY (u.x - b.mx) * (u.x - b.mx) + (u.y - b.my) * (u.y - b.my), u.id) - 1) // 12 AS block
  FROM unit u JOIN centres b ON b.cl = coalesce(u.cluster, 0)),
packed AS (SELECT id, cluster, CAST(q AS INTEGER) AS q, CAST(r AS INTEGER) AS r FROM ranked JOIN ({taken}) USING (place, block))
"""


@query("hex_pack", _pack_sql(CLUSTERS) + "SELECT * FROM packed")
def _hex_pack(spark, sf):
    return H.hex_pack(unit_points(spark, sf)).select("id", "cluster", "q", "r")


@query("hex_pack_check", _pack_sql(CLUSTERS) + """
SELECT count(*) AS n_points, max(n) <= 12 AS within_capacity, max(k) = 1 AS one_cluster_per_cell FROM (
  SELECT count(*) OVER (PARTITION BY q, r) AS n, max(cluster) OVER (PARTITION BY q, r) - min(cluster) OVER (PARTITION BY q, r) + 1 AS k FROM packed)""")
def _hex_pack_check(spark, sf):
    cells = H.hex_pack(unit_points(spark, sf)).groupBy("q", "r").agg(
        F.count("*").alias("n"), F.count_distinct("cluster").alias("k")
    )
    return cells.agg(
        F.sum("n").alias("n_points"),
        (F.max("n") <= 12).alias("within_capacity"),
        (F.max("k") == 1).alias("one_cluster_per_cell"),
    )


@query("cell_aggregates", UNIT + """
SELECT CAST(cell_id AS INTEGER) AS cell_id, cluster, n_points, round(mean_score_gap, 4) AS mean_score_gap, round(pos_ratio, 4) AS pos_ratio,
  round(patri_path_mean, 4) AS patri_path_mean, round(same_lin_frac, 4) AS same_lin_frac, empty FROM cell_stats""")
def _cell_aggregates(spark, sf):
    out = cell_stats(spark, sf).select(
        "cell_id", "cluster", "n_points", "mean_score_gap", "pos_ratio", "patri_path_mean", "same_lin_frac", "empty"
    )
    return rounded(out)


@query("cluster_summary", UNIT + """
SELECT cluster, count(*) AS n_cells, CAST(sum(n_points) AS BIGINT) AS n_points, string_agg(CAST(cell_id AS VARCHAR), ',' ORDER BY cell_id) AS cells
FROM cell_stats WHERE NOT empty GROUP BY cluster""")
def _cluster_summary(spark, sf):
    out = H.cluster_summary(cell_stats(spark, sf))
    return out.select("cluster", "n_cells", "n_points", F.array_join("cell_ids", ",").alias("cells"))


@query("cluster_cells", UNIT + """
SELECT cluster, CAST(cell_id AS INTEGER) AS cell_id, CAST(q AS INTEGER) AS q, CAST(r AS INTEGER) AS r FROM cell_stats WHERE NOT empty""")
def _cluster_cells(spark, sf):
    return H.cluster_cells(cell_stats(spark, sf))


NEIGHBOR_SQL = UNIT + """,
near AS (
  SELECT a.cell_id, b.cell_id AS neighbor_id FROM cells a JOIN cells b ON a.cell_id <> b.cell_id
  WHERE (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) < 0.0052)"""


@query("cell_neighbors", NEIGHBOR_SQL + """SELECT CAST(n.cell_id AS INTEGER) AS cell_id, CAST(neighbor_id AS INTEGER) AS neighbor_id FROM near n
JOIN cell_stats a ON a.cell_id = n.cell_id JOIN cell_stats b ON b.cell_id = n.neighbor_id WHERE NOT a.empty AND NOT b.empty""")
def _cell_neighbors(spark, sf):
    """Neighbours among the cells that hold points."""
    return H.cell_neighbors(cell_stats(spark, sf).where(~F.col("empty")))


@query("cluster_borders", NEIGHBOR_SQL + """
SELECT CAST(n.cell_id AS INTEGER) AS a, CAST(n.neighbor_id AS INTEGER) AS b, x.cluster AS cluster_a, y.cluster AS cluster_b
FROM near n JOIN cell_stats x ON x.cell_id = n.cell_id JOIN cell_stats y ON y.cell_id = n.neighbor_id
WHERE n.cell_id < n.neighbor_id AND NOT x.empty AND NOT y.empty AND x.cluster <> y.cluster""")
def _cluster_borders(spark, sf):
    return H.cluster_borders(cell_stats(spark, sf))


@query("outlier_cells", UNIT + """
SELECT CAST(cell_id AS INTEGER) AS cell_id, round(pos_ratio - (SELECT avg(pos_ratio) FROM cell_stats WHERE NOT empty), 4) AS deviation
FROM cell_stats WHERE NOT empty AND abs(pos_ratio - (SELECT avg(pos_ratio) FROM cell_stats WHERE NOT empty)) > 1.5 * (SELECT stddev_pop(pos_ratio) FROM cell_stats WHERE NOT empty)""")
def _outlier_cells(spark, sf):
    return rounded(H.outlier_cells(cell_stats(spark, sf), 1.5).select("cell_id", "deviation"))


# -- surface --------------------------------------------------------------------------

CHANNEL_SQL = UNIT + """,
span AS (SELECT min(conf_mean) AS c0, max(conf_mean) AS c1, min(patri_path_mean) AS p0, max(patri_path_mean) AS p1 FROM cell_stats WHERE NOT empty),
channels AS (
  SELECT cell_id, cx, cy, (conf_mean - c0) / (c1 - c0) AS confidence, (patri_path_mean - p0) / (p1 - p0) AS patrilineal,
    greatest(0.0, least(1.0, same_lin_frac)) AS endogamy FROM cell_stats, span WHERE NOT empty),
heights AS (
  SELECT *, greatest(confidence, patrilineal * 0.8, endogamy * 0.6) AS height,
    CASE WHEN confidence = greatest(confidence, patrilineal * 0.8, endogamy * 0.6) THEN 0
      WHEN patrilineal * 0.8 = greatest(confidence, patrilineal * 0.8, endogamy * 0.6) THEN 1 ELSE 2 END AS lead FROM channels)"""
WEIGHTS = {"patrilineal": 0.8, "endogamy": 0.6}


def heights(spark, sf):
    return U.weighted_height(U.channel_values(cell_stats(spark, sf)), WEIGHTS)


@query("channel_values", CHANNEL_SQL + """
SELECT CAST(cell_id AS INTEGER) AS cell_id, round(confidence, 4) AS confidence, round(patrilineal, 4) AS patrilineal, round(endogamy, 4) AS endogamy FROM channels""")
def _channel_values(spark, sf):
    return rounded(U.channel_values(cell_stats(spark, sf)).drop("cx", "cy"))


@query("weighted_height", CHANNEL_SQL + "SELECT CAST(cell_id AS INTEGER) AS cell_id, round(height, 4) AS height, lead FROM heights")
def _weighted_height(spark, sf):
    return rounded(heights(spark, sf).select("cell_id", "height", "lead"))


RASTER_SQL = CHANNEL_SQL + """,
box AS (SELECT min(cx) - 0.04 * (max(cx) - min(cx)) AS x0, max(cx) + 0.04 * (max(cx) - min(cx)) AS x1,
  min(cy) - 0.04 * (max(cy) - min(cy)) AS y0, max(cy) + 0.04 * (max(cy) - min(cy)) AS y1 FROM heights),
marks AS (SELECT cell_id, (cx - x0) / (x1 - x0) * 39 AS gx, (cy - y0) / (y1 - y0) * 29 AS gy, height, lead FROM heights, box),
cut AS (SELECT greatest(2.0, 0.12 / greatest(1e-6, ((x1 - x0) / 39 + (y1 - y0) / 29) * 0.5)) AS c FROM box),
dist AS (
  SELECT CAST(a.x AS INTEGER) AS gx, CAST(b.y AS INTEGER) AS gy, (m.gx - a.x) * (m.gx - a.x) + (m.gy - b.y) * (m.gy - b.y) AS d2, m.cell_id, m.height, m.lead
  FROM range(0, 40) a(x), range(0, 30) b(y), marks m),
near AS (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY d2, cell_id) AS rn, min(d2) OVER (PARTITION BY gx, gy) AS nearest FROM dist QUALIFY rn <= 12),
raster AS (
  SELECT gx, gy, CASE WHEN min(nearest) <= (SELECT c * c FROM cut) THEN sum(height / (d2 + 1e-6)) / sum(1 / (d2 + 1e-6)) ELSE 0.0 END AS height,
    CASE WHEN min(nearest) > (SELECT c * c FROM cut) THEN 0
      WHEN sum(CASE WHEN lead = 0 THEN 1 / (d2 + 1e-6) ELSE 0 END) >= greatest(sum(CASE WHEN lead = 1 THEN 1 / (d2 + 1e-6) ELSE 0 END), sum(CASE WHEN lead = 2 THEN 1 / (d2 + 1e-6) ELSE 0 END)) THEN 0
      WHEN sum(CASE WHEN lead = 1 THEN 1 / (d2 + 1e-6) ELSE 0 END) >= sum(CASE WHEN lead = 2 THEN 1 / (d2 + 1e-6) ELSE 0 END) THEN 1 ELSE 2 END AS lead
  FROM near GROUP BY gx, gy)"""
SIZE = (40, 30)


def raster(spark, sf):
    return U.idw_raster(heights(spark, sf), size=SIZE, pad_min=0.0)


@query("idw_raster", RASTER_SQL + "SELECT gx, gy, round(height, 4) AS height, lead FROM raster")
def _idw_raster(spark, sf):
    return rounded(raster(spark, sf))


SMOOTH_SQL = RASTER_SQL + """,
across AS (SELECT CAST(a.gx + o AS INTEGER) AS gx, gy, sum(height * exp(-o * o / 4.5)) / sum(exp(-o * o / 4.5)) AS height
  FROM raster a, range(-5, 6) t(o) WHERE a.gx + o BETWEEN 0 AND 39 GROUP BY ALL),
smooth AS (SELECT gx, CAST(a.gy + o AS INTEGER) AS gy, sum(height * exp(-o * o / 4.5)) / sum(exp(-o * o / 4.5)) AS height
  FROM across a, range(-5, 6) t(o) WHERE a.gy + o BETWEEN 0 AND 29 GROUP BY ALL)"""


@query("gaussian_smooth", SMOOTH_SQL + "SELECT gx, gy, round(height, 4) AS height FROM smooth")
def _gaussian_smooth(spark, sf):
    return rounded(U.gaussian_smooth(raster(spark, sf), SIZE))


@query("percentile_levels", SMOOTH_SQL + """
SELECT CAST(i AS INTEGER) AS level, round(v, 4) AS value FROM (
  SELECT quantile_cont(height, [0.50, 0.50 + 0.49 / 6, 0.50 + 0.49 * 2 / 6, 0.745, 0.50 + 0.49 * 4 / 6, 0.50 + 0.49 * 5 / 6, 0.99]) AS q FROM smooth),
  LATERAL (SELECT unnest(q) AS v, unnest(range(0, 7)) AS i)""")
def _percentile_levels(spark, sf):
    return rounded(U.percentile_levels(U.gaussian_smooth(raster(spark, sf), SIZE)))


@query("exact_percentiles", """
SELECT unnest([50.0, 90.0, 99.0])::DOUBLE AS percent, unnest([round(quantile_cont(l_extendedprice, 0.5), 4), round(quantile_cont(l_extendedprice, 0.9), 4), round(quantile_cont(l_extendedprice, 0.99), 4)]) AS value FROM lineitem""")
def _exact_percentiles(spark, sf):
    from kinloom.operators.ordered import exact_percentiles

    out = exact_percentiles(table(spark, sf, "lineitem"), "l_extendedprice", [50.0, 90.0, 99.0])
    return rounded(out.select("percent", "value"))


@query("density_2d", UNIT + """,
counts AS (SELECT least(floor(x * 20), 19) AS gx, least(floor(y * 20), 19) AS gy, count(*) AS n FROM unit GROUP BY ALL),
full_grid AS (SELECT a.i AS gx, b.i AS gy, coalesce(n, 0) AS v FROM range(0, 20) a(i) CROSS JOIN range(0, 20) b(i) LEFT JOIN counts c ON c.gx = a.i AND c.gy = b.i),
across AS (SELECT a.gx + o AS gx, gy, sum(v * exp(-o * o / 2.0)) / sum(exp(-o * o / 2.0)) AS v FROM full_grid a, range(-3, 4) t(o) WHERE a.gx + o BETWEEN 0 AND 19 GROUP BY ALL)
SELECT CAST(gx AS INTEGER) AS gx, CAST(a.gy + o AS INTEGER) AS gy, round(sum(v * exp(-o * o / 2.0)) / sum(exp(-o * o / 2.0)), 4) AS density
FROM across a, range(-3, 4) t(o) WHERE a.gy + o BETWEEN 0 AND 19 GROUP BY ALL""")
def _density_2d(spark, sf):
    return rounded(U.density_2d(unit_points(spark, sf), bins=20, bandwidth=1.0))
