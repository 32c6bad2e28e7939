"""Queries: cohort split, as-of views, yearly covariates, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions import scalars as S
from kinloom.operators import cleaning as C
from kinloom.operators import edges as E
from kinloom.operators import features as X
from kinloom.operators import macro as M
from kinloom.operators import temporal as T
from kinloom.plans import views as V
from kinloom.plans.registry import query, rounded, table

P = V.PANEL

# Most marriages of the view fall into its first years.
BOUNDS = {"train_end": 1995, "val_end": 1996, "low": 1995, "high": 1999}
BUCKET_SQL = """CASE WHEN t < 1995 OR t > 1999 THEN NULL WHEN t <= 1995 THEN 'train' WHEN t <= 1996 THEN 'val' ELSE 'test' END"""
SPLIT_SQL = V.HW_SQL + f""",
split AS (SELECT src AS h, dst AS w, t AS year, {BUCKET_SQL} AS bucket FROM hw)"""


def hw(spark, sf):
    return E.marriage_edges(V.panel(spark, sf), P, V.persons(spark, sf))


def split(spark, sf):
    return T.cohort_split(hw(spark, sf), **BOUNDS)


@query("cohort_split", "WITH" + SPLIT_SQL + "SELECT h, w, year, bucket FROM split")
def _cohort_split(spark, sf):
    return split(spark, sf)


@query("bucket_summary", "WITH" + SPLIT_SQL + """
SELECT bucket, year, count(*) AS n_pairs, CAST(grouping(bucket, year) AS INTEGER) AS level
FROM split WHERE bucket IS NOT NULL GROUP BY ROLLUP (bucket, year)""")
def _bucket_summary(spark, sf):
    return T.bucket_summary(split(spark, sf))


@query("bucket_pair_set", "WITH" + SPLIT_SQL + "SELECT DISTINCT h, w FROM split WHERE bucket IN ('val', 'test')")
def _bucket_pair_set(spark, sf):
    return T.bucket_pair_set(split(spark, sf))


@query("exclusion_set", "WITH" + SPLIT_SQL + """
SELECT h, w FROM split WHERE bucket = 'train' AND year = 1995 UNION SELECT h, w FROM split WHERE bucket IN ('val', 'test')""")
def _exclusion_set(spark, sf):
    return T.exclusion_set(split(spark, sf), 1995)


@query("restrict_years", "WITH" + SPLIT_SQL + """
SELECT h, w, year, bucket FROM split
WHERE (bucket = 'train' AND year = 1995) OR (bucket = 'val' AND year BETWEEN 1990 AND 1995) OR (bucket = 'test' AND year BETWEEN 1997 AND 1998)""")
def _restrict_years(spark, sf):
    return T.restrict_years(split(spark, sf), {"train": (1995, 1995), "val": (1990, 1995), "test": (1997, 1998)})


@query("ablate_relations", "WITH" + V.EDGES_SQL + """
SELECT r.rel, count(e.rel) AS n_edges
FROM (SELECT unnest(['r_hw','r_fs','r_fd','r_ms','r_md','r_sib','r_hh','r_hc','r_cb']) AS rel) r
LEFT JOIN (SELECT rel FROM edges WHERE rel NOT IN ('r_ms', 'r_md')) e ON e.rel = r.rel GROUP BY r.rel""")
def _ablate_relations(spark, sf):
    return E.edge_counts(T.ablate_relations(V.stored_edges(spark, sf)))


@query("mask_pairs", "WITH" + SPLIT_SQL + """
SELECT src, dst, rel, t FROM hw WHERE (src, dst) NOT IN (SELECT h, w FROM split WHERE bucket IN ('val', 'test'))
UNION ALL SELECT PERSON_ID, HOUSEHOLD_ID, 'r_hh', YEAR FROM panel""")
def _mask_pairs(spark, sf):
    panel = V.panel(spark, sf)
    edges = hw(spark, sf).unionByName(E.membership_edges_timed(panel, P))
    return T.mask_pairs(edges, T.bucket_pair_set(split(spark, sf)))


@query("as_of", "WITH" + V.EDGES_SQL + """
SELECT rel, count(*) AS n_edges FROM edges WHERE t < 1965 GROUP BY rel
UNION ALL SELECT rel, 0 FROM (SELECT unnest(['r_hw','r_hh']) AS rel)""")
def _as_of(spark, sf):
    return E.edge_counts(T.as_of(V.stored_edges(spark, sf), 1965))


@query("as_of_many", "WITH" + V.EDGES_SQL + """,
years AS (SELECT DISTINCT YEAR AS year FROM panel UNION SELECT 1960 UNION SELECT 1975)
SELECT CAST(y.year AS INTEGER) AS year, e.rel, count(*) AS n_visible FROM years y JOIN edges e ON e.t < y.year GROUP BY 1, 2""")
def _as_of_many(spark, sf):
    years = V.panel(spark, sf).select(F.col("YEAR").alias("year"))
    years = years.unionByName(spark.createDataFrame([(1960,), (1975,)], "year int"))
    return T.as_of_many(V.stored_edges(spark, sf), years)


@query("degrees_as_of", "WITH" + V.EDGES_SQL + """,
asked AS (SELECT DISTINCT PERSON_ID AS id, YEAR - 30 AS year FROM panel UNION SELECT DISTINCT PERSON_ID, YEAR FROM panel),
ends AS (SELECT src AS id, rel, t FROM edges UNION ALL SELECT dst, rel, t FROM edges)
SELECT a.id, CAST(a.year AS INTEGER) AS year, e.rel, count(*) AS degree FROM asked a JOIN ends e ON e.id = a.id AND e.t < a.year GROUP BY 1, 2, 3""")
def _degrees_as_of(spark, sf):
    asked = V.panel(spark, sf).select(F.col("PERSON_ID").alias("id"), F.col("YEAR").alias("year"))
    asked = asked.unionByName(asked.select("id", (F.col("year") - 30).alias("year")))
    # Households, places and persons share the id space of the benchmark view, here and in the SQL.
    return T.degrees_as_of(V.stored_edges(spark, sf), asked, "any")


# -- yearly covariates ----------------------------------------------------------------

MONTH_SQL = """
months AS (
  SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS YEAR, l_extendedprice, l_returnflag, l_quantity, l_tax FROM lineitem),
price AS (
  SELECT YEAR, CASE WHEN YEAR % 5 <> 0 THEN CAST(avg(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) END AS grain_price FROM months GROUP BY YEAR),
disaster AS (SELECT YEAR, count(*) AS disaster_count FROM months WHERE l_returnflag = 'R' AND l_quantity > 49.5 AND YEAR % 3 = 0 GROUP BY YEAR),
calendar AS (SELECT CAST(y AS INTEGER) AS YEAR FROM range(23938, 24026) t(y)),
scaffold AS (
  SELECT c.YEAR, p.grain_price, d.disaster_count FROM calendar c LEFT JOIN price p ON p.YEAR = c.YEAR LEFT JOIN disaster d ON d.YEAR = c.YEAR),
filled AS (
  SELECT YEAR, disaster_count, coalesce(last_value(grain_price IGNORE NULLS) OVER (ORDER BY YEAR ROWS UNBOUNDED PRECEDING),
    first_value(grain_price IGNORE NULLS) OVER (ORDER BY YEAR ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS grain_price FROM scaffold)"""
# First and last month index of the calendar, which reaches beyond the data at both ends.
MONTHS = (23938, 24025)
STARTS = ((0, 23940), (1, 23960), (2, 23990), (3, 24010))


def months(spark, sf):
    lines = table(spark, sf, "lineitem")
    index = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("YEAR")
    return lines.select(index, "l_extendedprice", "l_returnflag", "l_quantity")


def prices(spark, sf):
    # avg over exact decimals, so that the order of rows does not matter
    exact = F.col("l_extendedprice").cast("decimal(12,2)")
    means = months(spark, sf).groupBy("YEAR").agg((F.sum(exact).cast("double") / F.count(exact)).alias("p"))
    return means.select("YEAR", F.when(F.col("YEAR") % 5 != 0, F.col("p")).alias("grain_price"))


def disasters(spark, sf):
    rows = months(spark, sf).where(
        (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49.5) & (F.col("YEAR") % 3 == 0)
    )
    return M.yearly_event_counts(rows)


@query("row_mean", """
SELECT l_orderkey, l_linenumber, l_partkey, round(list_avg(list_filter([l_quantity, l_discount * 100, l_tax * 100], lambda v: v <> 5)), 4) AS mean_value
FROM lineitem""")
def _row_mean(spark, sf):
    columns = [F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100]
    mean = S.row_mean(columns, missing=5.0)
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", mean.alias("mean_value")))


@query("yearly_event_counts", "WITH" + MONTH_SQL + "SELECT YEAR, disaster_count FROM disaster")
def _yearly_event_counts(spark, sf):
    return disasters(spark, sf)


@query("calendar_scaffold", "WITH" + MONTH_SQL + "SELECT YEAR, round(grain_price, 4) AS grain_price, disaster_count FROM scaffold")
def _calendar_scaffold(spark, sf):
    return rounded(M.calendar_scaffold(*MONTHS, prices(spark, sf), disasters(spark, sf)))


@query("ffill_bfill", "WITH" + MONTH_SQL + "SELECT YEAR, round(grain_price, 4) AS grain_price FROM filled")
def _ffill_bfill(spark, sf):
    full = M.calendar_scaffold(*MONTHS, prices(spark, sf))
    return rounded(M.ffill_bfill(full, "grain_price", "YEAR"))


@query("zscore", "WITH" + MONTH_SQL + """
SELECT YEAR, round((grain_price - (SELECT avg(grain_price) FROM price)) / (SELECT stddev_samp(grain_price) FROM price), 4) AS z FROM price""")
def _zscore(spark, sf):
    return rounded(M.zscore(prices(spark, sf), "grain_price", "z").select("YEAR", "z"))


@query("diff", "WITH" + MONTH_SQL + """
SELECT YEAR, round(coalesce(grain_price - lag(grain_price) OVER (ORDER BY YEAR), 0.0), 4) AS change FROM filled""")
def _diff(spark, sf):
    full = M.ffill_bfill(M.calendar_scaffold(*MONTHS, prices(spark, sf)), "grain_price", "YEAR")
    return rounded(M.diff(full, "grain_price", "YEAR", "change").select("YEAR", "change"))


@query("flag_positive", "WITH" + MONTH_SQL + """
SELECT YEAR, CASE WHEN coalesce(disaster_count, 0) > 0 THEN 1 ELSE 0 END AS disaster_flag FROM scaffold""")
def _flag_positive(spark, sf):
    full = M.calendar_scaffold(*MONTHS, disasters(spark, sf))
    return full.select("YEAR", S.flag_positive(F.col("disaster_count")).alias("disaster_flag"))


ERA_SQL = "CASE WHEN YEAR >= 24010 THEN 3 WHEN YEAR >= 23990 THEN 2 WHEN YEAR >= 23960 THEN 1 ELSE 0 END"


@query("era_id", "WITH" + MONTH_SQL + f"SELECT YEAR, {ERA_SQL} AS era_id, count(*) AS n FROM months GROUP BY ALL")
def _era_id(spark, sf):
    rows = months(spark, sf).select("YEAR", S.era_id(F.col("YEAR"), STARTS).alias("era_id"))
    return rows.groupBy("YEAR", "era_id").agg(F.count("*").alias("n"))


MACRO_SQL = MONTH_SQL + f""",
stats AS (SELECT avg(grain_price) AS m, stddev_samp(grain_price) AS s, avg(YEAR) AS ym, stddev_samp(YEAR) AS ys FROM filled),
macro AS (
  SELECT YEAR, (YEAR - ym) / ys AS cohort_year_z, (grain_price - m) / s AS grain_price_z,
    coalesce(grain_price - lag(grain_price) OVER (ORDER BY YEAR), 0.0) AS grain_price_yoy, {ERA_SQL} AS era_id,
    CASE WHEN coalesce(disaster_count, 0) > 0 THEN 1 ELSE 0 END AS disaster_flag FROM filled, stats)"""
MACRO_COLUMNS_SQL = """round(cohort_year_z, 4) AS cohort_year_z, round(grain_price_z, 4) AS grain_price_z,
  round(grain_price_yoy, 4) AS grain_price_yoy, era_id, disaster_flag"""


def macro(spark, sf, years=None):
    return M.macro_table(prices(spark, sf), disasters(spark, sf), *MONTHS, STARTS, years)


@query("yearly_mean", """
SELECT CAST(year(l_shipdate) AS INTEGER) AS YEAR, round((l_extendedprice + l_tax) / 2, 4) AS grain_price FROM lineitem""")
def _yearly_mean(spark, sf):
    """A yearly price source with several price columns, one row per source row."""
    lines = table(spark, sf, "lineitem").withColumn("YEAR", F.year("l_shipdate"))
    return rounded(M.yearly_mean(lines, ["l_extendedprice", "l_tax", "absent"]))


@query("macro_table", "WITH" + MACRO_SQL + f"SELECT YEAR, {MACRO_COLUMNS_SQL} FROM macro")
def _macro_table(spark, sf):
    return rounded(macro(spark, sf))


@query("macro_table_years", "WITH" + MACRO_SQL + f"SELECT YEAR, {MACRO_COLUMNS_SQL} FROM macro WHERE YEAR IN (SELECT YEAR FROM disaster)")
def _macro_table_years(spark, sf):
    return rounded(macro(spark, sf, disasters(spark, sf).select("YEAR")))


@query("standardize_columns", "WITH" + MACRO_SQL + """
SELECT YEAR, round((era_id - (SELECT avg(era_id) FROM macro)) / (SELECT stddev_samp(era_id) FROM macro), 4) AS era_id,
  round((disaster_flag - (SELECT avg(disaster_flag) FROM macro)) / (SELECT stddev_samp(disaster_flag) FROM macro), 4) AS disaster_flag
FROM macro""")
def _standardize_columns(spark, sf):
    return rounded(M.standardize_columns(macro(spark, sf).select("YEAR", "era_id", "disaster_flag"), ["era_id", "disaster_flag"]))


@query("macro_at", "WITH" + MACRO_SQL + """,
cohorts AS (SELECT DISTINCT YEAR + 1 AS year FROM months UNION SELECT 23000 UNION SELECT 25000)
SELECT CAST(c.year AS INTEGER) AS year, m.YEAR AS macro_year, round(grain_price_z, 4) AS grain_price_z, era_id, disaster_flag
FROM cohorts c JOIN macro m ON m.YEAR = greatest(23938, least(c.year - 1, 24025))""")
def _macro_at(spark, sf):
    cohorts = months(spark, sf).select((F.col("YEAR") + 1).alias("year")).distinct()
    cohorts = cohorts.unionByName(spark.createDataFrame([(23000,), (25000,)], "year int"))
    out = T.macro_at(cohorts, macro(spark, sf), *MONTHS)
    return rounded(out.select("year", "macro_year", "grain_price_z", "era_id", "disaster_flag"))


# -- features -------------------------------------------------------------------------


def latest_sql(column: str, alias: str, where: str = "TRUE") -> str:
    return f"""{alias} AS (SELECT PERSON_ID, {column} AS v FROM (SELECT PERSON_ID, {column}, row_number() OVER (
      PARTITION BY PERSON_ID ORDER BY OBS_DATE DESC, OBS_KEY DESC) AS rn FROM panel WHERE {column} IS NOT NULL AND {where}) WHERE rn = 1)"""


@query("latest_as_of", "WITH" + V.PANEL_SQL + "," + latest_sql("MARITAL_STATUS", "a", "YEAR <= 1997") + ","
       + latest_sql("WIFE_1_ID", "b", "YEAR <= 1997") + "," + latest_sql("RELATIONSHIP", "c", "YEAR <= 1997") + """
SELECT p.PERSON_ID, a.v AS MARITAL_STATUS, b.v AS WIFE_1_ID, c.v AS RELATIONSHIP
FROM (SELECT DISTINCT PERSON_ID FROM panel WHERE YEAR <= 1997) p LEFT JOIN a ON a.PERSON_ID = p.PERSON_ID
LEFT JOIN b ON b.PERSON_ID = p.PERSON_ID LEFT JOIN c ON c.PERSON_ID = p.PERSON_ID""")
def _latest_as_of(spark, sf):
    return X.latest_as_of(
        V.panel(spark, sf), "PERSON_ID", P.row_order, ["MARITAL_STATUS", "WIFE_1_ID", "RELATIONSHIP"], F.col("YEAR") <= 1997
    )


@query("valid_code", "WITH" + V.PANEL_SQL + """
SELECT OBS_KEY, CASE WHEN GENERATION IN (1, 2) THEN GENERATION ELSE 0 END AS code FROM panel""")
def _valid_code(spark, sf):
    return V.panel(spark, sf).select("OBS_KEY", S.valid_code(F.col("GENERATION"), (1, 2)).alias("code"))


@query("missing_mask", "WITH" + V.PANEL_SQL + """
SELECT OBS_KEY, BIRTHYEAR IS NOT NULL AS BIRTHYEAR_present, MARITAL_STATUS IS NOT NULL AS MARITAL_STATUS_present FROM panel""")
def _missing_mask(spark, sf):
    out = X.missing_mask(V.panel(spark, sf), ["BIRTHYEAR", "MARITAL_STATUS"])
    return out.select("OBS_KEY", "BIRTHYEAR_present", "MARITAL_STATUS_present")


@query("binary_flags", "WITH" + V.PANEL_SQL + """
SELECT OBS_KEY, CASE WHEN POSITION > 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS POSITION_flag,
  CASE WHEN MARITAL_STATUS > 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS MARITAL_STATUS_flag FROM panel""")
def _binary_flags(spark, sf):
    out = X.binary_flags(V.panel(spark, sf), ["POSITION", "MARITAL_STATUS"])
    return out.select("OBS_KEY", "POSITION_flag", "MARITAL_STATUS_flag")


VOCAB_SQL = """
counts AS (SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1),
vocab AS (SELECT value, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS code, n FROM counts QUALIFY code < 16)"""


@query("fit_vocab", "WITH" + VOCAB_SQL + "SELECT value, code, n FROM vocab")
def _fit_vocab(spark, sf):
    return X.fit_vocab(table(spark, sf, "part"), "p_brand", 16)


@query("fit_vocab_count_unknown", """
WITH counts AS (SELECT coalesce(CASE WHEN p_size % 3 > 0 THEN p_type END, '<UNK>') AS value, count(*) AS n FROM part GROUP BY 1)
SELECT value, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS code, n FROM counts""")
def _fit_vocab_unknown(spark, sf):
    kinds = table(spark, sf, "part").select(F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("kind"))
    return X.fit_vocab(kinds, "kind", None, count_unknown=True)


@query("encode", "WITH" + VOCAB_SQL + """
SELECT p_partkey, coalesce(code, 0) AS brand_code FROM part LEFT JOIN vocab ON value = p_brand""")
def _encode(spark, sf):
    part = table(spark, sf, "part")
    return X.encode(part, "p_brand", X.fit_vocab(part, "p_brand", 16), "brand_code").select("p_partkey", "brand_code")


@query("masked_zscore", "WITH" + V.PANEL_SQL + """
SELECT OBS_KEY, round(CASE WHEN BIRTHYEAR IS NULL THEN 0.0 ELSE (BIRTHYEAR - (SELECT avg(BIRTHYEAR) FROM panel)) /
  (SELECT stddev_samp(BIRTHYEAR) FROM panel) END, 4) AS BIRTHYEAR_z FROM panel""")
def _masked_zscore(spark, sf):
    return rounded(X.masked_zscore(V.panel(spark, sf), ["BIRTHYEAR"]).select("OBS_KEY", "BIRTHYEAR_z"))


@query("household_snapshot", "WITH" + V.PANEL_SQL + """,
last AS (SELECT HOUSEHOLD_ID, max(YEAR) AS y FROM panel WHERE YEAR <= 2000 GROUP BY 1)
SELECT p.HOUSEHOLD_ID AS household, count(*) AS household_size, round(count(*) FILTER (WHERE MARITAL_STATUS = 2) / 2.0, 4) AS couples,
  count(DISTINCT GENERATION) AS generations,
  CASE WHEN max(CASE WHEN RELATIONSHIP LIKE '%URGENT%' THEN POSITION END) > 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS head_has_position,
  round((max(p.YEAR) - 1995) / 6.0, 4) AS year_scaled
FROM panel p JOIN last l ON p.HOUSEHOLD_ID = l.HOUSEHOLD_ID AND p.YEAR = l.y GROUP BY 1""")
def _household_snapshot(spark, sf):
    return rounded(X.household_snapshot(V.panel(spark, sf), P, head_pattern="URGENT", cutoff=2000, low=1995, high=2001))


@query("community_size", "WITH" + V.PANEL_SQL + """,
s AS (SELECT CAST(UNIQUE_VILLAGE_ID AS VARCHAR) AS community, count(DISTINCT PERSON_ID) AS population FROM panel WHERE UNIQUE_VILLAGE_ID IS NOT NULL GROUP BY 1)
SELECT community, population, round(population / (SELECT max(population) FROM s), 4) AS relative_size FROM s""")
def _community_size(spark, sf):
    return rounded(X.community_size(V.panel(spark, sf), P))


@query("one_hot", "WITH" + V.PANEL_SQL + """,
b AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM (SELECT DISTINCT CAST(REGION AS VARCHAR) AS id FROM panel WHERE REGION IS NOT NULL))
SELECT a.id, c.idx AS position, CASE WHEN a.idx = c.idx THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS value
FROM b a, b c""")
def _one_hot(spark, sf):
    banners = C.dense_index(C.distinct_ids(V.panel(spark, sf), "REGION", True))
    rows = X.one_hot_rows(banners).select("id", F.posexplode("one_hot").alias("position", "value"))
    return rows.select("id", F.col("position").cast("bigint").alias("position"), "value")


@query("minmax_scale", """
SELECT o_orderkey, round((o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 4) AS o_totalprice_01
FROM orders""")
def _minmax_scale(spark, sf):
    out = X.minmax_scale(table(spark, sf, "orders"), ["o_totalprice"])
    return rounded(out.select("o_orderkey", "o_totalprice_01"))


@query("assemble_features", "WITH" + V.PANEL_SQL + "," + latest_sql("SEX", "sx") + "," + latest_sql("BIRTHYEAR", "bi") + ","
       + latest_sql("UNIQUE_VILLAGE_ID", "vi") + "," + latest_sql("REGION", "rg") + "," + latest_sql("RELATIONSHIP", "re") + ","
       + latest_sql("POSITION", "po") + """,
rc AS (SELECT v, row_number() OVER (ORDER BY count(*) DESC, v) AS code FROM re GROUP BY v)
SELECT p.PERSON_ID AS person, sx.v AS sex, bi.v IS NOT NULL AS birth_present, coalesce(bi.v, 0) AS birth_year,
  round(CASE WHEN bi.v IS NULL THEN 0.0 ELSE (bi.v - (SELECT avg(v) FROM bi)) / (SELECT stddev_samp(v) FROM bi) END, 4) AS birth_z,
  CAST(CASE WHEN rc.code < 4 THEN rc.code ELSE 0 END AS INTEGER) AS relationship_code,
  CASE WHEN po.v > 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS position_flag,
  coalesce(vi.v, -1) AS community_id, coalesce(rg.v, -1) AS banner_id
FROM (SELECT DISTINCT PERSON_ID FROM panel) p LEFT JOIN sx USING (PERSON_ID) LEFT JOIN bi USING (PERSON_ID)
  LEFT JOIN vi USING (PERSON_ID) LEFT JOIN rg USING (PERSON_ID) LEFT JOIN re USING (PERSON_ID) LEFT JOIN po USING (PERSON_ID)
  LEFT JOIN rc ON rc.v = re.v""")
def _assemble_features(spark, sf):
    out = X.assemble_features(V.panel(spark, sf), P, occupation=["POSITION"], vocab_size=4)
    return rounded(out.drop("features"))


@query("relation_degrees", "WITH" + V.EDGES_SQL + """,
ends AS (SELECT src AS id, rel FROM edges UNION ALL SELECT dst, rel FROM edges)
SELECT p.id, r.rel, count(x.id) AS degree FROM persons p CROSS JOIN (SELECT DISTINCT rel FROM edges) r
LEFT JOIN ends x ON x.id = p.id AND x.rel = r.rel GROUP BY 1, 2""")
def _relation_degrees(spark, sf):
    return X.relation_degrees(V.stored_edges(spark, sf), V.persons(spark, sf), "any")


_SPEC = [("men", r, m) for r, m, _ in X.COHORT_SIDES if m] + [("women", r, w) for r, _, w in X.COHORT_SIDES if w]
DENSITY_SQL = V.EDGES_SQL + f""",
split AS (SELECT src AS h, dst AS w, t AS year FROM hw WHERE t BETWEEN 1995 AND 1999),
spec(who, rel, side) AS (VALUES {", ".join(str(s) for s in _SPEC)}),
links AS (
  SELECT s.who, s.rel, e.dst AS id, e.t FROM edges e JOIN spec s ON s.rel = e.rel AND s.side IN ('in', 'any')
  UNION ALL SELECT s.who, s.rel, e.src, e.t FROM edges e JOIN spec s ON s.rel = e.rel AND s.side IN ('out', 'any')),
members AS (SELECT DISTINCT 'men' AS who, h AS id, year FROM split UNION SELECT DISTINCT 'women', w, year FROM split),
deg AS (
  SELECT m.who, m.year, s.rel, m.id, count(l.id) AS d FROM members m JOIN spec s ON s.who = m.who
  LEFT JOIN links l ON l.who = m.who AND l.rel = s.rel AND l.id = m.id AND l.t < m.year GROUP BY ALL)"""


def density(spark, sf):
    edges = V.stored_edges(spark, sf)
    pairs = T.cohort_split(edges, **BOUNDS).where(F.col("bucket").isNotNull())
    return X.context_density(edges, pairs)


@query("context_density", "WITH" + DENSITY_SQL + """
SELECT year, who, rel, count(*) AS n_members, round(avg(d), 4) AS mean_degree, round(100.0 * count(*) FILTER (WHERE d = 0) / count(*), 4) AS zero_pct
FROM deg GROUP BY year, who, rel""")
def _context_density(spark, sf):
    return rounded(density(spark, sf))


MEN = [r for who, r, _ in _SPEC if who == "men"]
_WIDE = ", ".join(
    f"round(avg(d) FILTER (WHERE rel = '{r}'), 4) AS {r}_mean, "
    f"round(100.0 * count(*) FILTER (WHERE d = 0 AND rel = '{r}') / count(*) FILTER (WHERE rel = '{r}'), 4) AS {r}_zero_pct"
    for r in MEN
)


@query("density_wide", "WITH" + DENSITY_SQL + f"SELECT year, count(DISTINCT id) AS n_members, {_WIDE} FROM deg WHERE who = 'men' GROUP BY year")
def _density_wide(spark, sf):
    return rounded(X.density_wide(density(spark, sf), "men", MEN))


AGGREGATE_SQL = V.EDGES_SQL + """,
e AS (SELECT src, dst, rel FROM edges),
h0 AS (SELECT person AS id, CAST(born AS DOUBLE) AS v FROM (SELECT PERSON_ID AS person, coalesce(max(BIRTHYEAR), 1960) AS born FROM panel GROUP BY 1)),
p1 AS (SELECT id, avg(v) AS v FROM (SELECT e.dst AS id, rel, avg(h0.v) AS v FROM e JOIN h0 ON h0.id = e.src GROUP BY 1, 2) GROUP BY 1),
h1 AS (SELECT h0.id, coalesce(p1.v, h0.v) AS v FROM h0 LEFT JOIN p1 ON p1.id = h0.id),
p2 AS (SELECT id, avg(v) AS v FROM (SELECT e.dst AS id, rel, avg(h1.v) AS v FROM e JOIN h1 ON h1.id = e.src GROUP BY 1, 2) GROUP BY 1),
h2 AS (SELECT h1.id, coalesce(p2.v, h1.v) AS v FROM h1 LEFT JOIN p2 ON p2.id = h1.id)"""


@query("neighbor_aggregate", "WITH" + AGGREGATE_SQL + "SELECT id, round(v, 4) AS born FROM h2")
def _neighbor_aggregate(spark, sf):
    edges = V.stored_edges(spark, sf)
    people = V.panel(spark, sf).groupBy(F.col("PERSON_ID").alias("id")).agg(
        F.coalesce(F.max("BIRTHYEAR"), F.lit(1960)).cast("double").alias("born")
    )
    return rounded(X.neighbor_aggregate(edges, people, ["born"], hops=2))
