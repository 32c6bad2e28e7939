"""The benchmark tables in the shape the operators expect, in Spark and as SQL text.

Only arithmetic is used, so both engines see the same rows. k stands for o_custkey.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators.cleaning import distinct_ids
from kinloom.operators.edges import Panel, build_edges
from kinloom.operators.ordered import first_row, numbered
from kinloom.plans.registry import table
from kinloom.session import ensure_checkpoint_dir, tidied
from kinloom.sources.files import write_edges

PANEL = Panel(order=("OBS_DATE", "OBS_KEY"))


def _code(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: the customer as a person observed on the order date."""
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer")
    nation = table(spark, sf, "nation")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1)
    # A married woman's rows name other parents, as in the register.
    block = F.floor(k / 8) + F.when((k % 2 == 0) & F.coalesce(status == 2, F.lit(False)), 1).otherwise(0)
    return joined.select(
        k.cast("string").alias("PERSON_ID"),
        F.year("o_orderdate").alias("YEAR"),
        F.col("o_orderdate").alias("OBS_DATE"),
        o.alias("OBS_KEY"),
        (k % 2 + 1).cast("int").alias("SEX"),
        status.alias("MARITAL_STATUS"),
        _code((k % 2 == 1) & (F.col("o_orderpriority") != "5-LOW"), (k - 1).cast("string")).alias("WIFE_1_ID"),
        _code(k % 2 == 0, (k + 1).cast("string")).alias("HUSBAND_ID"),
        _code(k >= 8, (block * 2 + 1).cast("string")).alias("FATHER_ID"),
        _code(k >= 8, (block * 2).cast("string")).alias("MOTHER_ID"),
        _code(k % 11 != 0, (1940 + k % 40).cast("int")).alias("BIRTHYEAR"),
        F.col("c_nationkey").cast("string").alias("HOUSEHOLD_ID"),
        _code(o % 5 != 0, F.col("n_regionkey").cast("int")).alias("UNIQUE_VILLAGE_ID"),
        _code(o % 7 != 0, F.ascii("c_mktsegment")).alias("REGION"),
        F.col("o_orderpriority").alias("RELATIONSHIP"),
        F.when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("POSITION"),
        (k % 4).cast("int").alias("GENERATION"),
    )


PANEL_SQL = """
panel AS (
  SELECT CAST(o_custkey AS VARCHAR) AS PERSON_ID,
    CAST(year(o_orderdate) AS INTEGER) AS YEAR, o_orderdate AS OBS_DATE, o_orderkey AS OBS_KEY,
    CAST(o_custkey % 2 + 1 AS INTEGER) AS SEX,
    CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 END AS MARITAL_STATUS,
    CASE WHEN o_custkey % 2 = 1 AND o_orderpriority <> '5-LOW' THEN CAST(o_custkey - 1 AS VARCHAR) END AS WIFE_1_ID,
    CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey + 1 AS VARCHAR) END AS HUSBAND_ID,
    CASE WHEN o_custkey >= 8 THEN CAST((o_custkey // 8 + CASE WHEN o_custkey % 2 = 0 AND o_orderstatus = 'F' THEN 1 ELSE 0 END) * 2 + 1 AS VARCHAR) END AS FATHER_ID,
    CASE WHEN o_custkey >= 8 THEN CAST((o_custkey // 8 + CASE WHEN o_custkey % 2 = 0 AND o_orderstatus = 'F' THEN 1 ELSE 0 END) * 2 AS VARCHAR) END AS MOTHER_ID,
    CASE WHEN o_custkey % 11 <> 0 THEN CAST(1940 + o_custkey % 40 AS INTEGER) END AS BIRTHYEAR,
    CAST(c_nationkey AS VARCHAR) AS HOUSEHOLD_ID,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(n_regionkey AS INTEGER) END AS UNIQUE_VILLAGE_ID,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(ascii(c_mktsegment) AS INTEGER) END AS REGION,
    o_orderpriority AS RELATIONSHIP,
    CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS POSITION,
    CAST(o_custkey % 4 AS INTEGER) AS GENERATION
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

PERSONS_SQL = PANEL_SQL + """,
persons AS (SELECT DISTINCT PERSON_ID AS id FROM panel)"""

REFS_SQL = PERSONS_SQL + """,
ranked_refs AS (
  SELECT *, row_number() OVER (PARTITION BY PERSON_ID ORDER BY
    CASE WHEN SEX = 1 AND coalesce(MARITAL_STATUS, 0) = 2 THEN 1 ELSE 0 END, OBS_DATE, OBS_KEY) AS rn
  FROM panel),
refs AS (
  SELECT PERSON_ID AS person, SEX AS sex, BIRTHYEAR AS birth, FATHER_ID AS father,
    MOTHER_ID AS mother, YEAR AS ref_year
  FROM ranked_refs WHERE rn = 1)"""

EVENTS_SQL = PERSONS_SQL + """,
with_prev AS (
  SELECT *, lag(MARITAL_STATUS) OVER w AS ps, lag(YEAR) OVER w AS py, row_number() OVER w AS rn
  FROM panel WINDOW w AS (PARTITION BY PERSON_ID ORDER BY OBS_DATE, OBS_KEY)),
transitions AS (
  SELECT PERSON_ID AS person, SEX AS sex,
    CASE WHEN SEX = 2 THEN WIFE_1_ID ELSE HUSBAND_ID END AS partner,
    CAST(floor((py + YEAR) / 2.0) AS INTEGER) AS year, 1 AS method
  FROM with_prev WHERE MARITAL_STATUS = 2 AND ps IS NOT NULL AND ps <> 2 AND SEX IS NOT NULL),
first_married AS (
  SELECT PERSON_ID AS person, SEX AS sex,
    CASE WHEN SEX = 2 THEN WIFE_1_ID ELSE HUSBAND_ID END AS partner, YEAR AS year, 2 AS method
  FROM with_prev WHERE rn = 1 AND MARITAL_STATUS = 2 AND SEX IS NOT NULL),
direct_links AS (
  SELECT person, sex, partner, year, 3 AS method FROM (
    SELECT PERSON_ID AS person, SEX AS sex, WIFE_1_ID AS partner, YEAR AS year,
      row_number() OVER (PARTITION BY PERSON_ID ORDER BY OBS_DATE, OBS_KEY) AS rn
    FROM panel WHERE SEX = 2 AND WIFE_1_ID IS NOT NULL) WHERE rn = 1)"""

HW_SQL = EVENTS_SQL + """,
all_events AS (
  SELECT * FROM transitions UNION ALL SELECT * FROM first_married UNION ALL SELECT * FROM direct_links),
hw AS (
  SELECT src, dst, 'r_hw' AS rel, year AS t FROM (
    SELECT CASE WHEN sex = 2 THEN person ELSE partner END AS src,
      CASE WHEN sex = 2 THEN partner ELSE person END AS dst, year,
      row_number() OVER (PARTITION BY least(person, partner), greatest(person, partner)
                         ORDER BY year, method, person) AS rn
    FROM all_events WHERE partner IN (SELECT id FROM persons)) WHERE rn = 1)"""

# All nine relations, the sibling relation as the full list of directed pairs.
EDGES_SQL = HW_SQL + """,
ranked_refs AS (
  SELECT *, row_number() OVER (PARTITION BY PERSON_ID ORDER BY
    CASE WHEN SEX = 1 AND coalesce(MARITAL_STATUS, 0) = 2 THEN 1 ELSE 0 END, OBS_DATE, OBS_KEY) AS rn
  FROM panel),
refs AS (
  SELECT PERSON_ID AS person, SEX AS sex, BIRTHYEAR AS birth, FATHER_ID AS father, MOTHER_ID AS mother
  FROM ranked_refs WHERE rn = 1),
kids AS (
  SELECT person, sex, father, coalesce(birth, 1749) AS born FROM refs
  WHERE father IN (SELECT id FROM persons)),
mkids AS (
  SELECT person, sex, mother, coalesce(birth, 1749) AS born FROM refs
  WHERE mother IN (SELECT id FROM persons)),
sib AS (
  SELECT a.person AS src, b.person AS dst, 'r_sib' AS rel, greatest(a.born, b.born) AS t
  FROM kids a JOIN kids b ON a.father = b.father AND a.person <> b.person),
hc AS (
  SELECT HOUSEHOLD_ID AS src, CAST(v AS VARCHAR) AS dst, 'r_hc' AS rel, 0 AS t FROM (
    SELECT HOUSEHOLD_ID, UNIQUE_VILLAGE_ID AS v,
      row_number() OVER (PARTITION BY HOUSEHOLD_ID ORDER BY YEAR, UNIQUE_VILLAGE_ID) AS rn
    FROM panel WHERE HOUSEHOLD_ID IS NOT NULL AND UNIQUE_VILLAGE_ID IS NOT NULL) WHERE rn = 1),
cb AS (
  SELECT PERSON_ID AS src, CAST(REGION AS VARCHAR) AS dst, 'r_cb' AS rel, 0 AS t
  FROM with_prev WHERE rn = 1 AND REGION IS NOT NULL),
edges AS (
  SELECT src, dst, rel, t FROM hw
  UNION ALL SELECT father, person, CASE sex WHEN 2 THEN 'r_fs' ELSE 'r_fd' END, born FROM kids
  UNION ALL SELECT mother, person, CASE sex WHEN 2 THEN 'r_ms' ELSE 'r_md' END, born FROM mkids
  UNION ALL SELECT src, dst, rel, t FROM sib
  UNION ALL SELECT PERSON_ID, HOUSEHOLD_ID, 'r_hh', YEAR FROM panel
  UNION ALL SELECT src, dst, rel, t FROM hc
  UNION ALL SELECT src, dst, rel, t FROM cb)"""


def persons(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_ids(table(spark, sf, "orders"), "o_custkey")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return build_edges(panel(spark, sf), PANEL, persons(spark, sf))


_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf: str, name: str, write) -> DataFrame:
    """A derived table written once per session to the shared checkpoint folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = f"{ensure_checkpoint_dir(spark)}/kinloom/{name}-{uuid.uuid4().hex}"
        with tidied(spark):
            write(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def stored_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edge table as a user keeps it: Parquet partitioned by relation."""
    return _stored(spark, sf, "edges", lambda path: write_edges(edges(spark, sf), path))


def raw_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel as a register arrives: padded ids, coded and unreadable values, all text."""
    base = panel(spark, sf)
    o = F.col("OBS_KEY")
    return base.select(
        F.concat(F.lit(" "), F.col("PERSON_ID"), F.lit(".0")).alias("PERSON_ID"),
        F.coalesce(F.col("FATHER_ID"), F.lit("nan")).alias("FATHER_ID"),
        F.coalesce(F.col("WIFE_1_ID"), F.lit("-99")).alias("WIFE_1_ID"),
        F.concat(F.col("HOUSEHOLD_ID"), F.lit(".00")).alias("HOUSEHOLD_ID"),
        F.col("YEAR").cast("string").alias("YEAR"),
        F.when(o % 19 == 0, "x").otherwise(F.col("MARITAL_STATUS").cast("string")).alias("MARITAL_STATUS"),
        F.when(o % 13 == 0, "-99").otherwise(F.col("BIRTHYEAR").cast("string")).alias("BIRTHYEAR"),
        F.when(o % 17 == 0, "NA").otherwise(F.col("POSITION").cast("string")).alias("POSITION"),
        F.when(o % 23 == 0, -9).otherwise(F.col("GENERATION")).alias("GENERATION"),
        "OBS_KEY",
    )


RAW_SQL = PANEL_SQL + """,
raw_panel AS (
  SELECT ' ' || PERSON_ID || '.0' AS PERSON_ID, coalesce(FATHER_ID, 'nan') AS FATHER_ID,
    coalesce(WIFE_1_ID, '-99') AS WIFE_1_ID, HOUSEHOLD_ID || '.00' AS HOUSEHOLD_ID,
    CAST(YEAR AS VARCHAR) AS YEAR,
    CASE WHEN OBS_KEY % 19 = 0 THEN 'x' ELSE CAST(MARITAL_STATUS AS VARCHAR) END AS MARITAL_STATUS,
    CASE WHEN OBS_KEY % 13 = 0 THEN '-99' ELSE CAST(BIRTHYEAR AS VARCHAR) END AS BIRTHYEAR,
    CASE WHEN OBS_KEY % 17 = 0 THEN 'NA' ELSE CAST(POSITION AS VARCHAR) END AS POSITION,
    CASE WHEN OBS_KEY % 23 = 0 THEN -9 ELSE GENERATION END AS GENERATION, OBS_KEY
  FROM panel)"""


# -- scored pairs ---------------------------------------------------------------------

def scores(spark: SparkSession, sf: str) -> DataFrame:
    """The stored score table, partitioned by cohort year."""
    return _stored(
        spark, sf, "scores", lambda path: build_scores(spark, sf).write.partitionBy("year").option("compression", "zstd").parquet(path)
    )


def build_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(year, h, w, score, k): revenue of customer h with supplier w per order year."""
    orders = table(spark, sf, "orders")
    lineitem = table(spark, sf, "lineitem")
    # Money in whole 1/10000 units: exact, and a plain long sum. Only what the sums need is shuffled.
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    price = cents * (F.lit(100) - F.round(F.col("l_discount") * 100).cast("bigint"))
    dated = orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    priced = lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", price.alias("price"))
    joined = dated.join(priced, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("year", F.col("o_custkey").alias("h"), F.col("l_suppkey").alias("w")).agg(
        (F.sum("price") / F.lit(10000.0)).alias("score"),
        F.min(F.col("o_orderkey") * 100 + F.col("l_linenumber")).alias("k"),
    )


def truth(scored: DataFrame) -> DataFrame:
    """(year, h, true_w, true_score): the partner met first, with its score from the same row."""
    first = first_row(scored, ["year", "h"], ["k", "w"], ["w", "score"])
    return first.withColumnsRenamed({"w": "true_w", "score": "true_score"})


def logits(scored: DataFrame) -> DataFrame:
    """Scores as logits of a plausible size."""
    return scored.withColumn("score", (F.col("score") - 50000.0) / 20000.0)


SCORES_SQL = """
scores AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey AS h, l_suppkey AS w,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS score,
    min(o_orderkey * 100 + l_linenumber) AS k
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""

TRUTH_SQL = SCORES_SQL + """,
truth AS (
  SELECT year, h, w AS true_w FROM (
    SELECT *, row_number() OVER (PARTITION BY year, h ORDER BY k, w) AS rn FROM scores) WHERE rn = 1),
pool AS (SELECT DISTINCT year, w FROM scores),
known AS (
  SELECT s.year, s.h, t.true_w, s.score AS true_score
  FROM scores s JOIN truth t ON s.year = t.year AND s.h = t.h AND s.w = t.true_w),
ranked AS (
  SELECT year, h, w, score,
    row_number() OVER (PARTITION BY year, h ORDER BY score DESC, w) AS rank FROM scores),
ranks AS (
  SELECT r.year, r.h, r.w AS true_w, r.rank AS rank_of_truth
  FROM ranked r JOIN truth t ON r.year = t.year AND r.h = t.h AND r.w = t.true_w)"""

# True pairs and five hard negatives per (year, h), numbered per cohort, with lineages and kin
# paths from the edges. The assignment itself has no SQL.
PAIR_TABLE_SQL = " RECURSIVE " + EDGES_SQL + "," + TRUTH_SQL + """,
up AS (SELECT dst AS id, min(src) AS parent FROM edges WHERE rel IN ('r_fs', 'r_fd') GROUP BY dst),
walk AS (
  SELECT id, id AS cur, 0 AS depth FROM persons
  UNION ALL SELECT w.id, u.parent, w.depth + 1 FROM walk w JOIN up u ON u.id = w.cur WHERE w.depth < 64),
roots AS (SELECT id, arg_max(cur, depth) AS root FROM walk GROUP BY id),
negatives AS (
  SELECT s.year, s.h, s.w, s.score, k.true_score,
    row_number() OVER (PARTITION BY s.year, s.h ORDER BY s.score DESC, s.w) AS neg_rank
  FROM scores s JOIN known k ON s.year = k.year AND s.h = k.h AND s.w <> k.true_w),
mutual AS (
  SELECT year, h, w FROM (
    SELECT *, row_number() OVER (PARTITION BY year, h ORDER BY score DESC, w) AS rl,
      row_number() OVER (PARTITION BY year, w ORDER BY score DESC, h) AS rr FROM scores)
  WHERE rl = 1 AND rr = 1),
pair_rows AS (
  SELECT k.year, k.h, k.true_w AS w, 1 AS label, 0 AS neg_rank, k.true_score AS score,
    k.true_score - coalesce(n.score, 0) AS score_gap, CAST(r.rank_of_truth AS INTEGER) AS rank_of_true_wife
  FROM known k LEFT JOIN negatives n ON n.year = k.year AND n.h = k.h AND n.neg_rank = 1
    JOIN ranks r ON r.year = k.year AND r.h = k.h
  UNION ALL
  SELECT year, h, w, 0, neg_rank, score, score - true_score, NULL FROM negatives WHERE neg_rank <= 5),
couples AS (SELECT DISTINCT CAST(h AS VARCHAR) AS h, CAST(w AS VARCHAR) AS w FROM pair_rows),
pp AS (
  SELECT src AS a, dst AS b FROM edges WHERE rel IN ('r_fs', 'r_fd', 'r_sib')
  UNION SELECT dst, src FROM edges WHERE rel IN ('r_fs', 'r_fd', 'r_sib')),
com AS (SELECT q.h, q.w, count(*) AS n FROM couples q JOIN pp x ON x.a = q.h JOIN pp y ON y.a = q.w AND y.b = x.b GROUP BY ALL),
hhm AS (SELECT DISTINCT src AS p, dst AS g FROM edges WHERE rel = 'r_hh'),
house AS (SELECT DISTINCT q.h, q.w FROM couples q JOIN hhm x ON x.p = q.h JOIN hhm y ON y.p = q.w AND y.g = x.g),
kin AS (
  SELECT q.h, q.w, CASE WHEN q.h = q.w THEN 0 ELSE CASE WHEN p.a IS NULL THEN 0 ELSE 1 END + coalesce(c.n, 0)
    + CASE WHEN g.h IS NULL THEN 0 ELSE 1 END END AS paths, coalesce(a.root = b.root, false) AS same_lineage
  FROM couples q LEFT JOIN pp p ON p.a = q.h AND p.b = q.w LEFT JOIN com c ON c.h = q.h AND c.w = q.w
    LEFT JOIN house g ON g.h = q.h AND g.w = q.w LEFT JOIN roots a ON a.id = q.h LEFT JOIN roots b ON b.id = q.w),
pair_table AS (
  SELECT r.year, r.h, r.w, label, neg_rank, round(score, 4) AS score, round(score_gap, 4) AS score_gap, rank_of_true_wife,
    CASE WHEN r.year = 1998 THEN 'catchup' WHEN r.year IN (2000, 2001) THEN 'late' ELSE 'regular' END AS era,
    k.same_lineage, CAST(k.paths AS INTEGER) AS patri_path_count,
    'P' || r.h AS husband_id, 'P' || r.w AS wife_id,
    row_number() OVER (PARTITION BY r.year ORDER BY r.h, label DESC, neg_rank) - 1 AS id
  FROM pair_rows r JOIN kin k ON k.h = CAST(r.h AS VARCHAR) AND k.w = CAST(r.w AS VARCHAR))"""

# Tags of this many buckets: different roots get different tags.
LINEAGES = 1 << 62


def assignment(spark: SparkSession, sf: str) -> DataFrame:
    """The stored one-to-one assignment of all cohorts: year, h, w, score."""
    from kinloom.operators.assignment import assign_one_to_one

    return _stored(spark, sf, "assignment", lambda path: assign_one_to_one(scores(spark, sf)).write.parquet(path))


def lineage_roots(spark: SparkSession, sf: str) -> DataFrame:
    """The stored root of every person: id (a number, as in the scores), root."""
    from kinloom.operators.kinship import first_parent, root_ancestor

    def write(path: str) -> None:
        found = root_ancestor(first_parent(stored_edges(spark, sf)), persons(spark, sf))
        found.select(F.col("id").cast("bigint").alias("id"), "root").write.parquet(path)

    return _stored(spark, sf, "roots", write)


def pair_table(spark: SparkSession, sf: str) -> DataFrame:
    """The stored pair table, partitioned by year. It is stored narrow; ``z`` is made for those who read it."""
    from kinloom.operators.ranking import with_pair_vectors

    stored = _stored(
        spark, sf, "pairs", lambda path: _narrow_pairs(spark, sf).write.partitionBy("year").parquet(path)
    )
    return with_pair_vectors(stored, _vectors(spark, sf))


def build_pair_table(spark: SparkSession, sf: str) -> DataFrame:
    """The scored-pair table of the benchmark, with the assignment, lineages, kin paths and vectors.

    The vector of a pair is made of the two members' embeddings; ids beyond the table of
    embeddings begin anew.
    """
    from kinloom.operators.ranking import with_pair_vectors

    return with_pair_vectors(_narrow_pairs(spark, sf), _vectors(spark, sf))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    embeddings = table(spark, sf, "embeddings")
    return embeddings.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _narrow_pairs(spark: SparkSession, sf: str) -> DataFrame:
    from kinloom.functions import scalars as S
    from kinloom.operators.ranking import scored_pair_table

    scored = scores(spark, sf)
    n = table(spark, sf, "embeddings").count()
    out = scored_pair_table(
        scored,
        truth(scored),
        assignment=assignment(spark, sf),
        roots=lineage_roots(spark, sf),
        edges=stored_edges(spark, sf),
        vectors=_vectors(spark, sf),
        buckets=LINEAGES,
        vector_key=lambda member: member % n,
        attach=False,
    )
    return out.withColumn("era", S.era_of_year(F.col("year"), catchup=(1998,), late=(2000, 2001)))


# -- embeddings -----------------------------------------------------------------------


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as layout points: the first two dimensions, the label as cluster."""
    e = table(spark, sf, "embeddings")
    v = F.col("embedding")
    return e.select(
        F.col("vec_id").alias("id"),
        v[0].cast("double").alias("x"),
        v[1].cast("double").alias("y"),
        F.col("label").alias("cluster"),
        v[2].cast("double").alias("score_gap"),
        (F.col("vec_id") % 3 == 0).cast("int").alias("label"),
        (F.col("vec_id") % 4).cast("int").alias("patri_path_count"),
        (F.col("vec_id") % 5 == 0).alias("same_lineage"),
        "embedding",
    )


POINTS_SQL = """
points AS (
  SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label AS cluster,
    CAST(embedding[3] AS DOUBLE) AS score_gap, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS label,
    CAST(vec_id % 4 AS INTEGER) AS patri_path_count, vec_id % 5 = 0 AS same_lineage
  FROM embeddings),
unit AS (
  SELECT id, (x - (SELECT min(x) FROM points)) / (SELECT max(x) - min(x) FROM points) AS x,
    (y - (SELECT min(y) FROM points)) / (SELECT max(y) - min(y) FROM points) AS y,
    cluster, score_gap, label, patri_path_count, same_lineage FROM points),
grid AS (
  SELECT q, r, CAST(q AS DOUBLE) * 0.06 AS cx, r * (sqrt(3.0) * 0.04) + CASE WHEN abs(q) % 2 = 1 THEN sqrt(3.0) * 0.04 / 2 ELSE 0 END AS cy
  FROM range(-2, 20) a(q), range(-2, 20) b(r)),
cells AS (
  SELECT *, row_number() OVER (ORDER BY q, r) - 1 AS cell_id FROM grid
  WHERE cx BETWEEN -0.04 AND 1.04 AND cy BETWEEN -0.04 AND 1.04),
placed AS (
  SELECT * FROM (
    SELECT u.*, c.q, c.r, c.cell_id,
      row_number() OVER (PARTITION BY u.id ORDER BY (u.x - c.cx) * (u.x - c.cx) + (u.y - c.cy) * (u.y - c.cy)) AS rn
    FROM unit u, cells c) WHERE rn = 1),
agg AS (
  SELECT q, r, count(*) AS n_points, avg(coalesce(score_gap, 0)) AS mean_score_gap,
    avg(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS pos_ratio,
    avg(coalesce(patri_path_count, 0)) AS patri_path_mean,
    avg(CASE WHEN same_lineage THEN 1.0 ELSE 0.0 END) AS same_lin_frac, min(cluster) AS cluster
  FROM placed GROUP BY q, r),
cell_stats AS (
  SELECT c.q, c.r, c.cx, c.cy, c.cell_id, a.cluster, coalesce(a.n_points, 0) AS n_points,
    coalesce(mean_score_gap, 0.0) AS mean_score_gap, coalesce(pos_ratio, 0.0) AS pos_ratio,
    coalesce(patri_path_mean, 0.0) AS patri_path_mean, coalesce(same_lin_frac, 0.0) AS same_lin_frac,
    coalesce(mean_score_gap, 0.0) AS conf_mean, a.n_points IS NULL AS empty
  FROM cells c LEFT JOIN agg a ON a.q = c.q AND a.r = c.r)"""


def vector_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cohorts of vectors: even ids left, odd ids right, true partner by equal place."""
    e = table(spark, sf, "embeddings").select(
        F.col("label").alias("year"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec")
    )
    left, right = e.where(F.col("id") % 2 == 0), e.where(F.col("id") % 2 == 1)
    h = numbered(left.select("year", F.col("id").alias("h")), ["year"], ["h"], "place")
    w = numbered(right.select("year", F.col("id").alias("true_w")), ["year"], ["true_w"], "place")
    return left, right, h.join(w, ["year", "place"]).select("year", "h", "true_w")


VECTOR_SQL = """
lefts AS (SELECT label AS year, vec_id AS h, embedding AS hv, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings WHERE vec_id % 2 = 0),
rights AS (SELECT label AS year, vec_id AS w, embedding AS wv, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings WHERE vec_id % 2 = 1),
couples AS (SELECT l.year, l.h, r.w AS true_w FROM lefts l JOIN rights r ON l.year = r.year AND l.place = r.place)"""


# -- live log -------------------------------------------------------------------------


def accepts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as accepts; a small error value is a reset marker."""
    e = table(spark, sf, "events")
    return e.select(
        F.dayofmonth("ts").alias("year"),
        F.lit("ablated").alias("ablation"),
        F.col("user_id").cast("string").alias("husband_id"),
        (F.col("event_id") % 4).cast("string").alias("wife_id"),
        F.col("event_type").alias("source"),
        F.col("value").alias("score"),
        "ts",
        F.col("event_id").alias("seq"),
        ((F.col("event_type") == "error") & (F.col("value") < 0.5)).alias("is_reset"),
    )


def accept_truth(spark: SparkSession, sf: str) -> DataFrame:
    """True partner of every user but each fifth."""
    users = table(spark, sf, "events").select("user_id").distinct().where(F.col("user_id") % 5 != 0)
    return users.select(
        F.col("user_id").cast("string").alias("husband_id"), (F.col("user_id") % 4).cast("string").alias("true_wife_id")
    )


ACCEPTS_SQL = """
accepts AS (
  SELECT CAST(day(ts) AS INTEGER) AS year, 'ablated' AS ablation, CAST(user_id AS VARCHAR) AS husband_id,
    CAST(event_id % 4 AS VARCHAR) AS wife_id, event_type AS source, value AS score, ts, event_id AS seq,
    event_type = 'error' AND value < 0.5 AS is_reset,
    CASE WHEN user_id % 5 <> 0 THEN 1 ELSE 0 END AS eligible,
    CASE WHEN user_id % 5 <> 0 AND user_id % 4 = event_id % 4 THEN 1 ELSE 0 END AS correct
  FROM events)"""
