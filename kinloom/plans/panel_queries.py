"""Queries: sources, cleaning, identity, edges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinloom.functions import scalars as S
from kinloom.operators import cleaning as C
from kinloom.operators import edges as E
from kinloom.operators import features as X
from kinloom.plans import views as V
from kinloom.plans.registry import query, rounded, table
from kinloom.session import ensure_checkpoint_dir
from kinloom.sources import files

P = V.PANEL


def scratch(spark, name: str) -> str:
    """A new folder in the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark)}/kinloom/{name}-{uuid.uuid4().hex}"


# -- sources and sinks ----------------------------------------------------------------


@query("read_panel", "WITH" + V.RAW_SQL + """
SELECT PERSON_ID, FATHER_ID, WIFE_1_ID, HOUSEHOLD_ID, YEAR, MARITAL_STATUS, BIRTHYEAR, POSITION FROM raw_panel""")
def _read_panel(spark, sf):
    raw = V.raw_panel(spark, sf)
    names = ["PERSON_ID", "FATHER_ID", "WIFE_1_ID", "HOUSEHOLD_ID", "YEAR", "MARITAL_STATUS", "BIRTHYEAR", "POSITION"]
    path = scratch(spark, "register")
    raw.select(*names).write.option("header", "true").option("compression", "gzip").option(
        "ignoreLeadingWhiteSpace", "false"
    ).csv(path)
    return files.read_panel(spark, path, files.panel_schema(names))


@query("read_parquet", "SELECT o_orderkey, o_custkey FROM orders")
def _read_parquet(spark, sf):
    return files.read_parquet(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey"])


@query("read_cohort_json", "WITH" + V.PAIR_TABLE_SQL + """
SELECT year, 'ablated' AS ablation, CAST(id AS INTEGER) AS id, husband_id, wife_id, label, score, score_gap,
  round(h / 10.0, 4) AS x, round(w / 10.0, 4) AS y, CAST(w % 10 AS INTEGER) AS cluster
FROM pair_table""")
def _read_cohort_json(spark, sf):
    pairs = V.pair_table(spark, sf)
    record = F.struct(
        F.col("id").cast("int").alias("id"), "husband_id", "wife_id", "label", "score", "score_gap",
        "rank_of_true_wife", "hungarian_correct", "same_lineage", "era", "patri_path_count",
    )
    x, y = F.round(F.col("h") / 10.0, 4), F.round(F.col("w") / 10.0, 4)
    # One payload per left entity, as a payload is one nested document.
    payload = pairs.groupBy("year", "h").agg(
        F.sort_array(F.collect_list(F.struct("id", record.alias("p"), F.array(x, y).alias("m"), (F.col("w") % 10).cast("int").alias("c")))).alias("s")
    ).select(
        "year",
        F.lit("ablated").alias("ablation"),
        F.transform("s", lambda e: e["p"]).alias("pairs"),
        F.transform("s", lambda e: e["m"]).alias("mds_coords"),
        F.transform("s", lambda e: e["c"]).alias("clusters"),
    )
    path = scratch(spark, "payload")
    payload.write.json(path)
    rows = files.read_cohort_json(spark, path, multi_line=False)
    return rows.select("year", "ablation", "id", "husband_id", "wife_id", "label", "score", "score_gap", "x", "y", "cluster")


@query("write_cohort", "WITH" + V.TRUTH_SQL + """
SELECT year, 'ablated' AS ablation, count(*) AS n, CAST(sum(w) AS BIGINT) AS w_sum FROM scores GROUP BY year""")
def _write_cohort(spark, sf):
    path = scratch(spark, "cohorts")
    pairs = V.scores(spark, sf).withColumn("ablation", F.lit("ablated"))
    files.write_cohort(pairs, path)
    back = spark.read.parquet(path)
    return back.groupBy("year", "ablation").agg(F.count("*").alias("n"), F.sum("w").alias("w_sum"))


# -- cleaning -------------------------------------------------------------------------


@query("null_missing_codes", "WITH" + V.RAW_SQL + """
SELECT PERSON_ID, FATHER_ID, nullif(WIFE_1_ID, '-99') AS WIFE_1_ID, MARITAL_STATUS,
  nullif(BIRTHYEAR, '-99') AS BIRTHYEAR, nullif(POSITION, 'NA') AS POSITION, nullif(GENERATION, -9) AS GENERATION, OBS_KEY
FROM raw_panel""")
def _null_missing_codes(spark, sf):
    raw = V.raw_panel(spark, sf).drop("HOUSEHOLD_ID", "YEAR")
    return C.null_missing_codes(raw)


@query("normalize_id", "WITH" + V.RAW_SQL + """
SELECT DISTINCT PERSON_ID AS raw_id, regexp_replace(trim(PERSON_ID), '\\.0+$', '') AS id FROM raw_panel""")
def _normalize_id(spark, sf):
    raw = V.raw_panel(spark, sf).select(F.col("PERSON_ID").alias("raw_id")).distinct()
    return raw.withColumn("id", S.normalize_id(F.col("raw_id")))


@query("normalize_ids", "WITH" + V.RAW_SQL + """
SELECT regexp_replace(trim(PERSON_ID), '\\.0+$', '') AS PERSON_ID, nullif(FATHER_ID, 'nan') AS FATHER_ID, WIFE_1_ID,
  regexp_replace(trim(HOUSEHOLD_ID), '\\.0+$', '') AS HOUSEHOLD_ID, OBS_KEY FROM raw_panel""")
def _normalize_ids(spark, sf):
    return C.normalize_ids(V.raw_panel(spark, sf)).select("PERSON_ID", "FATHER_ID", "WIFE_1_ID", "HOUSEHOLD_ID", "OBS_KEY")


@query("coerce_numeric", "WITH" + V.RAW_SQL + """
SELECT OBS_KEY, TRY_CAST(YEAR AS DOUBLE) AS YEAR, TRY_CAST(MARITAL_STATUS AS DOUBLE) AS MARITAL_STATUS,
  TRY_CAST(BIRTHYEAR AS DOUBLE) AS BIRTHYEAR, TRY_CAST(POSITION AS DOUBLE) AS POSITION FROM raw_panel""")
def _coerce_numeric(spark, sf):
    out = C.coerce_numeric(V.raw_panel(spark, sf))
    return out.select("OBS_KEY", "YEAR", "MARITAL_STATUS", "BIRTHYEAR", "POSITION")


@query("decode_factors", "WITH" + V.PANEL_SQL + """
SELECT OBS_KEY, CAST(REGION AS VARCHAR) AS REGION, CAST(GENERATION AS VARCHAR) AS GENERATION, SEX FROM panel""")
def _decode_factors(spark, sf):
    out = C.decode_factors(V.panel(spark, sf), ["REGION", "GENERATION"])
    return out.select("OBS_KEY", "REGION", "GENERATION", "SEX")


@query("clean_panel", "WITH" + V.RAW_SQL + """
SELECT OBS_KEY, regexp_replace(trim(PERSON_ID), '\\.0+$', '') AS PERSON_ID, nullif(FATHER_ID, 'nan') AS FATHER_ID,
  nullif(WIFE_1_ID, '-99') AS WIFE_1_ID, regexp_replace(trim(HOUSEHOLD_ID), '\\.0+$', '') AS HOUSEHOLD_ID,
  CAST(YEAR AS DOUBLE) AS YEAR, TRY_CAST(MARITAL_STATUS AS DOUBLE) AS MARITAL_STATUS,
  CAST(nullif(BIRTHYEAR, '-99') AS DOUBLE) AS BIRTHYEAR, CAST(nullif(POSITION, 'NA') AS DOUBLE) AS POSITION,
  CAST(nullif(GENERATION, -9) AS DOUBLE) AS GENERATION
FROM raw_panel""")
def _clean_panel(spark, sf):
    return C.clean_panel(V.raw_panel(spark, sf))


PAIR_RULES = ("id", "husband_id", "wife_id", "label", "score", "same_lineage", "era", "patri_path_count")
MADE = ("lineage_husband", "lineage_wife", "z")


@query("validate_pairs", "WITH" + V.PAIR_TABLE_SQL + f""",
n AS (SELECT year, count(*) AS n, count(DISTINCT id) AS d, max(id) AS m FROM pair_table GROUP BY year),
o AS (SELECT CAST(sum(abs(m + 1 - d)) AS BIGINT) AS gaps, CAST(sum(n - d) AS BIGINT) AS twice FROM n),
r AS ({" UNION ALL ".join(f"SELECT 'missing_column:{c}' AS rule, 0 AS n_bad" for c in C.PAIR_COLUMNS)}
  UNION ALL {" UNION ALL ".join(f"SELECT 'null:{c}', count(*) FILTER (WHERE {c} IS NULL) FROM pair_table" for c in PAIR_RULES)}
  UNION ALL {" UNION ALL ".join(f"SELECT 'null:{c}', 0" for c in MADE)} UNION ALL SELECT 'empty_vector:z', 0
  UNION ALL SELECT 'not_finite:score', count(*) FILTER (WHERE abs(score) > 1e300) FROM pair_table
  UNION ALL SELECT 'not_finite:score_gap', count(*) FILTER (WHERE abs(score_gap) > 1e300) FROM pair_table
  UNION ALL SELECT 'id_range', gaps FROM o UNION ALL SELECT 'id_duplicates', twice FROM o
  UNION ALL SELECT 'only_on_positives:' || c, 0 FROM (SELECT unnest(['rank_of_true_wife', 'hungarian_correct']) AS c))
SELECT rule, CAST(n_bad AS BIGINT) AS n_bad, n_bad = 0 AS ok FROM r""")
def _validate_pairs(spark, sf):
    """The stored table keeps every rule of the contract."""
    return C.validate_pairs(V.pair_table(spark, sf))


@query("check_year_gaps", """
SELECT CAST(y AS INTEGER) AS year FROM range(1990, 2006) t(y)
WHERE y NOT IN (SELECT year(o_orderdate) FROM orders)""")
def _check_year_gaps(spark, sf):
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y"))
    return C.check_year_gaps(years, "y", 1990, 2005)


@query("coverage_report", "WITH" + V.PANEL_SQL + """,
c AS (SELECT count(*) AS n, count(MARITAL_STATUS) AS a, count(WIFE_1_ID) AS b, count(BIRTHYEAR) AS c, count(REGION) AS d FROM panel)
SELECT unnest(['MARITAL_STATUS','WIFE_1_ID','BIRTHYEAR','REGION']) AS column_name, unnest([a, b, c, d]) AS n_present,
  unnest([n, n, n, n]) AS n_rows,
  unnest([round(a / n, 4), round(b / n, 4), round(c / n, 4), round(d / n, 4)]) AS coverage FROM c""")
def _coverage_report(spark, sf):
    return rounded(C.coverage_report(V.panel(spark, sf), ["MARITAL_STATUS", "WIFE_1_ID", "BIRTHYEAR", "REGION"]))


# -- identity -------------------------------------------------------------------------


@query("distinct_ids", "WITH" + V.PANEL_SQL + """
SELECT 'household' AS kind, HOUSEHOLD_ID AS id FROM panel WHERE HOUSEHOLD_ID IS NOT NULL GROUP BY 2
UNION ALL SELECT 'banner', CAST(REGION AS VARCHAR) FROM panel WHERE REGION IS NOT NULL GROUP BY 2""")
def _distinct_ids(spark, sf):
    panel = V.panel(spark, sf)
    house = C.distinct_ids(panel, "HOUSEHOLD_ID").select(F.lit("household").alias("kind"), "id")
    return house.unionByName(C.distinct_ids(panel, "REGION", True).select(F.lit("banner").alias("kind"), "id"))


@query("dense_index", "WITH" + V.PERSONS_SQL + """
SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx FROM persons""")
def _dense_index(spark, sf):
    return C.dense_index(V.persons(spark, sf))


@query("known_ids_only", "WITH" + V.PERSONS_SQL + """
SELECT OBS_KEY, FATHER_ID FROM panel WHERE FATHER_ID IN (SELECT id FROM persons)""")
def _known_ids_only(spark, sf):
    return C.known_ids_only(V.panel(spark, sf), "FATHER_ID", V.persons(spark, sf)).select("OBS_KEY", "FATHER_ID")


@query("node_counts", "WITH" + V.PANEL_SQL + """
SELECT 'person' AS node_type, count(DISTINCT PERSON_ID) AS n FROM panel
UNION ALL SELECT 'household', count(DISTINCT HOUSEHOLD_ID) FROM panel
UNION ALL SELECT 'community', count(DISTINCT UNIQUE_VILLAGE_ID) FROM panel
UNION ALL SELECT 'banner', count(DISTINCT REGION) FROM panel""")
def _node_counts(spark, sf):
    return C.node_counts(C.node_table(V.panel(spark, sf), C.NODE_COLUMNS))


@query("edge_counts", "WITH" + V.EDGES_SQL + """
SELECT rel, count(*) AS n_edges FROM edges GROUP BY rel""")
def _edge_counts(spark, sf):
    return E.edge_counts(V.edges(spark, sf))


@query("attach_person_attrs", "WITH" + V.PERSONS_SQL + """,
lv AS (SELECT PERSON_ID, UNIQUE_VILLAGE_ID AS v, row_number() OVER (PARTITION BY PERSON_ID ORDER BY OBS_DATE DESC, OBS_KEY DESC) AS rn
  FROM panel WHERE UNIQUE_VILLAGE_ID IS NOT NULL AND YEAR <= 1996),
lr AS (SELECT PERSON_ID, REGION AS r, row_number() OVER (PARTITION BY PERSON_ID ORDER BY OBS_DATE DESC, OBS_KEY DESC) AS rn
  FROM panel WHERE REGION IS NOT NULL AND YEAR <= 1996)
SELECT p.id AS PERSON_ID, coalesce(lv.v, -1) AS community_id, coalesce(lr.r, -1) AS banner_id
FROM persons p LEFT JOIN lv ON lv.PERSON_ID = p.id AND lv.rn = 1 LEFT JOIN lr ON lr.PERSON_ID = p.id AND lr.rn = 1""")
def _attach_person_attrs(spark, sf):
    panel = V.panel(spark, sf)
    latest = X.latest_as_of(panel, "PERSON_ID", P.row_order, ["UNIQUE_VILLAGE_ID", "REGION"], F.col("YEAR") <= 1996)
    people = V.persons(spark, sf).withColumnRenamed("id", "PERSON_ID")
    return C.attach_person_attrs(people, latest, {"UNIQUE_VILLAGE_ID": "community_id", "REGION": "banner_id"})


@query("enrich_by_record", """
SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, o_orderstatus FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def _enrich_by_record(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("RECORD_NUMBER"), "l_linenumber", "l_partkey"
    )
    second = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("RECORD_NUMBER"), "o_custkey", "o_orderstatus"
    )
    return C.enrich_by_record(lines, second).withColumnRenamed("RECORD_NUMBER", "l_orderkey")


# -- edges ----------------------------------------------------------------------------

EVENT_COLUMNS = "person, sex, partner, year, method"


@query("status_transitions", "WITH" + V.EVENTS_SQL + f"SELECT {EVENT_COLUMNS} FROM transitions")
def _status_transitions(spark, sf):
    return E.status_transitions(V.panel(spark, sf), P)


@query("first_observation_in_state", "WITH" + V.EVENTS_SQL + f"SELECT {EVENT_COLUMNS} FROM first_married")
def _first_observation(spark, sf):
    return E.first_observation_in_state(V.panel(spark, sf), P)


@query("first_direct_link", "WITH" + V.EVENTS_SQL + f"SELECT {EVENT_COLUMNS} FROM direct_links")
def _first_direct_link(spark, sf):
    return E.first_direct_link(V.panel(spark, sf), P)


@query("pick_partner", "WITH" + V.PANEL_SQL + """
SELECT OBS_KEY, CASE WHEN SEX = 2 THEN WIFE_1_ID ELSE HUSBAND_ID END AS partner FROM panel""")
def _pick_partner(spark, sf):
    partner = S.pick_partner(F.col("SEX"), F.col("WIFE_1_ID"), F.col("HUSBAND_ID"))
    return V.panel(spark, sf).select("OBS_KEY", partner.alias("partner"))


@query("canonical_pairs", "WITH" + V.HW_SQL + """
SELECT src, dst, 'r_hw' AS rel, year AS t FROM (
  SELECT CASE WHEN sex = 2 THEN person ELSE partner END AS src, CASE WHEN sex = 2 THEN partner ELSE person END AS dst, year,
    row_number() OVER (PARTITION BY least(person, partner), greatest(person, partner) ORDER BY year, method, person) AS rn
  FROM all_events WHERE partner IS NOT NULL) WHERE rn = 1""")
def _canonical_pairs(spark, sf):
    events = E.marriage_events(V.panel(spark, sf), P)
    return E.canonical_pairs(events.where(F.col("partner").isNotNull()))


@query("marriage_edges", "WITH" + V.HW_SQL + "SELECT src, dst, rel, t FROM hw")
def _marriage_edges(spark, sf):
    return E.marriage_edges(V.panel(spark, sf), P, V.persons(spark, sf))


@query("reference_rows", "WITH" + V.REFS_SQL + "SELECT person, sex, birth, father, mother, ref_year FROM refs")
def _reference_rows(spark, sf):
    return E.reference_rows(V.panel(spark, sf), P)


@query("first_birth_year", "WITH" + V.PANEL_SQL + """
SELECT PERSON_ID AS person, min(BIRTHYEAR) AS birth FROM panel WHERE BIRTHYEAR IS NOT NULL GROUP BY 1""")
def _first_birth_year(spark, sf):
    return E.first_birth_year(V.panel(spark, sf), P)


@query("parent_child_edges", "WITH" + V.EDGES_SQL + """
SELECT src, dst, rel, t FROM edges WHERE rel IN ('r_fs', 'r_fd', 'r_ms', 'r_md')""")
def _parent_child_edges(spark, sf):
    refs = E.reference_rows(V.panel(spark, sf), P)
    people = V.persons(spark, sf)
    fathers = E.parent_child_edges(refs, "father", people, "r_fs", "r_fd")
    return fathers.unionByName(E.parent_child_edges(refs, "mother", people, "r_ms", "r_md"))


@query("unknown_sex_drops", "WITH" + V.REFS_SQL + """
SELECT 'father' AS parent, count(*) FILTER (WHERE CAST(person AS BIGINT) % 9 = 0) AS n_dropped FROM refs WHERE father IN (SELECT id FROM persons)
UNION ALL SELECT 'mother', count(*) FILTER (WHERE CAST(person AS BIGINT) % 9 = 0) FROM refs WHERE mother IN (SELECT id FROM persons)""")
def _unknown_sex_drops(spark, sf):
    refs = E.reference_rows(V.panel(spark, sf), P)
    refs = refs.withColumn("sex", F.when(F.col("person").cast("bigint") % 9 != 0, F.col("sex")))
    return E.unknown_sex_drops(refs, V.persons(spark, sf))


@query("sibling_edges", "WITH" + V.EDGES_SQL + """
SELECT src AS person, count(*) AS n_siblings, CAST(max(t) AS INTEGER) AS last_edge_t, CAST(sum(t) AS BIGINT) AS sum_edge_t
FROM sib GROUP BY src""")
def _sibling_edges(spark, sf):
    refs = E.reference_rows(V.panel(spark, sf), P)
    return E.sibling_summary(E.sibling_links(refs, V.persons(spark, sf)))


@query("siblings_of", "WITH" + V.EDGES_SQL + "SELECT src, dst, rel, t FROM sib WHERE src IN ('10', '47', '99', '120')")
def _siblings_of(spark, sf):
    refs = E.reference_rows(V.panel(spark, sf), P)
    return E.siblings_of(E.sibling_links(refs, V.persons(spark, sf)), ["10", "47", "99", "120"])


@query("membership_edges_timed", "WITH" + V.EDGES_SQL + "SELECT src, dst, rel, t FROM edges WHERE rel = 'r_hh'")
def _membership_timed(spark, sf):
    return E.membership_edges_timed(V.panel(spark, sf), P)


@query("membership_edges_static_first", "WITH" + V.EDGES_SQL + "SELECT src, dst, rel, t FROM hc")
def _membership_static_first(spark, sf):
    return E.membership_edges_static_first(V.panel(spark, sf), P)


@query("membership_edges_first_row", "WITH" + V.EDGES_SQL + "SELECT src, dst, rel, t FROM cb")
def _membership_first_row(spark, sf):
    return E.membership_edges_first_row(V.panel(spark, sf), P)


@query("build_edges", "WITH" + V.EDGES_SQL + """
SELECT src, dst, rel, t FROM edges WHERE rel <> 'r_sib'
UNION ALL SELECT person, father, 'r_sib', born FROM kids""")
def _build_edges(spark, sf):
    return V.edges(spark, sf)
