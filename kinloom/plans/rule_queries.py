"""Queries: exploration of the pair table and two-sided rule scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions import scalars as S
from kinloom.operators import explore as Q
from kinloom.operators import rules as A
from kinloom.plans import layout_queries as L
from kinloom.plans import views as V
from kinloom.plans.registry import query, rounded, table

PAIRS = "WITH" + V.PAIR_TABLE_SQL
PROFILE_SQL = """
people AS (
  SELECT PERSON_ID AS id, CASE SEX WHEN 2 THEN 'M' WHEN 1 THEN 'F' ELSE '?' END AS sex, BIRTHYEAR AS birth_year, REGION AS banner_id,
    UNIQUE_VILLAGE_ID AS community_id, HOUSEHOLD_ID AS household_id
  FROM (SELECT *, row_number() OVER (PARTITION BY PERSON_ID ORDER BY OBS_DATE, OBS_KEY) AS rn FROM panel) WHERE rn = 1)"""


# -- exploration ----------------------------------------------------------------------


@query("get_pair", PAIRS + "SELECT year, id, husband_id, wife_id, score FROM pair_table WHERE year = 1999 AND id = 42")
def _get_pair(spark, sf):
    return Q.get_pair(V.pair_table(spark, sf), 1999, 42).select("year", "id", "husband_id", "wife_id", "score")


@query("filter_pairs")
def _filter_pairs(spark, sf):
    return Q.filter_pairs(V.pair_table(spark, sf), era="late", correct=False).select("year", "id", "era", "hungarian_correct")


@query("filter_pairs_check", PAIRS + "SELECT year, id, era FROM pair_table WHERE era = 'late'")
def _filter_pairs_check(spark, sf):
    """The pairs of an era are those found correct and those not, each once."""
    pairs = V.pair_table(spark, sf)
    return Q.filter_pairs(pairs, era="late", correct=False).unionByName(Q.filter_pairs(pairs, era="late", correct=True)).select("year", "id", "era")


@query("cells_with_match", L.UNIT + """
SELECT CAST(q AS INTEGER) AS q, CAST(r AS INTEGER) AS r, bool_or(label = 1 AND cluster < 5) AS has_match FROM placed GROUP BY q, r""")
def _cells_with_match(spark, sf):
    placed = L.placed(spark, sf).withColumn("era", F.when(F.col("cluster") < 5, "low").otherwise("high"))
    placed = placed.withColumn("hungarian_correct", F.col("label") == 1)
    return Q.cells_with_match(placed, era="low", correct=True)


@query("cell_pairs", L.UNIT + "SELECT id, CAST(q AS INTEGER) AS q, CAST(r AS INTEGER) AS r FROM placed WHERE (q = 8 AND r = 7) OR (q = 9 AND r = 8)")
def _cell_pairs(spark, sf):
    return Q.cell_pairs(L.placed(spark, sf), [(8, 7), (9, 8)]).select("id", "q", "r")


@query("sort_nulls_last", PAIRS + """
SELECT year, id, rank_of_true_wife FROM pair_table ORDER BY rank_of_true_wife DESC NULLS LAST, year, id""")
def _sort_nulls_last(spark, sf):
    return Q.sort_nulls_last(V.pair_table(spark, sf), "rank_of_true_wife", "desc", ["year", "id"]).select("year", "id", "rank_of_true_wife")


@query("leading_channel", L.UNIT + """,
v AS (SELECT cell_id, abs(conf_mean) AS a, abs(mean_score_gap) AS b, abs(patri_path_mean) AS c, abs(same_lin_frac) AS d, abs(pos_ratio) AS e FROM cell_stats WHERE NOT empty)
SELECT CAST(cell_id AS INTEGER) AS cell_id, CASE greatest(a, b, c, d, e) WHEN a THEN 'confidence' WHEN b THEN 'score gap' WHEN c THEN 'patri paths'
  WHEN d THEN 'same lineage' ELSE 'positives' END AS leading_channel FROM v""")
def _leading_channel(spark, sf):
    cells = L.cell_stats(spark, sf).where(~F.col("empty"))
    return Q.leading_channel(cells).select("cell_id", "leading_channel")


@query("box_select", L.UNIT + "SELECT id FROM unit WHERE x BETWEEN 0.25 AND 0.6 AND y BETWEEN 0.3 AND 0.8")
def _box_select(spark, sf):
    return Q.box_select(L.unit_points(spark, sf), 0.25, 0.3, 0.6, 0.8).select("id")


@query("hide_accepted", PAIRS + """
SELECT year, id FROM pair_table p WHERE NOT EXISTS (SELECT 1 FROM mutual m WHERE m.h = p.h AND m.w = p.w)""")
def _hide_accepted(spark, sf):
    from kinloom.operators.ranking import mutual_best

    accepted = mutual_best(V.scores(spark, sf)).select("h", "w").distinct()
    return Q.hide_accepted(V.pair_table(spark, sf), accepted).select("year", "id")


@query("bipartite_summary", PAIRS + """
SELECT year, count(DISTINCT h) AS n_left, count(DISTINCT w) AS n_right, count(*) AS n_edges,
  round(avg(0.6 + 1.6 * greatest(0.0, least(1.0, score / 100000.0))), 4) AS mean_width FROM pair_table GROUP BY year""")
def _bipartite_summary(spark, sf):
    return rounded(Q.bipartite_summary(V.pair_table(spark, sf), scale=100000.0))


@query("era_of_year", PAIRS + """
SELECT year, CASE WHEN year = 1998 THEN 'catchup' WHEN year >= 2000 THEN 'late' ELSE 'regular' END AS era, count(*) AS n FROM pair_table GROUP BY ALL""")
def _era_of_year(spark, sf):
    pairs = V.pair_table(spark, sf).select("year", S.era_of_year(F.col("year"), (1998,), (2000, 2001)).alias("era"))
    return pairs.groupBy("year", "era").agg(F.count("*").alias("n"))


@query("score_band", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'na' WHEN value / 10 >= 7 THEN 'hi' WHEN value / 10 >= 5 THEN 'mid' ELSE 'lo' END AS band FROM events""")
def _score_band(spark, sf):
    score = F.when(F.col("event_type") != "view", F.col("value") / 10)
    return table(spark, sf, "events").select("event_id", S.score_band(score).alias("band"))


@query("profiles", "WITH" + V.PANEL_SQL + "," + PROFILE_SQL + "SELECT * FROM people")
def _profiles(spark, sf):
    return Q.profiles(V.panel(spark, sf), V.PANEL)


@query("get_profiles", "WITH" + V.PANEL_SQL + "," + PROFILE_SQL + """,
asked AS (SELECT DISTINCT 'P' || l_suppkey * 40 AS id FROM lineitem)
SELECT a.id, coalesce(p.sex, '?') AS sex, birth_year, banner_id, community_id, household_id FROM asked a LEFT JOIN people p ON 'P' || p.id = a.id""")
def _get_profiles(spark, sf):
    asked = table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), (F.col("l_suppkey") * 40).cast("string")).alias("id")
    ).distinct()
    return Q.get_profiles(asked, Q.profiles(V.panel(spark, sf), V.PANEL))


ATTRIBUTION_SQL = PAIRS + """,
parts AS (
  SELECT year, id, ln(score) AS score, score_gap, [-1.0::DOUBLE, 1.2 * (0.6 * patri_path_count), CASE WHEN patri_path_count >= 2 THEN 0.35 ELSE 0.0 END,
    CASE WHEN patri_path_count >= 3 THEN 0.45 ELSE 0.0 END, 0.5 * 0.3, 0.8 * CASE era WHEN 'regular' THEN 0.4 WHEN 'late' THEN 0.2 ELSE 0.0 END,
    CASE WHEN same_lineage THEN -2.0 ELSE 0.0 END] AS v FROM pair_table),
scaled AS (SELECT *, list_sum(v) AS total FROM parts)"""


@query("pair_attribution", ATTRIBUTION_SQL + """
SELECT year, id, CAST(i AS INTEGER) AS position, ['bias','paternal lineage','sibling overlap','household share','banner match','macro era','endogamy penalty'][i + 1] AS label,
  round(v[i + 1], 4) AS value, round(v[i + 1] * CASE WHEN abs(total) > 1e-9 THEN score / total ELSE 1 END, 4) AS scaled, false AS is_total
FROM scaled, range(0, 7) r(i)
UNION ALL SELECT year, id, 7, 'FINAL (logit)', round(score, 4), round(score, 4), true FROM scaled
UNION ALL SELECT year, id, 8, 'score gap', round(score_gap, 4), round(score_gap, 4), true FROM scaled""")
def _pair_attribution(spark, sf):
    pairs = V.pair_table(spark, sf).withColumn("score", F.log("score"))
    out = Q.pair_attribution(pairs, {"paternal_lineage": 1.2})
    return out.select(
        "year", "id", "position", "label", F.round("value", 4).alias("value"), F.round("scaled", 4).alias("scaled"), "is_total"
    )


@query("merge_weights", """
WITH d AS (SELECT unnest(['paternal_lineage','sibling_overlap','household_share','banner_match','macro_era']) AS name, unnest([1.0, 1.0, 1.0, 0.5, 0.8]) AS value),
o AS (SELECT CASE r_regionkey WHEN 0 THEN 'banner_match' WHEN 1 THEN 'macro_era' ELSE r_name END AS name, CASE WHEN r_regionkey <> 1 THEN r_regionkey + 0.25 END AS value FROM region)
SELECT d.name, CAST(coalesce(o.value, d.value) AS DOUBLE) AS value FROM d LEFT JOIN o ON o.name = d.name""")
def _merge_weights(spark, sf):
    region = table(spark, sf, "region")
    key = F.col("r_regionkey")
    name = F.when(key == 0, "banner_match").when(key == 1, "macro_era").otherwise(F.col("r_name"))
    overrides = region.select(name.alias("name"), F.when(key != 1, key + 0.25).alias("value"))
    return Q.merge_weights(Q.default_weights(region), overrides)


# -- rules ----------------------------------------------------------------------------

CANDIDATE_SQL = V.TRUTH_SQL + "," + V.PANEL_SQL + "," + PROFILE_SQL + """,
cand AS (
  SELECT r.year, CAST(r.h AS VARCHAR) AS h, CAST(r.w AS VARCHAR) AS w, (r.score - 50000.0) / 20000.0 AS score, CAST(r.rank AS INTEGER) AS rank
  FROM ranked r WHERE r.rank <= 8),
prof AS (
  SELECT c.*, t.banner_id AS tb, k.banner_id AS cb, t.community_id AS tc, k.community_id AS cc, t.birth_year AS ty, k.birth_year AS cy,
    t.sex AS ts, t.household_id AS th, k.sex AS cs, k.household_id AS ch, abs(t.birth_year - k.birth_year) AS gap
  FROM cand c LEFT JOIN people t ON t.id = c.h LEFT JOIN people k ON k.id = c.w),
base AS (
  SELECT *, CASE WHEN tb = cb THEN 2.0 WHEN tb IS NOT NULL AND cb IS NOT NULL THEN -1.0 ELSE 0.0 END
    + CASE WHEN tc = cc THEN 1.0 ELSE 0.0 END + CASE WHEN gap <= 5 THEN 1.5 WHEN gap <= 10 THEN 0.5 WHEN gap IS NOT NULL THEN -1.0 ELSE 0.0 END AS s FROM prof),
scored AS (
  SELECT *, CAST(least(10, greatest(1, round_even(5.0 + s + 0.4 * score, 0))) AS INTEGER) AS target_score,
    CASE WHEN least(10, greatest(1, round_even(5.0 + s + 0.4 * score, 0))) >= 5 THEN CAST(least(10, greatest(1, round_even(5.0 + s, 0))) AS INTEGER) END AS candidate_score FROM base),
final AS (
  SELECT *, round(CASE WHEN candidate_score IS NOT NULL THEN (target_score + candidate_score) / 2.0 ELSE target_score * 0.85 END * (1 / (1 + exp(-score))), 4) AS final_score FROM scored)"""
RULES = "WITH" + CANDIDATE_SQL


def candidates(spark, sf):
    people = Q.profiles(V.panel(spark, sf), V.PANEL)
    return A.candidates_with_profiles(V.logits(V.scores(spark, sf)).select("year", "h", "w", "score"), people)


def scored(spark, sf):
    return A.score_candidates(candidates(spark, sf))


@query("candidate_funnel", "WITH" + V.TRUTH_SQL + "SELECT year, h, count(*) AS in_cohort, least(count(*), 8) AS kept FROM scores GROUP BY year, h")
def _candidate_funnel(spark, sf):
    return A.candidate_funnel(V.scores(spark, sf)).withColumn("kept", F.col("kept").cast("bigint"))


@query("rule_score", RULES + "SELECT year, h, w, target_score FROM scored")
def _rule_score(spark, sf):
    return scored(spark, sf).select("year", "h", "w", "target_score")


REASON_SQL = """concat_ws('; ', CASE WHEN tb = cb THEN 'same banner (' || tb || ')' WHEN tb IS NOT NULL AND cb IS NOT NULL THEN 'different banner' END,
  CASE WHEN tc = cc THEN 'same community' END,
  CASE WHEN gap <= 5 THEN 'close age (Δ=' || gap || 'y)' WHEN gap <= 10 THEN 'reasonable age (Δ=' || gap || 'y)' WHEN gap IS NOT NULL THEN 'large age gap (Δ=' || gap || 'y)' END)"""


@query("rule_reason", RULES + f"""
SELECT year, h, w, {REASON_SQL} AS base_reason, CASE WHEN {REASON_SQL} = '' THEN 'default heuristic' ELSE {REASON_SQL} END AS reason FROM scored""")
def _rule_reason(spark, sf):
    rows = candidates(spark, sf)
    reason = A.rule_reason("t", "c")
    base = F.when(reason == "default heuristic", "").otherwise(reason)
    return rows.select("year", "h", "w", base.alias("base_reason"), reason.alias("reason"))


@query("reverse_score", RULES + "SELECT year, h, w, candidate_score FROM scored")
def _reverse_score(spark, sf):
    return scored(spark, sf).select("year", "h", "w", "candidate_score")


@query("final_ranking", RULES + """
SELECT year, h, w, final_score, CAST(row_number() OVER (PARTITION BY year, h ORDER BY final_score DESC, score DESC, w) AS INTEGER) AS final_rank FROM final""")
def _final_ranking(spark, sf):
    return A.final_ranking(scored(spark, sf)).select("year", "h", "w", "final_score", "final_rank")


@query("choose", RULES + """
SELECT year, h, w, final_score FROM (SELECT *, row_number() OVER (PARTITION BY year, h ORDER BY final_score DESC, score DESC, w) AS rn FROM final)
WHERE rn = 1 AND final_score >= 6.5 * (1 / (1 + exp(-2.0)))""")
def _choose(spark, sf):
    return A.choose(A.final_ranking(scored(spark, sf))).select("year", "h", "w", "final_score")


ANSWER_SQL = RULES + """,
entry AS (
  SELECT year, h, w, rank, CASE WHEN CAST(h AS BIGINT) % 10 = 0 THEN 'bad' WHEN CAST(w AS BIGINT) % 13 = 0 THEN 'absent' ELSE 'given' END AS kind,
    CASE WHEN CAST(w AS BIGINT) % 7 = 0 THEN 5 WHEN CAST(w AS BIGINT) % 11 = 0 THEN 10 WHEN CAST(w AS BIGINT) % 5 = 0 THEN 1 ELSE CAST(CAST(w AS BIGINT) % 9 + 1 AS INTEGER) END AS score FROM cand)"""


@query("parse_evaluations", ANSWER_SQL + """
SELECT year, h, w, CASE kind WHEN 'given' THEN score ELSE 5 END AS score,
  CASE kind WHEN 'given' THEN 'reason ' || w WHEN 'absent' THEN 'no LLM output' ELSE 'fallback' END AS reason FROM entry""")
def _parse_evaluations(spark, sf):
    rows = candidates(spark, sf).select("year", "h", "w", "rank")
    n = F.col("w").cast("bigint")
    text = F.when(n % 7 == 0, "x").when(n % 11 == 0, "99").when(n % 5 == 0, "-3").otherwise((n % 9 + 1).cast("string"))
    entry = F.struct(F.col("w").alias("candidate_id"), text.alias("score"), F.concat(F.lit("reason "), "w").alias("reason"))
    listed = rows.where(n % 13 != 0).groupBy("year", "h").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"]).alias("evaluations")
    )
    answers = rows.select("year", "h").distinct().join(listed, ["year", "h"], "left")
    # Two list names and broken texts, as a service may answer.
    named = F.when(F.col("h").cast("bigint") % 3 == 0, F.to_json(F.struct(F.col("evaluations").alias("scores")))).otherwise(
        F.to_json(F.struct("evaluations"))
    )
    answer = F.when(F.col("h").cast("bigint") % 10 == 0, "not json {").otherwise(named)
    return A.parse_evaluations(answers.select("year", "h", answer.alias("answer")), rows)


PROMPT_SQL = """
SELECT year, p.h, count(*) AS n_candidates,
  'You are person ' || p.h || '.' || chr(10) || '- sex: ' || coalesce(max(ts), '?') || chr(10) || '- born: ' || coalesce(CAST(max(ty) AS VARCHAR), '?') || chr(10)
  || '- banner: ' || coalesce(CAST(max(tb) AS VARCHAR), '?') || chr(10) || '- community: ' || coalesce(CAST(max(tc) AS VARCHAR), '?') || chr(10)
  || '- household: ' || coalesce(max(th), '?') || chr(10) || 'Rules.' || chr(10) || {told} || 'Candidates:' || chr(10)
  || string_agg('- candidate ' || w || ': sex=' || coalesce(cs, '?') || ', born=' || coalesce(CAST(cy AS VARCHAR), '?') || ', banner=' || coalesce(CAST(cb AS VARCHAR), '?')
     || ', community=' || coalesce(CAST(cc AS VARCHAR), '?') || ', household=' || coalesce(ch, '?') || ', pre_score=' || printf('%.2f', round(score, 1) + 0.0), chr(10) ORDER BY rank) AS prompt
FROM prof p {join} GROUP BY year, p.h"""


@query("render_prompts", RULES + PROMPT_SQL.replace("{told}", "''").replace("{join}", ""))
def _render_prompts(spark, sf):
    rows = candidates(spark, sf).withColumn("score", F.round("score", 1))
    return A.render_prompts(rows, "Rules.")


@query("render_prompts_hints", RULES + """,
told AS (SELECT CAST(conv_id AS VARCHAR) AS h, 'Hints:' || chr(10) || string_agg('  - [' || role || '] ' || text, chr(10) ORDER BY turn) || chr(10) AS t
  FROM conversations GROUP BY conv_id)""" + PROMPT_SQL.replace("{told}", "coalesce(max(t), '')").replace("{join}", "LEFT JOIN told ON told.h = p.h"))
def _render_prompts_hints(spark, sf):
    """Turns of a conversation as the hints of the entity with its number."""
    rows = candidates(spark, sf).withColumn("score", F.round("score", 1))
    hints = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("h"), "turn", "role", "text")
    return A.render_prompts(rows, "Rules.", hints=hints, order="turn")


VERB_SQL = """
talk AS (SELECT conv_id, turn, ['boost', 'Penalize', 'eliminate', 'accept'][conv_id % 4 + 1] || ' @c-P' || conv_id || ' and @c-' || turn || ' @c-P' || conv_id || ' ' || text AS text FROM conversations)"""


def talk(spark, sf):
    c = table(spark, sf, "conversations")
    verb = F.element_at(F.array(*[F.lit(v) for v in ("boost", "Penalize", "eliminate", "accept")]), (F.col("conv_id") % 4 + 1).cast("int"))
    text = F.concat(
        verb, F.lit(" @c-P"), F.col("conv_id").cast("string"), F.lit(" and @c-"), F.col("turn").cast("string"),
        F.lit(" @c-P"), F.col("conv_id").cast("string"), F.lit(" "), F.col("text"),
    )
    return c.select("conv_id", "turn", text.alias("text"))


@query("parse_directives", "WITH" + VERB_SQL + """
SELECT conv_id, turn, ['boost', 'penalise', 'eliminate', 'accept'][conv_id % 4 + 1] AS verb, 'P' || conv_id || ',' || turn AS ids FROM talk""")
def _parse_directives(spark, sf):
    parsed = A.parse_directives(talk(spark, sf))
    return parsed.select("conv_id", "turn", "verb", F.array_join("ids", ",").alias("ids"))


@query("apply_directives", """
WITH d AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'penalise' WHEN role = 'system' THEN 'eliminate' ELSE 'boost' END AS verb FROM conversations),
c AS (SELECT DISTINCT conv_id, k AS candidate_id FROM conversations, (SELECT unnest(['a', 'b']) AS k)),
moves AS (SELECT c.conv_id, c.candidate_id, list(CASE d.verb WHEN 'boost' THEN 0.5::DOUBLE WHEN 'penalise' THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END ORDER BY d.turn) AS l, bool_or(d.verb = 'eliminate') AS eliminated
  FROM c JOIN d ON d.conv_id = c.conv_id AND (c.candidate_id = 'a' OR d.turn % 2 = 0) GROUP BY ALL)
SELECT conv_id, candidate_id, round(list_reduce(list_prepend(9.3 + 0.0::DOUBLE, l), lambda x, y: least(10.0::DOUBLE, greatest(0.0::DOUBLE, x + y))), 4) AS target_score, eliminated, false AS accepted FROM moves""")
def _apply_directives(spark, sf):
    c = table(spark, sf, "conversations")
    verb = F.when(F.col("turn") % 3 == 2, "penalise").when(F.col("role") == "system", "eliminate").otherwise("boost")
    mention = F.when(F.col("turn") % 2 == 0, "@c-all").otherwise("@c-a")
    said = c.select("conv_id", F.col("turn").alias("seq"), F.concat(verb, F.lit(" "), mention).alias("text"))
    cards = c.select("conv_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("candidate_id")).distinct()
    cards = cards.withColumn("target_score", F.lit(9.3))
    return rounded(A.apply_directives(cards, A.parse_directives(said), ["conv_id"], per_slice=3))


@query("hints_for", "SELECT conv_id, turn, role FROM conversations WHERE role IN ('all', 'assistant')")
def _hints_for(spark, sf):
    return A.hints_for(table(spark, sf, "conversations"), "assistant").select("conv_id", "turn", "role")
