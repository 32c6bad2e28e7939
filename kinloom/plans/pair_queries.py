"""Queries: candidates, ranking, assignment, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions import arrays as A
from kinloom.functions import scalars as S
from kinloom.operators import assignment as G
from kinloom.operators import candidates as N
from kinloom.operators import metrics as M
from kinloom.operators import ranking as R
from kinloom.operators.cleaning import PAIR_COLUMNS
from kinloom.operators.temporal import bucket_of_year
from kinloom.plans import views as V
from kinloom.plans.panel_queries import scratch
from kinloom.plans.registry import query, rounded, table
from kinloom.sources import files

WITH = "WITH" + V.TRUTH_SQL
PAIRS = "WITH" + V.PAIR_TABLE_SQL


def couples(scores):
    """True couples as training pairs (year, h, w)."""
    return V.truth(scores).select("year", "h", F.col("true_w").alias("w"))


# -- candidates -----------------------------------------------------------------------


@query("cohort_scores", "WITH" + V.SCORES_SQL + "SELECT year, h, w, score, k FROM scores")
def _cohort_scores(spark, sf):
    return V.build_scores(spark, sf)


@query("cohort_pool", WITH + "SELECT year, w FROM pool")
def _cohort_pool(spark, sf):
    return N.cohort_pool(V.scores(spark, sf))


@query("first_k_candidates", WITH + """,
placed AS (SELECT year, w, row_number() OVER (PARTITION BY year ORDER BY w) - 1 AS pos, count(*) OVER (PARTITION BY year) AS n FROM pool)
SELECT t.year, t.h, t.true_w, c.w AS neg_w, CAST(i AS INTEGER) AS i
FROM truth t JOIN placed o ON o.year = t.year AND o.w = t.true_w, range(0, 4) r(i)
JOIN placed c ON c.year = t.year AND c.pos = (o.pos + 1 + i) % c.n WHERE i < c.n - 1""")
def _first_k(spark, sf):
    scores = V.scores(spark, sf)
    return N.first_k_candidates(couples(scores), N.cohort_pool(scores), 4)


@query("sample_negatives")
def _sample_negatives(spark, sf):
    scores = V.scores(spark, sf)
    return N.sample_negatives(couples(scores), N.cohort_pool(scores), 4, seed=7)


@query("sample_negatives_check", WITH + """
SELECT t.year, t.h, t.true_w, least(p.n - 1, 4) AS n_distinct, 0 AS n_own, 4 AS n_drawn
FROM truth t JOIN (SELECT year, count(*) AS n FROM pool GROUP BY year) p ON p.year = t.year WHERE p.n > 1""")
def _sample_negatives_check(spark, sf):
    drawn = _sample_negatives(spark, sf)
    return drawn.groupBy("year", "h", "true_w").agg(
        F.count_distinct("neg_w").alias("n_distinct"),
        F.count_if(F.col("neg_w") == F.col("true_w")).cast("int").alias("n_own"),
        F.count("*").cast("int").alias("n_drawn"),
    )


@query("training_examples")
def _training_examples(spark, sf):
    scores = V.scores(spark, sf)
    positives = couples(scores)
    return N.training_examples(positives, N.sample_negatives(positives, N.cohort_pool(scores), 4, seed=0))


@query("training_examples_check", WITH + """
SELECT year, 1 AS label, count(*) AS n FROM truth GROUP BY year UNION ALL SELECT year, 0, count(*) * 4 FROM truth GROUP BY year""")
def _training_examples_check(spark, sf):
    return _training_examples(spark, sf).groupBy("year", "label").agg(F.count("*").alias("n"))


@query("batch_years", WITH + """
SELECT year, CAST(floor((row_number() OVER (ORDER BY year) - 1) / 4) AS INTEGER) AS batch FROM (SELECT DISTINCT year FROM truth)""")
def _batch_years(spark, sf):
    return N.batch_years(V.scores(spark, sf), 4, seed=None)


VECTOR_SCORES_SQL = V.VECTOR_SQL + """,
crossed AS (
  SELECT l.year, l.h, r.w, list_sum(list_transform(range(1, 65), lambda i: CAST(hv[i] AS DOUBLE) * CAST(wv[i] AS DOUBLE)
    - abs(CAST(hv[i] AS DOUBLE) - CAST(wv[i] AS DOUBLE)))) AS score
  FROM lefts l JOIN rights r ON l.year = r.year)"""


def linear_weights(d: int) -> list[float]:
    """Inner product minus L1 distance."""
    return [0.0] * (2 * d) + [-1.0] * d + [1.0] * d


@query("candidate_pairs", "WITH" + VECTOR_SCORES_SQL + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY year, h ORDER BY score DESC, w) AS rank FROM crossed)
SELECT year, h, CAST(rank AS INTEGER) AS rank, w, round(score, 4) AS score FROM placed WHERE rank <= 5""")
def _candidate_pairs(spark, sf):
    left, right, _ = V.vector_sides(spark, sf)
    top = N.score_cohorts(left, right, None, linear_weights(64), k=5)
    rows = top.select("year", "h", F.posexplode("top").alias("p", "t"))
    return rounded(rows.select("year", "h", (F.col("p") + 1).alias("rank"), "t.w", "t.score"))


@query("top_candidates", "WITH" + VECTOR_SCORES_SQL + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY year, h ORDER BY score DESC, w) AS rank FROM crossed)
SELECT year, h, CAST(rank AS INTEGER) AS rank, w, round(score, 4) AS score FROM placed WHERE rank <= 5""")
def _top_candidates(spark, sf):
    left, right, _ = V.vector_sides(spark, sf)
    top, _ = N.top_candidates(left, right, linear_weights(64), k=5, block=256)
    rows = top.select("year", "h", F.posexplode("top").alias("p", "t"))
    return rounded(rows.select("year", "h", (F.col("p") + 1).alias("rank"), "t.w", "t.score"))


@query("top_candidates_keyed", "WITH" + VECTOR_SCORES_SQL + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY year, h ORDER BY score DESC, w) AS rank FROM crossed WHERE h % 3 = w % 3)
SELECT year, h, CAST(rank AS INTEGER) AS rank, w, round(score, 4) AS score FROM placed WHERE rank <= 3""")
def _top_candidates_keyed(spark, sf):
    """Only members that agree in a blocking key meet."""
    left, right = (side.withColumn("key", F.col("id") % 3) for side in V.vector_sides(spark, sf)[:2])
    top, _ = N.top_candidates(left, right, linear_weights(64), k=3, block=64, keys=["key"])
    rows = top.select("year", "h", F.posexplode("top").alias("p", "t"))
    return rounded(rows.select("year", "h", (F.col("p") + 1).alias("rank"), "t.w", "t.score"))


@query("cohort_true_ranks", "WITH" + VECTOR_SCORES_SQL + """,
t AS (SELECT c.year, c.h, c.true_w, x.score AS true_score FROM couples c JOIN crossed x ON x.year = c.year AND x.h = c.h AND x.w = c.true_w)
SELECT x.year, x.h, t.true_w, 1 + count(*) FILTER (WHERE x.score > t.true_score OR x.score = t.true_score AND x.w < t.true_w) AS rank_of_truth, count(*) AS n_pool
FROM crossed x JOIN t ON t.year = x.year AND t.h = x.h GROUP BY ALL""")
def _cohort_true_ranks(spark, sf):
    left, right, truth = V.vector_sides(spark, sf)
    ranks = N.score_cohorts(left, right, truth, linear_weights(64), k=1, block=256)
    known = ranks.where(F.col("rank_of_truth").isNotNull())
    return known.select("year", "h", "true_w", "rank_of_truth", "n_pool")


@query("pair_features", "WITH" + V.VECTOR_SQL + """
SELECT c.year, c.h, c.true_w AS w, CAST(256 AS INTEGER) AS n, round(CAST(hv[1] AS DOUBLE), 4) AS f0, round(CAST(wv[1] AS DOUBLE), 4) AS f64,
  round(abs(CAST(hv[1] AS DOUBLE) - CAST(wv[1] AS DOUBLE)), 4) AS f128, round(CAST(hv[1] AS DOUBLE) * CAST(wv[1] AS DOUBLE), 4) AS f192
FROM couples c JOIN lefts l ON l.year = c.year AND l.h = c.h JOIN rights r ON r.year = c.year AND r.w = c.true_w""")
def _pair_features(spark, sf):
    left, right, truth = V.vector_sides(spark, sf)
    rows = N.pair_vectors(truth.withColumnRenamed("true_w", "w"), left, right)
    f = F.col("features")
    return rounded(
        rows.select(
            "year", "h", "w", F.size(f).alias("n"), f[0].alias("f0"), f[64].alias("f64"), f[128].alias("f128"), f[192].alias("f192")
        )
    )


@query("linear_score", """
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (i - 32) / 8.0)) + 0.25, 4) AS logit,
  round(1 / (1 + exp(-(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * (i - 32) / 8.0)) + 0.25))), 4) AS p
FROM embeddings""")
def _linear_score(spark, sf):
    e = table(spark, sf, "embeddings")
    logit = A.linear_score(A.as_doubles(F.col("embedding")), [(i - 32) / 8.0 for i in range(1, 65)], 0.25)
    return rounded(e.select("vec_id", logit.alias("logit")).withColumn("p", S.sigmoid(F.col("logit"))))


@query("fit_pair_scorer")
def _fit_pair_scorer(spark, sf):
    left, right, truth = V.vector_sides(spark, sf)
    positives = truth.withColumnRenamed("true_w", "w")
    train = positives.where(F.col("year") < 8)
    pool = right.select("year", F.col("id").alias("w"))
    examples = N.training_examples(train, N.sample_negatives(train, pool, 4, seed=0))
    model = N.fit_pair_scorer(examples, left, right, truth.where(F.col("year") >= 8), reg_params=(0.01, 0.1), max_iter=10)
    ranks = N.score_cohorts(left, right, truth, model["weights"], model["bias"], k=1)
    recall = M.topk_recall(ranks.where(F.col("rank_of_truth").isNotNull()), (1, 5))
    return recall.withColumn("reg_param", F.lit(model["reg_param"]))


@query("limit_left_entities", WITH + """
SELECT h, w FROM (SELECT DISTINCT h, true_w AS w FROM truth) ORDER BY md5('0|' || h || '|' || w), h, w LIMIT 1000""")
def _limit_left(spark, sf):
    return N.limit_left_entities(couples(V.scores(spark, sf)), 6000, 6)


@query("reference_sample")
def _reference_sample(spark, sf):
    pairs = couples(V.scores(spark, sf))
    pairs = pairs.withColumn("bucket", bucket_of_year(F.col("year"), 1998, 2000, 1995, 2001))
    return N.reference_sample(pairs, 1000)


# -- ranking --------------------------------------------------------------------------


@query("rank_candidates", WITH + "SELECT year, h, w, score, rank FROM ranked")
def _rank_candidates(spark, sf):
    return R.rank_candidates(V.scores(spark, sf).drop("k"))


@query("rank_of_truth", WITH + """
SELECT r.year, r.h, r.true_w, k.true_score, r.rank_of_truth, p.n AS n_pool FROM ranks r
JOIN known k ON k.year = r.year AND k.h = r.h JOIN (SELECT year, h, count(*) AS n FROM scores GROUP BY ALL) p ON p.year = r.year AND p.h = r.h""")
def _rank_of_truth(spark, sf):
    scores = V.scores(spark, sf)
    return R.rank_of_truth(scores, V.truth(scores))


POOL_RANK_SQL = WITH + """,
other AS (SELECT year, h, (true_w + 1) % (SELECT max(w) + 1 FROM pool) AS true_w FROM truth),
ot AS (SELECT o.* FROM other o WHERE EXISTS (SELECT 1 FROM pool p WHERE p.year = o.year AND p.w = o.true_w)),
everybody AS (
  SELECT o.year, o.h, o.true_w, p.w, coalesce(s.score, 50000.0) AS score FROM ot o JOIN pool p ON p.year = o.year
  LEFT JOIN scores s ON s.year = o.year AND s.h = o.h AND s.w = p.w)
SELECT e.year, e.h, e.true_w, t.score AS true_score,
  1 + count(*) FILTER (WHERE e.score > t.score OR (e.score = t.score AND e.w < e.true_w)) AS rank_of_truth, count(*) AS n_pool
FROM everybody e JOIN everybody t ON t.year = e.year AND t.h = e.h AND t.w = e.true_w GROUP BY ALL"""


@query("rank_of_truth_whole_cohort", POOL_RANK_SQL)
def _rank_whole_cohort(spark, sf):
    scores = V.scores(spark, sf)
    pool = N.cohort_pool(scores)
    top = pool.agg(F.max("w")).scalar()
    shifted = V.truth(scores).select("year", "h", ((F.col("true_w") + 1) % (top + 1)).alias("true_w"))
    return R.rank_of_truth(scores, shifted, pool, default_score=50000.0, exact_ties=True)


@query("hard_negatives", PAIRS + "SELECT year, h, w, score, neg_rank FROM negatives WHERE neg_rank <= 5")
def _hard_negatives(spark, sf):
    scores = V.scores(spark, sf)
    return R.hard_negatives(scores, V.truth(scores)).select("year", "h", "w", "score", F.col("neg_rank").cast("bigint").alias("neg_rank"))


@query("score_gap", WITH + """
SELECT s.year, s.h, s.w, CASE WHEN s.w = k.true_w THEN 1 ELSE 0 END AS label,
  round(CASE WHEN s.w = k.true_w THEN s.score - coalesce(b.best, 0) ELSE s.score - k.true_score END, 4) AS score_gap
FROM scores s JOIN known k ON k.year = s.year AND k.h = s.h
LEFT JOIN (SELECT s.year, s.h, max(s.score) AS best FROM scores s JOIN truth t ON t.year = s.year AND t.h = s.h AND s.w <> t.true_w GROUP BY ALL) b
  ON b.year = s.year AND b.h = s.h""")
def _score_gap(spark, sf):
    scores = V.scores(spark, sf)
    return rounded(R.score_gap(scores, V.truth(scores)).drop("score"))


@query("top_k_per_left", WITH + "SELECT year, h, w, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 8")
def _top_k(spark, sf):
    return R.top_k_per_left(V.scores(spark, sf).drop("k"), 8)


@query("mutual_best", PAIRS + "SELECT m.year, m.h, m.w, s.score FROM mutual m JOIN scores s ON s.year = m.year AND s.h = m.h AND s.w = m.w")
def _mutual_best(spark, sf):
    return R.mutual_best(V.scores(spark, sf).drop("k"))


@query("assign_greedy")
def _assign_greedy(spark, sf):
    return G.assign_one_to_one(V.scores(spark, sf), "greedy")


@query("assign_one_to_one")
def _assign_auction(spark, sf):
    return G.assign_one_to_one(V.scores(spark, sf), "auction")


@query("assign_check", WITH + """
SELECT year, least(count(DISTINCT h), count(DISTINCT w)) AS n_bidders, true AS h_once, true AS w_once, true AS within_bound
FROM scores GROUP BY year""")
def _assign_check(spark, sf):
    """Nobody is matched twice, and weak duality bounds what any assignment could gain over this one.

    The bound is the sum of the auction's prices and of every bidder's best gain at them.
    """
    solved = G.auction(V.scores(spark, sf))
    once = solved.matches.groupBy("year").agg(
        (F.count("*") == F.count_distinct("h")).alias("h_once"), (F.count("*") == F.count_distinct("w")).alias("w_once")
    )
    gap = F.col("bound") - F.col("total")
    allowed = F.col("n_bidders") * F.col("epsilon") + F.abs("bound") * 1e-12
    return solved.certificate.join(once, "year").select("year", "n_bidders", "h_once", "w_once", (gap <= allowed).alias("within_bound"))


@query("assignment_correct")
def _assignment_correct(spark, sf):
    scores = V.scores(spark, sf)
    return G.assignment_correct(V.assignment(spark, sf), V.truth(scores))


@query("assignment_correct_check", WITH + "SELECT year, count(*) AS n_truth, true AS consistent FROM truth GROUP BY year")
def _assignment_correct_check(spark, sf):
    """As many are correct as pairs are in the assignment and in the truth."""
    judged = _assignment_correct(spark, sf).groupBy("year").agg(F.count("*").alias("n_truth"), F.count_if("correct").alias("n"))
    pairs = V.truth(V.scores(spark, sf)).select("year", "h", F.col("true_w").alias("w"))
    both = V.assignment(spark, sf).join(pairs, ["year", "h", "w"], "left_semi").groupBy("year").agg(F.count("*").alias("m"))
    return judged.join(both, "year", "left").select("year", "n_truth", (F.col("n") == F.coalesce("m", F.lit(0))).alias("consistent"))


@query("list_matches", PAIRS + """
SELECT year, id, husband_id, wife_id, score, CASE WHEN label = 1 THEN 'gt' ELSE 'pred' END AS pair_type
FROM pair_table WHERE label = 1 ORDER BY score DESC, id, year LIMIT 300""")
def _list_matches(spark, sf):
    return R.list_matches(V.pair_table(spark, sf)).select("year", "id", "husband_id", "wife_id", "score", "pair_type")


@query("scored_pair_table")
def _scored_pair_table(spark, sf):
    """All columns of the contract; ``scored_pair_table_check`` holds them against SQL."""
    return V.build_pair_table(spark, sf).select("year", *PAIR_COLUMNS)


@query("scored_pair_table_check", PAIRS + """
SELECT year, id, husband_id, wife_id, label, score, score_gap, rank_of_true_wife, label = 1 AS judged, era, same_lineage, patri_path_count,
  CAST(128 AS INTEGER) AS n_z
FROM pair_table""")
def _scored_pair_table_check(spark, sf):
    """The stored table; the assignment's column as its property: positives are judged, negatives not."""
    return V.pair_table(spark, sf).select(
        "year", "id", "husband_id", "wife_id", "label", "score", "score_gap", "rank_of_true_wife",
        F.col("hungarian_correct").isNotNull().alias("judged"), "era", "same_lineage", "patri_path_count", F.size("z").alias("n_z"),
    )


# -- metrics --------------------------------------------------------------------------


@query("assignment_recall")
def _assignment_recall(spark, sf):
    return rounded(M.assignment_recall(V.assignment(spark, sf), V.truth(V.scores(spark, sf))))


TOPK = ", ".join(f"round(avg(CASE WHEN rank_of_truth <= {k} THEN 1.0 ELSE 0.0 END), 4) AS top{k}_recall" for k in (1, 5, 10))


@query("topk_recall", WITH + f"SELECT year, count(*) AS n_ranked, {TOPK} FROM ranks GROUP BY year")
def _topk_recall(spark, sf):
    scores = V.scores(spark, sf)
    return rounded(M.topk_recall(R.rank_of_truth(scores, V.truth(scores))))


@query("cohort_topk_recall", WITH + f""",
everybody AS (
  SELECT t.year, t.h, t.true_w, p.w, coalesce(s.score, 0) AS score FROM truth t JOIN pool p ON p.year = t.year
  LEFT JOIN scores s ON s.year = t.year AND s.h = t.h AND s.w = p.w),
whole AS (
  SELECT e.year, e.h, 1 + count(*) FILTER (WHERE e.score > k.true_score OR (e.score = k.true_score AND e.w < e.true_w)) AS rank_of_truth
  FROM everybody e JOIN known k ON k.year = e.year AND k.h = e.h GROUP BY e.year, e.h)
SELECT year, count(*) AS n_ranked, {TOPK} FROM whole GROUP BY year""")
def _cohort_topk_recall(spark, sf):
    scores = V.scores(spark, sf)
    ranks = R.rank_of_truth(scores, V.truth(scores), N.cohort_pool(scores), default_score=0.0)
    return rounded(M.topk_recall(ranks))


LABELLED_SQL = WITH + """,
labelled AS (
  SELECT s.year, s.h, s.w, round((s.score - 50000.0) / 20000.0, 2) AS score, CASE WHEN s.w = t.true_w THEN 1 ELSE 0 END AS label
  FROM scores s JOIN truth t ON t.year = s.year AND t.h = s.h),
by_score AS (
  SELECT year, score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM labelled GROUP BY ALL),
cum AS (
  SELECT *, sum(pos) OVER (PARTITION BY year ORDER BY score) AS cpos, sum(neg) OVER (PARTITION BY year ORDER BY score) AS cneg,
    sum(pos) OVER (PARTITION BY year) AS p, sum(neg) OVER (PARTITION BY year) AS n FROM by_score),
pooled AS (
  SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM by_score GROUP BY score),
pcum AS (
  SELECT *, sum(pos) OVER (ORDER BY score) AS cpos, sum(neg) OVER (ORDER BY score) AS cneg, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM pooled)"""
AUC_SQL = "round(sum(pos * (cneg - neg + neg / 2.0)) / (max(p) * max(n)), 4) AS roc_auc"
AP_SQL = "round(sum(pos / p * ((p - cpos + pos) / (p - cpos + pos + n - cneg + neg))), 4)"


def labelled(spark, sf):
    """Every scored pair with its label; logits in steps of 0.01, so that ties occur."""
    scores = V.logits(V.scores(spark, sf)).withColumn("score", F.round("score", 2))
    return scores.join(V.truth(scores), ["year", "h"]).select(
        "year", "h", "w", "score", (F.col("w") == F.col("true_w")).cast("int").alias("label")
    )


@query("roc_auc", LABELLED_SQL + f"SELECT {AUC_SQL} FROM pcum")
def _roc_auc(spark, sf):
    return rounded(M.roc_auc(labelled(spark, sf)))


@query("roc_auc_by_cohort", LABELLED_SQL + f"SELECT year, {AUC_SQL} FROM cum GROUP BY year")
def _roc_auc_by_cohort(spark, sf):
    return rounded(M.roc_auc(labelled(spark, sf), group=["year"]))


@query("average_precision", LABELLED_SQL + f"SELECT {AP_SQL} AS average_precision FROM pcum")
def _average_precision(spark, sf):
    return rounded(M.average_precision(labelled(spark, sf)))


LOSS_SQL = """round(avg(-ln(CASE WHEN label = 1 THEN greatest(least(1 / (1 + exp(-score)), 1 - 1e-7), 1e-7)
  ELSE 1 - greatest(least(1 / (1 + exp(-score)), 1 - 1e-7), 1e-7) END)), 4) AS log_loss"""


@query("log_loss", LABELLED_SQL + f"SELECT {LOSS_SQL} FROM labelled")
def _log_loss(spark, sf):
    return rounded(M.log_loss(labelled(spark, sf)))


@query("pair_metrics", LABELLED_SQL + f"""
SELECT a.year, a.roc_auc, a.pr_auc, a.n_pairs_scored, l.log_loss
FROM (SELECT year, {AUC_SQL}, {AP_SQL} AS pr_auc, CAST(sum(pos + neg) AS BIGINT) AS n_pairs_scored FROM cum GROUP BY year) a
JOIN (SELECT year, {LOSS_SQL} FROM labelled GROUP BY year) l ON l.year = a.year""")
def _pair_metrics(spark, sf):
    return rounded(M.pair_metrics(labelled(spark, sf), group=["year"]))


@query("pair_level_sample")
def _pair_level_sample(spark, sf):
    scores = V.logits(V.scores(spark, sf))
    sample = M.pair_level_sample(scores, V.truth(scores), N.cohort_pool(scores), default_score=-2.5)
    return rounded(M.pair_metrics(sample, group=["year"]))


@query("per_cohort_report")
def _per_cohort_report(spark, sf):
    return rounded(per_cohort(spark, sf))


@query("per_cohort_report_check", WITH + """
SELECT r.year, count(*) AS n_men, max(p.n) AS n_women, round(avg(CASE WHEN rank_of_truth <= 1 THEN 1.0 ELSE 0.0 END), 4) AS top1_recall,
  round(avg(CASE WHEN rank_of_truth <= 5 THEN 1.0 ELSE 0.0 END), 4) AS top5_recall
FROM ranks r JOIN (SELECT year, count(*) AS n FROM pool GROUP BY year) p ON p.year = r.year GROUP BY r.year""")
def _per_cohort_report_check(spark, sf):
    """All but the recall of the assignment."""
    return rounded(per_cohort(spark, sf).drop("hungarian_recall@1"))


def per_cohort(spark, sf):
    scores = V.scores(spark, sf)
    t = V.truth(scores)
    assigned = M.assignment_recall(V.assignment(spark, sf), t)
    return M.per_cohort_report(R.rank_of_truth(scores, t), N.cohort_pool(scores), t, assigned)


@query("summary_report", WITH + """
SELECT year, count(*) AS n_ranked, round(avg(CASE WHEN rank_of_truth <= 1 THEN 1.0 ELSE 0.0 END), 4) AS top1_recall,
  round(avg(CASE WHEN rank_of_truth <= 5 THEN 1.0 ELSE 0.0 END), 4) AS top5_recall, 'test' AS label FROM ranks GROUP BY ROLLUP (year)""")
def _summary_report(spark, sf):
    scores = V.scores(spark, sf)
    return rounded(M.summary_report(R.rank_of_truth(scores, V.truth(scores))))


COHORT_SQL = """count(*) AS n_pairs, count(*) FILTER (WHERE label = 1) AS n_positives,
  round(count(*) FILTER (WHERE label = 1 AND rank_of_true_wife = 1) / count(*) FILTER (WHERE label = 1), 4) AS top1_recall,
  round(count(*) FILTER (WHERE label = 1 AND rank_of_true_wife <= 10) / count(*) FILTER (WHERE label = 1), 4) AS top10_recall,
  round(sum(CASE WHEN label = 1 THEN 1.0 / rank_of_true_wife ELSE 0 END) / count(*) FILTER (WHERE label = 1), 4) AS mrr"""


@query("cohort_metrics")
def _cohort_metrics(spark, sf):
    return rounded(M.cohort_metrics(V.pair_table(spark, sf)))


@query("cohort_metrics_check", PAIRS + f"SELECT year, {COHORT_SQL} FROM pair_table GROUP BY year")
def _cohort_metrics_check(spark, sf):
    """All but the two shares of the assignment."""
    return _cohort_metrics(spark, sf).drop("hungarian_recall_at_1", "completion")


BUCKETS = (("early", 1995, 1996), ("middle", 1997, 1999), ("late", 2001, 2001))
REPORT_SQL = PAIRS + """,
report AS (SELECT r.year, count(*) AS n_men, avg(CASE WHEN rank_of_truth <= 1 THEN 1.0 ELSE 0.0 END) AS top1_recall,
  avg(CASE WHEN rank_of_truth <= 5 THEN 1.0 ELSE 0.0 END) AS top5_recall FROM ranks r GROUP BY r.year)"""


@query("era_rollup", REPORT_SQL + """,
e AS (SELECT *, CASE WHEN year <= 1998 THEN 'train' ELSE 'test' END AS pass,
  CASE WHEN year <= 1996 THEN 'early' WHEN year <= 1999 THEN 'middle' WHEN year = 2001 THEN 'late' ELSE 'OTHER' END AS era FROM report)
SELECT pass, era, count(*) AS n_cohorts, CAST(sum(n_men) AS BIGINT) AS n_marriages, min(year) AS min_year, max(year) AS max_year,
  round(sum(top1_recall * n_men) / sum(n_men), 4) AS top1_recall_weighted, round(avg(top1_recall), 4) AS top1_recall_unweighted,
  round(sum(top5_recall * n_men) / sum(n_men), 4) AS top5_recall_weighted, round(avg(top5_recall), 4) AS top5_recall_unweighted
FROM e GROUP BY pass, era""")
def _era_rollup(spark, sf):
    scores = V.scores(spark, sf)
    t = V.truth(scores)
    report = M.per_cohort_report(R.rank_of_truth(scores, t), N.cohort_pool(scores), t)
    report = report.withColumn("pass", F.when(F.col("year") <= 1998, "train").otherwise("test"))
    return rounded(M.era_rollup(report, ["top1_recall", "top5_recall"], BUCKETS))


COMPARE_SQL = PAIRS + """,
m AS (SELECT CASE WHEN year <= 1998 THEN 'a' ELSE 'b' END AS run,
  count(*) FILTER (WHERE label = 1 AND rank_of_true_wife = 1) / count(*) FILTER (WHERE label = 1) AS top1_recall,
  sum(CASE WHEN label = 1 THEN 1.0 / rank_of_true_wife ELSE 0 END) / count(*) FILTER (WHERE label = 1) AS mrr FROM pair_table GROUP BY 1),
u AS (SELECT run, unnest(['top1_recall', 'mrr']) AS metric, unnest([top1_recall, mrr]) AS v FROM m),
cmp AS (SELECT a.metric, a.v AS va, b.v AS vb FROM u a JOIN u b ON a.metric = b.metric AND a.run = 'a' AND b.run = 'b')"""
METRICS = ("hungarian_recall_at_1", "top1_recall", "mrr")


def compared(spark, sf, metrics=METRICS):
    pairs = V.pair_table(spark, sf).withColumn("run", F.when(F.col("year") <= 1998, "a").otherwise("b"))
    runs = M.cohort_metrics(pairs, ["run"])
    return M.compare_runs(runs.where(F.col("run") == "a"), runs.where(F.col("run") == "b"), metrics)


@query("compare_runs")
def _compare_runs(spark, sf):
    return rounded(compared(spark, sf))


@query("compare_runs_check", COMPARE_SQL + """
SELECT metric, round(va, 4) AS value_a, round(vb, 4) AS value_b, round(vb - va, 4) AS delta, '↑ better' AS direction FROM cmp""")
def _compare_runs_check(spark, sf):
    """The metrics that do not follow the assignment."""
    return rounded(compared(spark, sf, METRICS[1:]))


@query("write_comparison", COMPARE_SQL + """
SELECT 'markdown' AS source, printf('| %s (↑ better) | %.4f | %.4f | %+.4f |', metric, round(va, 2), round(vb, 2), round(round(vb - va, 2) + 0.0, 2)) AS line FROM cmp
UNION ALL SELECT 'json', metric || ' ' || round(va, 2) || ' ' || round(vb, 2) FROM cmp""")
def _write_comparison(spark, sf):
    """Both files, as written."""
    path = scratch(spark, "comparison")
    files.write_comparison(rounded(compared(spark, sf, METRICS[1:]), 2), path)
    lines = spark.read.text(f"{path}/comparison_md").select(F.lit("markdown").alias("source"), F.col("value").alias("line"))
    rows = spark.read.json(f"{path}/comparison_json")
    return lines.unionByName(rows.select(F.lit("json").alias("source"), F.concat_ws(" ", "metric", "value_a", "value_b").alias("line")))


@query("write_metrics", REPORT_SQL + """,
p AS (SELECT year, count(*) AS n FROM pool GROUP BY year),
s AS (SELECT year, count(*) AS n, avg(CASE WHEN rank_of_truth <= 1 THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN rank_of_truth <= 5 THEN 1.0 ELSE 0.0 END) AS b
  FROM ranks GROUP BY ROLLUP (year))
SELECT CASE WHEN r.year <= 1998 THEN 'train' ELSE 'test' END AS part, CAST(r.year AS BIGINT) AS year, n_men AS n, p.n AS n_women,
  round(top1_recall, 4) AS top1_recall, round(top5_recall, 4) AS top5_recall, true AS ablate FROM report r JOIN p ON p.year = r.year
UNION ALL SELECT 'summary', year, n, NULL, round(a, 4), round(b, 4), true FROM s""")
def _write_metrics(spark, sf):
    scores = V.scores(spark, sf)
    t = V.truth(scores)
    ranks = R.rank_of_truth(scores, t)
    report = M.per_cohort_report(ranks, N.cohort_pool(scores), t)
    path = scratch(spark, "metrics")
    passes = {"train": report.where(F.col("year") <= 1998), "test": report.where(F.col("year") > 1998)}
    files.write_metrics(M.summary_report(ranks), passes, path, ablate=True)
    per_cohort = spark.read.option("header", "true").option("inferSchema", "true").csv(f"{path}/per_cohort")
    summary = spark.read.json(f"{path}/summary")
    year, none = F.col("year").cast("bigint").alias("year"), F.lit(None).cast("bigint").alias("n_women")
    shares = [F.col(c).cast("double").alias(c) for c in ("top1_recall", "top5_recall")]
    rows = per_cohort.select(
        F.col("pass").alias("part"), year, F.col("n_men").cast("bigint").alias("n"), F.col("n_women").cast("bigint").alias("n_women"), *shares, "ablate"
    )
    return rounded(rows.unionByName(summary.select(F.lit("summary").alias("part"), year, F.col("n_ranked").alias("n"), none, *shares, "ablate")))


@query("latest_run", """
SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS VARCHAR) AS run, count(*) AS n FROM orders
WHERE year(o_orderdate) * 100 + month(o_orderdate) = (SELECT max(year(o_orderdate) * 100 + month(o_orderdate)) FROM orders WHERE o_orderdate < TIMESTAMP '2001-03-15') GROUP BY 1""")
def _latest_run(spark, sf):
    orders = table(spark, sf, "orders")
    run = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("string").alias("run")
    runs = orders.groupBy(run).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"))
    return M.latest_run(runs, "run", F.col("first") < F.lit("2001-03-15").cast("timestamp")).select("run", "n")


@query("gap_distribution", PAIRS + """
SELECT year, id, round((score_gap - (SELECT min(score_gap) FROM pair_table)) / (SELECT max(score_gap) - min(score_gap) FROM pair_table), 4) AS position,
  CASE WHEN label = 1 THEN 'positives' ELSE 'negatives' END AS side FROM pair_table""")
def _gap_distribution(spark, sf):
    return rounded(M.gap_distribution(V.pair_table(spark, sf)).select("year", "id", "position", "side"))


@query("classify_outcome")
def _classify_outcome(spark, sf):
    return M.classify_outcome(V.pair_table(spark, sf))


@query("classify_outcome_check", PAIRS + """
SELECT year, husband_id, CASE WHEN max(label) = 0 THEN 'negative-only' WHEN max(rank_of_true_wife) > 1 THEN 'wrong-wife' ELSE 'collision' END AS otherwise
FROM pair_table GROUP BY year, husband_id""")
def _classify_outcome_check(spark, sf):
    """What the outcome is where the assignment has not found the partner."""
    pairs = V.pair_table(spark, sf)
    unmatched = pairs.withColumn("hungarian_correct", F.when(F.col("hungarian_correct").isNotNull(), F.lit(False)))
    found = M.classify_outcome(unmatched).withColumnRenamed("outcome", "otherwise")
    real = _classify_outcome(spark, sf).where("outcome <> 'correct'")
    # Outcomes of the real assignment differ from these by 'correct' alone.
    return found.join(real, ["year", "husband_id"], "left").select(
        "year", "husband_id", F.when(F.col("outcome").isNull() | (F.col("outcome") == F.col("otherwise")), F.col("otherwise")).alias("otherwise")
    )


@query("breakdown_by", PAIRS + """
SELECT year, era, same_lineage, count(*) AS n, round(avg(CASE WHEN rank_of_true_wife = 1 THEN 1.0 ELSE 0.0 END), 4) AS top1,
  CAST(grouping(year, era, same_lineage) AS INTEGER) AS level
FROM pair_table WHERE label = 1 GROUP BY GROUPING SETS ((year), (era), (same_lineage), ())""")
def _breakdown_by(spark, sf):
    pairs = V.pair_table(spark, sf).where(F.col("label") == 1)
    measures = {"n": F.count("*"), "top1": F.avg((F.col("rank_of_true_wife") == 1).cast("int"))}
    return rounded(M.breakdown_by(pairs, ["year", "era", "same_lineage"], measures))


@query("first_truth", PAIRS + "SELECT year, husband_id, wife_id AS true_wife_id FROM pair_table WHERE label = 1")
def _first_truth(spark, sf):
    return M.first_truth(V.pair_table(spark, sf))


@query("baseline_recall")
def _baseline_recall(spark, sf):
    return rounded(M.baseline_recall(V.pair_table(spark, sf)))


@query("baseline_recall_check", PAIRS + "SELECT year, count(*) FILTER (WHERE label = 1) AS n_positives, true AS agrees FROM pair_table GROUP BY year")
def _baseline_recall_check(spark, sf):
    """The recall that the pair table gives is that of the assignment among true pairs."""
    pairs, scores = V.pair_table(spark, sf), V.scores(spark, sf)
    base = M.baseline_recall(pairs)
    hits = G.assignment_correct(V.assignment(spark, sf), V.truth(scores)).groupBy("year").agg(F.avg(F.col("correct").cast("int")).alias("share"))
    return base.join(hits, "year").select("year", "n_positives", (F.abs(F.col("recall_at_1") - F.col("share")) < 1e-9).alias("agrees"))
