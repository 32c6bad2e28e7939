"""Evaluation of rankings, assignments and pair scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom import fixed
from kinloom.functions import scalars as S
from kinloom.operators.candidates import sample_negatives
from kinloom.operators.ordered import first_row, running_sums, with_scalar


def _share(hit: Column, of: Column) -> Column:
    return F.when(of > 0, hit / of)


def assignment_recall(assignment: DataFrame, truth: DataFrame) -> DataFrame:
    """Correct / matched per cohort, with the pooled and the averaged value.

    Every matched row counts in the denominator, also that of an entity without truth.
    Level ``year`` is per cohort; ``pooled`` divides the sums, ``mean`` averages cohorts.
    """
    joined = assignment.select("year", "h", "w").join(truth.select("year", "h", "true_w"), ["year", "h"], "left")
    per_year = joined.groupBy("year").agg(
        F.count_if(F.coalesce(F.col("w") == F.col("true_w"), F.lit(False))).alias("n_correct"),
        F.count("*").alias("n_matched"),
    )
    yearly = per_year.select(
        F.lit("year").alias("level"), "year", "n_correct", "n_matched",
        _share(F.col("n_correct"), F.col("n_matched")).alias("recall"),
    )
    c, m = F.sum("n_correct"), F.sum("n_matched")
    null_year = F.lit(None).cast(per_year.schema["year"].dataType).alias("year")
    pooled = per_year.agg(c.alias("n_correct"), m.alias("n_matched"), _share(c, m).alias("recall"))
    mean = per_year.agg(
        c.alias("n_correct"), m.alias("n_matched"), F.avg(F.col("n_correct") / F.col("n_matched")).alias("recall")
    )
    columns = ["level", "year", "n_correct", "n_matched", "recall"]
    return (
        yearly.unionByName(pooled.select(F.lit("pooled").alias("level"), null_year, "*").select(columns))
        .unionByName(mean.select(F.lit("mean").alias("level"), null_year, "*").select(columns))
    )


def topk_recall(ranks: DataFrame, ks: Sequence[int] = fixed.RECALL_AT) -> DataFrame:
    """Share of entities whose truth ranks within k, per cohort (``ranks`` from rank_of_truth)."""
    aggregates = [F.count("*").alias("n_ranked")]
    for k in ks:
        aggregates.append(F.avg((F.col("rank_of_truth") <= k).cast("int")).alias(f"top{k}_recall"))
    return ranks.groupBy("year").agg(*aggregates)


def threshold_counts(df: DataFrame, label: str = "label", score: str = "score", group: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: positives, negatives and their cumulative counts from below.

    Rows are counted per score before anything is ordered; the cumulative counts are
    carried over range slices, so neither one task nor the driver sees all scores.
    """
    group = list(group)
    counts = df.groupBy(*group, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return running_sums(counts, group, ["score"], {"cpos": F.col("pos"), "cneg": F.col("neg")})


def _auc_terms() -> Column:
    below = F.col("cneg") - F.col("neg")
    return F.sum(F.col("pos") * (below + F.col("neg") / F.lit(2.0)))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", group: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve (ties count half); NULL with a single class."""
    counts = threshold_counts(df, label, score, group)
    total = F.sum("pos") * F.sum("neg")
    return counts.groupBy(*group).agg(F.when(total > 0, _auc_terms() / total).alias("roc_auc"))


def _with_totals(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    group = list(group)
    totals = counts.groupBy(*group).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if group:
        return counts.join(totals, group)
    joined = with_scalar(counts, "_t", totals.select(F.struct("P", "N")))
    return joined.withColumns({"P": F.col("_t")["P"], "N": F.col("_t")["N"]}).drop("_t")


def _ap_terms() -> Column:
    above_pos = F.col("P") - F.col("cpos") + F.col("pos")
    above_neg = F.col("N") - F.col("cneg") + F.col("neg")
    precision = above_pos / (above_pos + above_neg)
    return F.sum(F.col("pos") / F.col("P") * precision)


def average_precision(df: DataFrame, label: str = "label", score: str = "score", group: Sequence[str] = ()) -> DataFrame:
    """Step sum of precision over recall gains, at every distinct score."""
    counts = _with_totals(threshold_counts(df, label, score, group), group).where(F.col("P") > 0)
    return counts.groupBy(*group).agg(_ap_terms().alias("average_precision"))


def log_loss(
    df: DataFrame, label: str = "label", score: str = "score", group: Sequence[str] = (), clip: float = fixed.PROBABILITY_CLIP
) -> DataFrame:
    """Mean negative log likelihood of sigmoid(score), clipped away from 0 and 1."""
    p = S.clamp(S.sigmoid(F.col(score)), clip, 1 - clip)
    loss = F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p))
    return df.groupBy(*group).agg(F.avg(loss).alias("log_loss"))


def pair_metrics(df: DataFrame, label: str = "label", score: str = "score", group: Sequence[str] = ()) -> DataFrame:
    """AUC, average precision and log loss; the ordered counts are built once for both areas."""
    group = list(group)
    counts = _with_totals(threshold_counts(df, label, score, group), group)
    total = F.sum("pos") * F.sum("neg")
    areas = counts.groupBy(*group).agg(
        F.when(total > 0, _auc_terms() / total).alias("roc_auc"),
        F.when(total > 0, _ap_terms()).alias("pr_auc"),
        F.sum(F.col("pos") + F.col("neg")).alias("n_pairs_scored"),
    )
    losses = log_loss(df, label, score, group)
    if group:
        return areas.join(losses, group)
    return areas.withColumn("log_loss", losses.scalar())


def pair_level_sample(
    scores: DataFrame,
    truth: DataFrame,
    pool: DataFrame,
    k: int = fixed.NEGATIVES_PER_POSITIVE,
    seed: int = 0,
    default_score: float = 0.0,
) -> DataFrame:
    """Labelled scores: every true pair in the pool and k sampled negatives of its entity."""
    positives = truth.select("year", "h", F.col("true_w").alias("w")).join(pool, ["year", "w"], "left_semi")
    negatives = sample_negatives(positives, pool, k, seed)
    rows = positives.select("year", "h", "w", F.lit(1).alias("label")).unionByName(
        negatives.select("year", "h", F.col("neg_w").alias("w"), F.lit(0).alias("label"))
    )
    return rows.join(scores.select("year", "h", "w", "score"), ["year", "h", "w"], "left").na.fill(
        default_score, ["score"]
    )


def per_cohort_report(
    ranks: DataFrame, pool: DataFrame, men: DataFrame, assigned: DataFrame | None = None
) -> DataFrame:
    """year, n_men, n_women and the recalls of each cohort."""
    n_men = men.select("year", "h").distinct().groupBy("year").agg(F.count("*").alias("n_men"))
    n_women = pool.groupBy("year").agg(F.count("*").alias("n_women"))
    recalls = topk_recall(ranks, (1, 5)).drop("n_ranked")
    out = n_men.join(n_women, "year").join(recalls, "year", "left").na.fill(0.0, ["top1_recall", "top5_recall"])
    if assigned is not None:
        per_year = assigned.where(F.col("level") == "year").select(
            "year", F.col("recall").alias("hungarian_recall@1")
        )
        out = out.join(per_year, "year", "left").na.fill(0.0, ["hungarian_recall@1"])
    return out


def summary_report(ranks: DataFrame, ks: Sequence[int] = (1, 5), label: str = "test") -> DataFrame:
    """Per-cohort and pooled top-k recall in one pass."""
    aggregates = [F.count("*").alias("n_ranked")]
    for k in ks:
        aggregates.append(F.avg((F.col("rank_of_truth") <= k).cast("int")).alias(f"top{k}_recall"))
    return ranks.rollup("year").agg(*aggregates).withColumn("label", F.lit(label))


def cohort_metrics(pairs: DataFrame, group: Sequence[str] = ("year",)) -> DataFrame:
    """Counts, assignment recall, top-1, top-10, MRR and completion from a pair table."""
    positive = F.col("label") == 1
    n = F.count_if(positive)
    rank = F.col("rank_of_true_wife")

    def share(hit: Column) -> Column:
        return F.when(n > 0, F.count_if(positive & F.coalesce(hit, F.lit(False))) / n).otherwise(0.0)

    mrr = F.sum(F.when(positive & (rank > 0), 1.0 / rank).otherwise(0.0))
    return pairs.groupBy(*group).agg(
        F.count("*").alias("n_pairs"),
        n.alias("n_positives"),
        share(F.col("hungarian_correct")).alias("hungarian_recall_at_1"),
        share(rank == 1).alias("top1_recall"),
        share(rank <= 10).alias("top10_recall"),
        F.when(n > 0, mrr / n).otherwise(0.0).alias("mrr"),
        share(F.col("hungarian_correct")).alias("completion"),
    )


def era_rollup(
    report: DataFrame,
    value_columns: Sequence[str],
    buckets: Sequence[tuple[str, int, int]] = fixed.ERA_BUCKETS,
    weight: str = "n_men",
    pass_column: str = "pass",
) -> DataFrame:
    """Weighted and plain means per (pass, era), with counts and year range."""
    with_era = report.withColumn("era", S.era_bucket(F.col("year"), buckets))
    total = F.sum(weight)
    aggregates = [
        F.count("*").alias("n_cohorts"),
        total.cast("bigint").alias("n_marriages"),
        F.min("year").cast("int").alias("min_year"),
        F.max("year").cast("int").alias("max_year"),
    ]
    for c in value_columns:
        aggregates.append(F.when(total > 0, F.sum(F.col(c) * F.col(weight)) / total).alias(f"{c}_weighted"))
        aggregates.append(F.avg(c).alias(f"{c}_unweighted"))
    return with_era.groupBy(pass_column, "era").agg(*aggregates)


def unpivot_metrics(df: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per metric."""
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(keys), list(metrics), "metric", "value"
    )


def compare_runs(a: DataFrame, b: DataFrame, metrics: Sequence[str], lower_is_better: Sequence[str] = ("log_loss",)) -> DataFrame:
    """Delta b - a per metric (a missing value counts 0), with the better direction."""
    left = unpivot_metrics(a, metrics).withColumnRenamed("value", "value_a")
    right = unpivot_metrics(b, metrics).withColumnRenamed("value", "value_b")
    zero = F.lit(0.0)
    return left.join(right, "metric", "full").select(
        "metric", "value_a", "value_b",
        (F.coalesce("value_b", zero) - F.coalesce("value_a", zero)).alias("delta"),
        F.when(F.col("metric").isin(list(lower_is_better)), "↓ better").otherwise("↑ better").alias("direction"),
    )


def comparison_lines(compared: DataFrame) -> DataFrame:
    """Markdown table row per metric."""
    line = F.format_string(
        "| %s (%s) | %.4f | %.4f | %+.4f |", "metric", "direction", "value_a", "value_b", "delta"
    )
    return compared.select("metric", line.alias("line"))


def latest_run(runs: DataFrame, run: str = "run", ready: Column | None = None) -> DataFrame:
    """Newest run (by name, which starts with its time stamp) that has metrics."""
    usable = runs if ready is None else runs.where(ready)
    newest = usable.agg(F.max(run)).scalar()
    return runs.where(F.col(run) == newest)


def gap_distribution(pairs: DataFrame, gap: str = "score_gap") -> DataFrame:
    """Linear position of every finite gap within the range of all gaps; a flat range is padded by 1."""
    usable = pairs.where(F.col(gap).isNotNull() & ~F.isnan(gap))
    one = usable.agg(F.struct(F.min(gap).alias("lo"), F.max(gap).alias("hi")))
    span = F.col("_span")
    flat = span["lo"] == span["hi"]
    low = F.when(flat, span["lo"] - 1).otherwise(span["lo"])
    high = F.when(flat, span["hi"] + 1).otherwise(span["hi"])
    placed = with_scalar(usable, "_span", one).withColumn("position", (F.col(gap) - low) / (high - low))
    return placed.withColumn(
        "side", F.when(F.col("label") == 1, "positives").otherwise("negatives")
    ).drop("_span")


def classify_outcome(pairs: DataFrame, keys: Sequence[str] = ("year", "husband_id")) -> DataFrame:
    """Per left entity: correct, wrong-wife, collision or negative-only."""
    first = F.min_by(
        F.struct("hungarian_correct", "rank_of_true_wife"), F.when(F.col("label") == 1, F.col("id"))
    )
    picked = pairs.groupBy(*keys).agg(first.alias("_p"))
    p = F.col("_p")
    outcome = (
        F.when(p.isNull(), "negative-only")
        .when(F.coalesce(p["hungarian_correct"], F.lit(False)), "correct")
        .when(p["rank_of_true_wife"] > 1, "wrong-wife")
        .otherwise("collision")
    )
    return picked.select(*keys, outcome.alias("outcome"))


def breakdown_by(df: DataFrame, dims: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """The measures along each dimension alone and in total, in one grouping-sets pass."""
    sets = [[F.col(d)] for d in dims] + [[]]
    out = df.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        *[m.alias(n) for n, m in measures.items()], F.grouping_id().cast("int").alias("level")
    )
    return out


def first_truth(pairs: DataFrame, keys: Sequence[str] = ("year", "husband_id")) -> DataFrame:
    """Partner of the first positive row (by id) per left entity."""
    positives = pairs.where(F.col("label") == 1)
    return first_row(positives, list(keys), ["id"], ["wife_id"]).withColumnRenamed("wife_id", "true_wife_id")


def baseline_recall(pairs: DataFrame, group: Sequence[str] = ("year",)) -> DataFrame:
    """Static recall of the positives: the reference line beside a learning curve."""
    positive = F.col("label") == 1
    n = F.count_if(positive)
    hit = F.count_if(positive & F.coalesce(F.col("hungarian_correct"), F.lit(False)))
    return pairs.groupBy(*group).agg(
        n.alias("n_positives"), F.when(n > 0, hit / n).otherwise(0.0).alias("recall_at_1")
    )
