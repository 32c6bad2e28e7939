"""Two-sided rule scoring of all candidates at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom import fixed
from kinloom.functions import scalars as S
from kinloom.operators.ranking import top_k_per_left


def candidate_funnel(pairs: DataFrame, k: int = fixed.TOP_K_CANDIDATES, keys: Sequence[str] = ("year", "h")) -> DataFrame:
    """Candidates in the cohort and candidates kept, per left entity."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("in_cohort")).withColumn(
        "kept", F.least(F.col("in_cohort"), F.lit(k))
    )


def candidates_with_profiles(
    pairs: DataFrame, people: DataFrame, k: int = fixed.TOP_K_CANDIDATES, keys: Sequence[str] = ("year", "h")
) -> DataFrame:
    """The k best candidates per left entity with both profiles (t_* and c_*)."""
    out = top_k_per_left(pairs, k, keys)
    fields = ("birth_year", "banner_id", "community_id", "household_id", "sex")
    for side, column in (("t", "h"), ("c", "w")):
        profile = people.select(
            F.col("id").alias(f"_{side}"), *[F.col(f).alias(f"{side}_{f}") for f in fields]
        )
        out = out.withColumn(column, F.col(column).cast("string"))
        out = out.join(profile, F.col(column) == F.col(f"_{side}"), "left").drop(f"_{side}")
    return out


def _age_gap(t: str, c: str) -> Column:
    ty, cy = F.col(f"{t}_birth_year"), F.col(f"{c}_birth_year")
    return F.when((ty != 0) & (cy != 0), F.abs(ty - cy))


def rule_score(
    t: str = "t",
    c: str = "c",
    prior: Column | None = None,
    motif: Column | None = None,
) -> Column:
    """Integer score 1..10 of candidate ``c`` seen by ``t`` (column prefixes).

    ``prior`` is the model logit (NULL: no prior), ``motif`` the average score of a
    matched motif (NULL: none matched).
    """
    tb, cb = F.col(f"{t}_banner_id"), F.col(f"{c}_banner_id")
    gap = _age_gap(t, c)
    score = (
        F.lit(5.0)
        + F.when(tb == cb, 2.0).when(tb.isNotNull() & cb.isNotNull(), -1.0).otherwise(0.0)
        + F.when(F.col(f"{t}_community_id") == F.col(f"{c}_community_id"), 1.0).otherwise(0.0)
        + F.when(gap <= 5, 1.5).when(gap <= 10, 0.5).when(gap.isNotNull(), -1.0).otherwise(0.0)
    )
    if motif is not None:
        score = score + F.coalesce(1.5 * motif, F.lit(0.0))
    if prior is not None:
        score = score + F.coalesce(0.4 * prior, F.lit(0.0))
    return S.clamp(S.half_even_int(score), 1, 10)


def rule_reason(
    t: str = "t",
    c: str = "c",
    prior: Column | None = None,
    motif: Column | None = None,
    motif_id: Column | None = None,
    prior_label: str = "pre-score",
) -> Column:
    """The rules that fired, as one text."""
    tb, cb = F.col(f"{t}_banner_id"), F.col(f"{c}_banner_id")
    gap = _age_gap(t, c)
    shown = gap.cast("string")

    def age(word: str) -> Column:
        return F.concat(F.lit(f"{word} age (Δ="), shown, F.lit("y)"))

    parts = [
        F.when(tb == cb, F.concat(F.lit("same banner ("), tb.cast("string"), F.lit(")"))).when(
            tb.isNotNull() & cb.isNotNull(), "different banner"
        ),
        F.when(F.col(f"{t}_community_id") == F.col(f"{c}_community_id"), "same community"),
        F.when(gap <= 5, age("close"))
        .when(gap <= 10, age("reasonable"))
        .when(gap.isNotNull(), F.concat(F.lit("large age gap (Δ="), shown, F.lit("y)"))),
    ]
    if motif is not None:
        name = motif_id if motif_id is not None else F.lit("none")
        parts.append(F.when(motif.isNotNull(), F.concat(F.lit("motif match "), name)))
    if prior is not None:
        parts.append(F.when(prior.isNotNull(), F.format_string(f"{prior_label} %+.2f", prior.cast("double"))))
    text = F.concat_ws("; ", *parts)
    return F.when(text == "", "default heuristic").otherwise(text)


def score_candidates(
    candidates: DataFrame, threshold: int = fixed.REVERSE_THRESHOLD, prior: str = "score"
) -> DataFrame:
    """Forward score and reason; the candidate's own view only where forward >= threshold."""
    p = F.col(prior)
    forward = candidates.withColumn("target_score", rule_score("t", "c", p)).withColumn(
        "target_reason", rule_reason("t", "c", p)
    )
    asked = F.col("target_score") >= threshold
    return forward.withColumn("candidate_score", F.when(asked, rule_score("c", "t"))).withColumn(
        "candidate_reason", F.when(asked, rule_reason("c", "t"))
    )


def final_ranking(scored: DataFrame, prior: str = "score", keys: Sequence[str] = ("year", "h")) -> DataFrame:
    """Mean of both views (or a discounted forward view) times the sigmoid of the prior, ranked."""
    t, c = F.col("target_score").cast("double"), F.col("candidate_score").cast("double")
    both = F.when(c.isNotNull(), (t + c) / 2.0).otherwise(t * fixed.ONE_SIDED_FACTOR)
    final = F.round(both * S.sigmoid(F.col(prior)), 4)
    window = Window.partitionBy(*keys).orderBy(F.desc("final_score"), F.desc(prior), "w")
    return scored.withColumn("final_score", final).withColumn("final_rank", F.row_number().over(window))


def commit_line(threshold: float = fixed.COMMIT_THRESHOLD, logit: float = fixed.COMMIT_LOGIT) -> float:
    return threshold / (1.0 + math.exp(-logit))


def choose(ranked: DataFrame, threshold: float = fixed.COMMIT_THRESHOLD) -> DataFrame:
    """The top candidate per left entity when it reaches the commit line."""
    return ranked.where((F.col("final_rank") == 1) & (F.col("final_score") >= commit_line(threshold)))


# -- text in and out ------------------------------------------------------------------

EVALUATION_SCHEMA = (
    "evaluations array<struct<candidate_id:string,score:string,reason:string>>,"
    "scores array<struct<candidate_id:string,score:string,reason:string>>"
)


def parse_evaluations(
    answers: DataFrame, candidates: DataFrame, keys: Sequence[str] = ("year", "h"), text: str = "answer"
) -> DataFrame:
    """Scores and reasons read from JSON answers, one row per asked candidate.

    The list is ``evaluations`` or, when that is missing or empty, ``scores``. Scores are
    cut to an integer in 1..10, an unreadable one counts 5; reasons are cut to 500
    characters; the last of duplicate entries wins. A candidate without an entry gets 5,
    and so do all candidates of an answer that is no JSON object.
    """
    keys = list(keys)
    parsed = answers.select(
        *keys,
        F.from_json(text, EVALUATION_SCHEMA, {"mode": "PERMISSIVE"}).alias("_j"),
        F.try_parse_json(text).isNull().alias("_bad"),
    )
    entries = F.when(F.size("_j.evaluations") > 0, F.col("_j.evaluations")).otherwise(F.col("_j.scores"))
    rows = parsed.select(*keys, F.posexplode(entries).alias("_pos", "_e")).where(
        F.col("_e.candidate_id").isNotNull()
    )
    value = F.col("_e.score").try_cast("double")
    whole = F.when(value.between(-1e9, 1e9), value.cast("int"))
    last = rows.groupBy(*keys, F.col("_e.candidate_id").alias("w")).agg(
        F.max_by(
            F.struct(
                S.clamp(F.coalesce(whole, F.lit(fixed.DEFAULT_SCORE)), 1, 10).alias("score"),
                F.substring(F.coalesce(F.col("_e.reason"), F.lit("")), 1, fixed.MAX_REASON_CHARS).alias("reason"),
            ),
            "_pos",
        ).alias("_v")
    )
    state = parsed.select(*keys, "_bad")
    asked = candidates.select(*keys, "w").distinct()
    joined = asked.join(state, keys, "left").join(last, [*keys, "w"], "left")
    fallback = F.when(F.coalesce("_bad", F.lit(False)), "fallback").otherwise("no LLM output")
    return joined.select(
        *keys,
        "w",
        F.coalesce(F.col("_v")["score"], F.lit(fixed.DEFAULT_SCORE)).alias("score"),
        F.coalesce(F.col("_v")["reason"], fallback).alias("reason"),
    )


PROFILE_LINES = "You are person %s.\n- sex: %s\n- born: %s\n- banner: %s\n- community: %s\n- household: %s\n"


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("?"))


def render_prompts(
    candidates: DataFrame,
    rules: str = "",
    keys: Sequence[str] = ("year", "h"),
    hints: DataFrame | None = None,
    order: str = "ts",
) -> DataFrame:
    """One text per left entity: own profile, rules, hints, and its candidates in rank order.

    ``candidates`` holds the few kept candidates per entity (``candidates_with_profiles``); a
    text column ``motif`` of it ends each candidate's line. ``hints`` has (h, order, role, text);
    an entity's hints, few as they are typed by hand, follow the rules in their order.
    """
    line = F.format_string(
        "- candidate %s: sex=%s, born=%s, banner=%s, community=%s, household=%s, pre_score=%.2f",
        F.col("w").cast("string"), _text("c_sex"), _text("c_birth_year"), _text("c_banner_id"),
        _text("c_community_id"), _text("c_household_id"), F.col("score").cast("double"),
    )
    if "motif" in candidates.columns:
        line = F.concat(line, F.coalesce(F.concat(F.lit(", motif="), F.col("motif")), F.lit("")))
    own = F.format_string(
        PROFILE_LINES, F.col("h").cast("string"), _text("t_sex"), _text("t_birth_year"),
        _text("t_banner_id"), _text("t_community_id"), _text("t_household_id"),
    )
    grouped = candidates.groupBy(*keys).agg(
        F.max(own).alias("_own"),
        F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("_lines"),
        F.count("*").alias("n_candidates"),
    )
    lines = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    intro = F.lit(f"{rules}\n" if rules else "")
    told = F.lit("")
    if hints is not None:
        per = hint_lines(hints, "h", order).groupBy("h").agg(F.sort_array(F.collect_list(F.struct(order, "line"))).alias("_hints"))
        grouped = grouped.join(per, "h", "left")
        listed = F.array_join(F.transform("_hints", lambda x: x["line"]), "\n")
        told = F.coalesce(F.concat(F.lit("Hints:\n"), listed, F.lit("\n")), F.lit(""))
    return grouped.select(
        *keys, "n_candidates", F.concat(F.col("_own"), intro, told, F.lit("Candidates:\n"), lines).alias("prompt")
    )


VERBS = ("boost", "penalise", "penalize", "eliminate", "accept")
MENTION = r"@c-([A-Za-z0-9_]+)"


def parse_directives(df: DataFrame, text: str = "text") -> DataFrame:
    """Mentioned ids (distinct, in order) and the first verb, one spelling of penalise."""
    verb = F.lower(F.regexp_extract(text, r"(?i)\b(" + "|".join(VERBS) + r")\b", 1))
    ids = F.array_distinct(F.regexp_extract_all(text, F.lit(MENTION), 1))
    return df.withColumn("verb", F.when(verb == "penalize", "penalise").otherwise(verb)).withColumn("ids", ids)


def apply_directives(
    cards: DataFrame, directives: DataFrame, key: Sequence[str] = (), order: str = "seq", step: float = 0.5, per_slice: int = 1000
) -> DataFrame:
    """Cards after all directives: score moved by +-step within 0..10, eliminated, accepted.

    ``cards`` has (key.., candidate_id, target_score), ``directives`` (key.., order, verb,
    ids). A mention names the id or P + id; ``all`` names every candidate of the key. The
    score is clamped after every directive. A run of clamped moves is itself one clamped
    move (shift, low, high), so moves are folded over slices of the order column, level
    by level; ``order`` must be a unique non-negative integer within a key.
    """
    key = list(key)
    marks = directives.where(F.col("verb") != "").select(*key, F.col(order).alias("_o"), "verb", F.explode("ids").alias("_id"))
    base = cards.select(*key, "candidate_id").distinct()
    named = base.select(*key, "candidate_id", F.explode(
        F.array(F.col("candidate_id").cast("string"), F.concat(F.lit("P"), F.col("candidate_id").cast("string")))
    ).alias("_id"))
    hits = named.join(marks.where(F.col("_id") != "all"), [*key, "_id"]).drop("_id")
    every = marks.where(F.col("_id") == "all").drop("_id")
    # Without a key every card hears every such directive: the key is then one constant.
    keyed = [F.col(k) for k in key] or [F.lit(0).alias("_k")]
    to_all = base.select(*(["*"] if key else ["*", *keyed])).join(every.select("*", *([] if key else keyed)), key or ["_k"])
    hits = hits.unionByName(to_all.select(hits.columns)).distinct()
    card = [*key, "candidate_id"]
    flags = hits.groupBy(*card).agg(
        F.bool_or(F.col("verb") == "eliminate").alias("eliminated"),
        F.bool_or(F.col("verb") == "accept").alias("accepted"),
    )
    moves = hits.where(F.col("verb").isin("boost", "penalise")).select(
        *card,
        "_o",
        F.struct(
            F.when(F.col("verb") == "boost", step).otherwise(-step).alias("d"),
            F.lit(0.0).alias("lo"),
            F.lit(10.0).alias("hi"),
        ).alias("m"),
    )

    def then(f: Column, g: Column) -> Column:
        def through(y: Column) -> Column:
            return F.least(g["hi"], F.greatest(g["lo"], y + g["d"]))

        return F.struct((f["d"] + g["d"]).alias("d"), through(f["lo"]).alias("lo"), through(f["hi"]).alias("hi"))

    nothing = F.struct(F.lit(0.0).alias("d"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    for level in range(4):
        group = card if level == 3 else [*card, "_s"]
        sliced = moves if level == 3 else moves.withColumn("_s", F.floor(F.col("_o") / per_slice))
        folded = sliced.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_o", "m"))).alias("_l"))
        one = F.aggregate(F.transform("_l", lambda x: x["m"]), nothing, then)
        moves = folded.select(*card, *([] if level == 3 else [F.col("_s").alias("_o")]), one.alias("m"))
    out = cards.join(flags, card, "left").join(moves, card, "left")
    score = F.col("target_score").cast("double")
    moved = F.least(F.col("m")["hi"], F.greatest(F.col("m")["lo"], score + F.col("m")["d"]))
    return out.select(
        *card,
        F.when(score.isNotNull() & F.col("m").isNotNull(), moved).otherwise(score).alias("target_score"),
        F.coalesce("eliminated", F.lit(False)).alias("eliminated"),
        F.coalesce("accepted", F.lit(False)).alias("accepted"),
    )


def hints_for(hints: DataFrame, role: str | None = None) -> DataFrame:
    """Hints addressed to everybody or to the role; all hints for no role or ``all``."""
    return hints if role in (None, "all") else hints.where(F.col("role").isin("all", role))


def hint_lines(hints: DataFrame, key: str = "h", order: str = "ts") -> DataFrame:
    """The hints of each entity as text lines with their place, ready to be joined to prompts."""
    return hints.select(
        key, order, F.concat(F.lit("  - ["), F.col("role"), F.lit("] "), F.col("text")).alias("line")
    )
