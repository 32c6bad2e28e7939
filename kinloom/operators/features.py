"""Node features: latest known values, vocabularies, scaling, snapshots, degrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom import fixed
from kinloom.functions import arrays as A
from kinloom.functions import scalars as S
from kinloom.operators.edges import PANEL, Panel
from kinloom.operators.ordered import numbered, with_scalar
from kinloom.operators.temporal import degrees_as_of
from kinloom.session import settle


def latest_as_of(
    df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], cutoff: Column | None = None
) -> DataFrame:
    """Last known value of each column per entity: the newest non-null one, per column.

    One aggregate with map-side combine; a value is ranked by the row order and a null
    value has no rank.
    """
    seen = df if cutoff is None else df.where(cutoff)
    key = F.struct(*order)
    return (
        seen.where(F.col(entity).isNotNull())
        .groupBy(entity)
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(c) for c in columns])
    )


def missing_mask(df: DataFrame, columns: Sequence[str], suffix: str = "_present") -> DataFrame:
    """Explicit presence flags; a zero is a value."""
    return df.select("*", *[F.col(c).isNotNull().alias(f"{c}{suffix}") for c in columns])


def binary_flags(df: DataFrame, columns: Sequence[str], suffix: str = "_flag") -> DataFrame:
    return df.select("*", *[S.binary_flag(F.col(c)).alias(f"{c}{suffix}") for c in columns])


def fit_vocab(
    df: DataFrame, column: str, max_size: int | None = fixed.VOCAB_SIZE, count_unknown: bool = False
) -> DataFrame:
    """vocab(value, code, n): codes 1.. by falling frequency, then value; 0 means unknown.

    ``count_unknown`` counts the filler of missing values as a value of its own, which
    then takes part in the ranking (its code is its frequency rank instead of 0).
    """
    source = df.select(F.col(column).cast("string").alias("value"))
    if count_unknown:
        source = source.select(F.coalesce("value", F.lit("<UNK>")).alias("value"))
    counts = source.where(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))
    if max_size is not None:
        counts = counts.orderBy(F.desc("n"), "value").limit(max_size - 1)
    ranked = numbered(counts, [], [F.desc("n"), F.col("value")], "code")
    return ranked.select("value", F.col("code").cast("int").alias("code"), "n")


def encode(df: DataFrame, column: str, vocab: DataFrame, name: str) -> DataFrame:
    """Code of each value, 0 when it is not in the vocabulary."""
    lookup = vocab.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    joined = df.join(lookup, F.col(column).cast("string") == F.col("_value"), "left")
    return joined.withColumn(name, F.coalesce("_code", F.lit(0))).drop("_value", "_code")


def masked_zscore(
    df: DataFrame, columns: Sequence[str], suffix: str = "_z", floor: float = fixed.STD_FLOOR
) -> DataFrame:
    """z-score over present values; missing rows become 0; one value or none is left as is."""
    one = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
            *[F.count(c).alias(f"n_{c}") for c in columns],
        )
    )
    stats = F.col("_stats")

    def scaled(c: str) -> Column:
        value = F.col(c).cast("double")
        std = F.greatest(F.coalesce(stats[f"s_{c}"], F.lit(floor)), F.lit(floor))
        return (
            F.when(value.isNull(), 0.0)
            .when(stats[f"n_{c}"] > 1, (value - stats[f"m_{c}"]) / std)
            .otherwise(value)
            .alias(f"{c}{suffix}")
        )

    return with_scalar(df, "_stats", one).select("*", *[scaled(c) for c in columns]).drop("_stats")


def household_snapshot(
    df: DataFrame,
    p: Panel = PANEL,
    relationship: str = "RELATIONSHIP",
    position: str = "POSITION",
    generation: str = "GENERATION",
    head_pattern: str = "head|Head",
    cutoff: int | None = None,
    low: int = fixed.MIN_YEAR,
    high: int = fixed.MAX_YEAR,
) -> DataFrame:
    """Size, couples, generations, head-has-position and scaled year at the latest year.

    Aggregated per (household, year) first; the latest year is then picked among one row
    per year, so the raw rows of a household are never gathered.
    """
    rows = df.where(F.col(p.household).isNotNull() & F.col(p.year).isNotNull())
    if cutoff is not None:
        rows = rows.where(F.col(p.year) <= cutoff)
    head = F.coalesce(F.col(relationship).cast("string").rlike(head_pattern), F.lit(False))
    yearly = rows.groupBy(F.col(p.household).alias("household"), F.col(p.year).cast("int").alias("year")).agg(
        F.count("*").alias("size"),
        F.count_if(F.col(p.status) == fixed.MARRIED).alias("married"),
        F.count_distinct(generation).alias("generations"),
        F.max(F.when(head, F.coalesce(F.col(position), F.lit(0)))).alias("head_position"),
    )
    latest = yearly.groupBy("household").agg(
        F.max_by(F.struct("size", "married", "generations", "head_position", "year"), "year").alias("s")
    )
    s = F.col("s")
    return latest.select(
        "household",
        s["size"].cast("bigint").alias("household_size"),
        (s["married"] / F.lit(2.0)).alias("couples"),
        s["generations"].cast("bigint").alias("generations"),
        S.binary_flag(s["head_position"]).alias("head_has_position"),
        ((s["year"] - low) / F.lit(float(high - low))).alias("year_scaled"),
    )


def community_size(df: DataFrame, p: Panel = PANEL, approximate: bool = False) -> DataFrame:
    """Distinct persons per community, and relative to the largest community."""
    count = F.approx_count_distinct(p.person) if approximate else F.count_distinct(p.person)
    sizes = (
        df.where(F.col(p.village).isNotNull())
        .groupBy(S.code_text(F.col(p.village)).alias("community"))
        .agg(count.alias("population"))
    )
    largest = sizes.agg(F.max("population")).scalar()  # sizes: one row per community
    return sizes.withColumn("relative_size", F.col("population") / largest)


def one_hot_rows(ids: DataFrame, index: str = "idx", name: str = "one_hot") -> DataFrame:
    """Identity-matrix row per id; meant for small code sets such as banners."""
    size = ids.agg(F.count("*")).scalar()
    sized = ids.withColumn("_size", size)
    return sized.withColumn(name, A.one_hot(F.col(index), F.col("_size"))).drop("_size")


def minmax_scale(df: DataFrame, columns: Sequence[str], flat: str = "one", suffix: str = "_01") -> DataFrame:
    """(x - min) / (max - min). A flat column divides by 1 (``one``) or is 0 (``zero``)."""
    one = df.agg(
        F.struct(
            *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
        )
    )
    stats = F.col("_stats")

    def scaled(c: str) -> Column:
        low = stats[f"lo_{c}"]
        span = stats[f"hi_{c}"] - low
        if flat == "one":
            divisor = F.when(span == 0, F.lit(1.0)).otherwise(span)
            return ((F.col(c) - low) / divisor).alias(f"{c}{suffix}")
        value = F.coalesce(F.col(c) - low, F.lit(0.0))
        return F.when(span < 1e-12, 0.0).otherwise(value / span).alias(f"{c}{suffix}")

    return with_scalar(df, "_stats", one).select("*", *[scaled(c) for c in columns]).drop("_stats")


def assemble_features(
    df: DataFrame,
    p: Panel = PANEL,
    relationship: str = "RELATIONSHIP",
    occupation: Sequence[str] = fixed.OCCUPATION_COLUMNS,
    cutoff: int | None = None,
    vocab: DataFrame | None = None,
    vocab_size: int = fixed.VOCAB_SIZE,
) -> DataFrame:
    """One typed row per person, plus the numeric columns as one vector."""
    occupation = [c for c in occupation if c in df.columns]
    columns = [p.sex, p.birth, p.village, p.region, relationship, *occupation]
    seen = None if cutoff is None else F.col(p.year) <= cutoff
    latest = latest_as_of(df, p.person, p.row_order, columns, seen)
    vocab = vocab if vocab is not None else fit_vocab(latest, relationship, vocab_size)
    coded = encode(latest, relationship, vocab, "relationship_code")
    scaled = masked_zscore(binary_flags(coded, occupation), [p.birth])
    flags = [F.col(f"{c}_flag") for c in occupation]
    return scaled.select(
        F.col(p.person).alias("person"),
        S.valid_code(F.col(p.sex), (fixed.FEMALE, fixed.MALE)).alias("sex"),
        F.col(p.birth).isNotNull().alias("birth_present"),
        F.coalesce(F.col(p.birth).cast("int"), F.lit(0)).alias("birth_year"),
        F.col(f"{p.birth}_z").alias("birth_z"),
        "relationship_code",
        *[F.col(f"{c}_flag").alias(f"{c.lower()}_flag") for c in occupation],
        F.coalesce(F.col(p.village).cast("int"), F.lit(-1)).alias("community_id"),
        F.coalesce(F.col(p.region).cast("int"), F.lit(-1)).alias("banner_id"),
        F.array(F.col(f"{p.birth}_z"), *flags).alias("features"),
    )


def relation_degrees(edges: DataFrame, persons: DataFrame, side: str = "any") -> DataFrame:
    """Degree of every person in every relation of the edge table, zeros included.

    All edges count, whenever they start (``temporal.degrees_as_of`` takes a cutoff).
    """
    plain = edges.where(F.col("rel") != "r_sib")
    ends = []
    if side in ("in", "any"):
        ends.append(plain.select(F.col("dst").alias("id"), "rel"))
    if side in ("out", "any"):
        ends.append(plain.select(F.col("src").alias("id"), "rel"))
    touched = ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])
    counts = touched.groupBy("id", "rel").agg(F.count("*").alias("n"))
    links = edges.where(F.col("rel") == "r_sib").select(F.col("src").alias("id"), "dst", "rel")
    sizes = links.groupBy("dst").agg(F.count("*").alias("members"))
    both = 2 if side == "any" else 1
    siblings = links.join(sizes, "dst").select(
        "id", "rel", ((F.col("members") - 1) * both).alias("n")
    )
    relations = edges.select("rel").distinct().agg(F.sort_array(F.collect_set("rel"))).scalar()
    every = persons.select("id", F.explode(relations).alias("rel"))
    return every.join(counts.unionByName(siblings), ["id", "rel"], "left").select(
        "id", "rel", F.coalesce("n", F.lit(0)).cast("bigint").alias("degree")
    )


# Which end of an edge touches a cohort member: (relation, side for men, side for women).
COHORT_SIDES = (
    ("r_fs", "in", None),
    ("r_fd", None, "in"),
    ("r_ms", "in", None),
    ("r_md", None, "in"),
    ("r_sib", "any", "any"),
    ("r_hh", "out", "out"),
    ("r_cb", "out", "out"),
)


def context_density(
    edges: DataFrame, pairs: DataFrame, sides: Sequence[tuple] = COHORT_SIDES
) -> DataFrame:
    """Mean degree and share without edges per cohort year, sex side and relation.

    ``pairs`` has (h, w, year). Degrees are those visible strictly before the cohort year.
    """
    men = pairs.select(F.lit("men").alias("who"), F.col("h").alias("id"), "year").distinct()
    women = pairs.select(F.lit("women").alias("who"), F.col("w").alias("id"), "year").distinct()
    members = men.unionByName(women)
    size = members.groupBy("who", "year").agg(F.count("*").alias("n"))
    for_men, for_women = {r: m for r, m, _ in sides if m}, {r: w for r, _, w in sides if w}
    wanted = [("men", r) for r in for_men] + [("women", r) for r in for_women]
    if all(for_men.get(r, side) == side for r, side in for_women.items()):
        degrees = degrees_as_of(edges, members, for_men | for_women)
        joined = members.join(degrees, ["id", "year"])
    else:
        # A relation that counts at one end for men and at another for women is read twice.
        joined = men.join(degrees_as_of(edges, men, for_men), ["id", "year"]).unionByName(
            women.join(degrees_as_of(edges, women, for_women), ["id", "year"])
        )
    allowed = F.lit(False)
    for who, rel in wanted:
        allowed = allowed | ((F.col("who") == who) & (F.col("rel") == rel))
    parts = joined.where(allowed).groupBy("who", "year", "rel").agg(
        F.sum("degree").alias("total"), F.count("*").alias("touched")
    )
    grid = edges.sparkSession.createDataFrame(wanted, "who string, rel string")
    return (
        size.join(grid, "who")
        .join(parts, ["who", "year", "rel"], "left")
        .select(
            "year",
            "who",
            "rel",
            F.col("n").cast("bigint").alias("n_members"),
            (F.coalesce("total", F.lit(0)) / F.col("n")).alias("mean_degree"),
            (100.0 * (F.col("n") - F.coalesce("touched", F.lit(0))) / F.col("n")).alias("zero_pct"),
        )
    )


def density_wide(density: DataFrame, who: str, relations: Sequence[str]) -> DataFrame:
    """One row per year with a mean and a zero-share column per relation."""
    return (
        density.where(F.col("who") == who)
        .groupBy("year", "n_members")
        .pivot("rel", list(relations))
        .agg(F.max("mean_degree").alias("mean"), F.max("zero_pct").alias("zero_pct"))
    )


def neighbor_aggregate(
    edges: DataFrame, features: DataFrame, columns: Sequence[str], hops: int = 1, settle_every: int = 2
) -> DataFrame:
    """k rounds of neighbour means pulled to the destination, averaged over relations.

    A node without incoming edges keeps its own values. Sibling memberships use
    (sum of the group - own) / (members - 1), so no sibling pairs are formed.
    """
    state = features.select("id", *[F.col(c).cast("double").alias(c) for c in columns])
    plain = edges.where(F.col("rel") != "r_sib").select("src", "dst", "rel")
    links = edges.where(F.col("rel") == "r_sib").select("src", F.col("dst").alias("_g"), "rel")
    for hop in range(1, hops + 1):
        pulled = (
            plain.join(state, plain["src"] == state["id"])
            .groupBy(F.col("dst").alias("id"), "rel")
            .agg(*[F.avg(c).alias(c) for c in columns])
        )
        members = links.join(state, links["src"] == state["id"])
        groups = members.groupBy("_g").agg(
            *[F.sum(c).alias(f"_s_{c}") for c in columns], *[F.count(c).alias(f"_n_{c}") for c in columns]
        )

        def others(c: str) -> Column:
            own = F.coalesce(F.col(c), F.lit(0.0))
            left = F.col(f"_n_{c}") - F.col(c).isNotNull().cast("int")
            return F.when(left > 0, (F.col(f"_s_{c}") - own) / left).alias(c)

        siblings = members.join(groups, "_g").select("id", "rel", *[others(c) for c in columns])
        merged = (
            pulled.unionByName(siblings)
            .groupBy("id")
            .agg(*[F.avg(c).alias(f"_new_{c}") for c in columns])
        )
        state = state.join(merged, "id", "left").select(
            "id", *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns]
        )
        if hop < hops and hop % settle_every == 0:
            state = settle(state)
    return state
