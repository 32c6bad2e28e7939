"""Yearly covariates. Every table here has one row per calendar year, so windows over
the whole table hold a few hundred rows at most."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom import fixed
from kinloom.functions import scalars as S
from kinloom.operators.ordered import with_scalar


def yearly_mean(df: DataFrame, columns: Sequence[str], year: str = "YEAR", name: str = "grain_price") -> DataFrame:
    """One row per source row: the mean of the values present."""
    present = [c for c in columns if c in df.columns]
    return df.where(F.col(year).isNotNull()).select(
        F.col(year).cast("int").alias("YEAR"), S.row_mean([F.col(c) for c in present]).alias(name)
    )


def yearly_event_counts(df: DataFrame, year: str = "YEAR", name: str = "disaster_count") -> DataFrame:
    return (
        df.where(F.col(year).isNotNull())
        .groupBy(F.col(year).cast("int").alias("YEAR"))
        .agg(F.count("*").alias(name))
    )


def calendar_scaffold(low: int, high: int, *facts: DataFrame, year: str = "YEAR") -> DataFrame:
    """Every year of [low, high], left-joined with the facts."""
    if not facts:
        raise ValueError("at least one fact table is needed")
    calendar = facts[0].sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias(year))
    for fact in facts:
        calendar = calendar.join(fact, year, "left")
    return calendar


def ffill_bfill(df: DataFrame, column: str, order: str, name: str | None = None) -> DataFrame:
    """Carry the last value forward, then the first known value back to the head."""
    back = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    filled = F.coalesce(
        F.last(column, ignorenulls=True).over(back), F.first(column, ignorenulls=True).over(ahead)
    )
    return df.withColumn(name or column, filled)


def zscore(df: DataFrame, column: str, name: str, floor: float | None = None) -> DataFrame:
    """(x - mean) / sample std; a zero or missing std counts as 1 (or as ``floor``)."""
    one = df.agg(F.struct(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")))
    std = F.col("_stats")["std"]
    if floor is None:
        divisor = F.when(std.isNull() | (std == 0), F.lit(1.0)).otherwise(std)
    else:
        divisor = F.greatest(F.coalesce(std, F.lit(floor)), F.lit(floor))
    scaled = (F.col(column) - F.col("_stats")["mean"]) / divisor
    return with_scalar(df, "_stats", one).withColumn(name, scaled).drop("_stats")


def diff(df: DataFrame, column: str, order: str, name: str) -> DataFrame:
    """Change to the row before, 0 on the first row."""
    change = F.col(column) - F.lag(column).over(Window.orderBy(order))
    return df.withColumn(name, F.coalesce(change, F.lit(0.0)))


def macro_table(
    prices: DataFrame,
    events: DataFrame,
    low: int = fixed.MIN_YEAR,
    high: int = fixed.MAX_YEAR,
    starts: Sequence[tuple[int, int]] = fixed.REIGN_STARTS,
    years: Iterable[int] | DataFrame | None = None,
) -> DataFrame:
    """YEAR and the five covariates for every year of [low, high].

    ``prices`` has (YEAR, grain_price), ``events`` has (YEAR, disaster_count).
    """
    full = calendar_scaffold(low, high, prices, events)
    full = ffill_bfill(full, "grain_price", "YEAR")
    full = zscore(full, "grain_price", "grain_price_z")
    full = diff(full, "grain_price", "YEAR", "grain_price_yoy")
    full = full.withColumn("disaster_flag", S.flag_positive(F.col("disaster_count")))
    full = full.withColumn("era_id", S.era_id(F.col("YEAR"), starts))
    full = zscore(full, "YEAR", "cohort_year_z")
    out = full.select("YEAR", *fixed.MACRO_COLUMNS)
    if years is None:
        return out
    if isinstance(years, DataFrame):
        return out.join(years.select("YEAR").distinct(), "YEAR", "left_semi")
    return out.where(F.col("YEAR").isin(sorted({int(y) for y in years})))


def standardize_columns(df: DataFrame, columns: Sequence[str], floor: float = fixed.STD_FLOOR) -> DataFrame:
    """Sample z-score of each column over all rows, std floored."""
    one = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)],
        )
    )
    stats = F.col("_stats")

    def scaled(i: int, c: str) -> Column:
        std = F.greatest(F.coalesce(stats[f"s{i}"], F.lit(floor)), F.lit(floor))
        return ((F.col(c) - stats[f"m{i}"]) / std).alias(c)

    index = {c: i for i, c in enumerate(columns)}
    return with_scalar(df, "_stats", one).select(
        *[scaled(index[c], c) if c in index else F.col(c) for c in df.columns]
    )
