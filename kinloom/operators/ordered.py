"""Ordered computations that stay distributed when one group is huge.

A window partitioned by a group puts the whole group into one task. The operators here
cut every group into slices first, work inside a slice, and carry one summary row per
slice to the next: either slices named by the caller (a column that never decreases along
the order, such as a date), or slices taken from a range partitioning of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.session import settle, shuffle_width

Order = Sequence[str | Column]


def columns_of(order: Order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def with_scalar(df: DataFrame, name: str, one_row: DataFrame) -> DataFrame:
    """Add the single value of a one-row table as a column.

    The value is planned once as a scalar subquery and read by name afterwards; repeating
    the subquery in every expression would plan it again each time.
    """
    return df.withColumn(name, one_row.scalar())


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys appear once."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def nulls_last(order: Sequence[str]) -> Column:
    """The order as one comparable struct in which a missing value comes after all others."""
    return F.struct(*[part for c in order for part in (F.col(c).isNull().alias(f"_n_{c}"), F.col(c))])


def first_row(df: DataFrame, group: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First whole row per group, rows without an order value last: one aggregate with
    map-side combine, no window."""
    picked = df.groupBy(*group).agg(F.min_by(F.struct(*keep), nulls_last(order)).alias("_first"))
    return picked.select(*group, *[F.col("_first")[c].alias(c) for c in keep])


def last_row(df: DataFrame, group: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Last whole row per group: one aggregate with map-side combine, no window."""
    picked = df.groupBy(*group).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_last"))
    return picked.select(*group, *[F.col("_last")[c].alias(c) for c in keep])


def sliced(df: DataFrame, group: Sequence[str], order: Order, slices: int | None = None) -> DataFrame:
    """Rows range-partitioned by (group, order) with their slice number in ``_slice``.

    The result is settled: a sampled range partitioning is only usable by two branches of
    a plan, or after the loss of an executor, when it has been written once.
    ``order`` should end in a unique column, since equal keys cannot be split.
    """
    width = slices or shuffle_width(df.sparkSession)
    ranged = df.repartitionByRange(width, *[F.col(g) for g in group], *columns_of(order))
    return settle(ranged.withColumn("_slice", F.spark_partition_id()))


def _carried(
    df: DataFrame, group: Sequence[str], slice_keys: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """Sums over all earlier slices of the same group, one row per (group, slice)."""
    totals = df.groupBy(*group, *slice_keys).agg(
        *[F.sum(expr).alias(f"_before_{name}") for name, expr in sums.items()]
    )
    before = (
        Window.partitionBy(*group)
        .orderBy(*slice_keys)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *group,
        *slice_keys,
        *[F.sum(f"_before_{n}").over(before).alias(f"_before_{n}") for n in sums],
    )


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Order,
    sums: Mapping[str, Column],
    slice_by: Sequence[str] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Cumulative sums along ``order`` within ``group`` (current row included)."""
    keys = list(slice_by) if slice_by else ["_slice"]
    base = df if slice_by else sliced(df, group, order, slices)
    inside = (
        Window.partitionBy(*group, *keys)
        .orderBy(*columns_of(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = base.select("*", *[F.sum(e).over(inside).alias(f"_here_{n}") for n, e in sums.items()])
    joined = join_null_safe(local, _carried(base, group, keys, sums), [*group, *keys], "left")
    for name in sums:
        zero = F.lit(0)
        joined = joined.withColumn(
            name,
            F.coalesce(F.col(f"_before_{name}"), zero) + F.coalesce(F.col(f"_here_{name}"), zero),
        )
    drop = [f"_before_{n}" for n in sums] + [f"_here_{n}" for n in sums]
    return joined.drop(*drop, *([] if slice_by else ["_slice"]))


def numbered(
    df: DataFrame,
    group: Sequence[str],
    order: Order,
    name: str = "rn",
    start: int = 1,
    slices: int | None = None,
    dear: bool = False,
) -> DataFrame:
    """Exact row number per group along ``order``; no group is held by one task.

    Rows are dealt by range, sorted and counted where they lie, and written once; one row per
    group and slice then tells at which number the slice begins. Dealing by range asks for the
    rows twice, so those that are ``dear`` to make are written before that, too.
    """
    if dear:
        df = settle(df)
    keys = [*[F.col(g) for g in group], *columns_of(order)]
    ranged = df.repartitionByRange(slices or shuffle_width(df.sparkSession), *keys).sortWithinPartitions(*keys)
    base = settle(ranged.withColumn("_slice", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    starts = base.groupBy(*group, "_slice").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + F.lit(start)
    # Written, too: Spark then knows that they are few, and leaves the rows where they are.
    starts = settle(starts.select(*group, "_slice", offset.alias("_offset")))
    joined = join_null_safe(base, starts, [*group, "_slice"], "left")
    return joined.withColumn(name, (F.col("_at") + F.col("_offset")).cast("bigint")).drop("_at", "_offset", "_slice")


def lagged(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    name: str = "prev",
    slice_by: Sequence[str] | None = None,
) -> DataFrame:
    """The immediately previous row of the group as a struct column (NULL on the first).

    Rows without an order value come last, as in ``first_row``.

    ``slice_by`` is a prefix of the order (default: its first column). Rows are lagged
    within (group, slice); the first row of a slice takes the last row of the slice
    before, found among one row per slice.
    """
    keys = list(slice_by) if slice_by else [order[0]]
    inside = Window.partitionBy(*group, *keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    across = Window.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_last() for c in keys])
    local = df.withColumn("_lag", F.lag(F.struct(*fields)).over(inside))
    ends = df.groupBy(*group, *keys).agg(
        F.max_by(F.struct(*fields), nulls_last(order)).alias("_end")
    )
    ends = ends.withColumn("_carry", F.lag("_end").over(across)).drop("_end")
    joined = join_null_safe(local, ends, [*group, *keys], "left")
    return joined.withColumn(name, F.coalesce("_lag", "_carry")).drop("_lag", "_carry")


def exact_percentiles(
    df: DataFrame, column: str, percents: Sequence[float], name: str = "value"
) -> DataFrame:
    """Linearly interpolated percentiles, exact and without holding the column in memory.

    Counts per distinct value are accumulated over range slices; each percentile then
    needs the two order statistics around it, found by a conditional minimum.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ranked = running_sums(counts, [], [column], {"upto": F.col("n")})
    ranked = with_scalar(ranked, "_total", df.agg(F.count(column)))
    aggregates = []
    for i, p in enumerate(percents):
        position = F.lit(float(p)) / 100.0 * (F.col("_total") - 1)
        for tag, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            aggregates.append(F.min(F.when(F.col("upto") > at, F.col(column))).alias(f"{tag}{i}"))
        aggregates.append(F.max(position - F.floor(position)).alias(f"w{i}"))
    one = ranked.agg(*aggregates)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("level"),
                F.lit(float(p)).alias("percent"),
                (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias(name),
            )
            for i, p in enumerate(percents)
        ]
    )
    return one.select(F.inline(rows))
