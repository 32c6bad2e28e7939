"""Scalar column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom import fixed

_WHITESPACE = " \t\n\r\x0b\x0c"


def null_if_coded(
    column: Column, dtype: T.DataType, codes: Iterable = fixed.MISSING_CODES
) -> Column:
    """NULL where the value is a missing code, compared in the column's own type."""
    if isinstance(dtype, T.StringType):
        texts = sorted({str(c) for c in codes if c is not None})
        return F.when(column.isin(texts), F.lit(None)).otherwise(column)
    if isinstance(dtype, T.NumericType):
        numbers = sorted({c for c in codes if isinstance(c, (int, float))})
        if not numbers:
            return column
        return F.when(column.isin(numbers), F.lit(None)).otherwise(column)
    return column


def normalize_id(column: Column, dtype: T.DataType | None = None) -> Column:
    """Identifier as text: trimmed, without a trailing ``.0``, textual nulls as NULL."""
    text = column.cast("string")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # A whole double must not be printed in scientific notation.
        whole = column.between(-9.0e15, 9.0e15) & (column == F.floor(column))
        text = F.when(F.isnan(column), F.lit(None)).when(
            whole, column.try_cast("decimal(20,0)").cast("string")
        ).otherwise(text)
    text = F.trim(text, F.lit(_WHITESPACE))
    # The pattern runs only on the few texts that can match it.
    text = F.when(text.endswith("0") & text.contains(".0"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)
    return F.when(~text.isin(list(fixed.NULL_ID_TEXTS)), text)


def to_number(column: Column, dtype: T.DataType) -> Column:
    """Double, or NULL where the text is no number (ANSI-safe)."""
    if isinstance(dtype, T.NumericType):
        number = column.cast("double")
        return F.when(~F.isnan(number), number)
    text = F.trim(column.cast("string"), F.lit(_WHITESPACE))
    number = text.try_cast("double")
    # The cast also reads Java literals (1d, NaN, 0x1p3): only a text that ends like a
    # plain number and holds no x counts.
    last = F.substring(text, -1, 1)
    return F.when((last.between("0", "9") | (last == ".")) & ~F.lower(text).contains("x"), number)


def code_text(column: Column) -> Column:
    """Integer code as text, as node identifiers are written."""
    return column.cast("bigint").cast("string")


def floor_midpoint(a: Column, b: Column) -> Column:
    """Midpoint of two years, rounded down also below zero."""
    return F.floor((a + b) / F.lit(2)).cast("int")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clamp(x: Column, low: float | int, high: float | int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def half_even_int(x: Column) -> Column:
    """Nearest integer, halves to the even neighbour."""
    return F.bround(x, 0).cast("int")


def era_of_year(
    year: Column,
    catchup: Sequence[int] = fixed.CATCHUP_YEARS,
    late: Sequence[int] = fixed.LATE_YEARS,
) -> Column:
    return (
        F.when(year.isin(list(catchup)), "catchup")
        .when(year.isin(list(late)), "late")
        .otherwise("regular")
    )


def era_bucket(year: Column, buckets: Sequence[tuple[str, int, int]] = fixed.ERA_BUCKETS) -> Column:
    """Name of the first bucket whose inclusive range holds the year, else OTHER."""
    out = None
    for name, low, high in buckets:
        inside = year.between(low, high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return F.lit("OTHER") if out is None else out.otherwise("OTHER")


def era_id(value: Column, starts: Sequence[tuple[int, int]] = fixed.REIGN_STARTS) -> Column:
    """Id of the last boundary at or before the value; the first id below all of them."""
    ordered = sorted(starts, key=lambda s: s[1])
    out = F.lit(max(ordered[0][0], 0))
    for index, (ident, start) in enumerate(ordered):
        if index:
            out = F.when(value >= start, F.lit(ident)).otherwise(out)
    return out.cast("int")


def score_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), "na")
        .when(score >= 7, "hi")
        .when(score >= 5, "mid")
        .otherwise("lo")
    )


def pair_type(label: Column) -> Column:
    return F.when(label == 1, "gt").otherwise("pred")


def valid_code(column: Column, allowed: Sequence[int], default: int = 0) -> Column:
    """The code when it is one of ``allowed``, else ``default``."""
    return F.when(column.isin(list(allowed)), column.cast("int")).otherwise(F.lit(default))


def binary_flag(column: Column) -> Column:
    """1.0 for a present value above zero, else 0.0."""
    return F.when(column > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def flag_positive(column: Column) -> Column:
    return (F.coalesce(column, F.lit(0)) > 0).cast("int")


def row_mean(columns: Sequence[Column], missing: float | None = fixed.PRICE_MISSING) -> Column:
    """Mean of the values present in a row; NULL when none is."""
    values = F.array(*[c.cast("double") for c in columns])
    present = F.filter(
        values,
        lambda v: v.isNotNull() & ~F.isnan(v) & (F.lit(True) if missing is None else v != missing),
    )
    total = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(present) > 0, total / F.size(present))


def pick_partner(sex: Column, if_male: Column, otherwise: Column) -> Column:
    """Partner column by sex: any code but male reads the second column."""
    return F.when(sex == fixed.MALE, if_male).otherwise(otherwise)


def lineage_tag(root: Column, buckets: int = fixed.LINEAGE_BUCKETS) -> Column:
    """Stable tag of a root; the hash is the same in every run."""
    tag = F.format_string("L%03d", F.pmod(F.xxhash64(root), F.lit(buckets)))
    return F.when(root.isNull(), "L_unknown").otherwise(tag)


def same_lineage(a: Column, b: Column, unknown: str = "L_unknown") -> Column:
    return F.coalesce((a == b) & (a != unknown), F.lit(False))


def epoch_seconds(column: Column, dtype: T.DataType) -> Column:
    """Seconds as double from a timestamp (with or without zone) or a number of seconds."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return column.cast("timestamp").cast("double")
    return column.cast("double")
