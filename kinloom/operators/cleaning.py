"""Cleaning, identity and data-quality operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom import fixed
from kinloom.functions import scalars as S
from kinloom.operators.ordered import numbered


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def _present(df: DataFrame, wanted: Iterable[str]) -> set[str]:
    wanted = {w.upper() for w in wanted}
    return {c for c in df.columns if c.upper() in wanted}


def null_missing_codes(df: DataFrame, codes: Iterable = fixed.MISSING_CODES) -> DataFrame:
    """NULL for every coded missing value in every column, in value and text form."""
    types = _types(df)
    return df.select(*[S.null_if_coded(F.col(c), types[c], codes).alias(c) for c in df.columns])


def normalize_ids(df: DataFrame, columns: Sequence[str] = fixed.ID_COLUMNS) -> DataFrame:
    """Normalise whichever of the identifier columns exist."""
    types, ids = _types(df), _present(df, columns)
    return df.select(
        *[(S.normalize_id(F.col(c), types[c]) if c in ids else F.col(c)).alias(c) for c in df.columns]
    )


def coerce_numeric(df: DataFrame, columns: Sequence[str] = fixed.NUMERIC_COLUMNS) -> DataFrame:
    """Doubles; NULL where a value cannot be read as a number."""
    types, numeric = _types(df), _present(df, columns)
    return df.select(
        *[(S.to_number(F.col(c), types[c]) if c in numeric else F.col(c)).alias(c) for c in df.columns]
    )


def decode_factors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Categorical columns as text."""
    factors = _present(df, columns)
    return df.select(
        *[(F.col(c).cast("string") if c in factors else F.col(c)).alias(c) for c in df.columns]
    )


def clean_panel(
    df: DataFrame,
    factors: Sequence[str] = (),
    codes: Iterable = fixed.MISSING_CODES,
    id_columns: Sequence[str] = fixed.ID_COLUMNS,
    numeric_columns: Sequence[str] = fixed.NUMERIC_COLUMNS,
) -> DataFrame:
    """Decode, null, normalise and coerce; Catalyst folds the steps into one projection."""
    out = decode_factors(df, factors)
    out = null_missing_codes(out, codes)
    out = normalize_ids(out, id_columns)
    return coerce_numeric(out, numeric_columns)


# -- checks ---------------------------------------------------------------------------


class CheckFailed(ValueError):
    """A check found rows that break the contract."""


# The columns every pair of a scored cohort must have; of these, three may be empty.
PAIR_COLUMNS = (
    "id", "husband_id", "wife_id", "label", "score", "score_gap", "rank_of_true_wife", "hungarian_correct",
    "lineage_husband", "lineage_wife", "same_lineage", "era", "patri_path_count", "z",
)
MAY_BE_NULL = ("rank_of_true_wife", "hungarian_correct", "score_gap")


def validate_pairs(
    df: DataFrame,
    required: Sequence[str] = PAIR_COLUMNS,
    numbers: Sequence[str] = ("score", "score_gap"),
    vector: str | None = "z",
    raise_on_error: bool = False,
    cohort: Sequence[str] = (),
    may_be_null: Sequence[str] = MAY_BE_NULL,
) -> DataFrame:
    """One row per rule of the pair contract: rule, number of offending rows, ok.

    Rules: required columns exist, and hold no null unless they may; ids run from 0 without
    gaps; numbers are finite; the vector is there and not empty; rank and correctness only on
    positives. Ids are judged within each cohort (columns ``cohort``; by default those of
    year and ablation that the table has), and offences are added up over cohorts.
    """
    columns = set(df.columns)
    cohort = [c for c in (cohort or ("year", "ablation")) if c in columns]
    rules: dict[str, Column] = {}
    absent = [name for name in dict.fromkeys([*required, *([vector] if vector else [])]) if name not in columns]
    for name in required:
        if name in columns and name not in may_be_null:
            rules[f"null:{name}"] = F.count_if(F.col(name).isNull())
    for name in numbers:
        if name in columns:
            value = F.col(name).cast("double")
            rules[f"not_finite:{name}"] = F.count_if(
                F.isnan(value) | value.isin(float("inf"), float("-inf"))
            )
    if "id" in columns:
        rules["id_range"] = (
            F.coalesce(F.max("id") + 1, F.lit(0)) - F.count_distinct("id") + F.abs(F.coalesce(F.min("id"), F.lit(0)))
        )
        rules["id_duplicates"] = F.count("id") - F.count_distinct("id")
    if vector and vector in columns:
        rules[f"empty_vector:{vector}"] = F.count_if(
            F.col(vector).isNull() | (F.size(vector) == 0)
        )
    for name in ("rank_of_true_wife", "hungarian_correct"):
        if name in columns and "label" in columns:
            rules[f"only_on_positives:{name}"] = F.count_if(
                F.col(name).isNotNull() & (F.col("label") != 1)
            )
    counted = df.groupBy(*cohort).agg(*[F.abs(r.cast("bigint")).alias(f"r{i}") for i, r in enumerate(rules.values())])
    total = counted.agg(F.count("*").alias("_cohorts"), *[F.coalesce(F.sum(f"r{i}"), F.lit(0)).alias(f"r{i}") for i in range(len(rules))])
    values = {f"missing_column:{name}": F.lit(int(name in absent)).cast("bigint") for name in dict.fromkeys([*required, *absent])}
    values |= {name: F.col(f"r{i}") for i, name in enumerate(rules)}
    rows = F.array(
        *[F.struct(F.lit(name).alias("rule"), n.alias("n_bad"), (n == 0).alias("ok")) for name, n in values.items()]
    )
    report = total.select(F.inline(rows))
    if raise_on_error:
        bad = report.where(~F.col("ok")).collect()  # at most one row per rule
        if bad:
            raise CheckFailed("; ".join(f"{r['rule']}={r['n_bad']}" for r in bad))
    return report


def check_year_gaps(
    df: DataFrame, column: str, low: int, high: int, raise_on_error: bool = False
) -> DataFrame:
    """Years of [low, high] that the table does not contain."""
    calendar = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("year"))
    seen = df.select(F.col(column).cast("int").alias("year")).distinct()
    gaps = calendar.join(seen, "year", "left_anti")
    if raise_on_error:
        years = [r["year"] for r in gaps.orderBy("year").collect()]  # bounded by the calendar
        if years:
            raise CheckFailed(f"missing years: {years[:10]}{'…' if len(years) > 10 else ''}")
    return gaps


def coverage_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-null count, row count and share per column, in long form."""
    columns = list(columns or df.columns)
    counted = df.agg(
        F.count("*").alias("_n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"c{i}").alias("n_present"),
                F.col("_n").alias("n_rows"),
                F.when(F.col("_n") > 0, F.col(f"c{i}") / F.col("_n")).alias("coverage"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return counted.select(F.inline(rows))


# -- identity -------------------------------------------------------------------------


def distinct_ids(df: DataFrame, column: str, integer_code: bool = False) -> DataFrame:
    """Distinct non-null ids of one node type, integer codes written as text."""
    value = S.code_text(F.col(column)) if integer_code else F.col(column).cast("string")
    return df.select(value.alias("id")).where(F.col("id").isNotNull()).distinct()


def node_table(df: DataFrame, node_columns: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """nodes(node_type, id) from (column, is integer code) per node type, read in one pass."""
    rows = F.array(
        *[
            F.struct(
                F.lit(kind).alias("node_type"),
                (S.code_text(F.col(c)) if code else F.col(c).cast("string")).alias("id"),
            )
            for kind, (c, code) in node_columns.items()
        ]
    )
    return df.select(F.inline(rows)).where(F.col("id").isNotNull()).distinct()


NODE_COLUMNS = {
    "person": ("PERSON_ID", False),
    "household": ("HOUSEHOLD_ID", False),
    "community": ("UNIQUE_VILLAGE_ID", True),
    "banner": ("REGION", True),
}


def dense_index(ids: DataFrame, column: str = "id", name: str = "idx") -> DataFrame:
    """0..n-1 in text order, numbered over range slices (never in one task)."""
    return numbered(ids, [], [column], name, start=0)


def known_ids_only(df: DataFrame, column: str, known: DataFrame, known_column: str = "id") -> DataFrame:
    """Rows whose id exists in the node set; Spark broadcasts the set only when it is small."""
    keys = known.select(F.col(known_column).alias("_known"))
    return df.join(keys, F.col(column) == F.col("_known"), "left_semi")


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count("*").alias("n"))


def attach_person_attrs(
    persons: DataFrame, latest: DataFrame, columns: Mapping[str, str], key: str = "PERSON_ID"
) -> DataFrame:
    """Latest known codes per person as ``columns`` (source -> name), -1 when unknown.

    ``latest`` holds one row per person (see ``features.latest_as_of``).
    """
    known = latest.select(key, *[F.col(c).cast("int").alias(n) for c, n in columns.items()])
    joined = persons.join(known, key, "left")
    return joined.select(key, *[F.coalesce(F.col(n), F.lit(-1)).alias(n) for n in columns.values()])


def enrich_by_record(df: DataFrame, second: DataFrame, record: str = "RECORD_NUMBER") -> DataFrame:
    """Columns of a second register joined on the record number; every row is kept."""
    extra = [c for c in second.columns if c not in df.columns]
    return df.join(second.select(record, *extra), record, "left")
