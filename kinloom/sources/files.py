"""File sources and sinks, all through Spark's own readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinloom import fixed

PAIR_STRUCT = (
    "struct<id:int,husband_id:string,wife_id:string,label:int,score:double,score_gap:double,"
    "rank_of_true_wife:int,hungarian_correct:boolean,lineage_husband:string,lineage_wife:string,"
    "same_lineage:boolean,era:string,patri_path_count:int,z:array<float>>"
)
COHORT_SCHEMA = (
    f"year int, n_pairs int, pairs array<{PAIR_STRUCT}>, mds_coords array<array<double>>, "
    "clusters array<int>, k_clusters int, ablation string, train_ref_coords array<array<double>>, train_ref_n int"
)


def panel_schema(columns: Sequence[str] | None = None) -> T.StructType:
    """Raw register schema: everything arrives as text and is coerced by ``clean_panel``."""
    names = columns or ("RECORD_NUMBER", *fixed.ID_COLUMNS, *fixed.NUMERIC_COLUMNS, "RELATIONSHIP")
    return T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(names)])


def read_panel(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, partitions: int | None = None
) -> DataFrame:
    """CSV register with a header, plain or gzip.

    One gzip file is read by one task, so ``partitions`` spreads the rows before further
    work; a register given as many files is read in parallel as it is.
    """
    reader = spark.read.option("header", "true").option("mode", "PERMISSIVE")
    out = reader.schema(schema if schema is not None else panel_schema()).csv(path)
    return out.repartition(partitions) if partitions else out


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet, with the column list pushed into the scan."""
    out = spark.read.parquet(path)
    return out.select(*columns) if columns else out


def _flat_pairs(raw: DataFrame) -> DataFrame:
    rows = raw.select(
        "year", "ablation", F.explode(F.arrays_zip("pairs", "mds_coords", "clusters")).alias("_p")
    )
    return rows.select(
        "year", "ablation", "_p.pairs.*",
        F.col("_p.mds_coords")[0].alias("x"), F.col("_p.mds_coords")[1].alias("y"),
        F.col("_p.clusters").alias("cluster"),
    )


def read_cohort_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Cohort payloads as flat pair rows; the aligned arrays are zipped by position.

    ``multi_line`` reads one document per file; without it every line is a document, and
    large files are split.
    """
    reader = spark.read.schema(COHORT_SCHEMA).option("multiLine", str(multi_line).lower())
    return _flat_pairs(reader.json(path))


def read_reference_points(spark: SparkSession, path: str) -> DataFrame:
    """Training reference coordinates of cohort payloads."""
    raw = spark.read.schema(COHORT_SCHEMA).option("multiLine", "true").json(path)
    points = raw.select("year", "ablation", F.explode("train_ref_coords").alias("_c"))
    return points.select("year", "ablation", F.col("_c")[0].alias("x"), F.col("_c")[1].alias("y"))


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges by relation, sorted by time within files so that as-of filters skip row groups.

    Spark evens out the write tasks by size: a large relation is split over as many as its
    bytes need, small ones stay in one.
    """
    edges.hint("rebalance", "rel").sortWithinPartitions("rel", "t").write.mode("overwrite").partitionBy("rel").parquet(path)


def write_cohort(pairs: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One artefact per (year, ablation); a new run replaces only the cohorts it holds."""
    (
        pairs.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "ablation")
        .format(fmt)
        .save(path)
    )


def write_metrics(summary: DataFrame, per_cohort: dict[str, DataFrame], path: str, ablate: bool) -> None:
    """Summary as JSON and the per-cohort reports as CSV with ``pass`` and ``ablate``."""
    summary.withColumn("ablate", F.lit(ablate)).write.mode("overwrite").json(f"{path}/summary")
    parts = [df.withColumn("pass", F.lit(name)) for name, df in per_cohort.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    out.withColumn("ablate", F.lit(ablate)).write.mode("overwrite").option("header", "true").csv(
        f"{path}/per_cohort"
    )


def write_comparison(compared: DataFrame, path: str) -> None:
    """Delta table as JSON and as Markdown rows."""
    from kinloom.operators.metrics import comparison_lines

    compared.write.mode("overwrite").json(f"{path}/comparison_json")
    lines = comparison_lines(compared).select("line")
    lines.write.mode("overwrite").text(f"{path}/comparison_md")
