"""Work per task and stored bytes when tables grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.plans import views as V
from kinloom.session import prepare


def test_tasks_get_more_when_rows_get_more(spark):
    """A task's share of a shuffle has a size, not a number of partitions."""
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = prepare(spark).range(2_000_000).select(F.xxhash64("id").alias("a"), F.hash("id").alias("b"))
        few, many = rows.limit(10), rows
        parts = [df.groupBy("a").agg(F.sum("b")).select(F.spark_partition_id().alias("p")).distinct().count() for df in (few, many)]
        assert parts[0] == 1 and 4 <= parts[1] <= 64
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)


def test_scores_shuffle_only_what_the_sums_need(spark, tmp_path, rows):
    orders = [(1, 7, "1995-01-01 00:00:00"), (2, 7, "1995-06-01 00:00:00"), (2, 7, "1995-06-01 00:00:00"), (3, None, None)]
    lines = [(1, 5, 1, 10.5, 0.1), (2, 5, 2, 20.0, 0.0), (3, 6, 1, 1.0, None), (3, 6, 2, 2.0, 0.5)]
    dated = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string")
    dated.withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    lineitem = spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double")
    lineitem.write.parquet(str(tmp_path / "lineitem.parquet"))
    assert rows(V.build_scores(spark, str(tmp_path))) == sorted([(1995, 7, 5, 49.45, 101), (None, None, 6, 1.0, 301)], key=repr)
    stored = V.scores(spark, str(tmp_path))
    assert rows(stored, "year", "h", "w", "score", "k") == rows(V.build_scores(spark, str(tmp_path)), "year", "h", "w", "score", "k")
    assert all(f.endswith(".zstd.parquet") for f in stored.inputFiles())
    below = V.build_scores(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "l_discount" not in below
