"""Compaction and clustering keep the rows and give the layout they promise."""

from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import layout
from tidemark.sources import materialise


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_compaction(spark):
    scattered = materialise(spark.range(1000).withColumn("v", F.col("id") % 7).repartition(20), "many")
    assert len(scattered.inputFiles()) == 20
    size = layout.stored_bytes(scattered)
    assert size > 0
    assert layout.target_files(scattered) == 1
    assert layout.target_files(scattered, size // 3) in (3, 4)
    few = materialise(layout.compact(scattered), "few")
    assert len(few.inputFiles()) == 1
    assert rows_of(few) == rows_of(scattered)
    plan = layout.compact(scattered)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def bounds_per_file(df, column):
    per_file = df.groupBy(F.input_file_name()).agg(F.min(column), F.max(column))
    return sorted((low, high) for _, low, high in per_file.collect())


def test_one_key_gives_disjoint_ranges(spark):
    df = spark.range(4000).select((F.col("id") * 7919 % 4001).alias("k"), F.col("id").alias("v"))
    out = materialise(layout.cluster_by(df, ["k"], 4), "ranged")
    bounds = bounds_per_file(out, "k")
    assert len(bounds) == 4
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))
    assert rows_of(out) == rows_of(df)


def test_hot_key_is_spread_over_neighbouring_files(spark):
    hot = F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 100)
    df = spark.range(9000).select(hot.alias("k"), F.col("id").alias("v"))
    out = materialise(layout.cluster_by(df, ["k"], 6), "hot")
    sizes = [r[1] for r in out.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 0.25 * 9000
    bounds = bounds_per_file(out, "k")
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))
    assert rows_of(out) == rows_of(df)


def test_two_keys_order_files_by_the_first(spark):
    df = spark.range(64 * 64).select(
        (F.col("id") % 64).alias("a"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("id") / 64).cast("int")).alias("b"),
    )
    out = materialise(layout.cluster_by(df, ["a", "b"], 16), "ordered")
    assert rows_of(out) == rows_of(df)
    bounds = bounds_per_file(out, "a")
    assert len(bounds) == 16
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))
    assert sum(low <= 5 <= high for low, high in bounds) <= 2


def test_nulls_and_repeated_cuts(spark):
    df = spark.createDataFrame([(None, 1.5), (3, None), (3, 2.5), (3, 2.5)], "a long, b double")
    assert rows_of(layout.cluster_by(df, ["a", "b"], 2)) == rows_of(df)
