"""Uniqueness and references of a load, checked against a stored index of keys.

The index holds a row per key and load and is bucketed by key. A load is counted per key and
sent to the buckets; the index is read where it lies, never shuffled, and grows by appending
the load's keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import backing, bucket_count, replace_table

KEY, N, LOADED = "key", "n_rows", "load"


def load_keys(load: DataFrame, key: str, number: int) -> DataFrame:
    """(key, n_rows, load): keys of a load, NULLs left out; a hot key is one row per task."""
    keys = load.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(KEY))
    return keys.agg(F.count("*").alias(N)).withColumn(LOADED, F.lit(number).cast("int"))


def index_keys(spark: SparkSession, name: str, keys: DataFrame, buckets: int = 0) -> None:
    """Add a load's keys to the index `name`, or create it with `buckets` buckets."""
    table = backing(spark, name)
    if table is None:
        replace_table(keys, name, KEY, buckets)
        return
    files = bucket_count(spark, name)
    rows = keys.select(spark.table(table).columns).repartition(files, KEY)
    rows.write.bucketBy(files, KEY).sortBy(KEY).format("parquet").mode("append").saveAsTable(table)


def repeats(spark: SparkSession, name: str, keys: DataFrame) -> DataFrame:
    """(key, n_rows, n_before): keys of a load that occur twice in it or were indexed by an
    earlier load; `n_before` is their number of rows there."""
    files = bucket_count(spark, name)
    number = F.col("i.load") < F.col("k.load")
    before = spark.table(backing(spark, name)).alias("i")
    sent = keys.repartition(files, KEY).alias("k")
    both = sent.join(before, (F.col("k.key") == F.col("i.key")) & number, "left")
    found = both.groupBy(F.col("k.key").alias(KEY)).agg(
        F.max("k.n_rows").alias(N), F.coalesce(F.sum("i.n_rows"), F.lit(0)).alias("n_before")
    )
    return found.where((F.col(N) > 1) | (F.col("n_before") > 0))


def unknown(spark: SparkSession, name: str, keys: DataFrame) -> DataFrame:
    """(key, n_rows): keys of a load the index `name` of their parent lacks."""
    known = spark.table(backing(spark, name)).select(KEY)
    return keys.repartition(bucket_count(spark, name), KEY).join(known, KEY, "left_anti").select(KEY, N)
