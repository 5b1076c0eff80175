"""Quantile sketches per load that are kept and merged, so a load is read once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.parts import overwrite_partitions
from tidemark.sources.shared import table_folder
from tidemark.sources.tables import backing, replace_table

# Values a sketch keeps, about; its rank error is near 0.1 % at this size.
SKETCH_SIZE = 4096
RANK_ERROR = 0.005


def load_sketches(df: DataFrame, value: str, load: str, size: int = SKETCH_SIZE) -> DataFrame:
    """(load, n_values, sketch): one row per load. NULL values are left out; sketches of
    tasks are merged behind the shuffle, so a load of any size is a row per task."""
    present = df.where(F.col(value).isNotNull()).withColumn("_value", F.col(value).cast("double"))
    return present.groupBy(F.col(load).alias("load")).agg(
        F.count("*").alias("n_values"), F.kll_sketch_agg_double("_value", F.lit(size)).alias("sketch")
    )


def keep_sketches(sketches: DataFrame, name: str) -> None:
    """Add the sketches of new loads to a stored table; a load that is there is replaced."""
    spark = sketches.sparkSession
    table = backing(spark, name)
    rows = sketches.select("n_values", "sketch", "load")
    if table is None:
        replace_table(rows, name, partition_by="load")
        return
    path = table_folder(spark, "sketches")
    rows.write.parquet(path)
    overwrite_partitions(spark, table, path)


def merged(sketches: DataFrame) -> DataFrame:
    """(n_values, n_loads, sketch): all loads as one, no rows for no loads."""
    return sketches.agg(
        F.sum("n_values").alias("n_values"),
        F.count("*").alias("n_loads"),
        F.kll_merge_agg_double("sketch").alias("sketch"),
    ).where("n_loads > 0")


def quantiles(sketches: DataFrame, percents: Sequence[int]) -> DataFrame:
    """(percentile, estimate, n_values, n_loads) from kept sketches alone."""
    ranks = F.array(*(F.lit(p / 100) for p in percents))
    rows = merged(sketches).select(
        F.posexplode(F.kll_sketch_get_quantile_double("sketch", ranks)).alias("at", "estimate"), "n_values", "n_loads"
    )
    percent = F.element_at(F.array(*(F.lit(p) for p in percents)), F.col("at") + 1)
    return rows.select(percent.alias("percentile"), "estimate", "n_values", "n_loads")


def within_rank_bounds(
    estimates: DataFrame, df: DataFrame, value: str, percents: Sequence[int], error: float = RANK_ERROR
) -> DataFrame:
    """(percentile, n_values, n_loads, within): whether the true ranks of each estimate
    meet its percentile up to `error` of the rows. One scan for all percentiles."""
    found = {r["percentile"]: r for r in estimates.collect()}  # a row per percentile
    x = F.col(value).cast("double")

    def ranks(p: int) -> list[Column]:
        e = F.lit(found[p]["estimate"])
        return [F.count_if(x < e).alias(f"below_{p}"), F.count_if(x <= e).alias(f"upto_{p}")]

    known = [p for p in percents if p in found]
    if not known:
        return estimates.select("percentile", "n_values", "n_loads", F.lit(True).alias("within"))
    counted = df.agg(*(c for p in known for c in ranks(p)))

    def line(p: int) -> Column:
        n = found[p]["n_values"]
        low, high = (p / 100 - error) * n, (p / 100 + error) * n
        return F.struct(
            F.lit(p).alias("percentile"),
            F.lit(n).cast("long").alias("n_values"),
            F.lit(found[p]["n_loads"]).cast("long").alias("n_loads"),
            ((F.col(f"below_{p}") <= high) & (F.col(f"upto_{p}") >= low)).alias("within"),
        )

    return counted.select(F.inline(F.array(*(line(p) for p in known))))
