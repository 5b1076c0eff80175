"""Catalog tables: bronze views, full replacement, batch append, audit tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.parts import LOAD, PART, bucket_of, laid_out, property_of, set_properties


def bronze(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)


def register_bronze(spark: SparkSession, views: Mapping[str, str]) -> None:
    """Pass-through views: `views` maps view name to raw table."""
    for view, table in views.items():
        spark.table(table).createOrReplaceTempView(view)


def _generation(spark: SparkSession, name: str) -> int | None:
    """Number of the backing table the view `name` shows; None when there is no view."""
    if not spark.catalog.tableExists(name):
        return None
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}")
    text = described.where("col_name = 'View Text'").select("data_type").first()
    number = text and re.search(r"__g(\d+)`?\s*$", text[0])
    if not number:
        raise ValueError(f"{name} was not published by replace_table, so it is not replaced")
    return int(number[1])


def stored(spark: SparkSession, name: str) -> DataFrame:
    """The backing table `name` shows now; unlike the view it knows its files."""
    return spark.table(f"{name}__g{_generation(spark, name)}")


def backing(spark: SparkSession, name: str) -> str | None:
    """Name of the backing table `name` shows now, if `name` exists."""
    generation = _generation(spark, name)
    return None if generation is None else f"{name}__g{generation}"


def bucket_count(spark: SparkSession, name: str) -> int:
    """Buckets of the backing table `name` shows now; 0 if there are none."""
    generation = _generation(spark, name)
    if generation is None:
        return 0
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}__g{generation}")
    found = described.where("col_name = 'Num Buckets'").first()
    return int(found["data_type"]) if found else 0


def no_rows(spark: SparkSession, schema: StructType) -> DataFrame:
    """An empty table, made without Python workers: those of an empty list take seconds to start."""
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def one_row(spark: SparkSession, row: Sequence[object], schema: StructType) -> DataFrame:
    """A single row of literals, likewise without Python workers."""
    return spark.range(1).select(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema, strict=True)))


def session_buckets(spark: SparkSession) -> int:
    """Files of a table nobody chose a number for: as many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def replace_table(
    df: DataFrame,
    name: str,
    bucket_key: str | None = None,
    buckets: int = 0,
    arranged: bool = False,
    in_parts: bool = False,
    partition_by: str | None = None,
    observe: tuple[Observation, list[Column]] | None = None,
) -> None:
    """Full replacement that may read the table it replaces and may change its schema.

    The rows go to a backing table with the next number, then the view `name` is
    pointed at it. Readers see the old or the new content, never a partial one, and
    a job lost halfway leaves the live table alone. The content replaced stays until
    the next replacement, for readers already running. One writer per name.

    With `bucket_key` the table is bucketed and sorted on it: rows are sent to
    their bucket first, so each bucket is one file, and later joins and
    aggregations on the key need no shuffle. `arranged` says that the partitions of
    `df` already follow the buckets, which saves sending the rows; were it untrue,
    the table would only have more files. `in_parts` also gives each bucket a partition
    of its own, so that `parts.replace_parts` can replace single ones; the view hides
    that column. `observe` measures the rows as they are written, behind the last shuffle:
    in the writing stage a task counts once, however often it is tried.
    """
    spark = df.sparkSession
    live = _generation(spark, name) or 0
    rows = df if arranged or bucket_key is None else df.repartition(buckets, bucket_key)
    if observe is not None:
        rows = rows.observe(observe[0], *observe[1])
    writer = rows.write
    if bucket_key is not None:
        if in_parts:
            rows = rows.withColumn(PART, bucket_of(bucket_key, buckets))
        writer = rows.write.bucketBy(buckets, bucket_key).sortBy(bucket_key)
        if in_parts:
            writer = writer.partitionBy(PART)
    elif partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.mode("overwrite").format("parquet").saveAsTable(f"{name}__g{live + 1}")
    publish(spark, name, live + 1)
    _drop_older(spark, name, live)


def publish(spark: SparkSession, name: str, generation: int) -> None:
    """Point the view `name` at a backing table, without the columns of its layout."""
    backing = f"{name}__g{generation}"
    shown = [c for c in spark.table(backing).columns if c not in (LOAD, PART)]
    listed = ", ".join(f"`{c}`" for c in shown)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {listed} FROM {backing}")


def _drop_older(spark: SparkSession, name: str, live: int) -> None:
    """Drop every generation before `live`, also those a lost job left behind."""
    database, _, table = name.rpartition(".")
    where = f"IN {database} " if database else ""
    for found in spark.sql(f"SHOW TABLES {where}LIKE '{table}__g*'").collect():
        number = re.fullmatch(rf"{re.escape(table.lower())}__g(\d+)", found["tableName"].lower())
        if number and int(number[1]) < live:
            spark.sql(f"DROP TABLE IF EXISTS {name}__g{number[1]}")


def replace_facts(df: DataFrame, name: str, key: str, stamp: str, parts: int) -> None:
    """Full replacement of a fact table laid out by load day and part of its key."""
    spark = df.sparkSession
    live = _generation(spark, name) or 0
    laid_out(df, key, stamp, parts).write.partitionBy(LOAD, PART).mode("overwrite").format("parquet").saveAsTable(
        f"{name}__g{live + 1}"
    )
    set_properties(spark, f"{name}__g{live + 1}", parts=str(parts))
    publish(spark, name, live + 1)
    _drop_older(spark, name, live)


def fact_parts(spark: SparkSession, name: str) -> int:
    """Parts of a fact table; 0 if it is not laid out so."""
    generation = _generation(spark, name)
    found = property_of(spark, f"{name}__g{generation}", "parts") if generation else None
    return int(found or 0)


def append_facts(df: DataFrame, name: str, key: str, stamp: str, parts: int) -> None:
    """Add a load to a fact table laid out by load day and part, or create it.

    The number of parts is the table's; `parts` counts for a new one. A table stored in
    another layout keeps it. A load that is lost halfway leaves nothing, since files count
    when their job commits.
    """
    spark = df.sparkSession
    live = _generation(spark, name)
    if live is None:
        replace_facts(df, name, key, stamp, parts)
        return
    known = spark.table(f"{name}__g{live}")
    if PART not in known.columns:
        append_batch(df, name)
        return
    rows = laid_out(df, key, stamp, fact_parts(spark, name)).select(known.columns)
    rows.write.partitionBy(LOAD, PART).mode("append").format("parquet").saveAsTable(f"{name}__g{live}")


def append_batch(df: DataFrame, name: str) -> None:
    """Add one ingest batch to the backing table of `name`, or create it."""
    live = _generation(df.sparkSession, name)
    if live is None:
        replace_table(df, name)
    else:
        df.write.mode("append").format("parquet").saveAsTable(f"{name}__g{live}")


def write_audit(violations: DataFrame, rule_id: str, database: str) -> str:
    """Store a rule's failing rows; the table holds the latest run only."""
    table = f"{database}.{rule_id}"
    violations.write.mode("overwrite").saveAsTable(table)
    return table


def drop_audit(spark: SparkSession, rule_ids: Iterable[str], database: str) -> None:
    """Remove the rows an earlier run left for rules that now pass."""
    left = {table.name for table in spark.catalog.listTables(database)}
    for rule_id in left.intersection(r.lower() for r in rule_ids):
        spark.sql(f"DROP TABLE {database}.{rule_id}")
