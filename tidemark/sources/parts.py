"""Tables laid out in parts by a hash of the key, and replaced part by part.

A target's part is the number of its bucket, so a part is one sorted file, the buckets stay
what joins rely on, and replacing some parts touches nothing else. Facts are laid out by
load day and part: what came after a mark is a filter on days, the history of some keys a
filter on parts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import pin_session
from tidemark.sources.shared import table_folder

LOAD, PART = "_load", "_part"
_PENDING = "pending"


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket Spark puts `key` into, out of `buckets`."""
    return F.pmod(F.hash(F.col(key)), F.lit(buckets)).cast("int")


def laid_out(facts: DataFrame, key: str, stamp: str, parts: int) -> DataFrame:
    """Facts with load day and part, gathered by both; a hot one is split by size."""
    rows = facts.withColumn(LOAD, F.col(stamp).cast("date")).withColumn(PART, bucket_of(key, parts))
    return rows.hint("rebalance", LOAD, PART)


def since(facts: DataFrame, stamp: str, mark: dt.datetime | None) -> DataFrame:
    """Facts stamped strictly after `mark`; only the days from it on are read."""
    if mark is None:
        return facts
    at = F.lit(mark if mark.tzinfo else mark.replace(tzinfo=dt.UTC))
    return facts.where((F.col(LOAD) >= at.cast("date")) & (F.col(stamp) > at))


def between(facts: DataFrame, stamp: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Facts stamped in [start, end); only the days of the window are read."""
    first, last = (F.lit(x if x.tzinfo else x.replace(tzinfo=dt.UTC)) for x in (start, end))
    days = (F.col(LOAD) >= first.cast("date")) & (F.col(LOAD) <= last.cast("date"))
    return facts.where(days & (F.col(stamp) >= first) & (F.col(stamp) < last))


def in_parts(df: DataFrame, parts: Sequence[int]) -> DataFrame:
    return df.where(F.col(PART).isin(*parts)) if parts else df.limit(0)


def touched(keys: DataFrame) -> list[int]:
    """Distinct parts of stored keys: at most as many as the table has."""
    return sorted(r[0] for r in keys.select(PART).distinct().collect())


def property_of(spark: SparkSession, table: str, name: str) -> str | None:
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == f"tidemark.{name}").collect()
    return rows[0]["value"] if rows else None


def set_properties(spark: SparkSession, table: str, **values: str) -> None:
    listed = ", ".join(f"'tidemark.{k}'='{v}'" for k, v in values.items())
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({listed})")


def replace_parts(spark: SparkSession, table: str, rows: DataFrame, **properties: str) -> None:
    """Replace the parts of `table` that occur in `rows` by those rows, nothing else.

    `rows` may read `table`. They are written to the shared folder first and named in the
    table's properties; then the parts are overwritten. A job lost between leaves a name
    behind, from which `recover` repeats the overwrite, so parts are never half new for
    the next run. `properties` are set together with the end of the replacement.
    """
    path = table_folder(spark, "parts")
    rows.select(spark.table(table).columns).write.parquet(path)
    set_properties(spark, table, **{_PENDING: path, **{f"{_PENDING}.{k}": v for k, v in properties.items()}})
    _overwrite(spark, table, path, properties)


def recover(spark: SparkSession, table: str) -> bool:
    """Repeat a replacement that was lost halfway; whether there was one."""
    path = property_of(spark, table, _PENDING)
    if not path:
        return False
    found = spark.sql(f"SHOW TBLPROPERTIES {table}").collect()
    prefix = f"tidemark.{_PENDING}."
    _overwrite(spark, table, path, {r["key"].removeprefix(prefix): r["value"] for r in found if r["key"].startswith(prefix)})
    return True


def _overwrite(spark: SparkSession, table: str, path: str, properties: dict[str, str]) -> None:
    # One file per part, as the scans that rely on its order expect.
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    overwrite_partitions(spark, table, path, lambda rows: rows.repartition(files, PART))
    set_properties(spark, table, **properties, **{_PENDING: ""})


def overwrite_partitions(
    spark: SparkSession, table: str, path: str, arrange: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> None:
    """Replace the partitions of `table` that occur in the Parquet files at `path`.

    The mode is a setting of a session of its own: set in a shared session, a run beside
    this one could switch it back before the overwrite is planned, and all other partitions
    would go.
    """
    own = spark.newSession()
    pin_session(own)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    own.catalog.setCurrentDatabase(spark.catalog.currentDatabase())
    rows = own.read.schema(own.table(table).schema).parquet(path)
    arrange(rows).write.mode("overwrite").insertInto(table)
    spark.catalog.refreshTable(table)
