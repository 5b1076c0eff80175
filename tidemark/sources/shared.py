"""Folder all executors can reach, and tables written there.

The cluster names the folder in `spark.checkpoint.dir`. Only a local session
without that setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder every executor can reach")
    app = context.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _local[app]


def table_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/tidemark/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage at storage that outlives an executor, and gives the planner
    the true size: a join with the result is a broadcast only when its bytes are
    below `spark.sql.autoBroadcastJoinThreshold`, and a shuffle join otherwise.
    """
    spark = df.sparkSession
    path = table_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
