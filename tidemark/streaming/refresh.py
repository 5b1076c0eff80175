"""Micro-batches of raw files refresh a roll-up as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.incremental import RollUp, changed_keys, recompute, upsert
from tidemark.schemas import CUSTOMER
from tidemark.sources.shared import materialise
from tidemark.sources.tables import bucket_count, replace_table, session_buckets

BATCH = "_batch"


def stream_refresh(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    history: str,
    target: str,
    roll_up: RollUp,
    checkpoint: str,
    buckets: int = 0,
    files_per_batch: int | None = None,
    key: str = CUSTOMER,
) -> None:
    """Take in the Parquet files waiting in `landing` and bring `target` up to date.

    Each micro-batch is stored under `history` in a folder of its own number, then
    the full history of the customers in it is rolled up again and upserted. Late
    rows therefore count like any others. A batch that is run again overwrites its
    folder and recomputes the same customers, so a restart after any failure ends
    in the same target.
    """

    def take_in(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{history}/{BATCH}={number}")
        stored = session.read.schema(_with_batch(schema)).parquet(history)
        # A later batch's folder can only exist after a restart further back.
        stored = stored.where(F.col(BATCH) <= number)
        raw = stored.drop(BATCH)
        keys = materialise(changed_keys(stored.where(F.col(BATCH) == number), key=key), "batch")
        delta = recompute(raw, keys, roll_up, key)
        files = buckets or session_buckets(session)
        known = session.catalog.tableExists(target)
        arranged = known and bucket_count(session, target) == files
        if known:
            delta = upsert(session.table(target), delta, key, files)
        replace_table(delta, target, key, files, arranged=arranged)

    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    running = (
        reader.parquet(landing)
        .writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BATCH, T.IntegerType(), True)])
