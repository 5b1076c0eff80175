"""A roll-up kept as streaming state: no history is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.config import session_settings
from tidemark.operators.incremental import RollUp, part_upsert
from tidemark.schemas import CUSTOMER
from tidemark.sources.tables import backing, replace_table, session_buckets

# State lies on disk and leaves a task as a change log, so it may outgrow its memory.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def stream_state(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    target: str,
    roll_up: RollUp,
    checkpoint: str,
    buckets: int = 0,
    files_per_batch: int | None = None,
    key: str = CUSTOMER,
) -> None:
    """Take in the Parquet files waiting in `landing` and bring `target` up to date.

    `roll_up` is one aggregation by `key`. Spark keeps its buffers, a row per key for as long
    as the stream lives: a roll-up over all time has no point from which on a late row does
    not count, so there is no watermark. A micro-batch yields the rows of the keys it
    touched, and only the parts of the target that hold them are replaced. A batch that is
    run again yields the same rows, so a restart after any failure ends in the same target.
    """

    def take_in(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        if session.catalog.tableExists(target):
            part_upsert(session, target, batch, key)
        else:
            replace_table(batch, target, key, buckets or session_buckets(session), in_parts=True)

    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    with session_settings(spark, STATE_STORE):
        running = (
            roll_up(reader.parquet(landing))
            .writeStream.outputMode("update")
            .foreachBatch(take_in)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        running.awaitTermination()
    # Batches ran in a session of their own; this one may know files that were replaced.
    table = backing(spark, target)
    if table is not None:
        spark.catalog.refreshTable(table)
