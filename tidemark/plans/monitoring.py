"""Run durations and row counts, with the conditions that call for attention."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Clock
from tidemark.operators.summaries import table_counts

# Fixed alert limits: minutes a run may take, days looked back, rows a table needs.
LONG_RUN_MINUTES, LOOK_BACK_DAYS, FEWEST_ROWS = 60, 7, 1000


def run_durations(
    log: DataFrame,
    prefix: str,
    clock: Clock = Clock(),
    days: int = LOOK_BACK_DAYS,
    limit_minutes: int = LONG_RUN_MINUTES,
) -> DataFrame:
    """Recent runs of the jobs with the name prefix, newest first, whole minutes."""
    recent = F.col("start_time") >= F.date_sub(clock.today(), days).cast("timestamp")
    return (
        log.where(F.col("job_name").startswith(prefix) & recent)
        .select(
            "job_id",
            "job_name",
            "start_time",
            "end_time",
            F.expr("timestampdiff(MINUTE, start_time, end_time)").alias("duration_minutes"),
            "state",
        )
        .withColumn("is_long", F.coalesce(F.col("duration_minutes") > limit_minutes, F.lit(False)))
        .orderBy(F.desc("start_time"), F.asc("job_id"))
    )


def row_counts(
    tables: Mapping[str, DataFrame],
    clock: Clock = Clock(),
    fewest: int = FEWEST_ROWS,
    previous: DataFrame | None = None,
    drop_share: float = 0.1,
) -> DataFrame:
    """Rows per table, when counted, and whether that is too few.

    With the `previous` report, `dropped` says whether the count fell by more than
    `drop_share` since.
    """
    report = table_counts(tables).select(
        "table_name",
        "row_count",
        clock.instant().cast("timestamp").alias("check_time"),
        (F.col("row_count") < fewest).alias("is_low"),
    )
    if previous is None:
        return report
    before = previous.select("table_name", F.col("row_count").alias("previous_count"))
    fell = F.col("row_count") < F.col("previous_count") * (1 - drop_share)
    return report.join(before, "table_name", "left").withColumn(
        "dropped", F.coalesce(fell, F.lit(False))
    )
