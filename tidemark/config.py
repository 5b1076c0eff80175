"""Thresholds, the injectable clock and session settings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


def moment(at: dt.datetime) -> Column:
    """Timestamp literal; a time without a zone is UTC."""
    return F.lit(at if at.tzinfo else at.replace(tzinfo=dt.UTC))


@dataclass(frozen=True)
class Thresholds:
    """Segment cut-offs. Fixed default values of the business definition."""

    active_days: int = 90
    at_risk_days: int = 180
    high_value: int = 150_000
    medium_value: int = 50_000
    premium_value: int = 100_000
    highly_engaged: int = 10
    moderately_engaged: int = 3
    new_days: int = 90
    growing_days: int = 365
    established_days: int = 1_095


@dataclass(frozen=True)
class Clock:
    """Business date and build time; left empty they follow the real clock."""

    as_of: dt.date | None = None
    now: dt.datetime | None = None

    def today(self) -> Column:
        return F.current_date() if self.as_of is None else F.lit(self.as_of)

    def instant(self) -> Column:
        return F.current_timestamp() if self.now is None else moment(self.now)


# What a session needs for right results (zone, ANSI) and for plans that survive
# skew. AQE splits a hot join key at run time and coalesces small partitions, so
# the initial partition number may be generous on a cluster.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Splits a hot key's join even where the aggregate above then needs a shuffle of
    # its own: that one only carries partial sums.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Bucketed tables are written one sorted file per bucket; scans may rely on it
    # (Spark checks that a bucket is a single file), which spares the joins a sort.
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
}

# Settings a session can only be started with. Without call-site capture, building
# an expression costs about half.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app: str = "tidemark", master: str | None = None, **extra: str) -> SparkSession:
    """Session with the settings above; `extra` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    settings = SESSION_SETTINGS | START_SETTINGS | {k.replace("__", "."): v for k, v in extra.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_session(spark: SparkSession) -> None:
    """Apply the run-time settings to a session somebody else created."""
    for key, value in SESSION_SETTINGS.items():
        spark.conf.set(key, value)


@contextmanager
def session_settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings that hold inside the block alone, for what runs there."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
