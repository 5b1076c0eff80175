"""Change processing by ingestion watermark."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import EPOCH, moment
from tidemark.operators.keys import distinct_keys, restrict_to, union_all
from tidemark.schemas import CUSTOMER, INGESTED
from tidemark.sources import parts
from tidemark.sources.shared import materialise
from tidemark.sources.tables import backing, bucket_count, fact_parts, stored

RollUp = Callable[[DataFrame], DataFrame]


def watermark(target: DataFrame) -> DataFrame:
    """Greatest stamp in the target, the epoch when it is empty: one row."""
    return target.agg(F.coalesce(F.max(INGESTED), moment(EPOCH)).alias("high_water"))


def changed_keys(
    raw: DataFrame, mark: Column | dt.datetime | None = None, key: str = CUSTOMER
) -> DataFrame:
    """Keys with rows stamped strictly after `mark`; without a mark all keys.

    The stamp filter reaches the file scan, and only the key and the stamp are read.
    """
    if mark is not None:
        mark = moment(mark) if isinstance(mark, dt.datetime) else mark
        raw = raw.where(F.col(INGESTED) > mark)
    return distinct_keys(raw, key)


def window_keys(
    raw: DataFrame, start: dt.datetime, end: dt.datetime, key: str = CUSTOMER
) -> DataFrame:
    """Keys with rows stamped in [start, end)."""
    stamp = F.col(INGESTED)
    return distinct_keys(raw.where((stamp >= moment(start)) & (stamp < moment(end))), key)


def upsert(
    target: DataFrame, delta: DataFrame, key: str = CUSTOMER, buckets: int | None = None
) -> DataFrame:
    """Target with the delta's rows replacing or joining it by key; none deleted.

    One full outer join: the delta is computed once, and keys are unique on both
    sides, so no key can be hot. For a target stored in `buckets` buckets on the
    key, the delta alone is sent to the buckets; the target is read where it lies.
    """
    if buckets is not None:
        delta = delta.repartition(buckets, key)
    fresh = delta.withColumn("_fresh", F.lit(True)).alias("d")
    both = target.alias("t").join(fresh, F.col(f"t.{key}") == F.col(f"d.{key}"), "full_outer")
    return both.select(
        *(
            F.when(F.col("d._fresh"), F.col(f"d.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
            for c in target.columns
        )
    )


def pending_keys(
    raw: DataFrame, target: DataFrame, key: str = CUSTOMER, extra_keys: DataFrame | None = None
) -> DataFrame:
    """Keys to roll up again: stamped after the target's watermark, or named.

    The key set is stored: its true size then decides whether it is broadcast into
    the history scan, so that a small change never shuffles the history, or joined
    by shuffle when it is large.
    """
    keys = changed_keys(raw, watermark(target).scalar(), key)
    if extra_keys is not None:
        keys = union_all(keys, extra_keys.select(key)).distinct()
    return materialise(keys, "pending")


def recompute(raw: DataFrame, keys: DataFrame, roll_up: RollUp, key: str = CUSTOMER) -> DataFrame:
    """Roll up the full history of the given keys."""
    return roll_up(restrict_to(raw, keys, key))


def incremental_refresh(
    raw: DataFrame,
    target: DataFrame | None,
    roll_up: RollUp,
    key: str = CUSTOMER,
    extra_keys: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """The target after taking in everything stamped after its watermark.

    Without a target this is the first run and all keys count as changed. Changes
    that carry no stamp in `raw`, such as a late enrollment, can be named in
    `extra_keys`. The target itself is returned when nothing is pending.
    """
    if target is None:
        return roll_up(raw)
    keys = pending_keys(raw, target, key, extra_keys)
    if keys.isEmpty():
        return target
    return upsert(target, recompute(raw, keys, roll_up, key), key, buckets)


def backfill(
    raw: DataFrame,
    target: DataFrame,
    roll_up: RollUp,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    key: str = CUSTOMER,
    buckets: int | None = None,
) -> DataFrame:
    """Recompute the keys stamped in [start, end); with no window, everything."""
    if start is None and end is None:
        return roll_up(raw)
    if start is None or end is None:
        raise ValueError("a backfill window needs both ends")
    keys = materialise(window_keys(raw, start, end, key), "window")
    if keys.isEmpty():
        return target
    return upsert(target, recompute(raw, keys, roll_up, key), key, buckets)


def part_upsert(
    spark: SparkSession, target: str, delta: DataFrame, key: str = CUSTOMER, **properties: str
) -> list[int]:
    """Upsert `delta` into a target laid out in parts; the parts that were replaced.

    Only parts that hold a key of the delta are read and written; the files of the others
    stay as they are. None deleted, as in `upsert`.
    """
    table, buckets = backing(spark, target), bucket_count(spark, target)
    parts.recover(spark, table)
    rows = materialise(delta.withColumn(parts.PART, parts.bucket_of(key, buckets)), "delta")
    chosen = parts.touched(rows)
    if chosen:
        current = parts.in_parts(spark.table(table), chosen)
        parts.replace_parts(spark, table, upsert(current, rows, key), **properties)
    elif properties:
        parts.set_properties(spark, table, **properties)
    return chosen


def stored_mark(spark: SparkSession, target: str) -> dt.datetime | None:
    """The target's greatest stamp: noted with each refresh in parts, else looked up."""
    noted = parts.property_of(spark, backing(spark, target), "mark")
    if noted:
        return dt.datetime.fromisoformat(noted)
    micros = watermark(spark.table(target)).select(F.unix_micros("high_water")).first()[0]
    return EPOCH + dt.timedelta(microseconds=micros)


def refresh_in_parts(
    spark: SparkSession,
    facts: str,
    target: str,
    roll_up: RollUp,
    window: tuple[dt.datetime, dt.datetime] | None = None,
    key: str = CUSTOMER,
    extra_keys: DataFrame | None = None,
) -> list[int]:
    """Bring a target in parts up to date with facts laid out by load day and part.

    The keys stamped after the target's mark, or in `window`, are found in the load days
    concerned alone, their history is read from their parts alone, and only parts that
    hold such keys are replaced. The parts replaced are returned, none if nothing is
    pending. A window leaves the mark as it is, unless it holds later stamps.
    """
    parts.recover(spark, backing(spark, target))
    rows = stored(spark, facts)
    mark = stored_mark(spark, target)
    new = parts.since(rows, INGESTED, mark) if window is None else parts.between(rows, INGESTED, *window)
    # Whole rows of one load can be many; key, part and stamp are what travels.
    found = new.groupBy(key, parts.PART).agg(F.max(INGESTED).alias("newest"))
    if extra_keys is not None:
        named = extra_keys.select(key).distinct()
        named = named.withColumn(parts.PART, parts.bucket_of(key, fact_parts(spark, facts)))
        found = found.unionByName(named.withColumn("newest", moment(EPOCH)))
        found = found.groupBy(key, parts.PART).agg(F.max("newest").alias("newest"))
    keys = materialise(found, "pending")
    chosen = parts.touched(keys)
    if not chosen:
        return []
    micros = keys.agg(F.unix_micros(F.max("newest"))).first()[0]
    newest = max(mark, EPOCH + dt.timedelta(microseconds=micros))
    history = restrict_to(parts.in_parts(rows, chosen), keys.select(key), key)
    delta = roll_up(history.drop(parts.LOAD, parts.PART))
    return part_upsert(spark, target, delta, key, mark=newest.isoformat())
