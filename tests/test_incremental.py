"""Refresh by watermark, backfill, upsert and the stream agree with a rebuild."""

import datetime as dt

import pytest

import rows
from rows import LOAD, by_key
from tidemark.operators import incremental
from tidemark.plans import silver
from tidemark.sources import materialise

SECOND = LOAD + dt.timedelta(days=1)
FIRST_ROWS = [rows.contact(i, i % 6, day=dt.date(2024, 1, 1 + i)) for i in range(1, 20)]
SECOND_ROWS = [
    rows.contact(101, 1, "Call", dt.date(2024, 3, 1), SECOND),
    rows.contact(102, 2, "Chat", dt.date(2023, 1, 1), SECOND),
    rows.contact(103, 77, "Call", dt.date(2024, 3, 1), SECOND),
    rows.contact(None, 88, "Call", dt.date(2024, 3, 1), SECOND),
    rows.contact(None, 3, "Call", dt.date(2024, 3, 1), SECOND),
]


@pytest.fixture(scope="module")
def raw(spark):
    return rows.interactions(spark, *FIRST_ROWS, *SECOND_ROWS)


@pytest.fixture(scope="module")
def first(spark):
    stored = silver.silver_interactions(rows.interactions(spark, *FIRST_ROWS))
    return materialise(stored, "first")


def test_refresh_equals_rebuild(raw, first):
    refreshed = incremental.incremental_refresh(raw, first, silver.silver_interactions)
    assert by_key(refreshed) == by_key(silver.silver_interactions(raw))


def test_first_run_takes_all(raw):
    built = incremental.incremental_refresh(raw, None, silver.silver_interactions)
    assert by_key(built) == by_key(silver.silver_interactions(raw))


def test_second_run_is_a_no_op(raw):
    done = materialise(silver.silver_interactions(raw), "done")
    mark = incremental.watermark(done).first()[0]
    assert incremental.changed_keys(raw, mark).count() == 0
    assert incremental.incremental_refresh(raw, done, silver.silver_interactions) is done


def test_mark_is_strict_and_starts_at_the_epoch(spark, raw, first):
    assert incremental.watermark(first).first()[0] == LOAD.replace(tzinfo=None)
    assert incremental.watermark(first.limit(0)).first()[0] == dt.datetime(1970, 1, 1)
    keys = {r[0] for r in incremental.changed_keys(raw, LOAD).collect()}
    assert keys == {1, 2, 3, 77, 88}
    assert incremental.changed_keys(raw).count() == 8


def test_rows_stamped_at_the_mark_need_a_backfill(spark, first):
    late = rows.contact(500, 1, "Call", dt.date(2024, 5, 5), LOAD)
    raw = rows.interactions(spark, *FIRST_ROWS, late)
    skipped = incremental.incremental_refresh(raw, first, silver.silver_interactions)
    assert by_key(skipped) == by_key(first)
    end = LOAD + dt.timedelta(seconds=1)
    mended = incremental.backfill(raw, first, silver.silver_interactions, LOAD, end)
    assert by_key(mended) == by_key(silver.silver_interactions(raw))


def test_window_is_half_open_and_leaves_others_alone(raw, first):
    before = incremental.backfill(
        raw, first, silver.silver_interactions, LOAD - dt.timedelta(days=1), LOAD
    )
    assert by_key(before) == by_key(first)
    window = incremental.backfill(
        raw, first, silver.silver_interactions, SECOND, SECOND + dt.timedelta(days=1)
    )
    assert by_key(window) == by_key(silver.silver_interactions(raw))


def test_backfill_without_window_rebuilds_and_half_a_window_is_refused(raw, first):
    assert by_key(incremental.backfill(raw, first, silver.silver_interactions)) == by_key(
        silver.silver_interactions(raw)
    )
    with pytest.raises(ValueError):
        incremental.backfill(raw, first, silver.silver_interactions, start=LOAD)


def test_late_enrollment_counts_only_when_named(spark):
    payments = rows.transactions(spark, rows.payment(1, 10, 1, "5"), rows.payment(2, 20, 2, "6"))
    none = rows.enrollments(spark)
    target = materialise(silver.silver_transactions(payments, none), "target")
    enrolled = rows.enrollments(spark, rows.enrollment(10, 1, stamp=SECOND))

    def roll_up(part):
        return silver.silver_transactions(part, enrolled)

    plain = by_key(incremental.incremental_refresh(payments, target, roll_up))
    assert plain[1]["savings_transaction_count"] == 0
    named = incremental.incremental_refresh(payments, target, roll_up, extra_keys=enrolled)
    assert by_key(named)[1]["savings_transaction_count"] == 1


def test_upsert_replaces_whole_rows(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "customer_id long, v string, w string")
    delta = spark.createDataFrame([(2, None, "z"), (3, "c", None)], target.schema)
    got = {tuple(r) for r in incremental.upsert(target, delta).collect()}
    assert got == {(1, "a", "x"), (2, None, "z"), (3, "c", None)}
