"""Reports against brute force on small data."""

import datetime as dt
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import oracle
import rows
from tidemark.operators.summaries import _Gap, blanks, exact_percentiles, share_of_total, surplus_rows
from tidemark.plans import monitoring, profiling
from tidemark.config import Clock
from workload.bank import CLOCK, bank


def nearest_rank(values, fraction):
    ordered = sorted(values)
    return ordered[max(1, math.ceil(Fraction(fraction) * len(ordered))) - 1]


@pytest.mark.parametrize(
    "values",
    [
        [5],
        [1, 2],
        list(range(1000)),
        [7] * 500 + list(range(20)),
        [10**15, *range(300)],
        [-(i**3) for i in range(777)],
        [None, 3, None, 1],
    ],
)
@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_exact_percentiles(spark, values, accuracy):
    df = spark.createDataFrame([(v,) for v in values], "x long").repartition(5)
    got = {r.fraction: r.value for r in exact_percentiles(df, "x", profiling.PERCENTILES, accuracy).collect()}
    present = [v for v in values if v is not None]
    assert got == {f: nearest_rank(present, f) for f in profiling.PERCENTILES}


@pytest.mark.parametrize("pivots", [(0, 1), (700, 900), (400, 400), (250, 640)])
def test_a_gap_holds_its_rank_wherever_the_pivots_fall(pivots):
    """Pivots that miss the rank move the gap to the side it lies on."""
    counted = [(p, p, p + 1) for p in pivots]  # of the values 0 to 999, once each
    gap = _Gap(None, None, 0, 1000).beside(500, counted)
    low, high = -1 if gap.low is None else gap.low, 1000 if gap.high is None else gap.high
    assert low < 499 < high
    assert (gap.below, gap.inside) == (low + 1, high - low - 1)


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([(None,)], "x long")
    assert exact_percentiles(empty, "x", ["0.5"]).collect() == []


def test_sketched_percentiles_are_close(spark):
    b = bank(spark, f"{oracle.DATA}/sf0.01")
    amounts = sorted(r[0] for r in b.transactions.select("transaction_amount").collect())
    row = profiling.profile_amounts(b.transactions).first()
    for fraction in profiling.PERCENTILES:
        value = row[f"p{round(float(fraction) * 100)}"]
        low = sum(a < value for a in amounts)
        high = sum(a <= value for a in amounts)
        slack = 1 + len(amounts) / 10_000
        assert low - slack <= float(fraction) * len(amounts) <= high + slack


def test_blank_counts_null_and_empty_text_only(spark):
    df = spark.createDataFrame([("", None), (None, 0), (" ", 1)], "t string, n int")
    assert {tuple(r) for r in blanks(df).collect()} == {("t", 2), ("n", 1)}


def test_share_and_surplus_count_null_as_a_value(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "v string")
    assert {tuple(r) for r in share_of_total(df, "v").collect()} == {("a", 2, 66.7), (None, 1, 33.3)}
    assert tuple(surplus_rows(df, "v").first()) == (3, 2, 1)
    assert tuple(surplus_rows(df.limit(0), "v").first()) == (0, 0, 0)


def test_phone_formats(spark):
    df = rows.customers(
        spark,
        rows.customer(1, mobile="0917"),
        rows.customer(2, mobile="+6391"),
        rows.customer(3, mobile="917"),
        rows.customer(4, mobile=None),
    )
    formats = {r.phone_format: r.n for r in profiling.profile_phone_formats(df).collect()}
    assert formats == {"09...": 1, "+63...": 1, "other": 2}
    assert [r.customer_id for r in profiling.odd_phones(df).collect()] == [3]


def test_outliers(spark):
    df = spark.createDataFrame([(1.0,)] * 50 + [(1000.0,)], "transaction_amount double")
    assert [r[0] for r in profiling.outliers(df).collect()] == [1000.0]
    assert profiling.profile_outliers(df.where("transaction_amount = 1")).first()[0] == 0


def test_report_repeats_the_single_reports(spark):
    b = bank(spark, f"{oracle.DATA}/sf0.001")
    report = profiling.profile_report(
        b.customers, b.enrollments, b.interactions, b.transactions, CLOCK
    ).collect()
    lines = {(r.section, r.item, r.metric): r.value for r in report}
    assert len(lines) == len(report)

    ages = profiling.profile_ages(b.customers, CLOCK).first()
    balances = profiling.profile_balances(b.transactions).first()
    limits = profiling.profile_limits(b.enrollments).first()
    for section, item, row in (
        ("age", "customer_raw", ages),
        ("balance", "transaction_history", balances),
        ("limit", "product_enrollments", limits),
    ):
        for metric, value in row.asDict().items():
            assert float(lines[section, item, metric]) == float(value)
    for r in profiling.profile_coverage(
        b.customers, b.enrollments, b.interactions, b.transactions
    ).collect():
        assert lines["coverage", r.missing, "n_customers"] == str(r.n_customers)
    for r in profiling.top_duplicates(b.customers, "email").collect():
        assert lines["top_duplicate", r.email, "n"] == str(r.n)
    for r in profiling.odd_phones(b.customers).collect():
        assert lines["odd_phone", str(r.customer_id), "mobile"] == r.mobile
    for r in profiling.profile_label_hygiene(b.enrollments, "product_type").collect():
        assert lines["label", f"{r.product_type} | {r.product_type_clean}", "n"] == str(r.n)
    assert lines["row_count", "transaction_history", "n_rows"] == "1500"
    assert lines["blank", "customer_raw.email", "n_blank"] == "0"


def test_run_durations(spark):
    day = dt.datetime(2024, 6, 30, tzinfo=dt.UTC)
    start = day - dt.timedelta(days=1)

    def run(id, name, begun, minutes):
        ended = None if minutes is None else begun + dt.timedelta(minutes=minutes, seconds=59)
        return (id, name, begun, ended, "SUCCESS")

    log = spark.createDataFrame(
        [
            run(1, "mart_a", start, 5),
            run(2, "mart_b", start, 60),
            run(3, "mart_c", start, 61),
            run(4, "mart_d", day - dt.timedelta(days=8), 61),
            run(5, "other", start, 61),
            run(6, "mart_e", start + dt.timedelta(hours=1), None),
            run(7, "mart_f", day - dt.timedelta(days=7), 1),
        ],
        "job_id long, job_name string, start_time timestamp, end_time timestamp, state string",
    )
    got = monitoring.run_durations(log, "mart_", Clock(as_of=day.date())).collect()
    assert [(r.job_id, r.duration_minutes, r.is_long) for r in got] == [
        (6, None, False),
        (1, 5, False),
        (2, 60, False),
        (3, 61, True),
        (7, 1, False),
    ]


def test_row_counts(spark):
    tables = {"small": spark.range(999), "enough": spark.range(1000)}
    report = monitoring.row_counts(tables, Clock(now=dt.datetime(2024, 1, 1)))
    assert {r.table_name: r.is_low for r in report.collect()} == {"small": True, "enough": False}
    before = report.withColumn("row_count", F.lit(1112)).where("table_name = 'enough'")
    later = monitoring.row_counts(tables, previous=before)
    assert {r.table_name: r.dropped for r in later.collect()} == {"small": False, "enough": True}
