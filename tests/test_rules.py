"""Rules on planted violations, the catalogue's size, gates and audit rows."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

import rows
from rows import LOAD
from tidemark.config import Clock
from tidemark.plans import checks, gold, rules, silver
from tidemark.plans.rules import Rule
from tidemark.schemas import GOLD, SILVER
from workload.oracles import COLUMNS


def counted(tables, *wanted):
    return {r.rule_id: r.failures for r in checks.run_rules(tables, list(wanted)).collect()}


def test_catalogue_size():
    bronze = rules.bronze_rules()
    middle = rules.silver_rules({t: COLUMNS[t] for t in SILVER})
    top = rules.gold_rules(COLUMNS[GOLD])
    kinds = [r.kind for r in (*bronze, *middle, *top)]
    assert (len(bronze), len(middle), len(top)) == (37, 66, 61)
    assert [kinds.count(k) for k in ("not_null", "unique", "accepted_values", "relationships")] == [
        131,
        9,
        16,
        8,
    ]
    ids = [r.rule_id for r in (*bronze, *middle, *top)]
    assert len(set(ids)) == len(ids)


def test_columns_of_the_checks_are_those_built(spark):
    c = silver.silver_customers(rows.customers(spark), rows.CLOCK)
    e = rows.enrollments(spark)
    p = silver.silver_products(e)
    i = silver.silver_interactions(rows.interactions(spark))
    t = silver.silver_transactions(rows.transactions(spark), e)
    built = dict(zip(SILVER, (c, p, i, t))) | {GOLD: gold.customer_profile(c, p, i, t, rows.CLOCK)}
    for name, df in built.items():
        assert set(df.columns) == set(COLUMNS[name])
        assert len(df.columns) == len(COLUMNS[name])


def test_column_rules_find_what_was_planted(spark):
    bad = spark.createDataFrame(
        [(1, "Male", 1), (1, "male", 2), (2, None, 9), (None, "it's", None), (None, "Female", 1)],
        "id long, gender string, parent long",
    )
    parents = spark.createDataFrame([(1,), (2,)], "key long")
    tables = {"t": bad, "p": parents}
    values = ("Male", "Female", "O'Hara")
    unique = Rule("unique", "t", "id")
    not_null = Rule("not_null", "t", "id")
    accepted = Rule("accepted_values", "t", "gender", values=values)
    related = Rule("relationships", "t", "parent", parent="p", parent_column="key")
    assert counted(tables, unique, not_null, accepted, related) == {
        unique.rule_id: 1,
        not_null.rule_id: 2,
        accepted.rule_id: 2,
        related.rule_id: 1,
    }
    assert [tuple(r) for r in unique.rows(tables).collect()] == [(1, 2)]
    assert not_null.rows(tables).count() == 2
    assert {r.gender for r in accepted.rows(tables).collect()} == {"male", "it's"}
    assert [r.parent for r in related.rows(tables).collect()] == [9]


def test_clean_rows_pass(spark):
    good = rows.customers(spark, rows.customer(1), rows.customer(2, gender="Female"))
    tables = {"customer_raw": good}
    found = counted(tables, *[r for r in rules.bronze_rules() if r.table == "customer_raw"])
    assert set(found.values()) == {0}


def test_owner_mismatch(spark):
    enrolled = rows.enrollments(spark, rows.enrollment(10, 1), rows.enrollment(20, 2))
    paid = rows.transactions(
        spark,
        rows.payment(1, 10, 1),
        rows.payment(2, 20, 1),
        rows.payment(3, 99, 1),
        rows.payment(4, None, 1),
        rows.payment(5, 20, None),
    )
    tables = {"transaction_history": paid, "product_enrollments": enrolled}
    (rule,) = rules.bronze_assertions()
    found = rule.rows(tables).collect()
    assert {r.transaction_id for r in found} == {2, 3, 4}
    assert rule.failures(tables).first()[0] == 3
    assert {r.product_customer_id for r in found} == {2, None}


def profile_rows(spark, **changes):
    built = gold.customer_profile(
        silver.silver_customers(rows.customers(spark, rows.customer(1), rows.customer(2)), rows.CLOCK),
        silver.silver_products(rows.enrollments(spark)),
        silver.silver_interactions(rows.interactions(spark, rows.contact(1, 1, day=rows.ago(1)))),
        silver.silver_transactions(rows.transactions(spark), rows.enrollments(spark)),
        rows.CLOCK,
    )
    return built.withColumns({k: F.lit(v).cast(built.schema[k].dataType) for k, v in changes.items()})


@pytest.mark.parametrize(
    "changes, found",
    [
        ({}, 0),
        ({"is_active_customer": True}, 1),
        ({"is_active_customer": False}, 1),
        ({"customer_status": "Never Active"}, 1),
        ({"customer_status": "Active", "is_active_customer": True, "days_since_last_activity": 91}, 2),
    ],
)
def test_recency_assertion(spark, changes, found):
    assert rules.assert_recency_consistent(profile_rows(spark, **changes)).count() == found


def test_premium_and_negative_assertions(spark):
    assert rules.assert_premium(profile_rows(spark)).count() == 0
    assert rules.assert_premium(profile_rows(spark, customer_segment="Premium")).count() == 2
    assert rules.assert_non_negative(profile_rows(spark)).count() == 0
    for column in rules.NON_NEGATIVE:
        assert rules.assert_non_negative(profile_rows(spark, **{column: -1})).count() == 2


def test_value_identity_assertion(spark):
    built = silver.silver_transactions(
        rows.transactions(spark, rows.payment(1, 10, 1, "5"), rows.payment(2, 10, 1, "-0.07")),
        rows.enrollments(spark, rows.enrollment(10, 1)),
    )
    assert rules.assert_value_identity(built).count() == 0
    off = built.withColumn("total_debit_value", F.col("total_debit_value") + F.lit(0.01).cast("decimal(3,2)"))
    assert rules.assert_value_identity(off).count() == 1


@pytest.mark.parametrize("hours, status", [(23, "pass"), (24, "pass"), (25, "warn"), (48, "warn"), (49, "error")])
def test_freshness(spark, hours, status):
    clock = Clock(now=LOAD + dt.timedelta(hours=hours))
    df = rows.customers(spark, rows.customer(1), rows.customer(2, stamp=LOAD - dt.timedelta(days=9)))
    (row,) = checks.freshness({"c": df}, clock).collect()
    assert (row.status, row.age_seconds) == (status, hours * 3600)
    (empty,) = checks.freshness({"c": df.limit(0)}, clock).collect()
    assert empty.status == "error"


def test_gate_and_audit(spark):
    audit = f"audit_{uuid.uuid4().hex}"
    rule = Rule("not_null", "t", "mobile")
    soft = Rule("unique", "t", "email", severity="warn")
    bad = rows.customers(spark, rows.customer(1, mobile=None), rows.customer(2))
    good = rows.customers(spark, rows.customer(1, email="x"), rows.customer(2))

    results = checks.evaluate(spark, {"t": bad}, [rule, soft], audit)
    assert {r.rule_id: r.status for r in results} == {rule.rule_id: "error", soft.rule_id: "warn"}
    assert [r.customer_id for r in spark.table(f"{audit}.{rule.rule_id}").collect()] == [1]
    assert [r.n for r in spark.table(f"{audit}.{soft.rule_id}").collect()] == [2]
    with pytest.raises(checks.GateFailed) as stop:
        checks.require_pass(results)
    assert [r.rule_id for r in stop.value.results] == [rule.rule_id]
    checks.require_pass(results, waived=frozenset([rule.rule_id]))

    checks.require_pass(checks.evaluate(spark, {"t": good}, [rule, soft], audit))
    assert not spark.catalog.tableExists(f"{audit}.{rule.rule_id}")
