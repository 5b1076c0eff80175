"""Boundaries of every derived column, on hand-made rows."""

import datetime as dt
from decimal import Decimal

import pytest

import rows
from rows import CLOCK, ago, by_key
from tidemark.config import Thresholds
from tidemark.plans import gold, silver


def build(spark, customers, enrollments=(), contacts=(), payments=(), limits=Thresholds()):
    enrolled = rows.enrollments(spark, *enrollments)
    return by_key(
        gold.customer_profile(
            silver.silver_customers(rows.customers(spark, *customers), CLOCK),
            silver.silver_products(enrolled),
            silver.silver_interactions(rows.interactions(spark, *contacts)),
            silver.silver_transactions(rows.transactions(spark, *payments), enrolled),
            CLOCK,
            limits,
        )
    )


def test_recency(spark):
    cases = {
        1: (0, "Active", True),
        2: (89, "Active", True),
        3: (90, "Active", True),
        4: (91, "At Risk", False),
        5: (180, "At Risk", False),
        6: (181, "Dormant", False),
        7: (-5, "Active", True),
        8: (None, "Never Active", False),
    }
    contacts = [rows.contact(k, k, day=ago(d)) for k, (d, _, _) in cases.items() if d is not None]
    built = build(spark, [rows.customer(k) for k in cases], contacts=contacts)
    for key, (gap, status, active) in cases.items():
        assert built[key]["days_since_last_activity"] == gap
        assert built[key]["customer_status"] == status
        assert built[key]["is_active_customer"] is active


def test_last_activity_is_the_later_of_both(spark):
    midnight = dt.time()
    built = build(
        spark,
        [rows.customer(1), rows.customer(2), rows.customer(3)],
        enrollments=[rows.enrollment(10, 1), rows.enrollment(20, 2)],
        contacts=[rows.contact(1, 1, day=ago(5)), rows.contact(3, 3, day=ago(7))],
        payments=[
            rows.payment(1, 10, 1, at=dt.datetime.combine(ago(3), midnight)),
            rows.payment(2, 20, 2, at=dt.datetime.combine(ago(4), midnight)),
        ],
    )
    assert {k: r["days_since_last_activity"] for k, r in built.items()} == {1: 3, 2: 4, 3: 7}
    assert built[3]["days_since_last_transaction"] is None
    assert built[2]["days_since_last_interaction"] is None


VALUES = ["0", "0.01", "49999.99", "50000", "99999.99", "100000", "149999.99", "150000"]


def test_value_and_tier(spark):
    customers, enrollments, payments = [], [], []
    want = {}
    for i, value in enumerate(VALUES):
        amount = Decimal(value)
        label = (
            "High Value"
            if amount >= 150_000
            else "Medium Value"
            if amount >= 50_000
            else "Low Value"
            if amount > 0
            else "No Transaction"
        )
        for card in (0, 1):
            for products in (1, 2):
                key = 100 + i * 10 + card * 2 + products
                customers.append(rows.customer(key))
                for n in range(products):
                    kind = "Credit Card" if card and n == 0 else "Savings"
                    enrollments.append(rows.enrollment(key * 10 + n, key, kind))
                payments.append(rows.payment(key, key * 10, key, f"-{value}"))
                tier = "Premium" if card and amount >= 100_000 else "Standard" if products > 1 else "Basic"
                want[key] = (label, tier)
    built = build(spark, customers, enrollments, payments=payments)
    assert {k: (r["customer_value_segment"], r["customer_segment"]) for k, r in built.items()} == want


def test_engagement(spark):
    want = {
        0: "No CRM Engagement",
        1: "Low Engagement",
        2: "Low Engagement",
        3: "Moderately Engaged",
        9: "Moderately Engaged",
        10: "Highly Engaged",
    }
    contacts = [rows.contact(n * 100 + i, n) for n in want for i in range(n)]
    built = build(spark, [rows.customer(n) for n in want], contacts=contacts)
    assert {k: r["engagement_segment"] for k, r in built.items()} == want


def test_lifecycle(spark):
    want = {
        89: "New",
        90: "Growing",
        364: "Growing",
        365: "Established",
        1094: "Established",
        1095: "Mature",
    }
    customers = [rows.customer(d, signup=ago(d)) for d in want] + [rows.customer(9999, signup=None)]
    built = build(spark, customers)
    assert built.pop(9999)["customer_lifecycle_stage"] == "Mature"
    assert {k: r["customer_lifecycle_stage"] for k, r in built.items()} == want


def test_thresholds_are_parameters(spark):
    built = build(
        spark,
        [rows.customer(1)],
        contacts=[rows.contact(1, 1, day=ago(40))],
        limits=Thresholds(active_days=30, at_risk_days=39, moderately_engaged=1),
    )
    assert built[1]["customer_status"] == "Dormant"
    assert built[1]["engagement_segment"] == "Moderately Engaged"


@pytest.mark.parametrize(
    "born, age, band",
    [
        (dt.date(1999, 7, 1), 24, "18-24"),
        (dt.date(1999, 6, 30), 25, "25-34"),
        (dt.date(1999, 6, 29), 25, "25-34"),
        (dt.date(2006, 7, 1), 17, "Under 18"),
        (dt.date(1959, 6, 30), 65, "65+"),
        (dt.date(2004, 2, 29), 20, "18-24"),
        (dt.date(1990, 7, 31), 33, "25-34"),
        (None, None, "65+"),
    ],
)
def test_age(spark, born, age, band):
    built = by_key(silver.silver_customers(rows.customers(spark, rows.customer(1, born=born)), CLOCK))
    assert (built[1]["age"], built[1]["age_band"]) == (age, band)


def test_cleaning(spark):
    built = by_key(
        silver.silver_customers(
            rows.customers(
                spark,
                rows.customer(1, first_name=" Ann ", last_name="Lee ", email=" A@B.C ", mobile="+63 (9) 1-2", gender=" Male"),
                rows.customer(2, first_name=None, mobile="--"),
                rows.customer(None),
            ),
            CLOCK,
        )
    )
    assert set(built) == {1, 2}
    first = built[1]
    assert (first["full_name"], first["email"], first["mobile_clean"], first["gender"]) == (
        "Ann Lee",
        "a@b.c",
        "63912",
        "Male",
    )
    assert built[2]["full_name"] is None and built[2]["mobile_clean"] is None


def test_latest_load_wins_and_ties_do_not_depend_on_order(spark):
    later = rows.LOAD + dt.timedelta(days=1)
    loads = [
        rows.customer(1, first_name="Old"),
        rows.customer(1, first_name="New", stamp=later),
        rows.customer(2, first_name="Zoe"),
        rows.customer(2, first_name="Amy"),
        rows.customer(3, first_name="Unstamped", stamp=None),
        rows.customer(3, first_name="Stamped"),
    ]
    for order in (loads, loads[::-1]):
        built = by_key(silver.silver_customers(rows.customers(spark, *order).repartition(3), CLOCK))
        assert {k: r["first_name"] for k, r in built.items()} == {1: "New", 2: "Amy", 3: "Stamped"}


def test_same_day_contacts_are_settled_by_id(spark):
    built = by_key(
        silver.silver_interactions(
            rows.interactions(
                spark,
                rows.contact(5, 1, "Call"),
                rows.contact(7, 1, " chat "),
                rows.contact(6, 1, "Email"),
                rows.contact(8, 1, "SMS", day=dt.date(2023, 12, 31)),
                rows.contact(None, 1),
                rows.contact(9, None),
            )
        )
    )
    assert set(built) == {1}
    one = built[1]
    assert one["last_interaction_type"] == "CHAT"
    assert one["total_interactions"] == 4
    assert one["email_interactions"] + one["chat_interactions"] + one["call_interactions"] == 3


def test_current_balance_follows_full_timestamp_then_id(spark):
    noon, evening = dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 1, 20)
    built = by_key(
        silver.silver_transactions(
            rows.transactions(
                spark,
                rows.payment(9, 10, 1, balance="1", at=noon),
                rows.payment(2, 10, 1, balance="2", at=evening),
                rows.payment(3, 10, 1, balance="3", at=evening),
            ),
            rows.enrollments(spark, rows.enrollment(10, 1)),
        )
    )
    assert built[1]["current_balance"] == Decimal("3.00")


def test_null_keys_zero_amounts_and_unknown_products(spark):
    built = by_key(
        silver.silver_transactions(
            rows.transactions(
                spark,
                rows.payment(1, 10, 1, "0"),
                rows.payment(2, 10, 1, "-2.50"),
                rows.payment(3, 99, 1, "4"),
                rows.payment(None, 10, 1, "100"),
                rows.payment(4, None, 1, "100"),
                rows.payment(5, 10, None, "100"),
            ),
            rows.enrollments(spark, rows.enrollment(10, 1, " credit card ")),
        )
    )
    one = built[1]
    assert set(built) == {1}
    assert (one["total_transactions"], one["debit_count"], one["credit_count"]) == (3, 1, 1)
    assert one["total_transaction_value"] == Decimal("6.50")
    assert one["net_transaction_amount"] == Decimal("1.50")
    assert one["credit_card_transaction_value"] == Decimal("2.50")
    assert one["credit_card_transaction_count"] == 2
    assert one["savings_transaction_count"] == 0
    assert one["avg_transaction_value"] == Decimal("2.166667")


def test_repeated_product_counts_its_transactions_again(spark):
    built = by_key(
        silver.silver_transactions(
            rows.transactions(spark, rows.payment(1, 10, 1, "5")),
            rows.enrollments(spark, rows.enrollment(10, 1), rows.enrollment(10, 1, "Credit Card")),
        )
    )
    assert built[1]["total_transactions"] == 2
    assert built[1]["total_transaction_value"] == Decimal("10.00")


def test_products_limits_and_ratio(spark):
    built = build(
        spark,
        [rows.customer(k) for k in (1, 2, 3, 4, 5)],
        enrollments=[
            rows.enrollment(10, 1, "Credit Card", limit="3"),
            rows.enrollment(11, 1, "Savings", limit="500"),
            rows.enrollment(20, 2, "Credit Card", limit="0"),
            rows.enrollment(30, 3, "Savings", limit="7"),
            rows.enrollment(40, 4, "Loan", limit="9"),
            rows.enrollment(None, 5, "Savings"),
            rows.enrollment(60, None, "Savings"),
        ],
        payments=[rows.payment(1, 10, 1, "-1")],
    )
    segments = {k: r["product_segment"] for k, r in built.items()}
    assert segments == {
        1: "Savings + Credit Card",
        2: "Credit Card Only",
        3: "Savings Only",
        4: "No Product",
        5: "No Product",
    }
    assert built[1]["credit_card_activity_to_limit_ratio"] == Decimal("0.3333333333")
    assert built[2]["credit_card_activity_to_limit_ratio"] is None
    assert built[3]["max_credit_limit"] is None and built[3]["total_credit_limit"] == 0
    assert built[4]["total_products"] == 1 and built[4]["total_credit_limit"] == 0
    assert built[5]["total_products"] == 0 and built[5]["total_credit_limit"] is None
    assert built[1]["is_multi_product"] and not built[2]["is_multi_product"]


def test_customer_without_anything_gets_defaults_and_epoch_stamps(spark):
    one = build(spark, [rows.customer(1)])[1]
    assert len(one) == 66
    nulls = {c for c, v in one.items() if v is None}
    assert nulls == gold.UNKNOWN_STAYS_NULL | {
        "last_activity_date",
        "days_since_last_transaction",
        "days_since_last_interaction",
        "days_since_last_activity",
        "credit_card_activity_to_limit_ratio",
    }
    epoch = dt.datetime(1970, 1, 1)
    assert one["_transactions_ingested_at"] == epoch
    assert one["_latest_source_ingested_at"] == one["_customer_ingested_at"] == rows.LOAD.replace(tzinfo=None)


def test_deidentified(spark):
    silver_rows = silver.silver_customers(rows.customers(spark, rows.customer(1)), CLOCK)
    safe = gold.deidentify(silver_rows)
    assert not {"first_name", "last_name", "full_name", "date_of_birth"} & set(safe.columns)
    assert len(safe.first()["email"]) == 64
