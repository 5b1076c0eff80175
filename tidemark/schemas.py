"""Declared schemas of the raw tables. `mobile` stays a string: inference would
turn `09…` into a number and lose the leading zero."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
INGESTED = "_ingested_at"
CUSTOMER = "customer_id"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


CUSTOMERS = _struct(
    customer_id=T.LongType(),
    first_name=T.StringType(),
    last_name=T.StringType(),
    email=T.StringType(),
    mobile=T.StringType(),
    gender=T.StringType(),
    date_of_birth=T.DateType(),
    signup_date=T.DateType(),
)

ENROLLMENTS = _struct(
    product_id=T.LongType(),
    customer_id=T.LongType(),
    product_type=T.StringType(),
    enrollment_date=T.DateType(),
    limit=MONEY,
)

INTERACTIONS = _struct(
    interaction_id=T.LongType(),
    customer_id=T.LongType(),
    interaction_type=T.StringType(),
    interaction_date=T.DateType(),
)

TRANSACTIONS = _struct(
    transaction_id=T.LongType(),
    product_id=T.LongType(),
    customer_id=T.LongType(),
    transaction_amount=MONEY,
    closing_balance=MONEY,
    transaction_date=T.TimestampType(),
)

RUN_LOG = _struct(
    job_id=T.LongType(),
    job_name=T.StringType(),
    start_time=T.TimestampType(),
    end_time=T.TimestampType(),
    state=T.StringType(),
)

VIOLATIONS = _struct(
    rule_id=T.StringType(),
    table_name=T.StringType(),
    severity=T.StringType(),
    violation=T.StringType(),
)

# Names of the raw tables and of the tables built from them.
RAW = {
    "customer_raw": CUSTOMERS,
    "product_enrollments": ENROLLMENTS,
    "crm_interactions": INTERACTIONS,
    "transaction_history": TRANSACTIONS,
}
SILVER = (
    "silver_customers",
    "silver_customer_products",
    "silver_customer_interactions",
    "silver_customer_transactions",
)
GOLD = "customer_profile"
