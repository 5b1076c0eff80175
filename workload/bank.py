"""The four raw bank tables, derived from the driver's tables by fixed rules.

The rules are those of FIXTURES.md; `PRELUDE` states them again in SQL.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Clock, moment, pin_session
from tidemark.schemas import INGESTED, MONEY

AS_OF = dt.date(2001, 8, 1)
FIRST_LOAD = dt.datetime(2001, 7, 31)
SECOND_LOAD = dt.datetime(2001, 8, 1)
CLOCK = Clock(as_of=AS_OF, now=SECOND_LOAD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Bank:
    """The raw tables, each derived when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, until: dt.datetime | None = None):
        self.spark, self.sf_dir, self.until = spark, sf_dir, until

    def loaded_by(self, stamp: dt.datetime) -> Bank:
        """Contacts and transactions stamped at or before `stamp` only."""
        return Bank(self.spark, self.sf_dir, stamp)

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def _seen(self, df: DataFrame) -> DataFrame:
        return df if self.until is None else df.where(F.col(INGESTED) <= moment(self.until))

    @cached_property
    def customers(self) -> DataFrame:
        return _customers(self._table("customer"))

    @cached_property
    def enrollments(self) -> DataFrame:
        return _enrollments(self._table("orders"))

    @cached_property
    def interactions(self) -> DataFrame:
        return self._seen(_interactions(self._table("events")))

    @cached_property
    def transactions(self) -> DataFrame:
        return self._seen(_transactions(self._table("orders")))


def bank(spark: SparkSession, sf_dir: str) -> Bank:
    pin_session(spark)
    return Bank(spark, sf_dir)


def _stamped(df: DataFrame, key: str) -> DataFrame:
    second = F.col(key) % 5 == 0
    return df.withColumn(INGESTED, F.when(second, moment(SECOND_LOAD)).otherwise(moment(FIRST_LOAD)))


def _days_after(start: str, days: Column) -> Column:
    return F.date_add(F.lit(start).cast("date"), days.cast("int"))


def _customers(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    mailbox = F.when(key % 500 == 499, key - 1).otherwise(key)
    mobile = (
        F.when(key % 10 == 0, F.concat(F.lit("+63-9"), key))
        .when(key % 97 == 5, "--")
        .otherwise(F.concat(F.lit("09"), key))
    )
    rows = customer.select(
        key.alias("customer_id"),
        F.concat(F.lit(" F"), key % 97).alias("first_name"),
        F.concat(F.lit("L"), key % 89, F.lit(" ")).alias("last_name"),
        F.concat(F.lit("U"), mailbox, F.lit("@Example.com")).alias("email"),
        mobile.alias("mobile"),
        F.when(key % 2 == 0, "Male").otherwise("Female").alias("gender"),
        _days_after("1925-01-01", (key * 7919) % 24500).alias("date_of_birth"),
        _days_after("1997-01-01", (key * 104729) % 1670).alias("signup_date"),
    )
    return _stamped(rows, "customer_id")


def _priority() -> Column:
    return F.substring("o_orderpriority", 1, 1).cast("long")


def _owner() -> Column:
    """Orders of customers with `% 13 = 5` belong to the customer before: gaps, but no loss."""
    return F.when(F.col("o_custkey") % 13 == 5, F.col("o_custkey") - 1).otherwise(F.col("o_custkey"))


def _enrollments(orders: DataFrame) -> DataFrame:
    card = F.col("priority") <= 2
    held = (
        orders.groupBy(_owner().alias("owner"), _priority().alias("priority"))
        .agg(F.min("o_orderdate").alias("first_order"), F.max("o_totalprice").alias("top_price"))
    )
    rows = held.select(
        (F.col("owner") * 10 + F.col("priority")).alias("product_id"),
        F.col("owner").alias("customer_id"),
        F.when(card, "Credit Card").otherwise(" savings ").alias("product_type"),
        F.col("first_order").cast("date").alias("enrollment_date"),
        F.when(card, F.round(F.col("top_price") / 1000) * 1000).otherwise(0.0).cast(MONEY).alias("limit"),
    )
    return _stamped(rows, "product_id")


def _transactions(orders: DataFrame) -> DataFrame:
    cents = F.expr("CAST(round(o_totalprice * 100) AS BIGINT) DIV 20")
    signed = F.when(F.col("o_orderstatus") == "F", -cents).otherwise(cents)
    amount = (signed * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY)
    rows = orders.select(
        F.col("o_orderkey").alias("transaction_id"),
        (_owner() * 10 + _priority()).alias("product_id"),
        _owner().alias("customer_id"),
        amount.alias("transaction_amount"),
        (amount - 5000).cast(MONEY).alias("closing_balance"),
        F.col("o_orderdate").cast("timestamp").alias("transaction_date"),
    )
    return _stamped(rows, "transaction_id")


def _interactions(events: DataFrame) -> DataFrame:
    # Channel of each event type; " email " and SMS are dirty on purpose.
    channel = {
        "click": "Email",
        "view": "Chat",
        "purchase": "Call",
        "error": " email ",
        "signup": "SMS",
    }
    label = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in channel.items()))
    event = F.col("event_id")
    contact = F.col("user_id") * 10 + event % 10
    rows = events.select(
        event.alias("interaction_id"),
        F.when(contact % 4 == 1, contact + 1).otherwise(contact).alias("customer_id"),
        label.alias("interaction_type"),
        F.date_sub(F.lit(AS_OF), ((event * 37) % 2400).cast("int")).alias("interaction_date"),
    )
    return _stamped(rows, "interaction_id")


# The same rules in SQL. Money is carried in integer cents as well (`cents`,
# `balance_cents`, `limit_cents`) so that the checks can divide exactly.
PRELUDE = """
customers AS (
  SELECT c_custkey AS customer_id,
         ' F' || (c_custkey % 97) AS first_name,
         'L' || (c_custkey % 89) || ' ' AS last_name,
         'U' || (c_custkey - CASE WHEN c_custkey % 500 = 499 THEN 1 ELSE 0 END) || '@Example.com' AS email,
         CASE WHEN c_custkey % 10 = 0 THEN '+63-9' || c_custkey
              WHEN c_custkey % 97 = 5 THEN '--'
              ELSE '09' || c_custkey END AS mobile,
         CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
         DATE '1925-01-01' + CAST((c_custkey * 7919) % 24500 AS INTEGER) AS date_of_birth,
         DATE '1997-01-01' + CAST((c_custkey * 104729) % 1670 AS INTEGER) AS signup_date,
         CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2001-08-01' ELSE TIMESTAMP '2001-07-31' END AS stamp
  FROM customer),
owned AS (
  SELECT *, CAST(o_orderpriority[1] AS BIGINT) AS prio,
         CASE WHEN o_custkey % 13 = 5 THEN o_custkey - 1 ELSE o_custkey END AS owner
  FROM orders),
enrollments AS (
  SELECT owner * 10 + prio AS product_id,
         owner AS customer_id,
         CASE WHEN prio <= 2 THEN 'Credit Card' ELSE ' savings ' END AS product_type,
         upper(trim(CASE WHEN prio <= 2 THEN 'Credit Card' ELSE ' savings ' END)) AS kind,
         CAST(min(o_orderdate) AS DATE) AS enrollment_date,
         CASE WHEN prio <= 2 THEN CAST(round(max(o_totalprice) / 1000) AS BIGINT) * 100000 ELSE 0 END AS limit_cents,
         CASE WHEN (owner * 10 + prio) % 5 = 0 THEN TIMESTAMP '2001-08-01' ELSE TIMESTAMP '2001-07-31' END AS stamp
  FROM owned
  GROUP BY owner, prio),
interactions AS (
  SELECT event_id AS interaction_id,
         (user_id * 10 + event_id % 10)
           + CASE WHEN (user_id * 10 + event_id % 10) % 4 = 1 THEN 1 ELSE 0 END AS customer_id,
         CASE event_type WHEN 'click' THEN 'Email' WHEN 'view' THEN 'Chat' WHEN 'purchase' THEN 'Call'
                         WHEN 'error' THEN ' email ' WHEN 'signup' THEN 'SMS' END AS interaction_type,
         DATE '2001-08-01' - CAST((event_id * 37) % 2400 AS INTEGER) AS interaction_date,
         CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '2001-08-01' ELSE TIMESTAMP '2001-07-31' END AS stamp
  FROM events),
transactions AS (
  SELECT o_orderkey AS transaction_id,
         product_id,
         owner AS customer_id,
         cents,
         cents - 500000 AS balance_cents,
         o_orderdate AS transaction_date,
         CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2001-08-01' ELSE TIMESTAMP '2001-07-31' END AS stamp
  FROM (SELECT *, owner * 10 + prio AS product_id,
               (CAST(round(o_totalprice * 100) AS BIGINT) // 20)
                 * CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS cents
        FROM owned))"""
