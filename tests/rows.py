"""Small hand-made raw tables."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from tidemark import schemas
from tidemark.config import Clock

AS_OF = dt.date(2024, 6, 30)
CLOCK = Clock(as_of=AS_OF, now=dt.datetime(2024, 6, 30, 12))
LOAD = dt.datetime(2024, 6, 1, tzinfo=dt.UTC)


def ago(days):
    return AS_OF - dt.timedelta(days=days)


def _frame(spark, rows, schema):
    stamped = T.StructType([*schema.fields, T.StructField("_ingested_at", T.TimestampType(), True)])
    return spark.createDataFrame(rows, stamped)


def customer(id, born=dt.date(1990, 1, 1), signup=dt.date(2020, 1, 1), stamp=LOAD, **over):
    row = dict(first_name="A", last_name="B", email="a@b.c", mobile="0912", gender="Male") | over
    return (id, *row.values(), born, signup, stamp)


def customers(spark, *rows):
    return _frame(spark, list(rows), schemas.CUSTOMERS)


def enrollment(product, customer, kind="Savings", day=dt.date(2021, 1, 1), limit="0", stamp=LOAD):
    return (product, customer, kind, day, Decimal(limit), stamp)


def enrollments(spark, *rows):
    return _frame(spark, list(rows), schemas.ENROLLMENTS)


def contact(id, customer, kind="Email", day=dt.date(2024, 1, 1), stamp=LOAD):
    return (id, customer, kind, day, stamp)


def interactions(spark, *rows):
    return _frame(spark, list(rows), schemas.INTERACTIONS)


def payment(id, product, customer, amount="1", balance="0", at=dt.datetime(2024, 1, 1), stamp=LOAD):
    return (id, product, customer, Decimal(amount), Decimal(balance), at.replace(tzinfo=dt.UTC), stamp)


def transactions(spark, *rows):
    return _frame(spark, list(rows), schemas.TRANSACTIONS)


def by_key(df, key="customer_id"):
    return {row[key]: row.asDict() for row in df.collect()}
