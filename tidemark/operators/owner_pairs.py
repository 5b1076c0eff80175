"""The owner gate by increments: counted (product, customer) pairs that are kept.

A load adds its pairs; only parts that hold one of its products, or a product whose
enrollment changed, are read, judged anew and replaced. The gate is a sum over the pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.keys import union_all
from tidemark.sources import parts
from tidemark.sources.shared import materialise
from tidemark.sources.tables import backing, bucket_count, replace_table

PRODUCT, PAYER, N, WRONG = "product_id", "transaction_customer_id", "n_rows", "n_wrong"


def payment_pairs(transactions: DataFrame) -> DataFrame:
    """(product, customer, rows): counted before any join, so a hot product is a row per
    customer and task."""
    return transactions.groupBy(PRODUCT, F.col("customer_id").alias(PAYER)).agg(F.count("*").alias(N))


def judged(pairs: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Pairs with their number of rows that have no owner or another: as many per enrollment
    that disagrees, as `keys.owner_mismatch` returns."""
    owner = F.col("owner")
    owners = enrollments.where(F.col(PRODUCT).isNotNull()).select(PRODUCT, F.col("customer_id").alias("owner"))
    wrong = F.when(owner.isNull() | (F.col(PAYER) != owner), 1).otherwise(0)
    found = pairs.join(owners, PRODUCT, "left").groupBy(PRODUCT, PAYER, N)
    return found.agg((F.sum(wrong) * F.col(N)).alias(WRONG))


def build_pairs(name: str, transactions: DataFrame, enrollments: DataFrame, buckets: int) -> None:
    replace_table(judged(payment_pairs(transactions), enrollments), name, PRODUCT, buckets, in_parts=True)


def add_pairs(
    spark: SparkSession,
    name: str,
    load: DataFrame,
    enrollments: DataFrame,
    changed_enrollments: DataFrame | None = None,
) -> list[int]:
    """Take a load's payments and changed enrollments in; the parts that were replaced.

    `enrollments` are all current ones, `changed_enrollments` those that came or changed since
    the last load. A load must be taken in once.
    """
    table, buckets = backing(spark, name), bucket_count(spark, name)
    parts.recover(spark, table)
    part = parts.bucket_of(PRODUCT, buckets)
    new = materialise(payment_pairs(load).withColumn(parts.PART, part), "pairs")
    touched = new.select(PRODUCT, parts.PART)
    if changed_enrollments is not None:
        touched = touched.union(changed_enrollments.select(PRODUCT).withColumn(parts.PART, part))
    chosen = parts.touched(touched)
    if not chosen:
        return []
    current = parts.in_parts(spark.table(table), chosen).select(PRODUCT, PAYER, N)
    both = union_all(current, new.select(PRODUCT, PAYER, N))
    pairs = both.groupBy(PRODUCT, PAYER).agg(F.sum(N).alias(N))
    owners = enrollments.where(part.isin(*chosen))
    parts.replace_parts(spark, table, judged(pairs, owners).withColumn(parts.PART, part))
    return chosen


def mismatches(pairs: DataFrame) -> DataFrame:
    """One row `failures`, as `keys.owner_mismatch_count` returns it."""
    return pairs.agg(F.coalesce(F.sum(WRONG), F.lit(0)).cast("long").alias("failures"))
