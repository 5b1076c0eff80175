"""Deduplication, key restriction, orphan search and union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_latest(df: DataFrame, keys: Sequence[str], latest: str) -> DataFrame:
    """One row per key: the one with the greatest `latest`.

    Equal stamps are settled by the remaining columns in order, so the result does
    not depend on how rows arrive. `row_number() = 1` lets Spark keep one row per
    key in every map task before the shuffle, so a hot key ships few rows.
    """
    rest = [c for c in df.columns if c not in (*keys, latest)]
    order = [F.col(latest).desc_nulls_last(), *(F.col(c).asc_nulls_first() for c in rest)]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def distinct_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys).distinct()


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def restrict_to(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in `keys`, each row once."""
    return df.join(keys, on, "left_semi")


def without(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in `keys` (a NULL key never occurs)."""
    return df.join(keys, on, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows with a non-NULL key the parent lacks.

    A hot key is one skewed join key: adaptive execution splits it, because a
    left anti join may read the child side in parts.
    """
    known = parent.select(F.col(parent_key).alias(child_key))
    return without(child.where(F.col(child_key).isNotNull()), known, child_key)


def orphan_keys(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Orphaned key values with their number of child rows, NULL keys included.

    Child rows are counted per key before they meet the parent, so what is joined
    is one row per key however many rows a hot key has.
    """
    per_key = child.groupBy(child_key).agg(F.count("*").alias("n_rows"))
    return without(per_key, parent.select(F.col(parent_key).alias(child_key)), child_key)


def owner_mismatch(transactions: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Transactions whose product is unknown or enrolled to another customer."""
    owners = enrollments.select("product_id", F.col("customer_id").alias("product_customer_id"))
    return (
        transactions.select(
            "transaction_id", F.col("customer_id").alias("transaction_customer_id"), "product_id"
        )
        .join(owners, "product_id", "left")
        .where(_wrong_owner())
        .select("transaction_id", "transaction_customer_id", "product_id", "product_customer_id")
    )


def owner_mismatch_count(transactions: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Number of rows `owner_mismatch` returns, from (product, customer) pairs.

    The pairs are counted before the join; this is what a gate evaluates.
    """
    pairs = transactions.groupBy(
        "product_id", F.col("customer_id").alias("transaction_customer_id")
    ).agg(F.count("*").alias("n_rows"))
    owners = enrollments.select("product_id", F.col("customer_id").alias("product_customer_id"))
    bad = pairs.join(owners, "product_id", "left").where(_wrong_owner())
    return bad.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("failures"))


def _wrong_owner() -> Column:
    owner = F.col("product_customer_id")
    return owner.isNull() | (F.col("transaction_customer_id") != owner)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First `k` rows; give `order` a tie-break to make the choice repeatable."""
    return df.orderBy(*order).limit(k)
