"""Silver tables: cleaned customers and three roll-ups to one row per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Clock
from tidemark.functions import (
    completed_years,
    day_gap,
    digits_or_null,
    first_match,
    money,
    norm_key,
    sum_where,
)
from tidemark.operators.keys import dedup_latest
from tidemark.schemas import CUSTOMER, INGESTED

# Fixed labels: cleaned product and channel keys, product segments, and the upper
# age limit (exclusive) of each age band.
CARD, SAVINGS = "CREDIT CARD", "SAVINGS"
CHANNELS = ("EMAIL", "CHAT", "CALL")
BOTH, CARD_ONLY, SAVINGS_ONLY, NO_PRODUCT = (
    "Savings + Credit Card",
    "Credit Card Only",
    "Savings Only",
    "No Product",
)
AGE_BANDS = (
    (18, "Under 18"),
    (25, "18-24"),
    (35, "25-34"),
    (45, "35-44"),
    (55, "45-54"),
    (65, "55-64"),
)
OLDEST_BAND = "65+"


def silver_customers(raw: DataFrame, clock: Clock = Clock()) -> DataFrame:
    """Cleaned customers, the latest load of each id, with age and tenure."""
    first, last = F.trim("first_name"), F.trim("last_name")
    cleaned = raw.where(F.col(CUSTOMER).isNotNull()).select(
        CUSTOMER,
        first.alias("first_name"),
        last.alias("last_name"),
        F.concat(first, F.lit(" "), last).alias("full_name"),
        F.lower(F.trim("email")).alias("email"),
        digits_or_null(F.col("mobile")).alias("mobile_clean"),
        F.trim("gender").alias("gender"),
        F.col("date_of_birth").cast("date").alias("date_of_birth"),
        F.col("signup_date").cast("date").alias("signup_date"),
        INGESTED,
    )
    age = F.col("age")
    return (
        dedup_latest(cleaned, [CUSTOMER], INGESTED)
        .withColumn("age", completed_years(clock.today(), F.col("date_of_birth")))
        .withColumn("age_band", first_match([(age < top, b) for top, b in AGE_BANDS], OLDEST_BAND))
        .withColumn("days_since_signup", day_gap(clock.today(), F.col("signup_date")))
        .select(
            CUSTOMER,
            "first_name",
            "last_name",
            "full_name",
            "email",
            "mobile_clean",
            "gender",
            "date_of_birth",
            "age",
            "age_band",
            "signup_date",
            "days_since_signup",
            INGESTED,
        )
    )


def silver_products(enrollments: DataFrame) -> DataFrame:
    """Product holdings per customer. Only cards carry a credit limit."""
    kind, held = F.col("kind"), F.col("held")
    rows = enrollments.where("product_id IS NOT NULL AND customer_id IS NOT NULL").select(
        CUSTOMER,
        norm_key(F.col("product_type")).alias("kind"),
        F.col("enrollment_date").cast("date").alias("held"),
        money(F.col("limit")).alias("card_limit"),
        INGESTED,
    )
    card_limit = F.when(kind == CARD, F.col("card_limit"))
    totals = rows.groupBy(CUSTOMER).agg(
        F.count("*").alias("total_products"),
        F.count_if(kind == CARD).alias("credit_card_count"),
        F.count_if(kind == SAVINGS).alias("savings_count"),
        F.max(card_limit).alias("max_credit_limit"),
        F.sum(F.coalesce(card_limit, F.lit(0))).alias("total_credit_limit"),
        F.min(held).alias("first_product_date"),
        F.max(held).alias("latest_product_date"),
        F.max(INGESTED).alias("stamp"),
    )
    card, savings = F.col("credit_card_count") > 0, F.col("savings_count") > 0
    return totals.select(
        *totals.drop("stamp").columns,
        card.alias("has_credit_card"),
        savings.alias("has_savings"),
        (F.col("total_products") > 1).alias("is_multi_product"),
        first_match(
            [(card & savings, BOTH), (card, CARD_ONLY), (savings, SAVINGS_ONLY)], NO_PRODUCT
        ).alias("product_segment"),
        F.col("stamp").alias(INGESTED),
    )


def silver_interactions(interactions: DataFrame) -> DataFrame:
    """Contacts per customer; the last channel is settled by date, then contact id."""
    rows = interactions.where("interaction_id IS NOT NULL AND customer_id IS NOT NULL").select(
        CUSTOMER,
        "interaction_id",
        norm_key(F.col("interaction_type")).alias("channel"),
        F.col("interaction_date").cast("date").alias("day"),
        INGESTED,
    )
    return rows.groupBy(CUSTOMER).agg(
        F.count("*").alias("total_interactions"),
        *(F.count_if(F.col("channel") == c).alias(f"{c.lower()}_interactions") for c in CHANNELS),
        F.min("day").alias("first_interaction_date"),
        F.max("day").alias("last_interaction_date"),
        F.max_by("channel", F.struct("day", "interaction_id")).alias("last_interaction_type"),
        F.max(INGESTED).alias(INGESTED),
    )


def with_product_type(transactions: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Transactions with the cleaned type of their product, NULL when unknown.

    Only two narrow columns of the enrollments travel. Catalyst broadcasts them when
    their known size allows, and otherwise joins by shuffle, where adaptive execution
    splits a product that holds a large part of the transactions.
    """
    kinds = enrollments.select("product_id", norm_key(F.col("product_type")).alias("kind"))
    return transactions.join(kinds, "product_id", "left")


def silver_transactions(transactions: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Transaction totals, balances and per-product-type activity per customer.

    Enrollments are expected to be unique by product: a repeated product counts its
    transactions again, which the uniqueness rule reports.
    """
    valid = "transaction_id IS NOT NULL AND customer_id IS NOT NULL AND product_id IS NOT NULL"
    rows = with_product_type(transactions.where(valid), enrollments).select(
        CUSTOMER,
        "transaction_id",
        money(F.col("transaction_amount")).alias("amount"),
        money(F.col("closing_balance")).alias("balance"),
        F.col("transaction_date").cast("timestamp").alias("at"),
        "kind",
        INGESTED,
    )
    amount, balance, day = F.col("amount"), F.col("balance"), F.col("at").cast("date")
    size, kind = F.abs("amount"), F.col("kind")
    return rows.groupBy(CUSTOMER).agg(
        F.count("*").alias("total_transactions"),
        F.count_if(amount < 0).alias("debit_count"),
        F.count_if(amount > 0).alias("credit_count"),
        F.sum(size).alias("total_transaction_value"),
        F.sum(amount).alias("net_transaction_amount"),
        F.avg(size).alias("avg_transaction_value"),
        sum_where(amount < 0, size).alias("total_debit_value"),
        sum_where(amount > 0, size).alias("total_credit_value"),
        F.max(balance).alias("max_balance"),
        F.min(balance).alias("min_balance"),
        F.min(day).alias("first_transaction_date"),
        F.max(day).alias("last_transaction_date"),
        F.max_by(balance, F.struct("at", "transaction_id")).alias("current_balance"),
        sum_where(kind == CARD, size).alias("credit_card_transaction_value"),
        sum_where(kind == SAVINGS, size).alias("savings_transaction_value"),
        sum_where(kind == CARD, amount).alias("credit_card_net_transaction_amount"),
        sum_where(kind == SAVINGS, amount).alias("savings_net_transaction_amount"),
        F.count_if(kind == CARD).alias("credit_card_transaction_count"),
        F.count_if(kind == SAVINGS).alias("savings_transaction_count"),
        F.max(INGESTED).alias(INGESTED),
    )
