"""The gold profile: one wide row per silver customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import EPOCH, Clock, Thresholds, moment
from tidemark.functions import day_gap, first_match
from tidemark.plans.silver import NO_PRODUCT
from tidemark.schemas import CUSTOMER, INGESTED

# Columns a customer without such rows keeps as NULL, by design: an unknown limit,
# date, channel or balance is not zero.
UNKNOWN_STAYS_NULL = {
    "max_credit_limit",
    "total_credit_limit",
    "first_product_date",
    "latest_product_date",
    "first_interaction_date",
    "last_interaction_date",
    "last_interaction_type",
    "max_balance",
    "min_balance",
    "current_balance",
    "first_transaction_date",
    "last_transaction_date",
}
_DEFAULTS = {"boolean": False, "string": NO_PRODUCT}

# Fixed segment labels, best first.
STATUSES = ("Never Active", "Active", "At Risk", "Dormant")
VALUE_SEGMENTS = ("High Value", "Medium Value", "Low Value", "No Transaction")
SEGMENTS = ("Premium", "Standard", "Basic")
ENGAGEMENTS = ("Highly Engaged", "Moderately Engaged", "Low Engagement", "No CRM Engagement")
STAGES = ("New", "Growing", "Established", "Mature")


def join_silver(
    customers: DataFrame, products: DataFrame, interactions: DataFrame, transactions: DataFrame
) -> DataFrame:
    """Every silver customer with its roll-ups, defaults filled in.

    All four sides are unique on the join key and, as aggregates or bucketed
    tables, already partitioned on it, so the joins add no shuffle.
    """
    sides = {"products": products, "interactions": interactions, "transactions": transactions}
    wide = customers.withColumnRenamed(INGESTED, "_customer_ingested_at")
    for name, side in sides.items():
        wide = wide.join(side.withColumnRenamed(INGESTED, f"_{name}_ingested_at"), CUSTOMER, "left")

    stamps = ["_customer_ingested_at", *(f"_{name}_ingested_at" for name in sides)]
    measures = [
        _or_default(field.name, field.dataType.typeName())
        for side in sides.values()
        for field in side.schema
        if field.name not in (CUSTOMER, INGESTED)
    ]
    return wide.select(
        *(c for c in customers.columns if c != INGESTED),
        *measures,
        *(F.coalesce(s, moment(EPOCH)).alias(s) for s in stamps),
    )


def _or_default(name: str, kind: str) -> Column:
    if name in UNKNOWN_STAYS_NULL:
        return F.col(name)
    return F.coalesce(name, F.lit(_DEFAULTS.get(kind, 0))).alias(name)


def recency(df: DataFrame, clock: Clock, limits: Thresholds) -> DataFrame:
    """Last activity, day gaps, active flag and status."""
    gap = F.col("days_since_last_activity")
    never, active, risk, dormant = STATUSES
    return (
        df.withColumn(
            "last_activity_date", F.greatest("last_transaction_date", "last_interaction_date")
        )
        .withColumns(
            {
                f"days_since_last_{what}": day_gap(clock.today(), F.col(f"last_{what}_date"))
                for what in ("transaction", "interaction", "activity")
            }
        )
        .withColumn("is_active_customer", F.coalesce(gap <= limits.active_days, F.lit(False)))
        .withColumn(
            "customer_status",
            first_match(
                [
                    (gap.isNull(), never),
                    (gap <= limits.active_days, active),
                    (gap <= limits.at_risk_days, risk),
                ],
                dormant,
            ),
        )
    )


def segments(df: DataFrame, limits: Thresholds) -> DataFrame:
    """Value, tier, engagement and lifecycle labels and the card activity ratio."""
    value, contacts = F.col("total_transaction_value"), F.col("total_interactions")
    tenure, limit = F.col("days_since_signup"), F.col("max_credit_limit")
    high, medium, low, none = VALUE_SEGMENTS
    premium, standard, basic = SEGMENTS
    highly, moderately, little, silent = ENGAGEMENTS
    new, growing, established, mature = STAGES
    return df.withColumns(
        {
            "customer_value_segment": first_match(
                [(value >= limits.high_value, high), (value >= limits.medium_value, medium), (value > 0, low)],
                none,
            ),
            "customer_segment": first_match(
                [
                    (F.col("has_credit_card") & (value >= limits.premium_value), premium),
                    (F.col("is_multi_product"), standard),
                ],
                basic,
            ),
            "engagement_segment": first_match(
                [
                    (contacts >= limits.highly_engaged, highly),
                    (contacts >= limits.moderately_engaged, moderately),
                    (contacts > 0, little),
                ],
                silent,
            ),
            "credit_card_activity_to_limit_ratio": F.when(
                limit > 0, F.col("credit_card_transaction_value") / limit
            ),
            "customer_lifecycle_stage": first_match(
                [
                    (tenure < limits.new_days, new),
                    (tenure < limits.growing_days, growing),
                    (tenure < limits.established_days, established),
                ],
                mature,
            ),
        }
    )


def customer_profile(
    customers: DataFrame,
    products: DataFrame,
    interactions: DataFrame,
    transactions: DataFrame,
    clock: Clock = Clock(),
    limits: Thresholds = Thresholds(),
) -> DataFrame:
    """All 66 columns of the profile; `_gold_updated_at` is the build time."""
    wide = join_silver(customers, products, interactions, transactions)
    stamps = [c for c in wide.columns if c.endswith(INGESTED)]
    return (
        segments(recency(wide, clock, limits), limits)
        .withColumn("_latest_source_ingested_at", F.greatest(*stamps))
        .withColumn("_gold_updated_at", clock.instant().cast("timestamp"))
    )


def status_summary(profile: DataFrame) -> DataFrame:
    """Customers per status and segment."""
    counts = profile.groupBy("customer_status", "customer_segment")
    return counts.agg(F.count("*").alias("customers")).orderBy("customer_status", "customer_segment")


def deidentify(
    df: DataFrame,
    drop: tuple[str, ...] = ("first_name", "last_name", "full_name", "date_of_birth"),
    hash: tuple[str, ...] = ("email", "mobile_clean"),
) -> DataFrame:
    """The frame without direct identifiers: some dropped, some as SHA-256."""
    kept = df.drop(*drop)
    return kept.withColumns({c: F.sha2(F.col(c), 256) for c in hash})
