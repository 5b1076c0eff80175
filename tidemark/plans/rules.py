"""The declared rules of every layer and the business assertions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Thresholds
from tidemark.operators.keys import orphan_keys, orphans, owner_mismatch, owner_mismatch_count
from tidemark.operators.summaries import repeated
from tidemark.plans.gold import ENGAGEMENTS, SEGMENTS, STAGES, STATUSES, VALUE_SEGMENTS
from tidemark.plans.silver import (
    AGE_BANDS,
    BOTH,
    CARD_ONLY,
    CHANNELS,
    NO_PRODUCT,
    OLDEST_BAND,
    SAVINGS_ONLY,
)
from tidemark.schemas import CUSTOMER, GOLD, INGESTED, RAW, SILVER

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Rule:
    """A column rule. `rows` returns the violating rows, `failures` their number."""

    kind: str
    table: str
    column: str
    values: tuple[str, ...] = ()
    parent: str = ""
    parent_column: str = ""
    severity: str = "error"

    @property
    def rule_id(self) -> str:
        return f"{self.kind}_{self.table}_{self.column}"

    @property
    def tables(self) -> tuple[str, ...]:
        return (self.table, self.parent) if self.parent else (self.table,)

    @property
    def violation(self) -> str | None:
        """The violation as SQL, for rules one row alone can violate."""
        if self.kind == "not_null":
            return f"`{self.column}` IS NULL"
        if self.kind == "accepted_values":
            listed = ", ".join("'" + v.replace("'", "\\'") + "'" for v in self.values)
            return f"`{self.column}` NOT IN ({listed})"
        return None

    def rows(self, tables: Tables) -> DataFrame:
        df = tables[self.table]
        if self.violation is not None:
            return df.where(self.violation)
        if self.kind == "unique":
            return repeated(df, self.column)
        return orphans(df, tables[self.parent], self.column, self.parent_column)

    def failures(self, tables: Tables) -> DataFrame:
        """One row `failures`: how many rows `rows` returns, from per-key counts."""
        if self.kind == "relationships":
            lost = orphan_keys(tables[self.table], tables[self.parent], self.column, self.parent_column)
            lost = lost.where(F.col(self.column).isNotNull())
            return lost.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("failures"))
        return self.rows(tables).agg(F.count("*").alias("failures"))


@dataclass(frozen=True)
class Assertion:
    """A business rule over one or more tables: `find` gives the violating rows and
    `count`, where given, their number at less cost. `also` names further tables."""

    rule_id: str
    table: str
    find: Callable[[Tables], DataFrame]
    count: Callable[[Tables], DataFrame] | None = None
    also: tuple[str, ...] = ()
    severity: str = "error"

    @property
    def tables(self) -> tuple[str, ...]:
        return (self.table, *self.also)

    def rows(self, tables: Tables) -> DataFrame:
        return self.find(tables)

    def failures(self, tables: Tables) -> DataFrame:
        if self.count is not None:
            return self.count(tables)
        return self.rows(tables).agg(F.count("*").alias("failures"))


def _rules(
    table: str,
    columns: Iterable[str],
    unique: str,
    nullable: Iterable[str] = (),
    accepted: Mapping[str, tuple[str, ...]] | None = None,
    parents: Mapping[str, tuple[str, str]] | None = None,
) -> list[Rule]:
    skip = set(nullable)
    return [
        Rule("unique", table, unique),
        *(Rule("not_null", table, c) for c in columns if c not in skip),
        *(Rule("accepted_values", table, c, values=v) for c, v in (accepted or {}).items()),
        *(
            Rule("relationships", table, c, parent=p, parent_column=k)
            for c, (p, k) in (parents or {}).items()
        ),
    ]


# Fixed accepted values.
GENDERS = ("Male", "Female")
PROFILE_GENDERS = (*GENDERS, "Other", "Unknown", "Prefer not to say")
RAW_PRODUCTS = ("Savings", "Credit Card")
RAW_CHANNELS = ("Email", "Chat", "Call")
PRODUCT_SEGMENTS = (BOTH, CARD_ONLY, SAVINGS_ONLY, NO_PRODUCT)
BANDS = (*(label for _, label in AGE_BANDS), OLDEST_BAND)
ADULT_BANDS = BANDS[1:]

_raw_customers, _raw_enrollments, _raw_contacts, _raw_transactions = RAW
_customers, _products, _interactions, _transactions = SILVER


def bronze_rules() -> list[Rule]:
    columns = {table: [*schema.names, INGESTED] for table, schema in RAW.items()}
    customer = {CUSTOMER: (_raw_customers, CUSTOMER)}
    return [
        *_rules(
            _raw_customers, columns[_raw_customers], CUSTOMER, accepted={"gender": GENDERS}
        ),
        *_rules(
            _raw_enrollments,
            columns[_raw_enrollments],
            "product_id",
            nullable=["limit"],
            accepted={"product_type": RAW_PRODUCTS},
            parents=customer,
        ),
        *_rules(
            _raw_contacts,
            columns[_raw_contacts],
            "interaction_id",
            accepted={"interaction_type": RAW_CHANNELS},
            parents=customer,
        ),
        *_rules(
            _raw_transactions,
            columns[_raw_transactions],
            "transaction_id",
            parents=customer | {"product_id": (_raw_enrollments, "product_id")},
        ),
    ]


def silver_rules(columns: Mapping[str, list[str]], only: Iterable[str] = SILVER) -> list[Rule]:
    """Rules of the silver tables; `columns` lists each table's columns."""
    customer = {CUSTOMER: (_customers, CUSTOMER)}
    details = {
        _customers: {"accepted": {"gender": GENDERS, "age_band": ADULT_BANDS}},
        _products: {
            "nullable": ["max_credit_limit"],
            "accepted": {"product_segment": PRODUCT_SEGMENTS},
            "parents": customer,
        },
        _interactions: {"accepted": {"last_interaction_type": CHANNELS}, "parents": customer},
        _transactions: {"parents": customer},
    }
    return [r for t in only for r in _rules(t, columns[t], CUSTOMER, **details[t])]


# Fixed list. Profile columns that may be NULL: what a customer without such rows lacks, and what
# follows from it. `total_credit_limit` is not among them although it is NULL for a
# customer without products; the rule reports that and is meant to.
PROFILE_NULLABLE = (
    "max_credit_limit",
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
    "last_activity_date",
    "days_since_last_transaction",
    "days_since_last_interaction",
    "days_since_last_activity",
    "credit_card_activity_to_limit_ratio",
)


def gold_rules(columns: list[str]) -> list[Rule]:
    return _rules(
        GOLD,
        columns,
        CUSTOMER,
        nullable=PROFILE_NULLABLE,
        accepted={
            "gender": PROFILE_GENDERS,
            "age_band": BANDS,
            "product_segment": PRODUCT_SEGMENTS,
            "last_interaction_type": CHANNELS,
            "customer_status": STATUSES,
            "customer_value_segment": VALUE_SEGMENTS,
            "customer_segment": SEGMENTS,
            "engagement_segment": ENGAGEMENTS,
            "customer_lifecycle_stage": STAGES,
        },
        parents={CUSTOMER: (_customers, CUSTOMER)},
    )


def duplicate_email_rule() -> Rule:
    """Shared e-mail addresses are worth a look, never a reason to stop."""
    return Rule("unique", _customers, "email", severity="warn")


# Business assertions -----------------------------------------------------------

# Fixed list of columns, in the order they are reported.
NON_NEGATIVE = (
    "age",
    "days_since_signup",
    "total_products",
    "total_interactions",
    "total_transactions",
    "credit_card_count",
    "savings_count",
    "email_interactions",
    "chat_interactions",
    "call_interactions",
    "debit_count",
    "credit_count",
    "total_transaction_value",
    "total_debit_value",
    "total_credit_value",
    "credit_card_transaction_value",
    "savings_transaction_value",
    "credit_card_transaction_count",
    "savings_transaction_count",
    "days_since_last_activity",
)


def assert_value_identity(transactions: DataFrame) -> DataFrame:
    """Customers whose total is not debits plus credits, to the cent."""
    total, debit, credit = "total_transaction_value", "total_debit_value", "total_credit_value"
    differs = F.round(total, 2) != F.round(F.col(debit) + F.col(credit), 2)
    return transactions.where(differs).select(CUSTOMER, total, debit, credit)


def assert_recency_consistent(profile: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Customers whose status, active flag and recency contradict each other."""
    status, flag = F.col("customer_status"), F.col("is_active_customer")
    seen, gap = F.col("last_activity_date"), F.col("days_since_last_activity")
    not_recent = seen.isNull() | (gap > limits.active_days)
    wrong = (
        ((status == "Active") & (not_recent | ~flag))
        | (flag & (not_recent | (status != "Active")))
        | ((status == "Never Active") & seen.isNotNull())
    )
    return profile.where(wrong).select(
        CUSTOMER,
        "last_activity_date",
        "days_since_last_activity",
        "is_active_customer",
        "customer_status",
    )


def assert_premium(profile: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Premium customers without a card or below the premium value."""
    short = ~F.col("has_credit_card") | (F.col("total_transaction_value") < limits.premium_value)
    return profile.where((F.col("customer_segment") == "Premium") & short).select(
        CUSTOMER, "customer_segment", "has_credit_card", "total_transaction_value"
    )


def assert_non_negative(profile: DataFrame) -> DataFrame:
    """Customers with a negative count, value or duration."""
    negative = reduce(lambda a, b: a | b, [F.col(c) < 0 for c in NON_NEGATIVE])
    return profile.where(negative).select(CUSTOMER, *NON_NEGATIVE)


def bronze_assertions() -> list[Assertion]:
    return [
        Assertion(
            "assert_product_owner_match",
            _raw_transactions,
            lambda t: owner_mismatch(t[_raw_transactions], t[_raw_enrollments]),
            lambda t: owner_mismatch_count(t[_raw_transactions], t[_raw_enrollments]),
            also=(_raw_enrollments,),
        )
    ]


def silver_assertions() -> list[Assertion]:
    return [
        Assertion(
            "assert_value_identity",
            _transactions,
            lambda t: assert_value_identity(t[_transactions]),
        )
    ]


def gold_assertions(limits: Thresholds = Thresholds()) -> list[Assertion]:
    return [
        Assertion("assert_non_negative", GOLD, lambda t: assert_non_negative(t[GOLD])),
        Assertion(
            "assert_recency_consistent",
            GOLD,
            lambda t: assert_recency_consistent(t[GOLD], limits),
        ),
        Assertion("assert_premium", GOLD, lambda t: assert_premium(t[GOLD], limits)),
    ]
