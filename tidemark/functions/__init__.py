"""Column helpers: every function takes and returns Spark columns."""

from tidemark.functions.columns import (
    completed_years,
    day_gap,
    digits_or_null,
    first_match,
    is_blank,
    money,
    norm_key,
    starts_with_none,
    sum_where,
    zone_aware,
)

__all__ = [
    "completed_years",
    "day_gap",
    "digits_or_null",
    "first_match",
    "is_blank",
    "money",
    "norm_key",
    "starts_with_none",
    "sum_where",
    "zone_aware",
]
