"""Small column expressions, all JVM built-ins so they stay inside codegen."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schemas import MONEY


def norm_key(label: Column) -> Column:
    """Category label without outer blanks, upper case."""
    return F.upper(F.trim(label))


def digits_or_null(text: Column) -> Column:
    """Only the digits of a text; NULL when there are none."""
    return F.nullif(F.regexp_replace(text.cast("string"), r"\D", ""), F.lit(""))


def money(value: Column) -> Column:
    return value.cast(MONEY)


def first_match(cases: Iterable[tuple[Column, object]], otherwise: object) -> Column:
    """Label of the first true predicate, in the given order.

    A NULL predicate counts as not met, so a NULL input ends in `otherwise`.
    """
    (predicate, label), *rest = cases
    picked = reduce(lambda acc, case: acc.when(*case), rest, F.when(predicate, label))
    return picked.otherwise(otherwise)


def sum_where(predicate: Column, value: Column) -> Column:
    """Sum of `value` over the rows meeting `predicate`; 0 when none does."""
    return F.sum(F.when(predicate, value).otherwise(0))


def completed_years(on: Column, born: Column) -> Column:
    """Whole years from `born` to `on`; two month ends count as full months."""
    return F.floor(F.months_between(on, born) / 12)


def day_gap(on: Column, since: Column) -> Column:
    """Days from `since` to `on`: negative for a future date, NULL for none."""
    return F.datediff(on, since)


def is_blank(name: str, is_text: bool) -> Column:
    """NULL, or the empty string where the column is text."""
    missing = f"`{name}` IS NULL"
    return F.expr(f"{missing} OR `{name}` = ''" if is_text else missing)


def starts_with_none(text: Column, prefixes: Iterable[str]) -> Column:
    """True when the text begins with none of the prefixes (NULL stays NULL)."""
    return reduce(lambda a, b: a & b, [~text.startswith(p) for p in prefixes])


def zone_aware(text: Column) -> Column:
    """True when a timestamp's text names an offset or ends in the UTC mark."""
    raw = text.cast("string")
    return raw.contains("+") | raw.endswith("Z")
