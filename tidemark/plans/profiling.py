"""Reports on the raw tables: completeness, duplicates, ranges, references, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import Clock
from tidemark.functions import completed_years, norm_key, starts_with_none, zone_aware
from tidemark.operators.keys import distinct_keys, orphan_keys, top_k, union_all
from tidemark.operators.summaries import (
    blank_counts,
    blanks,
    count_by,
    exact_percentiles,
    fan_out,
    repeated,
    share_of_total,
    surplus_rows,
    table_counts,
)
from tidemark.plans.silver import SAVINGS
from tidemark.sources.delimited import TEXT_SUFFIX

# Fixed spellings of a standard phone number and fixed age limits of the report.
LOCAL_PREFIX, COUNTRY_PREFIX = "09", "+63"
ADULT, VERY_OLD = 18, 100
PERCENTILES = ("0.01", "0.25", "0.50", "0.75", "0.99")


def profile_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return table_counts(tables)


def profile_nulls(tables: Mapping[str, DataFrame]) -> DataFrame:
    """NULL-or-empty values per table and column, one scan per table."""
    return union_all(
        *(
            blanks(df).select(F.lit(name).alias("table_name"), "column_name", "n_blank")
            for name, df in tables.items()
        )
    )


def profile_duplicates(columns: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Rows, values and surplus rows for each (table, frame, column)."""
    return union_all(
        *(
            surplus_rows(df, column).select(
                F.lit(name).alias("table_name"),
                F.lit(column).alias("column_name"),
                "n_rows",
                "n_values",
                "n_duplicates",
            )
            for name, df, column in columns
        )
    )


def top_duplicates(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The `k` most repeated values; equal counts are settled by the value."""
    return top_k(repeated(df, column), [F.desc("n"), F.asc(column)], k)


Metrics = dict[str, Column]


def _measured(df: DataFrame, metrics: Metrics) -> DataFrame:
    return df.agg(*(c.alias(name) for name, c in metrics.items()))


def age_metrics(clock: Clock = Clock()) -> Metrics:
    age = completed_years(clock.today(), F.col("date_of_birth"))
    return {
        "min_age": F.min(age),
        "max_age": F.max(age),
        "avg_age": F.avg(age),
        "under_18": F.count_if(age < ADULT),
        "over_100": F.count_if(age > VERY_OLD),
    }


def profile_ages(customers: DataFrame, clock: Clock = Clock()) -> DataFrame:
    return _measured(customers, age_metrics(clock))


def phone_format(mobile: Column) -> Column:
    return (
        F.when(mobile.startswith(LOCAL_PREFIX), f"{LOCAL_PREFIX}...")
        .when(mobile.startswith(COUNTRY_PREFIX), f"{COUNTRY_PREFIX}...")
        .otherwise("other")
    )


def profile_phone_formats(customers: DataFrame) -> DataFrame:
    formats = count_by(customers, phone_format(F.col("mobile")).alias("phone_format"))
    return formats.orderBy("phone_format")


def odd_phones(customers: DataFrame, k: int = 20) -> DataFrame:
    """A sample of numbers in neither format, lowest customer ids first."""
    odd = starts_with_none(F.col("mobile"), (LOCAL_PREFIX, COUNTRY_PREFIX))
    return top_k(customers.where(odd).select("customer_id", "mobile"), [F.asc("customer_id")], k)


def profile_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows and percentage per value, most frequent first."""
    return share_of_total(df, column).orderBy(F.desc("n"), F.asc(column))


def profile_label_hygiene(df: DataFrame, column: str) -> DataFrame:
    """Raw labels beside their cleaned form, with counts."""
    clean = norm_key(F.col(column)).alias(f"{column}_clean")
    return count_by(df, column, clean).orderBy(column)


def limit_metrics() -> Metrics:
    limit = F.col("limit")
    savings = norm_key(F.col("product_type")) == SAVINGS
    return {
        "min_limit": F.min(limit),
        "max_limit": F.max(limit),
        "avg_limit": F.avg(limit),
        "negative_limits": F.count_if(limit < 0),
        "savings_with_nonzero_limit": F.count_if(savings & (limit != 0)),
    }


def profile_limits(enrollments: DataFrame) -> DataFrame:
    return _measured(enrollments, limit_metrics())


def profile_orphans(
    references: Sequence[tuple[str, DataFrame, str, DataFrame]],
) -> DataFrame:
    """Child rows without a parent for each (label, child, key, parent); a NULL key
    has no parent."""
    return union_all(
        *(
            orphan_keys(child, parent, key, key)
            .agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_orphans"))
            .select(F.lit(label).alias("reference"), "n_orphans")
            for label, child, key, parent in references
        )
    )


def profile_products_per_customer(enrollments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(min, max and average products per customer, histogram)."""
    spread, histogram = fan_out(enrollments, "customer_id")
    named = spread.toDF("min_products", "max_products", "avg_products")
    return named, histogram.toDF("products_per_customer", "num_customers").orderBy(
        "products_per_customer"
    )


def range_metrics(column: str) -> Metrics:
    return {
        "earliest": F.min(column).cast("timestamp"),
        "latest": F.max(column).cast("timestamp"),
    }


def profile_date_ranges(columns: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Earliest and latest value for each (table, frame, date column)."""
    return union_all(
        *(
            _measured(df, range_metrics(column)).select(
                F.lit(name).alias("table_name"),
                F.lit(column).alias("column_name"),
                "earliest",
                "latest",
            )
            for name, df, column in columns
        )
    )


def amount_metrics(column: str = "transaction_amount") -> Metrics:
    """Range, mean, sample deviation and percentiles, all from one sketch."""
    points = F.percentile_approx(column, [float(p) for p in PERCENTILES])
    return {
        "min_amount": F.min(column),
        "max_amount": F.max(column),
        "mean_amount": F.avg(column),
        "stddev_amount": F.stddev(column),
        **{_percentile_name(p): points[i] for i, p in enumerate(PERCENTILES)},
    }


def profile_amounts(transactions: DataFrame, column: str = "transaction_amount") -> DataFrame:
    return _measured(transactions, amount_metrics(column))


def profile_amount_percentiles(
    transactions: DataFrame, column: str = "transaction_amount"
) -> DataFrame:
    """The percentiles of `profile_amounts`, exact: (percentile, value)."""
    exact = exact_percentiles(transactions, column, PERCENTILES)
    names = F.create_map(*(F.lit(x) for p in PERCENTILES for x in (p, _percentile_name(p))))
    return exact.select(names[F.col("fraction")].alias("percentile"), "value")


def _percentile_name(fraction: str) -> str:
    return f"p{round(float(fraction) * 100)}"


def outliers(
    transactions: DataFrame, column: str = "transaction_amount", sigmas: int = 3
) -> DataFrame:
    """Rows further than `sigmas` sample deviations from the mean."""
    stats = transactions.agg(F.avg(column).alias("mean"), F.stddev(column).alias("sd"))
    mean, deviation = stats.select("mean").scalar(), stats.select("sd").scalar()
    return transactions.where(F.abs(F.col(column) - mean) > sigmas * deviation)


def profile_outliers(transactions: DataFrame, column: str = "transaction_amount") -> DataFrame:
    return outliers(transactions, column).agg(F.count("*").alias("n_outliers"))


def balance_metrics() -> Metrics:
    balance = F.col("closing_balance")
    negative = F.count_if(balance < 0)
    share = 100 * negative.cast("double") / F.nullif(F.count("*"), F.lit(0))
    return {
        "n_negative": negative,
        "pct_negative": F.round(share, 1),
        "min_balance": F.min(balance),
        "max_balance": F.max(balance),
        "avg_balance": F.avg(balance),
    }


def profile_balances(transactions: DataFrame) -> DataFrame:
    return _measured(transactions, balance_metrics())


def zone_metrics(column: str = "transaction_date", delivered: Sequence[str] = ()) -> Metrics:
    """Of the delivered text, where ingest kept it among the columns `delivered`."""
    column = f"{column}{TEXT_SUFFIX}" if f"{column}{TEXT_SUFFIX}" in delivered else column
    return {"n_zone_aware": F.count_if(zone_aware(F.col(column))), "n_rows": F.count("*")}


def profile_naive_timestamps(df: DataFrame, column: str = "transaction_date") -> DataFrame:
    """How many timestamps name a zone, in the text as it was delivered if it was kept."""
    return _measured(df, zone_metrics(column, df.columns))


def profile_coverage(
    customers: DataFrame, enrollments: DataFrame, interactions: DataFrame, transactions: DataFrame
) -> DataFrame:
    """Customers lacking products, contacts, transactions, or the last two.

    Each side is reduced to its distinct customers before it meets the customers,
    and all four answers come from one pass over the joined flags.
    """
    sides = {"products": enrollments, "crm": interactions, "transactions": transactions}
    flagged = customers.select("customer_id")
    for name, side in sides.items():
        present = distinct_keys(side, "customer_id").withColumn(f"has_{name}", F.lit(True))
        flagged = flagged.join(present, "customer_id", "left")
    lacks = {name: F.col(f"has_{name}").isNull() for name in sides}
    lacks["crm_and_transactions"] = lacks["crm"] & lacks["transactions"]
    counts = flagged.agg(
        F.count("*").alias("total"), *(F.count_if(p).alias(name) for name, p in lacks.items())
    )
    gaps = counts.unpivot("total", list(lacks), "missing", "n_customers")
    share = 100 * F.col("n_customers").cast("double") / F.nullif(F.col("total"), F.lit(0))
    return gaps.select("missing", "n_customers", F.round(share, 1).alias("pct"))


def profile_report(
    customers: DataFrame,
    enrollments: DataFrame,
    interactions: DataFrame,
    transactions: DataFrame,
    clock: Clock = Clock(),
) -> DataFrame:
    """The whole report in long form: (section, item, metric, value).

    Everything one row at a time can tell about a table is one aggregate over one
    scan; what needs keys is counted per key first. Nothing is collected.
    """
    tables = {
        "customer_raw": customers,
        "product_enrollments": enrollments,
        "crm_interactions": interactions,
        "transaction_history": transactions,
    }
    scans: dict[str, dict[str, Metrics]] = {
        "customer_raw": {"age": age_metrics(clock), "signup_date": range_metrics("signup_date")},
        "product_enrollments": {"limit": limit_metrics()},
        "crm_interactions": {"interaction_date": range_metrics("interaction_date")},
        "transaction_history": {
            "amount": amount_metrics(),
            "balance": balance_metrics(),
            "zone": zone_metrics(delivered=transactions.columns),
            "transaction_date": range_metrics("transaction_date"),
        },
    }
    keys = [
        ("customer_raw", customers, "customer_id"),
        ("customer_raw", customers, "email"),
        ("product_enrollments", enrollments, "product_id"),
        ("crm_interactions", interactions, "interaction_id"),
        ("transaction_history", transactions, "transaction_id"),
    ]
    references = [
        ("enrollment to customer", enrollments, "customer_id", customers),
        ("interaction to customer", interactions, "customer_id", customers),
        ("transaction to product", transactions, "product_id", enrollments),
        ("transaction to customer", transactions, "customer_id", customers),
    ]
    distributions = [
        ("gender", customers),
        ("product_type", enrollments),
        ("interaction_type", interactions),
    ]
    spread, histogram = profile_products_per_customer(enrollments)
    coverage = profile_coverage(customers, enrollments, interactions, transactions)
    labels = profile_label_hygiene(enrollments, "product_type")
    odd = odd_phones(customers).distinct().selectExpr(
        "'odd_phone' AS section", "CAST(customer_id AS STRING) AS item", "'mobile' AS metric", "mobile AS value"
    )
    return union_all(
        *(_one_scan(name, df, scans[name]) for name, df in tables.items()),
        _long("duplicate", profile_duplicates(keys), F.concat_ws(".", "table_name", "column_name")),
        _long("top_duplicate", top_duplicates(customers, "email"), F.col("email")),
        _long("phone_format", profile_phone_formats(customers), F.col("phone_format")),
        odd,
        _long("label", labels, F.concat_ws(" | ", "product_type", "product_type_clean")),
        *(_long(c, share_of_total(df, c), F.col(c)) for c, df in distributions),
        _long("orphan", profile_orphans(references), F.col("reference")),
        _long("products_per_customer", spread, F.lit("all")),
        _long("products_per_customer", histogram, F.col("products_per_customer")),
        _long("outlier", profile_outliers(transactions), F.lit("transaction_amount")),
        _long("coverage", coverage, F.col("missing")),
    )


def _one_scan(name: str, df: DataFrame, groups: Mapping[str, Metrics]) -> DataFrame:
    """Row count, blanks per column and the given metrics of one table."""
    labels = [("row_count", name, "n_rows"), *(("blank", f"{name}.{c}", "n_blank") for c in df.columns)]
    values = [F.count("*"), *blank_counts(df).values()]
    for section, metrics in groups.items():
        labels += [(section, name, metric) for metric in metrics]
        values += metrics.values()
    entries = [
        f"struct('{section}' AS section, '{item}' AS item, '{metric}' AS metric, "
        f"CAST(m{i} AS STRING) AS value)"
        for i, (section, item, metric) in enumerate(labels)
    ]
    measured = df.agg(*(v.alias(f"m{i}") for i, v in enumerate(values)))
    return measured.selectExpr(f"inline(array({', '.join(entries)}))")


def _long(section: str, df: DataFrame, item: Column) -> DataFrame:
    """The numeric columns of a small report, one row each."""
    metrics = [f.name for f in df.schema if f.dataType.typeName() != "string"]
    texts = [f"CAST(`{c}` AS STRING) AS `{c}`" for c in metrics]
    rows = df.select(item.cast("string").alias("item"), *(F.expr(t) for t in texts))
    return rows.unpivot("item", metrics, "metric", "value").select(
        F.lit(section).alias("section"), "item", "metric", "value"
    )
