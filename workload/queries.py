"""One query per operator family, over the driver's tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import streaming
from tidemark.config import Clock, Thresholds, moment, pin_session
from tidemark.operators import incremental, key_index, keys, layout, owner_pairs, sketches
from tidemark.plans import checks, gold, monitoring, pipeline, profiling, rules, silver
from tidemark.schemas import CUSTOMER, CUSTOMERS, GOLD, INGESTED, RAW, SILVER, TRANSACTIONS
from tidemark.sources import (
    bronze,
    materialise,
    read_delimited,
    register_bronze,
    replace_table,
    stamp_ingest,
    table_folder,
)
from tidemark.sources.delimited import LINE, REASONS, read_checked, split_checked
from tidemark.sources.tables import append_facts, replace_facts, session_buckets
from workload.bank import CLOCK, FIRST_LOAD, SECOND_LOAD, Bank, bank, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


OTHER_LIMITS = Thresholds(
    active_days=30,
    at_risk_days=60,
    high_value=90_000,
    medium_value=30_000,
    premium_value=60_000,
    highly_engaged=7,
    moderately_engaged=5,
    new_days=200,
    growing_days=500,
    established_days=900,
)
LABELS = (
    "is_active_customer",
    "customer_status",
    "customer_value_segment",
    "customer_segment",
    "engagement_segment",
    "customer_lifecycle_stage",
)


def scratch_database(spark: SparkSession) -> str:
    """A new database whose tables live in the shared folder."""
    name = f"scratch_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{table_folder(spark, 'database')}'")
    return name


def query(fn: Callable[[Bank], DataFrame]) -> Callable[[Bank], DataFrame]:
    """Register a function of the four raw tables under its own name."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(bank(spark, sf_dir))
    return fn


@query
def silver_customers(b: Bank) -> DataFrame:
    return silver.silver_customers(b.customers, CLOCK)


@query
def silver_products(b: Bank) -> DataFrame:
    return silver.silver_products(b.enrollments)


@query
def silver_interactions(b: Bank) -> DataFrame:
    return silver.silver_interactions(b.interactions)


@query
def silver_transactions(b: Bank) -> DataFrame:
    return silver.silver_transactions(b.transactions, b.enrollments)


def profile(b: Bank) -> DataFrame:
    return gold.customer_profile(
        silver_customers(b), silver_products(b), silver_interactions(b), silver_transactions(b), CLOCK
    )


@query
def gold_profile(b: Bank) -> DataFrame:
    return profile(b).drop("_gold_updated_at")


@query
def gold_custom_thresholds(b: Bank) -> DataFrame:
    """The profile's labels under other thresholds."""
    built = gold.customer_profile(
        silver_customers(b),
        silver_products(b),
        silver_interactions(b),
        silver_transactions(b),
        CLOCK,
        OTHER_LIMITS,
    )
    return built.select("customer_id", *LABELS)


@query
def gold_status_summary(b: Bank) -> DataFrame:
    return gold.status_summary(profile(b))


@query
def gold_segment_only(b: Bank) -> DataFrame:
    return profile(b).select("customer_id", "customer_segment", "total_transaction_value")


@query
def deidentified_view(b: Bank) -> DataFrame:
    return gold.deidentify(silver_customers(b))


# Keys, joins, changes ----------------------------------------------------------


def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items repeat (order, line): the latest shipment of each is kept."""
    pin_session(spark)
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    return keys.dedup_latest(lines, ["l_orderkey", "l_linenumber"], "l_shipdate")


QUERIES["dedup_latest"] = dedup_latest


@query
def transactions_with_product_type(b: Bank) -> DataFrame:
    return silver.with_product_type(b.transactions, b.enrollments).select(
        "transaction_id", "product_id", "kind"
    )


@query
def watermark(b: Bank) -> DataFrame:
    return incremental.watermark(silver_transactions(b.loaded_by(FIRST_LOAD)))


@query
def changed_keys(b: Bank) -> DataFrame:
    target = silver_transactions(b.loaded_by(FIRST_LOAD))
    return incremental.changed_keys(b.transactions, incremental.watermark(target).scalar())


@query
def history_of_changed(b: Bank) -> DataFrame:
    changed = incremental.changed_keys(b.transactions, FIRST_LOAD)
    return keys.restrict_to(b.transactions, changed, "customer_id").select(
        "transaction_id", "customer_id"
    )


@query
def incremental_transactions(b: Bank) -> DataFrame:
    """First load in full, second load by watermark: equals the full roll-up."""
    target = materialise(silver_transactions(b.loaded_by(FIRST_LOAD)), "target")
    return incremental.incremental_refresh(
        b.transactions, target, lambda rows: silver.silver_transactions(rows, b.enrollments)
    )


@query
def incremental_interactions(b: Bank) -> DataFrame:
    target = materialise(silver_interactions(b.loaded_by(FIRST_LOAD)), "target")
    return incremental.incremental_refresh(b.interactions, target, silver.silver_interactions)


@query
def backfill_interactions(b: Bank) -> DataFrame:
    """A target that missed the second load, mended by a window over that load."""
    target = silver_interactions(b.loaded_by(FIRST_LOAD))
    end = SECOND_LOAD + dt.timedelta(days=1)
    return incremental.backfill(
        b.interactions, target, silver.silver_interactions, SECOND_LOAD, end
    )


@query
def backfill_empty_window(b: Bank) -> DataFrame:
    """A window ending where the second load begins leaves its rows out."""
    first = b.loaded_by(FIRST_LOAD)
    start = FIRST_LOAD - dt.timedelta(days=9)
    return incremental.backfill(
        b.interactions, silver_interactions(first), silver.silver_interactions, start, FIRST_LOAD
    )


# Rules and assertions ----------------------------------------------------------


def raw_tables(b: Bank) -> dict[str, DataFrame]:
    return dict(zip(RAW, [b.customers, b.enrollments, b.interactions, b.transactions]))


def stored_at_once(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Independent tables written side by side."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return dict(zip(frames, pool.map(materialise, frames.values(), frames)))


def all_tables(b: Bank) -> dict[str, DataFrame]:
    """Every layer under the names the rules use, stored as in a mart."""
    raw = stored_at_once(raw_tables(b))
    customers, enrollments, contacts, paid = raw.values()
    built = [
        silver.silver_customers(customers, CLOCK),
        silver.silver_products(enrollments),
        silver.silver_interactions(contacts),
        silver.silver_transactions(paid, enrollments),
    ]
    silver_tables = stored_at_once(dict(zip(SILVER, built)))
    whole = materialise(gold.customer_profile(*silver_tables.values(), CLOCK), GOLD)
    return raw | silver_tables | {GOLD: whole}


def all_checks(columns: dict[str, list[str]]) -> list:
    return [
        *rules.bronze_rules(),
        *rules.silver_rules(columns),
        *rules.gold_rules(columns[GOLD]),
        *rules.bronze_assertions(),
        *rules.silver_assertions(),
        *rules.gold_assertions(),
        rules.duplicate_email_rule(),
    ]


@query
def rule_summary(b: Bank) -> DataFrame:
    """Every declared rule and assertion over every layer, with its failures."""
    tables = all_tables(b)
    return checks.run_rules(tables, all_checks({n: t.columns for n, t in tables.items()}))


@query
def rule_not_null(b: Bank) -> DataFrame:
    rule = rules.Rule("not_null", "silver_customers", "mobile_clean")
    return rule.rows({"silver_customers": silver_customers(b)})


@query
def rule_unique(b: Bank) -> DataFrame:
    """Shared e-mail addresses."""
    return rules.duplicate_email_rule().rows({"silver_customers": silver_customers(b)})


@query
def rule_accepted_values(b: Bank) -> DataFrame:
    rule = rules.Rule("accepted_values", "contacts", "interaction_type", values=rules.RAW_CHANNELS)
    return rule.rows({"contacts": b.interactions}).select("interaction_id", "interaction_type")


@query
def rule_relationships(b: Bank) -> DataFrame:
    """Transactions against card enrollments only: savings rows have no parent."""
    cards = b.enrollments.where("product_type = 'Credit Card'")
    rule = rules.Rule(
        "relationships", "child", "product_id", parent="cards", parent_column="product_id"
    )
    return rule.rows({"child": b.transactions, "cards": cards}).select("transaction_id", "product_id")


def misowned(b: Bank) -> DataFrame:
    """Transactions with some owners and products changed."""
    number = F.col("transaction_id")
    return b.transactions.withColumns(
        {
            "customer_id": F.col("customer_id") + F.when(number % 50 == 0, 1).otherwise(0),
            "product_id": F.col("product_id") + F.when(number % 70 == 0, 7).otherwise(0),
        }
    )


@query
def assert_product_owner_match(b: Bank) -> DataFrame:
    return keys.owner_mismatch(misowned(b), b.enrollments)


@query
def assert_product_owner_count(b: Bank) -> DataFrame:
    return keys.owner_mismatch_count(misowned(b), b.enrollments)


@query
def assert_value_identity(b: Bank) -> DataFrame:
    total = F.col("total_transaction_value")
    cent = F.when(F.col("customer_id") % 40 == 0, F.lit("0.01").cast("decimal(3,2)")).otherwise(0)
    wrong = silver_transactions(b).withColumn(
        "total_transaction_value", (total + cent).cast("decimal(28,2)")
    )
    return rules.assert_value_identity(wrong)


@query
def assert_recency_consistent(b: Bank) -> DataFrame:
    part, flag = F.col("customer_id") % 30, F.col("is_active_customer")
    wrong = profile(b).withColumns(
        {
            "is_active_customer": F.when(part == 0, ~flag).otherwise(flag),
            "customer_status": F.when(part == 1, "Never Active").otherwise(F.col("customer_status")),
        }
    )
    return rules.assert_recency_consistent(wrong)


@query
def assert_premium(b: Bank) -> DataFrame:
    promoted = F.when(F.col("customer_id") % 25 == 0, "Premium").otherwise(F.col("customer_segment"))
    return rules.assert_premium(profile(b).withColumn("customer_segment", promoted))


@query
def assert_non_negative(b: Bank) -> DataFrame:
    key = F.col("customer_id")
    wrong = profile(b).withColumns(
        {
            "total_products": F.when(key % 33 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("total_products")),
            "total_credit_value": F.when(key % 34 == 0, -F.col("total_credit_value")).otherwise(
                F.col("total_credit_value")
            ),
        }
    )
    return rules.assert_non_negative(wrong)


@query
def freshness_status(b: Bank) -> DataFrame:
    """36 hours after the second load: warn; without that load: error."""
    later = Clock(now=SECOND_LOAD + dt.timedelta(hours=36))
    tables = {"transactions": b.transactions, "first_load": b.loaded_by(FIRST_LOAD).transactions}
    return checks.freshness(tables, later)


@query
def build_freshness(b: Bank) -> DataFrame:
    later = Clock(now=SECOND_LOAD + dt.timedelta(minutes=91))
    return checks.build_freshness(profile(b), dt.timedelta(minutes=90), later)


# Profiling ---------------------------------------------------------------------


@query
def profile_counts(b: Bank) -> DataFrame:
    return profiling.profile_counts(raw_tables(b))


@query
def profile_nulls(b: Bank) -> DataFrame:
    """With some e-mails emptied and some types and limits missing."""
    tables = raw_tables(b)
    key = F.col("customer_id")
    tables["customer_raw"] = b.customers.withColumn(
        "email", F.when(key % 17 == 0, "").when(key % 19 == 0, None).otherwise(F.col("email"))
    )
    tables["product_enrollments"] = b.enrollments.withColumn(
        "limit", F.when(key % 23 != 0, F.col("limit"))
    )
    return profiling.profile_nulls(tables)


@query
def profile_duplicates(b: Bank) -> DataFrame:
    return profiling.profile_duplicates(
        [
            ("customer_raw", b.customers, "customer_id"),
            ("customer_raw", b.customers, "email"),
            ("product_enrollments", b.enrollments, "product_id"),
            ("crm_interactions", b.interactions, "interaction_id"),
            ("transaction_history", b.transactions, "transaction_id"),
            ("transaction_history", b.transactions, "product_id"),
        ]
    )


@query
def profile_top_duplicates(b: Bank) -> DataFrame:
    return profiling.top_duplicates(b.customers, "email")


@query
def profile_ages(b: Bank) -> DataFrame:
    return profiling.profile_ages(b.customers, CLOCK)


@query
def profile_phone_formats(b: Bank) -> DataFrame:
    return profiling.profile_phone_formats(b.customers)


@query
def profile_odd_phones(b: Bank) -> DataFrame:
    return profiling.odd_phones(b.customers)


@query
def profile_gender(b: Bank) -> DataFrame:
    return profiling.profile_distribution(b.customers, "gender")


@query
def profile_product_types(b: Bank) -> DataFrame:
    return profiling.profile_distribution(b.enrollments, "product_type")


@query
def profile_distribution(b: Bank) -> DataFrame:
    return profiling.profile_distribution(b.interactions, "interaction_type")


@query
def profile_label_hygiene(b: Bank) -> DataFrame:
    return profiling.profile_label_hygiene(b.enrollments, "product_type")


@query
def profile_limits(b: Bank) -> DataFrame:
    return profiling.profile_limits(b.enrollments)


@query
def profile_orphans(b: Bank) -> DataFrame:
    """The last reference lacks its odd parents, so that there is something to find."""
    even = b.customers.where("customer_id % 2 = 0")
    return profiling.profile_orphans(
        [
            ("enrollment to customer", b.enrollments, "customer_id", b.customers),
            ("interaction to customer", b.interactions, "customer_id", b.customers),
            ("transaction to product", b.transactions, "product_id", b.enrollments),
            ("transaction to customer", b.transactions, "customer_id", b.customers),
            ("transaction to even customer", b.transactions, "customer_id", even),
        ]
    )


@query
def profile_products_per_customer(b: Bank) -> DataFrame:
    return profiling.profile_products_per_customer(b.enrollments)[0]


@query
def profile_products_histogram(b: Bank) -> DataFrame:
    return profiling.profile_products_per_customer(b.enrollments)[1]


@query
def profile_date_ranges(b: Bank) -> DataFrame:
    return profiling.profile_date_ranges(
        [
            ("customer_raw", b.customers, "signup_date"),
            ("crm_interactions", b.interactions, "interaction_date"),
            ("transaction_history", b.transactions, "transaction_date"),
        ]
    )


@query
def profile_amount_stats(b: Bank) -> DataFrame:
    stats = profiling.profile_amounts(b.transactions)
    return stats.select(
        "min_amount", "max_amount", "mean_amount", F.round("stddev_amount", 3).alias("stddev_amount")
    )


@query
def profile_amount_percentiles(b: Bank) -> DataFrame:
    return profiling.profile_amount_percentiles(b.transactions)


@query
def profile_sketched_percentiles(b: Bank) -> DataFrame:
    return profiling.profile_amounts(b.transactions).select("p1", "p25", "p50", "p75", "p99")


@query
def profile_outliers(b: Bank) -> DataFrame:
    """With a few amounts multiplied so that some lie beyond three deviations."""
    factor = F.when(F.col("transaction_id") % 211 == 0, 9).otherwise(1)
    amount = (F.col("transaction_amount") * factor).cast("decimal(18,2)")
    return profiling.profile_outliers(b.transactions.withColumn("transaction_amount", amount))


@query
def profile_balances(b: Bank) -> DataFrame:
    return profiling.profile_balances(b.transactions)


@query
def profile_naive_timestamps(b: Bank) -> DataFrame:
    """Timestamps as text, some with an offset or the UTC mark."""
    number, text = F.col("transaction_id"), F.col("transaction_date").cast("string")
    zone = F.when(number % 60 == 0, "+08:00").when(number % 77 == 0, "Z").otherwise("")
    return profiling.profile_naive_timestamps(
        b.transactions.withColumn("transaction_date", F.concat(text, zone))
    )


@query
def profile_coverage(b: Bank) -> DataFrame:
    return profiling.profile_coverage(b.customers, b.enrollments, b.interactions, b.transactions)


@query
def profile_report(b: Bank) -> DataFrame:
    return profiling.profile_report(
        b.customers, b.enrollments, b.interactions, b.transactions, CLOCK
    )


# Monitoring --------------------------------------------------------------------


def monitor_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs derived from the events: some long, some of other jobs, some unfinished."""
    pin_session(spark)
    kind, started = F.col("event_type"), F.col("ts").cast("timestamp")
    seconds = F.floor(F.col("value") * 60)
    log = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"),
        F.when(kind.isin("click", "view"), F.concat(F.lit("mart_"), kind))
        .otherwise(F.concat(F.lit("other_"), kind))
        .alias("job_name"),
        started.alias("start_time"),
        F.when(
            F.col("event_id") % 100 != 0,
            F.timestamp_micros(F.unix_micros(started) + seconds * 1_000_000),
        ).alias("end_time"),
        F.when(kind == "click", "SUCCESS").otherwise("FAILED").alias("state"),
    )
    return monitoring.run_durations(log, "mart_", Clock(as_of=dt.date(2024, 1, 25)))


QUERIES["monitor_durations"] = monitor_durations


@query
def monitor_row_counts(b: Bank) -> DataFrame:
    tables = {n: t for n, t in all_tables(b).items() if n in SILVER or n == GOLD}
    return monitoring.row_counts(tables, CLOCK, fewest=1200)


@query
def monitor_row_drop(b: Bank) -> DataFrame:
    """Today's counts against a report in which one table was a fifth larger."""
    tables = raw_tables(b)
    grown = F.col("row_count") * F.when(F.col("table_name") == "crm_interactions", 1.2).otherwise(1.05)
    before = monitoring.row_counts(tables, CLOCK).withColumn("row_count", F.floor(grown))
    report = monitoring.row_counts(tables, CLOCK, previous=before)
    return report.select("table_name", "row_count", "previous_count", "dropped")


# Sources, sinks, layout, runs --------------------------------------------------


@query
def delimited_round_trip(b: Bank) -> DataFrame:
    """Customers as chunks of pipe-separated text, read back by glob and stamped."""
    spark = b.spark
    path = table_folder(spark, "text")
    chunks = b.customers.drop(INGESTED).repartition(session_buckets(spark), "customer_id").write
    chunks.option("header", True).option("sep", "|").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    read = read_delimited(spark, f"{path}/part-*.csv", CUSTOMERS, mode="FAILFAST")
    return stamp_ingest(read, SECOND_LOAD)


@query
def delimited_rejects(b: Bank) -> DataFrame:
    """Customers as lines, some with a field too few or a text that is no date: good rows
    and rejected lines with their reasons, side by side."""
    spark = b.spark
    path = table_folder(spark, "lines")
    key = F.col("customer_id")
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CUSTOMERS.names]
    born = F.when(key % 50 == 7, F.lit("unknown")).otherwise(F.col("date_of_birth").cast("string"))
    joined = F.concat_ws("|", *fields[:6], born, fields[7])
    lines = b.customers.select(F.when(key % 40 == 3, F.concat_ws("|", *fields[:5])).otherwise(joined).alias("value"))
    lines.repartition(session_buckets(spark)).write.text(path)
    good, rejected = split_checked(read_checked(spark, path, CUSTOMERS, header=False))
    return good.select("customer_id", "date_of_birth", F.lit("").alias("reasons"), F.lit(None).cast("string").alias("line")).union(
        rejected.select(
            F.split_part(LINE, F.lit("|"), F.lit(1)).cast("long"), F.lit(None).cast("date"), F.concat_ws(",", REASONS), LINE
        )
    )


@query
def delivered_zone(b: Bank) -> DataFrame:
    """Payments delivered as text, some stamps with a zone: what the whole report says of
    zones, from the text that ingest kept beside the typed column."""
    spark = b.spark
    path, database = table_folder(spark, "lines"), scratch_database(spark)
    number = F.col("transaction_id")
    zone = F.when(number % 60 == 0, "+08:00").when(number % 77 == 0, "Z").otherwise("")
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in TRANSACTIONS.names[:-1]]
    stamp = F.concat(F.date_format("transaction_date", "yyyy-MM-dd HH:mm:ss"), zone)
    lines = b.transactions.select(F.concat_ws("|", *texts, stamp).alias("value"))
    lines.repartition(session_buckets(spark)).write.text(path)
    mart = pipeline.Mart(spark, database, clock=CLOCK)
    pipeline.ingest_files(mart, path, "transaction_history", header=False)
    paid = mart.read("transaction_history")
    report = profiling.profile_report(b.customers, b.enrollments, b.interactions, paid, CLOCK)
    return report.where("section = 'zone'").select("metric", F.col("value").cast("long").alias("value"))


def _repeated_load(b: Bank) -> tuple[DataFrame, DataFrame]:
    """First load, and a second that repeats some of it and some of its own."""
    first = b.transactions.where(F.col(INGESTED) == moment(FIRST_LOAD))
    second = b.transactions.where(F.col(INGESTED) == moment(SECOND_LOAD))
    number = F.col("transaction_id")
    return first, second.union(first.where(number % 51 == 3)).union(second.where(number % 55 == 0))


@query
def key_repeats(b: Bank) -> DataFrame:
    """Payment numbers a second load repeats, of the first one or of its own."""
    spark, name = b.spark, f"{scratch_database(b.spark)}.payment_keys"
    first, second = _repeated_load(b)
    key_index.index_keys(spark, name, key_index.load_keys(first, "transaction_id", 1), session_buckets(spark))
    keys_of_load = materialise(key_index.load_keys(second, "transaction_id", 2), "load")
    key_index.index_keys(spark, name, keys_of_load)
    return key_index.repeats(spark, name, keys_of_load)


@query
def key_unknown(b: Bank) -> DataFrame:
    """Products of the second load that the index of the first enrollments lacks."""
    spark, name = b.spark, f"{scratch_database(b.spark)}.product_keys"
    first = b.enrollments.where(F.col(INGESTED) == moment(FIRST_LOAD))
    key_index.index_keys(spark, name, key_index.load_keys(first, "product_id", 1), session_buckets(spark))
    second = b.transactions.where(F.col(INGESTED) == moment(SECOND_LOAD))
    return key_index.unknown(spark, name, key_index.load_keys(second, "product_id", 2))


@query
def owner_gate_delta(b: Bank) -> DataFrame:
    """Payments of the wrong customer after each load, from pairs that are kept."""
    spark, name = b.spark, f"{scratch_database(b.spark)}.owner_pairs"
    payer = F.when(F.col("transaction_id") % 37 == 0, F.col("customer_id") + 1).otherwise(F.col("customer_id"))
    paid = materialise(b.transactions.withColumn("customer_id", payer), "paid")
    enrolled = materialise(b.enrollments, "enrolled")
    first, second = F.col(INGESTED) == moment(FIRST_LOAD), F.col(INGESTED) == moment(SECOND_LOAD)
    owner_pairs.build_pairs(name, paid.where(first), enrolled.where(first), session_buckets(spark))
    before = materialise(owner_pairs.mismatches(spark.table(name)), "before")
    owner_pairs.add_pairs(spark, name, paid.where(second), enrolled, enrolled.where(second))
    after = owner_pairs.mismatches(spark.table(name))
    return before.select(F.lit(1).alias("load"), "failures").union(after.select(F.lit(2), "failures"))


@query
def bronze_views(b: Bank) -> DataFrame:
    """Pass-through views over the four stored raw tables; one of them is read."""
    spark = b.spark
    mart = pipeline.Mart(spark, scratch_database(spark), clock=CLOCK)
    load_mart(mart, b)
    register_bronze(spark, {f"bronze_{t}": mart.name(t) for t in RAW})
    return bronze(spark, "bronze_crm_interactions")


@query
def compacted_table(b: Bank) -> DataFrame:
    """Interactions stored in many small files, rewritten in few."""
    files = session_buckets(b.spark)
    scattered = materialise(b.interactions.repartition(files, "interaction_id"), "scattered")
    return materialise(layout.compact(scattered), "compact")


@query
def clustered_table(b: Bank) -> DataFrame:
    files = session_buckets(b.spark)
    return materialise(layout.cluster_by(b.transactions, ["customer_id"], files), "clustered")


@query
def clustered_by_two(b: Bank) -> DataFrame:
    stored = materialise(b.transactions, "plain")
    spread = layout.cluster_by(stored, ["customer_id", "transaction_date"], session_buckets(b.spark))
    return materialise(spread, "clustered")


@query
def audit_rows(b: Bank) -> DataFrame:
    """The rows a failing rule left in the audit database."""
    spark = b.spark
    rule = rules.Rule("accepted_values", "silver_customers", "age_band", values=rules.ADULT_BANDS)
    audit = scratch_database(spark)
    checks.evaluate(spark, {rule.table: silver_customers(b)}, [rule], audit)
    return spark.table(f"{audit}.{rule.rule_id}").select("customer_id", "age", "age_band")


# Column rules these tables are known to violate: no limit without a product, channels
# outside the list, minors, and customers without contacts, payments or products. The
# findings are stored; they do not stop a run.
WAIVED = frozenset(
    {
        "not_null_silver_customers_mobile_clean",
        "accepted_values_silver_customers_age_band",
        "relationships_silver_customer_interactions_customer_id",
        "relationships_silver_customer_transactions_customer_id",
        "relationships_silver_customer_products_customer_id",
        "accepted_values_silver_customer_interactions_last_interaction_type",
        "accepted_values_customer_profile_last_interaction_type",
        "not_null_customer_profile_mobile_clean",
        "not_null_customer_profile_total_credit_limit",
        "not_null_customer_profile__products_ingested_at",
        "not_null_customer_profile__interactions_ingested_at",
        "not_null_customer_profile__transactions_ingested_at",
    }
)


def fresh_mart(b: Bank) -> pipeline.Mart:
    spark = b.spark
    mart = pipeline.Mart(spark, scratch_database(spark), clock=CLOCK, waived=WAIVED)
    load_mart(mart, b.loaded_by(FIRST_LOAD))
    return mart


def load_mart(mart: pipeline.Mart, b: Bank) -> None:
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda item: mart.ingest(item[1], item[0]), raw_tables(b).items()))


def add_second_load(mart: pipeline.Mart, b: Bank) -> None:
    """Contacts and payments of the second load, added to what is stored."""
    tables = raw_tables(b)
    for name in pipeline.RAW_FACTS:
        mart.ingest(tables[name].where(F.col(INGESTED) == moment(SECOND_LOAD)), name, append=True)


@query
def pipeline_refresh(b: Bank) -> DataFrame:
    """Stored tables: everything from the first load, then the second by watermark."""
    mart = fresh_mart(b)
    pipeline.refresh_all(mart)
    add_second_load(mart, b)
    pipeline.refresh_facts(mart)
    return mart.read(GOLD).drop("_gold_updated_at")


@query
def pipeline_backfill(b: Bank) -> DataFrame:
    """As above, with the second load taken in by a backfill window."""
    mart = fresh_mart(b)
    pipeline.refresh_all(mart)
    add_second_load(mart, b)
    pipeline.backfill_all(mart, SECOND_LOAD, SECOND_LOAD + dt.timedelta(hours=1))
    return mart.read(GOLD).drop("_gold_updated_at")


@query
def full_refresh_run(b: Bank) -> DataFrame:
    """A built mart whose facts were replaced, rebuilt in full."""
    mart = fresh_mart(b)
    pipeline.refresh_all(mart)
    load_mart(mart, b)
    pipeline.refresh_facts(mart, full_refresh=True)
    return mart.read(GOLD).drop("_gold_updated_at")


@query
def gate_counts(b: Bank) -> DataFrame:
    """Failures per silver and gold rule as the gates of a whole run saw them; those of row
    rules were counted while the tables were written."""
    spark = b.spark
    mart = pipeline.Mart(spark, scratch_database(spark), clock=CLOCK, waived=WAIVED)
    load_mart(mart, b)
    pipeline.refresh_all(mart)
    rows = [(r.rule_id, r.table_name, r.failures, r.status) for r in mart.results]
    return spark.createDataFrame(rows, "rule_id string, table_name string, failures long, status string")


@query
def gate_violations(b: Bank) -> DataFrame:
    """Rows per rule in the table of violations a whole run leaves."""
    spark = b.spark
    mart = pipeline.Mart(spark, scratch_database(spark), clock=CLOCK, waived=WAIVED)
    load_mart(mart, b)
    pipeline.refresh_all(mart)
    return mart.read("violations").groupBy("rule_id", "table_name").agg(F.count("*").alias("failures"))


@query
def audit_all_rules(b: Bank) -> DataFrame:
    """The violating rows of every declared rule in one table, counted by rule."""
    tables = all_tables(b)
    declared = all_checks({n: t.columns for n, t in tables.items()})
    name = f"{scratch_database(b.spark)}.violations"
    replace_table(checks.violations(tables, declared), name, partition_by="rule_id")
    return b.spark.table(name).groupBy("rule_id", "table_name").agg(F.count("*").alias("failures"))


def facts_in_parts(b: Bank, name: str, facts: DataFrame) -> None:
    first = facts.where(F.col(INGESTED) == moment(FIRST_LOAD))
    replace_facts(first, name, CUSTOMER, INGESTED, session_buckets(b.spark))


@query
def append_refresh(b: Bank) -> DataFrame:
    """Two loads of payments appended by load day and part, each taken in by refreshing the
    parts it touches."""
    spark = b.spark
    database = scratch_database(spark)
    facts, target = f"{database}.transaction_history", f"{database}.silver_customer_transactions"
    enrollments = materialise(b.enrollments, "enrollments")
    roll_up = lambda rows: silver.silver_transactions(rows, enrollments)
    facts_in_parts(b, facts, b.transactions)
    first = roll_up(spark.table(facts))
    replace_table(first, target, CUSTOMER, session_buckets(spark), in_parts=True)
    second = b.transactions.where(F.col(INGESTED) == moment(SECOND_LOAD))
    append_facts(second, facts, CUSTOMER, INGESTED, session_buckets(spark))
    incremental.refresh_in_parts(spark, facts, target, roll_up)
    incremental.refresh_in_parts(spark, facts, target, roll_up)  # nothing is pending
    return spark.table(target)


@query
def partial_upsert(b: Bank) -> DataFrame:
    """The contacts of a few days' customers rolled up again into a target in parts."""
    spark = b.spark
    target = f"{scratch_database(spark)}.silver_customer_interactions"
    first = b.interactions.where(F.col(INGESTED) == moment(FIRST_LOAD))
    replace_table(silver.silver_interactions(first), target, CUSTOMER, session_buckets(spark), in_parts=True)
    stored = materialise(b.interactions, "interactions")
    changed = incremental.changed_keys(stored, FIRST_LOAD)
    delta = incremental.recompute(stored, materialise(changed, "changed"), silver.silver_interactions)
    incremental.part_upsert(spark, target, delta)
    return spark.table(target)


PERCENTS = (1, 5, 25, 50, 75, 95, 99)


@query
def merged_percentiles(b: Bank) -> DataFrame:
    """Percentiles of payments from sketches kept per load: whether their ranks hold."""
    name = f"{scratch_database(b.spark)}.amount_sketches"
    loads = b.transactions.withColumn("load", F.col(INGESTED).cast("date"))
    for day in (FIRST_LOAD, SECOND_LOAD, SECOND_LOAD):  # the second is taken in twice
        part = loads.where(F.col(INGESTED) == moment(day))
        sketches.keep_sketches(sketches.load_sketches(part, "transaction_amount", "load"), name)
    estimates = sketches.quantiles(b.spark.table(name), PERCENTS)
    return sketches.within_rank_bounds(estimates, loads, "transaction_amount", PERCENTS)


@query
def stream_state(b: Bank) -> DataFrame:
    """Contacts landing in three loads, the last one late, rolled up in streaming state."""
    spark = b.spark
    landing, checkpoint = table_folder(spark, "landing"), table_folder(spark, "checkpoint")
    target = f"{scratch_database(spark)}.silver_customer_interactions"
    first, late = F.col(INGESTED) == moment(FIRST_LOAD), F.col("interaction_id") % 3 == 0
    for rows in (first & ~late, ~first, first & late):
        part = b.interactions.where(rows)
        part.repartition(session_buckets(spark), "interaction_id").write.mode("append").parquet(landing)
        streaming.stream_state(
            spark, landing, b.interactions.schema, target, silver.silver_interactions, checkpoint
        )
    return spark.table(target)


@query
def stream_refresh(b: Bank) -> DataFrame:
    """Interactions landing in two loads; after each the stream takes in what is new."""
    spark = b.spark
    landing, history, checkpoint = (table_folder(spark, x) for x in ("landing", "history", "checkpoint"))
    target = f"{scratch_database(spark)}.silver_customer_interactions"
    for load in (FIRST_LOAD, SECOND_LOAD):
        part = b.interactions.where(F.col(INGESTED) == moment(load))
        part.repartition(session_buckets(spark), "interaction_id").write.mode("append").parquet(landing)
        streaming.stream_refresh(
            spark, landing, b.interactions.schema, history, target, silver.silver_interactions, checkpoint
        )
    return spark.table(target)
