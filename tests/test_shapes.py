"""Physical plans: what is read, what is shuffled, what happens to hot keys."""

import contextlib
import datetime as dt
import re
import uuid
from collections import Counter
from decimal import Decimal
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

import oracle
from tidemark.operators import incremental, keys
from tidemark.plans import gold, profiling, silver
from tidemark.schemas import SILVER
from tidemark.sources import materialise, replace_table, stored
from workload.bank import CLOCK, FIRST_LOAD, bank


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def b(spark):
    loaded = bank(spark, f"{oracle.DATA}/sf0.001")
    names = ("customers", "enrollments", "interactions", "transactions")
    return SimpleNamespace(**{n: materialise(getattr(loaded, n), n) for n in names})


@pytest.fixture(scope="module")
def tables(spark, b):
    built = (
        silver.silver_customers(b.customers, CLOCK),
        silver.silver_products(b.enrollments),
        silver.silver_interactions(b.interactions),
        silver.silver_transactions(b.transactions, b.enrollments),
    )
    names = {t: f"{t}_{uuid.uuid4().hex}" for t in SILVER}
    for df, name in zip(built, names.values()):
        replace_table(df, name, "customer_id", 5)
    return names


def test_profile_join_does_not_shuffle_stored_tables(spark, tables):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        text = plan(gold.customer_profile(*(spark.table(t) for t in tables.values()), CLOCK))
    assert text.count("SortMergeJoin") == 3
    assert "Exchange" not in text
    assert "Sort [" not in text, "each bucket is one sorted file"


def test_bucket_of_several_files_is_sorted_again(spark, b):
    name = f"t_{uuid.uuid4().hex}"
    scattered = silver.silver_interactions(b.interactions).repartition(4, "total_interactions")
    replace_table(scattered, name, "customer_id", 3, arranged=True)
    assert len(stored(spark, name).inputFiles()) > 3
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        joined = spark.table(name).join(spark.table(name).select("customer_id"), "customer_id")
        assert "Sort [" in plan(joined)
        assert joined.count() == scattered.count()


def test_one_file_per_bucket(spark, tables):
    assert all(len(stored(spark, t).inputFiles()) == 5 for t in tables.values())


def test_upsert_shuffles_the_delta_only(spark, b, tables):
    name = tables["silver_customer_interactions"]
    delta = silver.silver_interactions(b.interactions.where("customer_id < 50"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        merged = incremental.upsert(spark.table(name), delta, buckets=5)
        target_side = re.split(r"\n\s+[+:]- .*FileScan parquet \[", plan(merged))[0]
        assert "Exchange" not in target_side.split("SortMergeJoin")[1].split("FileScan")[0]
        replace_table(merged, name, "customer_id", 5, arranged=True)
    assert len(stored(spark, name).inputFiles()) == 5
    assert spark.table(name).count() == silver.silver_interactions(b.interactions).count()


def test_change_scan_reads_two_columns_and_pushes_the_mark(b):
    text = plan(incremental.changed_keys(b.transactions, FIRST_LOAD))
    assert "ReadSchema: struct<customer_id:bigint,_ingested_at:timestamp>" in text
    assert "GreaterThan(_ingested_at," in text


def test_small_change_is_broadcast_into_the_history_scan(b):
    changed = materialise(incremental.changed_keys(b.transactions, FIRST_LOAD), "changed")
    text = plan(incremental.recompute(b.transactions, changed, lambda df: df))
    assert re.search(r"BroadcastHashJoin \[customer_id#\d+L\], \[customer_id#\d+L\], LeftSemi", text)
    assert "hashpartitioning" not in text


def test_large_change_is_not_broadcast(spark, b):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="10"):
        changed = materialise(incremental.changed_keys(b.transactions, FIRST_LOAD), "changed")
        text = plan(incremental.recompute(b.transactions, changed, lambda df: df))
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_dedup_limits_each_key_before_the_shuffle(b):
    text = plan(silver.silver_customers(b.customers, CLOCK))
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_products_read_what_they_use_and_hash_aggregate(b):
    text = plan(silver.silver_products(b.enrollments))
    assert "SortAggregate" not in text
    assert text.count("Exchange") == 1
    assert "IsNotNull(customer_id)" in text


def test_orphans_are_counted_per_key_before_the_join(spark, b):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        text = plan(keys.orphan_keys(b.transactions, b.enrollments, "product_id", "product_id"))
    assert text.index("Join") < text.index("HashAggregate")
    assert text.count("Exchange") == 2, "the join reuses the partitioning of the counts"
    assert "ReadSchema: struct<product_id:bigint>" in text


def test_outliers_take_their_statistics_from_subqueries(b):
    text = plan(profiling.profile_outliers(b.transactions))
    assert "Subquery" in text and "Join" not in text


def test_hot_product_is_split_and_nothing_is_lost(spark, b):
    """A third of all transactions on one product, which belongs to one customer."""
    number = F.col("transaction_id")
    hot = b.enrollments.orderBy("product_id").first()
    many = spark.range(200).crossJoin(b.transactions).select(
        (F.col("id") * 1_000_000 + number).alias("transaction_id"),
        F.when(number % 3 == 0, hot.product_id).otherwise(F.col("product_id")).alias("product_id"),
        F.when(number % 3 == 0, hot.customer_id).otherwise(F.col("customer_id")).alias("customer_id"),
        "transaction_amount",
        "closing_balance",
        "transaction_date",
        "_ingested_at",
    )
    many = materialise(many.repartition(12), "hot")
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__shuffle__partitions="16",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="128KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    ):
        built = silver.silver_transactions(many, b.enrollments)
        got = {r.customer_id: r for r in built.collect()}
        assert "SortMergeJoin(skew=true)" in plan(built)
    totals: Counter = Counter()
    counts: Counter = Counter()
    for r in many.select("customer_id", "transaction_amount").collect():
        totals[r.customer_id] += abs(r.transaction_amount)
        counts[r.customer_id] += 1
    assert {k: r.total_transactions for k, r in got.items()} == counts
    assert {k: r.total_transaction_value for k, r in got.items()} == totals
    assert counts[hot.customer_id] > sum(counts.values()) / 3.5


def test_hot_customer_is_split_in_a_restricted_roll_up(spark, b):
    """A third of the contacts on one customer, whose history is rolled up again."""
    times = F.explode(F.sequence(F.lit(1), F.lit(20))).alias("again")
    spread = b.interactions.select(*b.interactions.columns, times).withColumn("interaction_id", F.xxhash64("interaction_id", "again"))
    hot = b.interactions.first().customer_id
    chosen = F.when(F.pmod("interaction_id", F.lit(3)) == 0, F.lit(hot)).otherwise(F.col("customer_id"))
    many = materialise(spread.drop("again").withColumn("customer_id", chosen).repartition(8, "interaction_id"), "hot-contacts")
    wanted = materialise(many.select("customer_id").distinct(), "hot-keys")
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__shuffle__partitions="16",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="16KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="32KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    ):
        built = incremental.recompute(many, wanted, silver.silver_interactions)
        got = {r.customer_id: r.total_interactions for r in built.collect()}
        assert "SortMergeJoin(skew=true)" in plan(built)
    assert got == Counter(r.customer_id for r in many.select("customer_id").collect())
    assert got[hot] > sum(got.values()) / 3.5


def test_average_is_exact_to_the_last_digit(spark, b):
    built = silver.silver_transactions(b.transactions, b.enrollments)
    for r in built.collect():
        exact = r.total_transaction_value / r.total_transactions
        assert abs(r.avg_transaction_value - exact) <= Decimal("0.0000005")


def test_window_of_stamps_is_pushed_down(b):
    text = plan(incremental.window_keys(b.interactions, FIRST_LOAD, FIRST_LOAD + dt.timedelta(days=1)))
    assert "GreaterThanOrEqual(_ingested_at," in text and "LessThan(_inges" in text
