"""Whole runs over stored tables, and the stream."""

import datetime as dt
import pathlib
import uuid

import pytest
from pyspark.sql import functions as F

import rows
from rows import CLOCK, LOAD, by_key
from tidemark.__main__ import arguments, run
from tidemark.plans import checks, pipeline, silver
from tidemark.plans.pipeline import Mart
from tidemark.schemas import GOLD, RAW
from tidemark.sources import replace_table, stored, table_folder
from tidemark.streaming import stream_refresh, stream_state

SECOND = LOAD + dt.timedelta(hours=1)


def raw(spark, second=False, **over):
    customers = [rows.customer(k, gender="Female") for k in range(1, 9)]
    enrolled = [rows.enrollment(k * 10, k, "Credit Card", limit="100") for k in range(1, 9)]
    contacts = [rows.contact(k, k, day=rows.ago(k)) for k in range(1, 7)]
    paid = [rows.payment(k, k * 10, k, f"-{k}") for k in range(1, 8)]
    if second:
        contacts += [rows.contact(50, 8, "Call", rows.ago(1), SECOND)]
        paid += [rows.payment(50, 10, 1, "200000", stamp=SECOND)]
    tables = {
        "customer_raw": rows.customers(spark, *customers),
        "product_enrollments": rows.enrollments(spark, *enrolled),
        "crm_interactions": rows.interactions(spark, *contacts),
        "transaction_history": rows.transactions(spark, *paid),
    }
    return tables | over


@pytest.fixture
def mart(spark):
    name = f"mart_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    built = Mart(spark, name, clock=CLOCK, buckets=3, audit_database=f"{name}_audit")
    seed(built, raw(spark))
    return built


def seed(mart, tables):
    for name in RAW:
        replace_table(tables[name], mart.name(name))


def test_daily_then_hourly(spark, mart):
    pipeline.refresh_all(mart)
    assert {r.status for r in mart.results} == {"pass"}
    before = by_key(mart.read(GOLD))
    assert before[1]["customer_segment"] == "Basic" and before[8]["total_interactions"] == 0

    seed(mart, raw(spark, second=True))
    pipeline.refresh_facts(mart)
    after = by_key(mart.read(GOLD))
    assert after[1]["customer_segment"] == "Premium" and after[8]["total_interactions"] == 1
    assert {k: v for k, v in after.items() if k not in (1, 8)} == {
        k: v for k, v in before.items() if k not in (1, 8)
    }
    log = {(r.job_name, r.state) for r in mart.read("run_log").collect()}
    assert log == {(f"{mart.database}_{job}", "SUCCESS") for job in ("refresh_all", "refresh_facts")}


def test_full_refresh_and_backfill_reach_the_same(spark, mart):
    pipeline.refresh_all(mart)
    seed(mart, raw(spark, second=True))
    pipeline.backfill_all(mart, SECOND, SECOND + dt.timedelta(minutes=1))
    window = by_key(mart.read(GOLD))
    pipeline.backfill_all(mart)
    assert by_key(mart.read(GOLD)) == window
    pipeline.refresh_facts(mart, full_refresh=True)
    assert by_key(mart.read(GOLD)) == window


def test_failing_raw_gate_stops_everything(spark, mart):
    pipeline.refresh_all(mart)
    before = by_key(mart.read(GOLD))
    wrong = rows.transactions(spark, rows.payment(1, 20, 1, "9", stamp=SECOND))
    seed(mart, raw(spark, transaction_history=wrong))
    with pytest.raises(checks.GateFailed, match="assert_product_owner_match: 1"):
        pipeline.refresh_facts(mart)
    assert by_key(mart.read(GOLD)) == before
    audit = spark.table(f"{mart.audit_database}.assert_product_owner_match")
    assert [r.product_customer_id for r in audit.collect()] == [2]
    assert mart.read("run_log").where("state = 'FAILED'").count() == 1


def test_column_rules_gate_unless_waived_or_off(spark, mart):
    odd = rows.interactions(spark, rows.contact(1, 1, "Fax", day=rows.ago(1)))
    seed(mart, raw(spark, crm_interactions=odd))
    with pytest.raises(checks.GateFailed, match="last_interaction_type"):
        pipeline.refresh_all(mart)
    assert not mart.has(GOLD)
    waived = frozenset(
        f"accepted_values_{t}_last_interaction_type" for t in ("silver_customer_interactions", GOLD)
    )
    patient = Mart(spark, mart.database, clock=CLOCK, buckets=3, waived=waived)
    pipeline.refresh_all(patient)
    assert {r.status for r in patient.results} == {"pass", "error"}
    pipeline.refresh_all(Mart(spark, mart.database, clock=CLOCK, buckets=3, gate_columns=False))


def test_optimize_keeps_rows_and_buckets(spark, mart):
    pipeline.refresh_all(mart)
    before = by_key(mart.read(GOLD))
    name = mart.name(GOLD)
    files = set(stored(spark, name).inputFiles())
    assert len(files) <= 3
    pipeline.optimize(mart, GOLD)
    assert set(stored(spark, name).inputFiles()) == files, "nothing to do"
    replace_table(mart.read(GOLD).repartition(7, "email"), name)
    pipeline.optimize(mart, GOLD)
    assert by_key(mart.read(GOLD)) == before
    assert len(stored(spark, name).inputFiles()) <= 3
    pipeline.optimize(mart, GOLD, cluster="customer_id, signup_date")
    assert by_key(mart.read(GOLD)) == before
    replace_table(mart.read("crm_interactions").repartition(4, "interaction_id"), mart.name("crm_interactions"))
    pipeline.optimize(mart, "crm_interactions")
    assert mart.read("crm_interactions").count() == 6
    assert len(stored(spark, mart.name("crm_interactions")).inputFiles()) == 1


def test_stream_equals_batch_and_restarts(spark):
    name = f"s{uuid.uuid4().hex}"
    landing, history, state = (table_folder(spark, n) for n in ("landing", "history", "state"))
    first = [rows.contact(i, i % 4) for i in range(10)]
    second = [rows.contact(100, 1, "Call", dt.date(2025, 1, 1)), rows.contact(101, 9)]

    def arrive(*batch):
        rows.interactions(spark, *batch).coalesce(1).write.mode("append").parquet(landing)

    def take_in():
        schema = rows.interactions(spark).schema
        stream_refresh(
            spark, landing, schema, history, name, silver.silver_interactions, state, buckets=2
        )
        return by_key(spark.table(name))

    arrive(*first)
    assert take_in() == by_key(silver.silver_interactions(rows.interactions(spark, *first)))
    whole = by_key(silver.silver_interactions(rows.interactions(spark, *first, *second)))
    arrive(*second)
    assert take_in() == whole
    assert take_in() == whole, "nothing new"

    # The last batch is replayed as after a crash before its commit was recorded.
    commits = pathlib.Path(state, "commits")
    last = max(int(p.name) for p in commits.glob("[0-9]*"))
    (commits / f"{last}").unlink()
    (commits / f".{last}.crc").unlink()
    assert take_in() == whole
    stored_rows = spark.read.parquet(history)
    assert stored_rows.count() == len(first) + len(second)
    assert stored_rows.select(F.col("_batch")).distinct().count() == 2


def test_jobs_from_the_command_line(spark, mart, tmp_path):
    def job(*argv):
        run(spark, arguments([*argv, "--database", mart.database]))

    text = tmp_path / "more.csv"
    text.write_text("interaction_id|customer_id|interaction_type|interaction_date\n7|8|Call|2024-06-01\n")
    job("ingest", "--table", "crm_interactions", "--path", str(text))
    job("refresh-all", "--buckets", "2")
    built = by_key(mart.read(GOLD))
    assert built[8]["call_interactions"] == 1 and built[1]["total_interactions"] == 0
    job("optimize", "--table", GOLD, "--cluster", "customer_id")
    job("profile")
    assert mart.read("profile_report").where("section = 'coverage'").count() == 8
    with pytest.raises(ValueError, match="both ends"):
        job("backfill", "--start", "2024-06-01")
    job("backfill", "--buckets", "2")
    assert {k: r["customer_segment"] for k, r in by_key(mart.read(GOLD)).items()} == {
        k: r["customer_segment"] for k, r in built.items()
    }


def test_appending_and_reports_from_the_command_line(spark, mart, tmp_path):
    def job(*argv):
        run(spark, arguments([*argv, "--database", mart.database]))

    job("refresh-all", "--buckets", "2")
    before = by_key(mart.read(GOLD))
    marks = {r._ingested_at for r in mart.read("crm_interactions").collect()}
    text = tmp_path / "late.csv"
    text.write_text("interaction_id|customer_id|interaction_type|interaction_date\n77|8|Call|2024-06-01\n")
    job("ingest", "--append", "--table", "crm_interactions", "--path", str(text))
    assert marks < {r._ingested_at for r in mart.read("crm_interactions").collect()}
    job("refresh-facts", "--buckets", "2")
    gained = {k: r["total_interactions"] - before[k]["total_interactions"] for k, r in by_key(mart.read(GOLD)).items()}
    assert {k for k, n in gained.items() if n} == {8} and gained[8] == 1

    job("check")
    job("freshness")
    assert mart.read("freshness").count() == 5
    job("monitor")
    job("monitor")
    assert {r.dropped for r in mart.read("row_counts").collect()} == {False}
    jobs = {r.job_name.removeprefix(f"{mart.database}_") for r in mart.read("recent_runs").collect()}
    assert jobs == {"refresh_all", "refresh_facts", "check"}


def test_a_lost_log_does_not_hide_the_failure(spark, mart, monkeypatch):
    def lost(*_):
        raise OSError("no log")

    monkeypatch.setattr(pipeline, "append_batch", lost)
    monkeypatch.setattr(pipeline, "build_dimensions", lambda _: 1 / 0)
    with pytest.raises(ZeroDivisionError) as failure:
        pipeline.refresh_all(mart)
    assert "no log" in failure.value.__notes__[0]


def test_streaming_state_equals_batch_and_restarts(spark):
    name = f"s{uuid.uuid4().hex}"
    landing, state = (table_folder(spark, n) for n in ("landing", "state"))
    loads = [
        [rows.contact(i, i % 6) for i in range(12)],
        [rows.contact(100, 1, "Call", dt.date(2025, 1, 1)), rows.contact(101, 9)],
        [rows.contact(200, 1, "Chat", dt.date(2001, 1, 1), LOAD - dt.timedelta(days=9))],  # late
    ]
    seen = []
    for load in loads:
        seen += load
        rows.interactions(spark, *load).coalesce(1).write.mode("append").parquet(landing)
        for _ in range(2):  # the second time nothing is new
            stream_state(spark, landing, rows.interactions(spark).schema, name, silver.silver_interactions, state, buckets=3)
            assert by_key(spark.table(name)) == by_key(silver.silver_interactions(rows.interactions(spark, *seen)))

    # The last batch is replayed as after a crash before its commit was recorded.
    commits = pathlib.Path(state, "commits")
    last = max(int(p.name) for p in commits.glob("[0-9]*"))
    (commits / f"{last}").unlink()
    (commits / f".{last}.crc").unlink()
    stream_state(spark, landing, rows.interactions(spark).schema, name, silver.silver_interactions, state, buckets=3)
    assert by_key(spark.table(name)) == by_key(silver.silver_interactions(rows.interactions(spark, *seen)))
