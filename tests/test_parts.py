"""Tables in parts: what a refresh reads and replaces, and what survives a lost job."""

import datetime as dt
import json
import os
import threading
import urllib.parse
import uuid

import pytest
from pyspark.sql import functions as F

import rows
from rows import CLOCK, LOAD, by_key
from tidemark.config import session_settings
from tidemark.operators import incremental, key_index, keys, owner_pairs, sketches
from tidemark.plans import checks, pipeline, silver
from tidemark.schemas import CUSTOMER, GOLD, INGESTED, RAW, RUN_LOG, SILVER, VIOLATIONS
from tidemark.sources import parts, replace_table, stored, tables
from tidemark.sources.delimited import read_checked, split_checked
from tidemark.schemas import CUSTOMERS

SECOND, THIRD = LOAD + dt.timedelta(days=1), LOAD + dt.timedelta(days=2)
PARTS = 8


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def contacts(spark, first, count, stamp, per=3):
    return rows.interactions(spark, *(rows.contact(first + i, (first + i) // per, stamp=stamp) for i in range(count)))


@pytest.fixture
def names(spark):
    database = f"p{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    return f"{database}.facts", f"{database}.target"


@pytest.fixture
def built(spark, names):
    facts, target = names
    tables.replace_facts(contacts(spark, 0, 120, LOAD), facts, CUSTOMER, INGESTED, PARTS)
    replace_table(silver.silver_interactions(spark.table(facts)), target, CUSTOMER, PARTS, in_parts=True)
    return names


def files(spark, name):
    """Path and time of change of every file of the backing table, by part."""
    out = {}
    for path in stored(spark, name).inputFiles():
        local = urllib.parse.unquote(urllib.parse.urlparse(path).path)
        part = int(local.split(f"{parts.PART}=")[1].split("/")[0])
        out.setdefault(part, set()).add((local, os.stat(local).st_mtime_ns))
    return out


def refresh(spark, names, **more):
    return incremental.refresh_in_parts(spark, *names, silver.silver_interactions, **more)


def test_a_part_is_a_bucket_and_one_file(spark, built):
    seen = stored(spark, built[1])
    bucket = F.regexp_extract(F.col("_metadata.file_name"), r"_(\d{5})\.", 1).cast("int")
    assert seen.where(bucket != F.col(parts.PART)).count() == 0
    assert all(len(f) == 1 for f in files(spark, built[1]).values())
    assert parts.PART not in spark.table(built[1]).columns and parts.LOAD not in spark.table(built[0]).columns


def test_refresh_touches_only_parts_of_the_load(spark, built):
    facts, target = built
    before = files(spark, target)
    tables.append_facts(contacts(spark, 1000, 2, SECOND), facts, CUSTOMER, INGESTED, PARTS)
    late = rows.interactions(spark, rows.contact(2000, 5, "Call", stamp=SECOND))
    tables.append_facts(late, facts, CUSTOMER, INGESTED, PARTS)
    replaced = refresh(spark, built)
    after = files(spark, target)
    assert 0 < len(replaced) < PARTS
    assert {p for p in after if after[p] != before.get(p)} == set(replaced)
    assert by_key(spark.table(target)) == by_key(silver.silver_interactions(spark.table(facts)))
    assert by_key(spark.table(target))[5]["call_interactions"] == 1
    assert all(len(f) == 1 for f in after.values())
    assert refresh(spark, built) == [] and files(spark, target) == after, "nothing pending"


def test_change_scan_reads_the_days_of_the_load(spark, built):
    facts, _ = built
    tables.append_facts(contacts(spark, 1000, 40, SECOND), facts, CUSTOMER, INGESTED, PARTS)
    tables.append_facts(contacts(spark, 2000, 40, THIRD), facts, CUSTOMER, INGESTED, PARTS)
    new = parts.since(stored(spark, facts), INGESTED, SECOND)
    assert f"isnotnull({parts.LOAD}" in plan(new).split("PartitionFilters: [")[1].split("]")[0]
    read = {r[0] for r in new.select(F.input_file_name()).distinct().collect()}
    assert read and all(f"{parts.LOAD}={THIRD.date()}" in f for f in read)
    window = parts.between(stored(spark, facts), INGESTED, SECOND, THIRD)
    assert window.count() == 40
    history = parts.in_parts(stored(spark, facts), [1, 2])
    assert parts.PART in plan(history).split("PartitionFilters: [")[1].split("]")[0]
    assert {r[0] for r in history.select(parts.PART).distinct().collect()} <= {1, 2}


def test_mark_is_noted_and_looked_up(spark, built):
    facts, target = built
    assert incremental.stored_mark(spark, target) == LOAD
    assert parts.property_of(spark, tables.backing(spark, target), "mark") is None
    tables.append_facts(contacts(spark, 1000, 2, SECOND), facts, CUSTOMER, INGESTED, PARTS)
    refresh(spark, built)
    assert parts.property_of(spark, tables.backing(spark, target), "mark") == SECOND.isoformat()
    assert incremental.stored_mark(spark, target) == SECOND
    # A window that holds older rows only leaves the mark where it is.
    assert refresh(spark, built, window=(LOAD, LOAD + dt.timedelta(hours=1))) == sorted(files(spark, target))
    assert incremental.stored_mark(spark, target) == SECOND


def test_extra_keys_are_rolled_up_again(spark, built):
    named = spark.createDataFrame([(7,)], "customer_id long")
    replaced = refresh(spark, built, extra_keys=named)
    assert len(replaced) == 1
    assert by_key(spark.table(built[1])) == by_key(silver.silver_interactions(spark.table(built[0])))


def test_replacing_does_not_rest_on_shared_settings(spark, built):
    """A run beside this one switches the session to replacing whole tables, all the time."""
    facts, target = built
    mode, stop = "spark.sql.sources.partitionOverwriteMode", threading.Event()

    def switch():
        while not stop.is_set():
            spark.conf.set(mode, "static")

    beside = threading.Thread(target=switch)
    beside.start()
    try:
        tables.append_facts(contacts(spark, 1000, 2, SECOND), facts, CUSTOMER, INGESTED, PARTS)
        refresh(spark, built)
    finally:
        stop.set()
        beside.join()
        spark.conf.unset(mode)
    assert by_key(spark.table(target)) == by_key(silver.silver_interactions(spark.table(facts)))


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_replacement_lost_halfway_is_repeated(spark, built, monkeypatch, when):
    """Parts are written to the shared folder and named before any of them is replaced."""
    facts, target = built
    tables.append_facts(contacts(spark, 1000, 9, SECOND), facts, CUSTOMER, INGESTED, PARTS)
    overwrite = parts._overwrite

    def lost(*args):
        if when == "after":
            monkeypatch.setattr(parts, "set_properties", lambda *a, **k: 1 / 0)
            overwrite(*args)
        raise ZeroDivisionError

    monkeypatch.setattr(parts, "_overwrite", lost)
    with pytest.raises(ZeroDivisionError):
        refresh(spark, built)
    monkeypatch.undo()
    assert parts.recover(spark, tables.backing(spark, target))
    assert by_key(spark.table(target)) == by_key(silver.silver_interactions(spark.table(facts)))
    assert incremental.stored_mark(spark, target) == SECOND
    assert not parts.recover(spark, tables.backing(spark, target))


def test_upsert_of_nothing_and_of_new_keys(spark, built):
    target = built[1]
    delta = silver.silver_interactions(rows.interactions(spark))
    assert incremental.part_upsert(spark, target, delta) == []
    delta = silver.silver_interactions(rows.interactions(spark, rows.contact(1, 900_001), rows.contact(2, 0)))
    count = spark.table(target).count()
    incremental.part_upsert(spark, target, delta)
    assert spark.table(target).count() == count + 1
    assert by_key(spark.table(target))[0]["total_interactions"] == 1


def test_generations_a_lost_job_left_are_dropped(spark, names):
    _, name = names
    df = spark.range(3)
    for _ in range(2):
        replace_table(df, name)
    df.write.saveAsTable(f"{name}__g0")
    replace_table(df, name)
    left = {r["tableName"] for r in spark.sql(f"SHOW TABLES IN {name.split('.')[0]} LIKE 'target__g*'").collect()}
    assert left == {"target__g2", "target__g3"}


# Runs in parts ------------------------------------------------------------------------


def raw(spark):
    return {
        "customer_raw": rows.customers(spark, *(rows.customer(k, gender="Female") for k in range(1, 9))),
        "product_enrollments": rows.enrollments(spark, *(rows.enrollment(k * 10, k, "Credit Card", limit="100") for k in range(1, 9))),
        "crm_interactions": rows.interactions(spark, *(rows.contact(k, k, day=rows.ago(k)) for k in range(1, 7))),
        "transaction_history": rows.transactions(spark, *(rows.payment(k, k * 10, k, f"-{k}") for k in range(1, 8))),
    }


@pytest.fixture
def mart(spark):
    name = f"m{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    mart = pipeline.Mart(spark, name, clock=CLOCK, buckets=4)
    for table, df in raw(spark).items():
        mart.ingest(df, table)
    return mart


def test_run_in_parts_equals_a_rebuild(spark, mart):
    pipeline.refresh_all(mart)
    before = files(spark, mart.name("silver_customer_transactions"))
    mart.ingest(rows.interactions(spark, rows.contact(50, 8, "Call", rows.ago(1), SECOND)), "crm_interactions", append=True)
    mart.ingest(rows.transactions(spark, rows.payment(50, 10, 1, "200000", stamp=SECOND)), "transaction_history", append=True)
    assert mart.in_parts("transaction_history", "silver_customer_transactions")
    pipeline.refresh_facts(mart)
    assert {r.status for r in mart.results} == {"pass"}
    after = files(spark, mart.name("silver_customer_transactions"))
    assert sum(after[p] != before.get(p) for p in after) == 1
    refreshed = by_key(mart.read(GOLD))
    assert refreshed[1]["customer_segment"] == "Premium" and refreshed[8]["call_interactions"] == 1
    pipeline.refresh_facts(mart, full_refresh=True)
    assert by_key(mart.read(GOLD)) == refreshed
    pipeline.backfill_all(mart, SECOND, SECOND + dt.timedelta(minutes=1))
    assert by_key(mart.read(GOLD)) == refreshed
    with session_settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        joined = plan(pipeline.customer_profile(*(mart.read(t) for t in SILVER), CLOCK))
    assert "Exchange" not in joined, "parts keep the buckets the profile join relies on"


def test_optimize_keeps_the_layout_of_facts(spark, mart):
    for i in range(3):
        mart.ingest(rows.interactions(spark, rows.contact(60 + i, 1, stamp=SECOND)), "crm_interactions", append=True)
    count = mart.read("crm_interactions").count()
    many = len(stored(spark, mart.name("crm_interactions")).inputFiles())
    pipeline.optimize(mart, "crm_interactions")
    assert len(stored(spark, mart.name("crm_interactions")).inputFiles()) < many
    assert mart.read("crm_interactions").count() == count
    assert tables.fact_parts(spark, mart.name("crm_interactions")) == 4


# Gates -------------------------------------------------------------------------------


def test_gates_count_while_writing_and_keep_the_rows(spark, mart, monkeypatch):
    odd = rows.interactions(spark, rows.contact(1, 1, "Fax", day=rows.ago(1)), rows.contact(2, 99, "Call", day=rows.ago(1)))
    mart.ingest(odd, "crm_interactions")
    asked = []
    run_rules = checks.run_rules
    monkeypatch.setattr(checks, "run_rules", lambda t, c: asked.extend(c) or run_rules(t, c))
    fax = [f"accepted_values_{t}_last_interaction_type" for t in ("silver_customer_interactions", GOLD)]
    lost = "relationships_silver_customer_interactions_customer_id"
    waiving = pipeline.Mart(spark, mart.database, clock=CLOCK, buckets=4, waived=frozenset([*fax, lost]))
    pipeline.refresh_all(waiving)
    assert not [c for c in asked if isinstance(c, checks.Rule) and c.violation is not None], "no row rule was scanned for"
    assert {r.rule_id: r.failures for r in waiving.results if r.failures} == {fax[0]: 1, fax[1]: 1, lost: 1}
    found = {(r.gate, r.rule_id): r.violation for r in waiving.read("violations").collect()}
    assert set(found) == {("silver", fax[0]), ("silver", lost), ("profile", fax[1])}
    assert '"customer_id":1' in found["silver", fax[0]] and '"last_interaction_type":"FAX"' in found["silver", fax[0]]
    assert '"customer_id":99' in found["silver", lost]

    # Once the rows are right, the next run leaves none; switched off, it leaves what is there.
    mart.ingest(rows.interactions(spark, rows.contact(1, 1, "Call", day=rows.ago(1))), "crm_interactions")
    pipeline.refresh_facts(waiving, full_refresh=True)
    assert waiving.read("violations").count() == 0
    pipeline.Mart(spark, mart.database, clock=CLOCK, buckets=4, audit=False).check("all", [])


def test_row_rules_of_a_table_are_one_scan(spark, tmp_path):
    path = str(tmp_path / "customers")
    rows.customers(spark, rows.customer(1, mobile=None, gender="X"), rows.customer(2)).write.parquet(path)
    table = spark.read.parquet(path)
    many = [checks.Rule("not_null", "t", c) for c in table.columns] + [checks.Rule("accepted_values", "t", "gender", values=("Male",))]
    found = checks.violations({"t": table}, many)
    assert plan(found).count("FileScan") == 1
    assert {r.rule_id for r in found.collect()} == {"not_null_t_mobile", "accepted_values_t_gender"}


def test_only_violating_rows_become_text_and_each_once(spark, tmp_path):
    path = str(tmp_path / "customers")
    rows.customers(spark, rows.customer(1, mobile=None, gender="X"), rows.customer(2), rows.customer(3, gender=None)).write.parquet(path)
    table = spark.read.parquet(path)
    many = [checks.Rule("not_null", "t", "mobile"), checks.Rule("accepted_values", "t", "gender", values=("Male",))]
    found = checks.violations({"t": table}, many)
    above, below = plan(found).lower().split("generate", 1)
    assert "json" not in above and "json" in below, "made once a row, below the unfolding"
    kept = [(r.rule_id, json.loads(r.violation)["customer_id"]) for r in found.collect()]
    assert sorted(kept) == [("accepted_values_t_gender", 1), ("not_null_t_mobile", 1)], "a NULL is no wrong value"


def test_a_gate_without_failures_leaves_an_empty_table_without_python(spark, names):
    table = rows.customers(spark, rows.customer(1))
    assert checks.settle({"t": table}, [checks.Rule("not_null", "t", "customer_id")], {}, names[1])[0].failures == 0
    assert spark.table(names[1]).count() == 0 and set(spark.table(names[1]).columns) == set(VIOLATIONS.names)
    empty = tables.no_rows(spark, VIOLATIONS)
    assert empty.schema.simpleString() == VIOLATIONS.simpleString() and empty.isEmpty()
    assert "ExistingRDD" not in plan(empty)


def test_a_line_of_the_run_log_needs_no_python(spark):
    row = (7, "bank_check", LOAD.replace(tzinfo=dt.UTC), None, "FAILED")
    line = tables.one_row(spark, row, RUN_LOG)
    assert line.schema.simpleString() == RUN_LOG.simpleString() and "ExistingRDD" not in plan(line)
    assert line.collect() == spark.createDataFrame([row], RUN_LOG).collect()


def test_mart_pins_the_session(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Manila")
    pipeline.Mart(spark, "default", buckets=2)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


# Sketches, index, pairs, lines -----------------------------------------------------------


def test_sketches_are_kept_per_load_and_merged(spark, names):
    name = names[1]
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("x"), (F.col("id") % 4).cast("int").alias("load"))
    for load in (0, 1, 2, 3, 3):
        sketches.keep_sketches(sketches.load_sketches(df.where(F.col("load") == load), "x", "load"), name)
    estimates = sketches.quantiles(spark.table(name), (1, 50, 99)).collect()
    assert {(r.n_values, r.n_loads) for r in estimates} == {(20_000, 4)}
    for r in estimates:
        assert abs(r.estimate - 200 * r.percentile) <= 20_000 * sketches.RANK_ERROR
    checked = sketches.within_rank_bounds(sketches.quantiles(spark.table(name), (1, 50, 99)), df, "x", (1, 50, 99))
    assert {(r.percentile, r.within) for r in checked.collect()} == {(1, True), (50, True), (99, True)}
    wrong = sketches.quantiles(spark.table(name), (1, 50, 99)).withColumn("estimate", F.lit(500.0))
    assert {r.within for r in sketches.within_rank_bounds(wrong, df, "x", (50,)).collect()} == {False}


def test_sketches_of_nothing(spark):
    nothing = spark.createDataFrame([(None, 1)], "x double, load int")
    assert sketches.load_sketches(nothing, "x", "load").count() == 0
    none = sketches.quantiles(sketches.load_sketches(nothing, "x", "load"), (50,))
    assert none.collect() == []
    assert sketches.within_rank_bounds(none, nothing, "x", (50,)).collect() == []


def test_key_index_is_never_shuffled(spark, names):
    name = names[0]
    first = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    second = spark.createDataFrame([(2,), (3,), (3,), (4,), (None,)], "id long")
    key_index.index_keys(spark, name, key_index.load_keys(first, "id", 1), 4)
    one = {r.key: (r.n_rows, r.n_before) for r in key_index.repeats(spark, name, key_index.load_keys(first, "id", 1)).collect()}
    assert one == {2: (2, 0)}
    keys_of_load = key_index.load_keys(second, "id", 2)
    key_index.index_keys(spark, name, keys_of_load)
    found = key_index.repeats(spark, name, keys_of_load)
    assert {r.key: (r.n_rows, r.n_before) for r in found.collect()} == {2: (1, 2), 3: (2, 0)}
    third = key_index.load_keys(spark.createDataFrame([(4,), (9,), (9,), (None,)], "id long"), "id", 3)
    lost = key_index.unknown(spark, name, third)
    assert {r.key: r.n_rows for r in lost.collect()} == {9: 2}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (key_index.repeats(spark, name, keys_of_load), key_index.unknown(spark, name, third)):
            side = plan(df).split("FileScan")[-2].splitlines()
            above = [line for line in side[-4:] if "Exchange" in line]
            assert not above, "the index side of the join has no exchange"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_owner_pairs_equal_the_full_count(spark, names):
    name = names[0]
    enrolled = rows.enrollments(spark, *(rows.enrollment(k, k % 5) for k in range(20)))
    paid = [rows.payment(i, i % 25, (i % 25) % 5 + (i % 7 == 0)) for i in range(200)]
    first, second = rows.transactions(spark, *paid[:120]), rows.transactions(spark, *paid[120:])
    owner_pairs.build_pairs(name, first, enrolled, 4)

    def agree(paid, enrolled):
        (kept,) = owner_pairs.mismatches(spark.table(name)).collect()
        (full,) = keys.owner_mismatch_count(paid, enrolled).collect()
        assert kept.failures == full.failures

    agree(first, enrolled)
    more = rows.enrollments(spark, *(rows.enrollment(k, k % 5, stamp=SECOND) for k in range(20, 23)))
    both = enrolled.union(more)
    owner_pairs.add_pairs(spark, name, second, both, more)
    agree(first.union(second), both)
    # A changed owner alone re-judges its pairs, and only their part.
    moved = rows.enrollments(spark, *(rows.enrollment(k, 9 if k == 3 else k % 5) for k in range(23)))
    assert len(owner_pairs.add_pairs(spark, name, second.limit(0), moved, moved.where("product_id = 3"))) == 1
    agree(first.union(second), moved)
    assert owner_pairs.add_pairs(spark, name, second.limit(0), moved) == []


def test_bad_lines_are_kept_with_their_reasons(spark, tmp_path):
    head = "|".join(CUSTOMERS.names)
    lines = [
        "1|A|B|a@b.c|0912|Male|1990-01-01|2020-01-01",
        "2|A|B|a@b.c|0912|Male|soon|never",
        "x|A|B|a@b.c|0912|Male|1990-01-01|2020-01-01",
        "4|A|B|a@b.c",
        "5|A|B|a@b.c|0912|Male|1990-01-01|2020-01-01|more",
        "6||||||| ",
    ]
    (tmp_path / "a.csv").write_text("\n".join([head, *lines]) + "\n")
    good, rejected = split_checked(read_checked(spark, str(tmp_path / "*.csv"), CUSTOMERS, keep_text=("signup_date",)))
    assert {r.customer_id: r.signup_date_text for r in good.collect()}.keys() == {1} | ({6} if good.count() == 2 else set())
    assert good.count() + rejected.count() == len(lines)
    why = {r._line.split("|")[0] + str(r._line.count("|")): list(r._reasons) for r in rejected.collect()}
    assert why["27"] == ["date_of_birth", "signup_date"] and why["x7"] == ["customer_id"]
    assert why["43"] == ["columns"] and why["58"] == ["columns"]
    assert all(r._file.endswith("a.csv") for r in rejected.collect())


def test_rejected_lines_do_not_stop_a_load(spark, mart, tmp_path):
    text = tmp_path / "t.csv"
    head = "transaction_id|product_id|customer_id|transaction_amount|closing_balance|transaction_date"
    text.write_text(f"{head}\n70|10|1|5.00|1.00|2024-06-01 10:00:00+08:00\n71|10|1|five|1.00|2024-06-01\n")
    pipeline.ingest_files(mart, str(text), "transaction_history")
    (row,) = mart.read("transaction_history").collect()
    assert row.transaction_id == 70 and row.transaction_date_text == "2024-06-01 10:00:00+08:00"
    (bad,) = mart.read("rejected_lines").collect()
    assert (bad.table_name, list(bad._reasons)) == ("transaction_history", ["transaction_amount"])
    assert set(RAW) <= {t.name for t in spark.catalog.listTables(mart.database)}
