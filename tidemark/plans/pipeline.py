"""The runs: facts by watermark, dimensions in full, backfill, table maintenance.

Each run is plain calls over catalog tables in dependency order. A failing gate
raises, so later layers keep their last good content.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Clock, Thresholds, pin_session
from tidemark.operators.incremental import RollUp, backfill, incremental_refresh, refresh_in_parts
from tidemark.operators.layout import cluster_by, compact, target_files
from tidemark.plans import rules
from tidemark.plans.checks import (
    Check,
    CheckResult,
    build_freshness,
    freshness,
    require_pass,
    row_counts_of,
    settle,
    store_rows,
)
from tidemark.plans.gold import customer_profile
from tidemark.plans.monitoring import row_counts, run_durations
from tidemark.plans.silver import (
    silver_customers,
    silver_interactions,
    silver_products,
    silver_transactions,
)
from tidemark.schemas import CUSTOMER, GOLD, INGESTED, RAW, RUN_LOG, SILVER
from tidemark.sources.delimited import read_checked, split_checked, stamp_ingest
from tidemark.sources.parts import LOAD, PART
from tidemark.sources.tables import (
    append_batch,
    append_facts,
    bucket_count,
    fact_parts,
    one_row,
    replace_facts,
    replace_table,
    session_buckets,
    stored,
)

CUSTOMERS, PRODUCTS, INTERACTIONS, TRANSACTIONS = SILVER
RAW_CUSTOMERS, RAW_ENROLLMENTS, RAW_INTERACTIONS, RAW_TRANSACTIONS = RAW
RAW_FACTS, FACTS = (RAW_INTERACTIONS, RAW_TRANSACTIONS), (INTERACTIONS, TRANSACTIONS)
LOG, REJECTED = "run_log", "rejected_lines"
GATES = ("customers", "products", "raw", "silver", "profile", "all")
# Age from which on a profile counts as overdue.
BUILD_SLA = dt.timedelta(minutes=90)


@dataclass(frozen=True)
class Mart:
    """Where the tables live and how the runs behave.

    `buckets` is the number of files of every customer-grain table; 0 takes the
    session's number of shuffle partitions, which a cluster sets by its data. All are
    bucketed on the customer, so the profile join and the upserts do not shuffle
    what is stored. `gate_columns` makes column rules stop a run like assertions do;
    rules in `waived` are evaluated and stored but never stop it. Rows that violate a rule
    are stored in `violations_<gate>`, and all gates together shown as `violations`, unless
    `audit` is off; `audit_database` also gets a table per failing rule with its own columns.
    The session gets the zone, ANSI and skew settings the results rest on.
    """

    spark: SparkSession
    database: str = "default"
    limits: Thresholds = Thresholds()
    clock: Clock = Clock()
    buckets: int = 0
    audit: bool = True
    audit_database: str | None = None
    gate_columns: bool = True
    waived: frozenset[str] = frozenset()
    results: list[CheckResult] = field(default_factory=list)
    observed: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        pin_session(self.spark)
        if not self.buckets:
            object.__setattr__(self, "buckets", session_buckets(self.spark))

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def has(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def write(
        self, df: DataFrame, table: str, arranged: bool = False, columns: Sequence[rules.Rule] = ()
    ) -> None:
        """Replace a customer-grain table; what its rows alone can violate of `columns` is
        counted by the write itself and kept for the next gate."""
        counts = row_counts_of(columns) if self.gate_columns else []
        seen = Observation() if counts else None
        replace_table(
            df, self.name(table), CUSTOMER, self.buckets, arranged,
            in_parts=table in FACTS, observe=(seen, counts) if seen else None,
        )
        self.observed.update(seen.get if seen else {})

    def ingest(self, df: DataFrame, table: str, append: bool = False) -> None:
        """Store a raw load: facts by load day and part, the others as they are."""
        if table in RAW_FACTS:
            store = append_facts if append else replace_facts
            store(df, self.name(table), CUSTOMER, INGESTED, self.buckets)
        elif append:
            append_batch(df, self.name(table))
        else:
            replace_table(df, self.name(table))

    def in_parts(self, raw: str, table: str) -> bool:
        """Whether a raw table and its roll-up lie in parts, so that a refresh may read and
        replace some of them alone."""
        if not self.has(raw) or not self.has(table) or not self.arranged(table):
            return False
        return bool(fact_parts(self.spark, self.name(raw))) and PART in stored(self.spark, self.name(table)).columns

    def arranged(self, *tables: str) -> bool:
        """Whether all these tables lie in the mart's buckets, so that what is joined from
        them does as well."""
        return all(bucket_count(self.spark, self.name(t)) == self.buckets for t in tables)

    def check(self, gate: str, columns: Sequence[rules.Rule], assertions: Sequence[Check] = ()) -> None:
        """One gate: the column rules, if they gate, and the assertions together. What the
        writes have counted is not counted again."""
        checks = [*(columns if self.gate_columns else ()), *assertions]
        if not checks:
            return
        tables = {t: self.read(t) for c in checks for t in c.tables}
        known = {c.rule_id: self.observed.pop(c.rule_id) for c in checks if c.rule_id in self.observed}
        found = settle(tables, checks, known, self.name(f"violations_{gate}") if self.audit else None)
        if self.audit:
            self._show_violations()
        if self.audit_database is not None:
            failing = {r.rule_id for r in found if r.failures}
            store_rows(self.spark, tables, checks, failing, self.audit_database)
        self.results.extend(found)
        require_pass(found, self.waived)

    def _show_violations(self) -> None:
        """`violations` shows the rows of the last run of every gate."""
        gates = [t for t in (f"violations_{g}" for g in GATES) if self.has(t)]
        shown = " UNION ALL ".join(f"SELECT '{g.removeprefix('violations_')}' AS gate, * FROM {self.name(g)}" for g in gates)
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name('violations')} AS {shown}")

    def silver_columns(self, *tables: str) -> dict[str, list[str]]:
        return {t: self.read(t).columns for t in tables}


def ingest_files(mart: Mart, path: str | list[str], table: str, append: bool = False, **opts: object) -> None:
    """Delimited files into a raw table; lines that do not fit it go to `rejected_lines` with
    their reasons and never fail the load. Of timestamps the delivered text is kept as well."""
    schema = RAW[table]
    texts = tuple(f.name for f in schema if f.dataType.typeName() == "timestamp")
    good, rejected = split_checked(read_checked(mart.spark, path, schema, keep_text=texts, **opts))
    mart.ingest(stamp_ingest(good), table, append)
    rejected = stamp_ingest(rejected.withColumn("table_name", F.lit(table)))
    append_batch(rejected, mart.name(REJECTED))


def transactions_roll_up(mart: Mart) -> RollUp:
    enrollments = mart.read(RAW_ENROLLMENTS)
    return lambda rows: silver_transactions(rows, enrollments)


def build_dimensions(mart: Mart) -> None:
    """Customers, then products, both in full; each is checked before the next."""
    customers = silver_customers(mart.read(RAW_CUSTOMERS), mart.clock)
    columns = rules.silver_rules({CUSTOMERS: customers.columns}, [CUSTOMERS])
    mart.write(customers, CUSTOMERS, columns=columns)
    mart.check("customers", columns)
    products = silver_products(mart.read(RAW_ENROLLMENTS))
    columns = rules.silver_rules({PRODUCTS: products.columns}, [PRODUCTS])
    mart.write(products, PRODUCTS, columns=columns)
    mart.check("products", columns)


def _refresh(mart: Mart, raw: str, table: str, roll_up: RollUp, full_refresh: bool) -> None:
    if not full_refresh and mart.in_parts(raw, table):
        refresh_in_parts(mart.spark, mart.name(raw), mart.name(table), roll_up)
        return
    target = None if full_refresh or not mart.has(table) else mart.read(table)
    rows = incremental_refresh(mart.read(raw), target, roll_up, buckets=mart.buckets)
    if rows is not target:  # nothing pending: the table stays as it is
        _write_facts(mart, rows, table, arranged=target is not None and mart.arranged(table))


def _write_facts(mart: Mart, rows: DataFrame, table: str, arranged: bool = False) -> None:
    mart.write(rows, table, arranged, rules.silver_rules({table: rows.columns}, [table]))


def refresh_interactions(mart: Mart, full_refresh: bool = False) -> None:
    _refresh(mart, RAW_INTERACTIONS, INTERACTIONS, silver_interactions, full_refresh)


def refresh_transactions(mart: Mart, full_refresh: bool = False) -> None:
    roll_up = transactions_roll_up(mart)
    _refresh(mart, RAW_TRANSACTIONS, TRANSACTIONS, roll_up, full_refresh)


def _backfill(
    mart: Mart,
    raw: str,
    table: str,
    roll_up: RollUp,
    start: dt.datetime | None,
    end: dt.datetime | None,
) -> None:
    if start is not None and end is not None and mart.in_parts(raw, table):
        refresh_in_parts(mart.spark, mart.name(raw), mart.name(table), roll_up, (start, end))
        return
    source = mart.read(raw)
    target = mart.read(table) if mart.has(table) and (start, end) != (None, None) else None
    if target is None:
        _write_facts(mart, roll_up(source), table)
        return
    rows = backfill(source, target, roll_up, start, end, buckets=mart.buckets)
    if rows is not target:
        _write_facts(mart, rows, table, arranged=mart.arranged(table))


def _both(first: Callable[[], None], second: Callable[[], None]) -> None:
    """Two independent builds at once: tasks of one fill the gaps of the other."""
    with ThreadPoolExecutor(2) as pool:
        for build in [pool.submit(first), pool.submit(second)]:
            build.result()


def _finish(mart: Mart) -> None:
    """Silver checks, the profile, profile checks."""
    facts = (INTERACTIONS, TRANSACTIONS)
    columns = rules.silver_rules(mart.silver_columns(*facts), facts)
    mart.check("silver", columns, rules.silver_assertions())
    profile = customer_profile(*(mart.read(t) for t in SILVER), mart.clock, mart.limits)
    columns = rules.gold_rules(profile.columns)
    mart.write(profile, GOLD, mart.arranged(*SILVER), columns)
    mart.check("profile", columns, rules.gold_assertions(mart.limits))


def refresh_facts(mart: Mart, full_refresh: bool = False) -> None:
    """Raw check, both fact roll-ups by watermark, then the profile, with gates."""

    def run() -> None:
        mart.observed.clear()
        mart.check("raw", [], rules.bronze_assertions())
        _both(
            lambda: refresh_interactions(mart, full_refresh),
            lambda: refresh_transactions(mart, full_refresh),
        )
        _finish(mart)

    _logged(mart, "refresh_facts", run)


def refresh_all(mart: Mart, full_refresh: bool = False) -> None:
    """Dimensions, facts and profile, then compaction of the fact tables."""

    def run() -> None:
        build_dimensions(mart)
        refresh_facts(mart, full_refresh)
        for table in (INTERACTIONS, TRANSACTIONS):
            optimize(mart, table)

    _logged(mart, "refresh_all", run)


def backfill_all(
    mart: Mart, start: dt.datetime | None = None, end: dt.datetime | None = None
) -> None:
    """Recompute the customers stamped in [start, end), or all, and the profile."""

    def run() -> None:
        roll_up = transactions_roll_up(mart)
        _both(
            lambda: _backfill(mart, RAW_INTERACTIONS, INTERACTIONS, silver_interactions, start, end),
            lambda: _backfill(mart, RAW_TRANSACTIONS, TRANSACTIONS, roll_up, start, end),
        )
        _finish(mart)

    _logged(mart, "backfill_all", run)


def optimize(mart: Mart, table: str, cluster: str | None = None) -> None:
    """Rewrite a table in full-size files; `cluster` lists columns to order it by.

    A customer-grain table gets one file per bucket, other tables files of about
    128 MB. A table that has no more files than that is left as it is.
    """
    name = mart.name(table)
    df = stored(mart.spark, name)
    files = len(df.inputFiles())
    if fact_parts(mart.spark, name):
        # A file per load day and part is what a fact table is read by.
        if cluster is not None or files > df.select(LOAD, PART).distinct().count():
            replace_facts(df.drop(LOAD, PART), name, CUSTOMER, INGESTED, mart.buckets)
        return
    df = df.drop(PART)
    by_customer = table in (*SILVER, GOLD)
    wanted = mart.buckets if by_customer and cluster is None else target_files(df)
    if cluster is not None:
        keys = [c.strip() for c in cluster.split(",")]
        replace_table(cluster_by(df, keys, wanted), mart.name(table))
    elif files > wanted:
        if by_customer:
            mart.write(df, table)
        else:
            replace_table(compact(df, wanted), mart.name(table))


def check_all(mart: Mart) -> None:
    """Every declared rule and assertion over all layers as they are."""

    def run() -> None:
        columns = [
            *rules.bronze_rules(),
            *rules.silver_rules(mart.silver_columns(*SILVER)),
            *rules.gold_rules(mart.read(GOLD).columns),
            rules.duplicate_email_rule(),
        ]
        assertions = [
            *rules.bronze_assertions(),
            *rules.silver_assertions(),
            *rules.gold_assertions(mart.limits),
        ]
        mart.observed.clear()
        mart.check("all", columns, assertions)

    _logged(mart, "check", run)


def report_freshness(mart: Mart, sla: dt.timedelta = BUILD_SLA) -> None:
    """Age of the raw tables and of the profile, into the table `freshness`."""
    raw = freshness({t: mart.read(t) for t in RAW}, mart.clock)
    built = build_freshness(mart.read(GOLD), sla, mart.clock, GOLD)
    replace_table(raw.union(built), mart.name("freshness"))


def monitor(mart: Mart) -> None:
    """Recent runs of this mart into `recent_runs`, rows per built table, compared with
    the report before, into `row_counts`."""
    if mart.has(LOG):
        runs = run_durations(mart.read(LOG), f"{mart.database}_", mart.clock)
        replace_table(runs, mart.name("recent_runs"))
    before = mart.read("row_counts") if mart.has("row_counts") else None
    report = row_counts({t: mart.read(t) for t in (*SILVER, GOLD)}, mart.clock, previous=before)
    replace_table(report, mart.name("row_counts"))


def _logged(mart: Mart, job: str, run: Callable[[], None]) -> None:
    """Run a job and add its times and outcome to the run log, as `<database>_<job>`. A log
    that cannot be written does not hide the error of a failed job."""
    started = dt.datetime.now(dt.UTC)

    def log(state: str) -> None:
        ended = dt.datetime.now(dt.UTC)
        row = (int(started.timestamp() * 1e6), f"{mart.database}_{job}", started, ended, state)
        append_batch(one_row(mart.spark, row, RUN_LOG), mart.name(LOG))

    try:
        run()
    except Exception as failure:
        try:
            log("FAILED")
        except Exception as unlogged:
            failure.add_note(f"the run log could not be written: {unlogged}")
        raise
    log("SUCCESS")
