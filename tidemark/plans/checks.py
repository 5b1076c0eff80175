"""Evaluating rules: one summary per run, violating rows kept for failing rules."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Clock
from tidemark.operators.keys import union_all
from tidemark.plans.rules import Assertion, Rule
from tidemark.schemas import INGESTED, VIOLATIONS
from tidemark.sources.tables import drop_audit, no_rows, replace_table, write_audit

Check = Rule | Assertion


def run_rules(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """(rule_id, table_name, severity, failures, status), one row per rule.

    All rules a single row can violate are counted in one scan of their table.
    Uniqueness, references and assertions are one aggregate each over per-key counts.
    """
    by_row: dict[str, list[Rule]] = defaultdict(list)
    others: list[Check] = []
    for check in checks:
        if isinstance(check, Rule) and check.violation is not None:
            by_row[check.table].append(check)
        else:
            others.append(check)

    scans = [
        tables[table].agg(_lines(rules, [f"count_if({r.violation})" for r in rules]))
        for table, rules in by_row.items()
    ]
    keyed = [c.failures(tables).select(_lines([c], ["failures"])) for c in others]
    failed = F.when(F.col("failures") > 0, F.col("severity")).otherwise("pass")
    return union_all(*scans, *keyed).select(F.inline("lines")).withColumn("status", failed)


def violations(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """(rule_id, table_name, severity, violation): every violating row of every rule, as JSON.

    A table is read once for all rules that one row alone can violate: each row carries the
    ids of the rules it violates, and only rows with some are unfolded. Uniqueness,
    references and assertions, which need other rows, add a branch each.
    """
    by_row: dict[str, list[Rule]] = defaultdict(list)
    found: list[DataFrame] = []
    for check in checks:
        if isinstance(check, Rule) and check.violation is not None:
            by_row[check.table].append(check)
        else:
            rows = check.rows(tables)
            found.append(_violated(rows.withColumn("_rules", F.array(_named(check)))))
    for table, rules in by_row.items():
        marks = ", ".join(
            f"CASE WHEN {r.violation} THEN named_struct('rule_id', '{r.rule_id}', 'table_name', '{r.table}', "
            f"'severity', '{r.severity}') END"
            for r in rules
        )
        # Good rows, mostly all, only meet the plain predicates.
        wrong = tables[table].where(" OR ".join(f"({r.violation})" for r in rules))
        found.append(_violated(wrong.withColumn("_rules", F.expr(f"filter(array({marks}), x -> x IS NOT NULL)"))))
    return union_all(*found)


def _named(check: Check) -> Column:
    return F.struct(
        F.lit(check.rule_id).alias("rule_id"), F.lit(check.table).alias("table_name"), F.lit(check.severity).alias("severity")
    )


def _violated(rows: DataFrame) -> DataFrame:
    content = [c for c in rows.columns if c != "_rules"]
    as_json = F.to_json(F.struct(*(F.col(f"`{c}`") for c in content))).alias("violation")
    # The text is made below the unfolding, once for all rules of a row.
    return rows.select("_rules", as_json).select(F.explode("_rules").alias("rule"), "violation").select("rule.*", "violation")


def row_counts_of(rules: Sequence[Rule]) -> list[Column]:
    """Failures of the rules one row alone can violate, to be observed while a table is
    written."""
    return [F.expr(f"count_if({r.violation})").alias(r.rule_id) for r in rules if r.violation is not None]


def settle(
    tables: Mapping[str, DataFrame],
    checks: Sequence[Check],
    known: Mapping[str, int],
    sink: str | None = None,
) -> list[CheckResult]:
    """Results of all checks, of which `known` counts were observed before, and the rows of
    all failing rules in the table `sink`, replaced as a whole and partitioned by rule."""
    rest = [c for c in checks if c.rule_id not in known]
    results = [
        CheckResult(c.rule_id, c.table, c.severity, known[c.rule_id], c.severity if known[c.rule_id] else "pass")
        for c in checks
        if c.rule_id in known
    ]
    if rest:
        results += [CheckResult(**row.asDict()) for row in run_rules(tables, rest).collect()]
    failing = {r.rule_id for r in results if r.failures}
    if sink is not None:
        wrong = [c for c in checks if c.rule_id in failing]
        spark = next(iter(tables.values())).sparkSession
        rows = violations(tables, wrong) if wrong else no_rows(spark, VIOLATIONS)
        replace_table(rows, sink, partition_by="rule_id")
    return results


def _lines(checks: Sequence[Check], failures: Sequence[str]) -> Column:
    """Summary lines as one array; SQL text, since a run has well over a hundred."""
    structs = [
        f"struct('{c.rule_id}' AS rule_id, '{c.table}' AS table_name, '{c.severity}' AS severity, "
        f"CAST({n} AS BIGINT) AS failures)"
        for c, n in zip(checks, failures, strict=True)
    ]
    return F.expr(f"array({', '.join(structs)})").alias("lines")


@dataclass(frozen=True)
class CheckResult:
    rule_id: str
    table_name: str
    severity: str
    failures: int
    status: str


class GateFailed(RuntimeError):
    """Error-severity rules were violated; `results` lists them."""

    def __init__(self, results: Sequence[CheckResult]):
        self.results = list(results)
        super().__init__(", ".join(f"{r.rule_id}: {r.failures}" for r in self.results))


def evaluate(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    checks: Sequence[Check],
    audit_database: str | None = None,
) -> list[CheckResult]:
    """Run the rules; what reaches the driver is one line per rule.

    With an audit database the violating rows of each failing rule are stored
    there, replacing those of its last run; a rule that passes now leaves none.
    """
    results = [CheckResult(**row.asDict()) for row in run_rules(tables, checks).collect()]
    if audit_database is not None:
        store_rows(spark, tables, checks, {r.rule_id for r in results if r.failures}, audit_database)
    return results


def store_rows(
    spark: SparkSession, tables: Mapping[str, DataFrame], checks: Sequence[Check], failing: set[str], database: str
) -> None:
    """A table per failing rule, with the columns of its rows; none for the others."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    drop_audit(spark, [c.rule_id for c in checks if c.rule_id not in failing], database)
    for check in checks:
        if check.rule_id in failing:
            write_audit(check.rows(tables), check.rule_id, database)


def require_pass(
    results: Sequence[CheckResult], waived: frozenset[str] = frozenset()
) -> list[CheckResult]:
    """Raise when a rule of severity error failed; waived rules only report."""
    stopping = [r for r in results if r.status == "error" and r.rule_id not in waived]
    if stopping:
        raise GateFailed(stopping)
    return list(results)


def freshness(
    tables: Mapping[str, DataFrame],
    clock: Clock = Clock(),
    warn: dt.timedelta = dt.timedelta(hours=24),
    error: dt.timedelta = dt.timedelta(hours=48),
    column: str = INGESTED,
) -> DataFrame:
    """(table_name, newest, age_seconds, status): pass, warn or error by age of the
    newest stamp. A table without a stamp is an error."""
    newest = union_all(
        *(
            df.agg(F.max(column).alias("newest")).select(F.lit(name).alias("table_name"), "newest")
            for name, df in tables.items()
        )
    )
    age = F.col("age_seconds")
    return newest.withColumn(
        "age_seconds", F.unix_seconds(clock.instant().cast("timestamp")) - F.unix_seconds("newest")
    ).withColumn(
        "status",
        F.when(age.isNull() | (age > error.total_seconds()), "error")
        .when(age > warn.total_seconds(), "warn")
        .otherwise("pass"),
    )


def build_freshness(
    profile: DataFrame, sla: dt.timedelta, clock: Clock = Clock(), name: str = "customer_profile"
) -> DataFrame:
    """Error when the profile was built longer ago than the agreed time."""
    return freshness({name: profile}, clock, warn=sla, error=sla, column="_gold_updated_at")
