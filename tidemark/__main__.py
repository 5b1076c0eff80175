"""Jobs for spark-submit: `python -m tidemark refresh-facts --database mart`."""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import SparkSession

from tidemark.config import build_session
from tidemark.plans import pipeline
from tidemark.plans.profiling import profile_report
from tidemark.schemas import RAW
from tidemark.sources import replace_table

JOBS = (
    "ingest", "refresh-facts", "refresh-all", "backfill", "optimize", "profile",
    "check", "freshness", "monitor",
)


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("job", choices=JOBS)
    parser.add_argument("--database", default="default")
    parser.add_argument("--audit-database")
    parser.add_argument("--buckets", type=int, default=0, help="files per customer-grain table; 0: the session's shuffle partitions")
    parser.add_argument("--full-refresh", action="store_true")
    parser.add_argument("--ungated-columns", action="store_true", help="column rules do not gate")
    parser.add_argument("--waive", nargs="*", default=[], help="rule ids that never stop a run")
    parser.add_argument("--start", type=dt.datetime.fromisoformat, help="backfill from, inclusive")
    parser.add_argument("--end", type=dt.datetime.fromisoformat, help="backfill to, exclusive")
    parser.add_argument("--table", help="table to ingest or optimize")
    parser.add_argument("--path", help="files to ingest, may be a glob")
    parser.add_argument("--append", action="store_true", help="ingest adds to the table instead of replacing it")
    parser.add_argument("--cluster", help="comma-separated columns to order the table by")
    return parser.parse_args(argv)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    mart = pipeline.Mart(
        spark,
        args.database,
        buckets=args.buckets,
        audit_database=args.audit_database,
        gate_columns=not args.ungated_columns,
        waived=frozenset(args.waive),
    )
    if args.job == "ingest":
        pipeline.ingest_files(mart, args.path, args.table, args.append)
    elif args.job == "refresh-facts":
        pipeline.refresh_facts(mart, args.full_refresh)
    elif args.job == "refresh-all":
        pipeline.refresh_all(mart, args.full_refresh)
    elif args.job == "backfill":
        pipeline.backfill_all(mart, args.start, args.end)
    elif args.job == "optimize":
        pipeline.optimize(mart, args.table, args.cluster)
    elif args.job == "check":
        pipeline.check_all(mart)
    elif args.job == "freshness":
        pipeline.report_freshness(mart)
    elif args.job == "monitor":
        pipeline.monitor(mart)
    else:
        replace_table(profile_report(*(mart.read(t) for t in RAW)), mart.name("profile_report"))


if __name__ == "__main__":
    run(build_session("tidemark"), arguments())
