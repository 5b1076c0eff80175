"""Counting and distribution operators used by profiling and monitoring."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import is_blank
from tidemark.operators.keys import union_all


def count_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def share_of_total(df: DataFrame, key: str, digits: int = 1) -> DataFrame:
    """Rows per value and their percentage of all rows.

    The total is a scalar subquery over the counts, not a window: no task ever
    holds all the groups.
    """
    counts = count_by(df, key)
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("pct", F.round(F.col("n").cast("double") / total * 100, digits))


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once, NULLs left out."""
    present = df.na.drop(subset=list(keys))
    return count_by(present, *keys).where("n > 1")


def surplus_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of each key value; NULL counts as one value.

    Counted from one row per value, so no distinct set is gathered in one task.
    """
    per_value = count_by(df, key)
    return per_value.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_values"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def blank_counts(df: DataFrame) -> dict[str, Column]:
    """NULL-or-empty count per column; only text can be empty."""
    return {
        f.name: F.count_if(is_blank(f.name, f.dataType.typeName() == "string")) for f in df.schema
    }


def blanks(df: DataFrame) -> DataFrame:
    """NULL-or-empty count of every column, one scan: (column_name, n_blank)."""
    counts = df.agg(*(n.alias(c) for c, n in blank_counts(df).items()))
    return counts.unpivot([], df.columns, "column_name", "n_blank")


def fan_out(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows per key: (min / max / average, histogram of the row counts)."""
    per_key = count_by(df, key)
    spread = per_key.agg(
        F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.avg("n").alias("avg_n")
    )
    return spread, per_key.groupBy("n").agg(F.count("*").alias("n_keys"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count), one row per table."""
    return union_all(
        *(
            df.agg(F.count("*").alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count"
            )
            for name, df in tables.items()
        )
    )


def exact_percentiles(
    df: DataFrame,
    column: str,
    fractions: Sequence[str],
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact nearest-rank percentiles, (fraction, value); fractions as decimal text.

    A mergeable sketch gives, for each fraction, two values beside its rank; a scan counts
    the rows under and up to each. Either one of them holds the rank, or the gap it lies in,
    before, between or after them, is sketched again. A gap leaves out the values that
    bound it, so it always shrinks, some thousandfold as a rule. The table is neither sorted
    nor shuffled, and the driver gets one row a round.
    """
    value, slack = F.col(column), 2 / accuracy
    total = df.agg(F.count(column)).first()[0]
    ranks = {f: max(1, math.ceil(Fraction(f) * total)) for f in fractions}
    gaps = {f: _Gap(None, None, 0, total) for f in fractions} if total else {}
    found: dict[str, object] = {}
    while gaps:
        # One sketch per gap; at first all ranks share the whole.
        shared: dict[_Gap, list[str]] = {}
        for f, gap in gaps.items():
            shared.setdefault(gap, []).append(f)
        sketches = []
        for n, (gap, members) in enumerate(shared.items()):
            aims = [(ranks[f] - gap.below) / gap.inside for f in members]
            ends = [min(1.0, max(0.0, a + shift)) for a in aims for shift in (-slack, slack)]
            inside = F.when(gap.holds(value), value)
            sketches.append(F.percentile_approx(inside, ends, accuracy).alias(f"s{n}"))
        sketched = df.agg(*sketches).first()
        pivots = {
            f: sketched[n][2 * at : 2 * at + 2]
            for n, members in enumerate(shared.values())
            for at, f in enumerate(members)
        }
        counts = df.agg(
            *(
                F.count_if(value < F.lit(p) if kind == "under" else value <= F.lit(p)).alias(f"{kind}{f}_{k}")
                for f, pair in pivots.items()
                for k, p in enumerate(pair)
                for kind in ("under", "upto")
            )
        ).first()
        for f, pair in pivots.items():
            seen = [(p, counts[f"under{f}_{k}"], counts[f"upto{f}_{k}"]) for k, p in enumerate(pair)]
            hit = [p for p, under, upto in seen if under < ranks[f] <= upto]
            if hit:
                found[f] = hit[0]
                del gaps[f]
            else:
                gaps[f] = gaps[f].beside(ranks[f], seen)
    kind = T.StructType().add("fraction", "string").add("value", df.schema[column].dataType)
    return df.sparkSession.createDataFrame(list(found.items()), kind)


@dataclass(frozen=True)
class _Gap:
    """Values strictly between two bounds, either of which may be open, with the rows
    before the gap and inside it."""

    low: object
    high: object
    below: int
    inside: int

    def holds(self, value: Column) -> Column:
        held = value.isNotNull()
        if self.low is not None:
            held &= value > F.lit(self.low)
        if self.high is not None:
            held &= value < F.lit(self.high)
        return held

    def beside(self, rank: int, pivots: Sequence[tuple[object, int, int]]) -> _Gap:
        """The part of the gap the rank lies in; `pivots` ascend: value, rows under it, rows up to it."""
        low, high, below, end = self.low, self.high, self.below, self.below + self.inside
        for pivot, under, upto in pivots:
            if upto < rank:
                low, below = pivot, upto
            else:
                high, end = pivot, under
                break
        return _Gap(low, high, below, end - below)
