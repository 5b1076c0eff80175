"""Helpers the operators share: row keys, checked broadcasts, groups, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import materialise

# Stands for a NULL id while rows are joined; turned back into NULL in results.
NO_ID = -(2**63)
# Rows of a few dozen bytes that may be broadcast; a larger side is shuffled.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", more: Sequence[Column] = ()) -> DataFrame:
    """Key and text, and columns asked for: no NULL key, no NULL text, no clash with others."""
    return docs.select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID)).alias("key"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        *more,
    )


def unkeyed(column: str, name: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column)).alias(name)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, a stored table of narrow rows, hinted for broadcast if it has at most
    `rows` rows (counted); otherwise left to a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Runs of equal keys from sorted batches. A run is held whole, nothing more."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for i, mark in enumerate(marks):
            if mark != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, mark
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def pieces_of(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `chars` characters: bounds what one step in a task holds."""
    return ranges_of([len(text) for text in texts], chars)


def ranges_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to about `most`."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        held += size
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node of its
    connected component.

    Alternates large stars and small stars. A node's neighbours are never gathered: each
    round takes a minimum per node (combined before the shuffle) and joins it back, and
    a hot node's join partition is split by adaptive execution. Each round is stored
    in the shared folder.
    """

    def star(links: DataFrame, least: DataFrame) -> DataFrame:
        return links.join(least, "u").select("u", "v", "m")

    current = materialise(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{label}-edges",
    )
    before = _mark(current)
    while before[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = (
            star(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = materialise(large.distinct(), f"{label}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = star(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = least.select("u", F.col("m").alias("v"))
        current = materialise(tied.union(least).distinct(), f"{label}-small")
        now = _mark(current)
        if now == before:
            break
        before = now
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.union(roots)


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free sum of hashes: equal marks mean equal edge sets."""
    row = edges.select(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)
