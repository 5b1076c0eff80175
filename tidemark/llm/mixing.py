"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time, linear between knots. Its
integral, scaled to the source's target, is the demand for the source's words up to
a time. Documents stand in a fixed shuffled order within their source; the
cumulative words before a document's middle, put through the inverse of the demand,
give its time, and all documents are range-sorted by it.

Running sums are taken in two levels (per slice of a source, then over slices), so a
source with any share of the rows is spread over many tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, small, unkeyed
from tidemark.sources.shared import materialise

# `[^\x20\x09-\x0D]+`: words are split at these alone.
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class MixOptions:
    """`weights` repeat over the sources in code-point order, NULL last. The mix takes
    `share` of all words, no source more than `most` times its own. `schedules` are weights
    at equally spaced knots, repeating over sources as well: early, even, late. `slice_rows` is
    the number of rows one slice should have."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: float = 2.0
    schedules: tuple[tuple[float, ...], ...] = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
    slice_rows: int = 20_000


def size_of(text: Column) -> Column:
    folded = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.size(F.array_remove(F.split(folded, " "), "")).cast("long")


def targets(sizes: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size): one row a source.

    Sources stop at `most` times their size, the excess is shared again by weight among the
    rest, until none is above. Equivalently there is one level x with target =
    min(cap, weight * x): sources are filled in ascending order of cap / weight, and the
    level is settled by the first that is not full. Sources without words get 0.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weights = F.array(*map(F.lit, options.weights))
    ranked = ranked.withColumn("weight", F.get(weights, F.col("rank") % len(options.weights)).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * options.most)
    filled = everything.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * options.share
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(
        filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    levels = ranked.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    settled = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)
    levels = levels.withColumn("settled", settled["level"])
    target = F.when(F.col("full") | F.col("settled").isNull(), F.col("cap")).otherwise(F.col("settled") * F.col("weight"))
    return levels.select("source", "source_size", "rank", F.least(target, F.col("cap")).alias("target"))


def _time(share: Column, rank: Column, options: MixOptions) -> Column:
    """Time in [0, 1] at which the integral of the source's schedule has reached `share` of
    its whole: on the right piece, the root of a quadratic."""
    out = F.lit(None).cast("double")
    for s, knots in enumerate(options.schedules):
        pieces = len(knots) - 1
        areas = [(a + b) / 2 / pieces for a, b in zip(knots, knots[1:], strict=False)]
        need, inverse, done = share * sum(areas), F.lit(1.0), sum(areas)
        for p in reversed(range(pieces)):
            done -= areas[p]
            slope = (knots[p + 1] - knots[p]) * pieces
            rest = F.greatest(F.lit(0.0), need - done)
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(float(knots[p] ** 2)) + rest * (2 * slope)))
            step = rest * 2 / (root + knots[p])
            inverse = F.when(need >= done, p / pieces + step).otherwise(inverse)
        out = F.when(rank % len(options.schedules) == s, inverse).otherwise(out)
    return F.least(F.lit(1.0), out)


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), "source", size_of(F.col("text")).alias("size")
    )


def _placed(docs: DataFrame, options: MixOptions) -> DataFrame:
    """One row per document with the words before it in its source (`start`). Its `rank`,
    `slice` and `nth` (place in the slice) together are its own, also if ids repeat."""
    rows = materialise(sized(docs), "mix-sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_source = materialise(by_source, "mix-sources")
    plan = targets(by_source.select("source", "source_size"), options)
    slices = F.ceil(F.col("n") / options.slice_rows).cast("long").alias("slices")
    counts = by_source.select(F.col("source").alias("s"), slices)
    plan = materialise(plan.join(counts, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-plan")
    placed = rows.withColumnRenamed("source", "s").join(small(plan), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    placed = placed.withColumn("order", F.xxhash64("key", "size")).withColumn("slice", F.pmod("order", "slices"))
    words = placed.groupBy("rank", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("rank").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = words.select("rank", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    mine = Window.partitionBy("rank", "slice").orderBy("order", "key", "size")
    inside = F.coalesce(F.sum("size").over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        placed.withColumn("inside", inside)
        .withColumn("nth", F.row_number().over(mine))
        .join(small(materialise(bases, "mix-bases")), ["rank", "slice"])
        .withColumn("start", F.col("base") + F.col("inside"))
        .drop("inside", "base", "slices", "order")
    )


def _taken(before: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - before)).cast("long")


def draws(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """One row per document and pass, with the words it takes and its position (time in
    [0, 1]), NULL if the pass does not reach it. Documents without words are taken once,
    where they stand."""
    passes = F.explode(F.array(*(F.lit(p).cast("long") for p in range(math.ceil(options.most)))))
    before = F.col("start") + F.col("pass") * F.col("source_size")
    rows = _placed(docs, options).withColumn("pass", passes).withColumn("before", before)
    rows = rows.withColumn("taken", _taken(F.col("before")))
    middle = F.least(F.lit(1.0), (F.col("before") + F.col("taken") / 2) / F.greatest(F.floor("target"), F.lit(1)))
    empty = (F.col("size") == 0) & (F.col("pass") == 0)
    position = F.when((F.col("taken") > 0) | empty, _time(middle, F.col("rank"), options))
    return rows.select(
        "key", "rank", "slice", "nth", "pass", "size", "source", "source_size", "target", "taken", position.alias("position")
    )


def _in_order(drawn: DataFrame) -> DataFrame:
    """`drawn`, a stored table, range-sorted by position, with the number of rows before (`place`)."""
    order = ["position", "key", "pass", "slice", "nth"]
    parts = int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = drawn.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The lower 33 bits of the id are the row's number in its partition.
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    rows = materialise(rows.withColumn("part", F.spark_partition_id()).withColumn("inside", inside), "mix-order")
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    bases = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = rows.join(small(materialise(bases, "mix-parts")), "part")
    return rows.withColumn("place", F.col("base") + F.col("inside")).drop("part", "inside", "base")


def shares(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats
    counted), and for each pass p its position_p (time in [0, 1]) and place_p (rows before
    it in the training order over all sources), both NULL if the pass does not reach it.

    A source is passed over in whole, then in part up to its target; the document on the
    target gives the part that is left. So the words taken are the target rounded
    down. NULL texts have no word, a NULL source is one more source, a NULL id is an id like
    any other; rows repeating an id are documents of their own. An empty table gives no row.
    """
    rows = materialise(draws(docs, options), "mix-draws")
    ordered = _in_order(rows.where("position IS NOT NULL"))
    every = ordered.unionByName(rows.where("position IS NULL").withColumn("place", F.lit(None).cast("long")))
    of_pass = [
        F.max(F.when(F.col("pass") == p, F.col(c))).alias(f"{c}_{p}")
        for c in ("position", "place")
        for p in range(math.ceil(options.most))
    ]
    one = every.groupBy("rank", "slice", "nth", "key", "size", "source_size", "target")
    return one.agg(F.sum("taken").alias("taken"), *of_pass).drop("rank", "slice", "nth").select(
        unkeyed("key", "doc_id"), "*"
    ).drop("key")


def assign(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """The draws that are due: key, pass, size, source, taken, position (time in [0, 1])."""
    return draws(docs, options).where("position IS NOT NULL").select("key", "pass", "size", "source", "taken", "position")


def mixed(docs: DataFrame, options: MixOptions = MixOptions()) -> DataFrame:
    """Documents in training order, a row for each time one is taken, with the columns of
    `docs`. A document of which only a part is due is taken whole if that is half or more,
    or left. Rows that agree in id, size and source are numbered, so each draw meets one."""
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))
    rows, ids = docs.select(F.count("*"), F.countDistinct(key)).first()
    drawn = draws(docs, options)
    others = [F.col(f"`{c}`") for c in docs.columns]
    docs = docs.withColumn("_size2", size_of(F.col("text")))
    twin = own = F.lit(1)
    if rows != ids:
        twin = F.row_number().over(Window.partitionBy("key", "size", "source", "pass").orderBy("slice", "nth"))
        own = F.row_number().over(Window.partitionBy(key, "_size2", "source").orderBy(F.xxhash64(*others)))
    docs = docs.withColumn("_own", own)
    drawn = drawn.withColumn("twin", twin).where((F.col("taken") * 2 >= F.col("size")) & F.col("position").isNotNull())
    drawn = drawn.select(
        F.col("key").alias("_key"), F.col("size").alias("_size"), "position", F.col("pass").alias("_pass"),
        F.col("source").alias("_source"), F.col("twin").alias("_twin"),
    )
    same = (
        (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col("_key"))
        & (docs["_size2"] == F.col("_size"))
        & docs["source"].eqNullSafe(F.col("_source"))
        & (docs["_own"] == F.col("_twin"))
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = docs.join(drawn, same).repartitionByRange(parts, "position", "_key").sortWithinPartitions("position", "_key", "_pass")
    return out.drop("_key", "_size", "_size2", "position", "_pass", "_source", "_own", "_twin")
