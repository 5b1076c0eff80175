"""Benchmark decontamination: passages of documents that repeat a benchmark item.

Windows as long as an item are fingerprinted with SimHash. Fingerprints are cut into
blocks; each item also lists, per block, all values within its share of the radius,
so that by the pigeonhole principle every pair within the radius meets in some block.
Pairs that do are verified by the exact weighted similarity of their shingles.

A window without a shingle of any item has similarity 0, so windows are taken where a
shared shingle aligns them with an item, and `slack` words to either side. Everything
is DataFrame functions; nothing is gathered beyond the windows of one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keyed, small, unkeyed
from tidemark.sources.shared import materialise


@dataclass(frozen=True)
class LeakOptions:
    """`blocks` must divide 64. Two texts at similarity 0.8 differ in 9.7 of 64 bits on
    average (deviation 2.9), at 0.9 in 6.7 (2.4): a radius of 15 holds 98% and 99.9%,
    and an unchanged passage always. `top_weight` is the weight of a shingle that one item
    has; one that n items share weighs the n-th part, 1 at least."""

    words: int = 5
    threshold: float = 0.8
    radius: int = 15
    blocks: int = 4
    slack: int = 2
    top_weight: int = 8


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column, n: int) -> Column:
    """Hash of each run of `n` words, in order; none if there are fewer words.

    The words are bound to a lambda variable; an expression in its place would be evaluated
    again for each run."""

    def runs(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1)))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, n)))

    return F.coalesce(F.transform(F.array(words), runs)[0], F.array().cast("array<bigint>"))


def _split(rows: DataFrame, options: LeakOptions) -> DataFrame:
    return rows.select("key", words_of(F.col("text")).alias("words")).select(
        "key", F.size("words").alias("length"), shingles_of(F.col("words"), options.words).alias("hashes")
    )


def _fingerprint(weight: Column, value: Column) -> tuple[list[Column], Column]:
    """Aggregates with the weight of every set bit and in all, and the SimHash over them."""
    ones = [
        F.sum(F.shiftrightunsigned(value, b).bitwiseAND(F.lit(1)) * weight).alias(f"bit{b}") for b in range(64)
    ]
    total = F.sum(weight).alias("total")
    bits = [F.when(F.col(f"bit{b}") * 2 > F.col("total"), F.lit(_signed(1 << b))).otherwise(F.lit(0)) for b in range(64)]
    joined = bits[0]
    for bit in bits[1:]:
        joined = joined.bitwiseOR(bit)
    return [*ones, total], joined


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _blocks(print_: Column, options: LeakOptions) -> Column:
    width = 64 // options.blocks
    mask = F.lit((1 << width) - 1)
    return F.array(
        *(F.shiftrightunsigned(print_, b * width).bitwiseAND(mask) for b in range(options.blocks))
    )


def find_leaks(docs: DataFrame, items: DataFrame, options: LeakOptions = LeakOptions()) -> DataFrame:
    """One row per document id and item it repeats: doc_id, item_id, similarity,
    first_word (of the most similar window, the earliest among equals) and n_words.

    Texts and items under five words have no shingle and match nothing, nor do NULL and
    empty ones. A document shorter than the item is one window. Rows repeating an id are
    searched one by one and reported under that id; NULL is an id like any other. Repeated
    item ids count as one item with the shingles of all. Empty tables give no row.
    """
    n = options.words
    split_items = materialise(_split(keyed(items, "item_id"), options).where("size(hashes) > 0"), "leak-items")
    hashes = split_items.select(
        F.col("key").alias("item"), F.col("length").alias("span"), F.posexplode("hashes").alias("place", "hash")
    )
    shared = hashes.groupBy("hash").agg(F.countDistinct("item").alias("n_items"))
    weight = F.greatest(F.lit(1), F.floor(options.top_weight / F.col("n_items"))).cast("long").alias("weight")
    weights = materialise(shared.select("hash", weight), "leak-weights")

    # Rows with the same shingles are one text for the search, whatever their ids.
    split_docs = _split(keyed(docs), options).withColumn("text", F.xxhash64("length", "hashes"))
    found = split_docs.select("key", "text", "length", F.posexplode("hashes").alias("at", "hash")).join(
        small(weights.select("hash")), "hash"
    )
    anchors = materialise(found, "leak-anchors")
    starts = F.array_distinct(
        F.transform(
            F.sequence(F.lit(-options.slack), F.lit(options.slack)),
            lambda d: F.greatest(
                F.lit(0), F.least(F.col("at") - F.col("place") + d, F.greatest(F.lit(0), F.col("length") - F.col("span")))
            ),
        )
    )
    windows = (
        anchors.join(hashes, "hash")
        .select("text", "length", "span", (F.col("at") - F.col("place")).alias("at"), F.lit(0).alias("place"))
        .distinct()
        .select("text", "length", "span", F.explode(starts).alias("first"))
        .groupBy("text", "length")
        .agg(F.collect_set(F.struct("span", "first")).alias("windows"))
    )
    windows = materialise(windows, "leak-windows")
    inside = (
        split_docs.join(small(windows), ["text", "length"])
        .dropDuplicates(["text", "length"])
        .select("text", "hashes", F.explode("windows").alias("w"))
        .select("text", "w.*", F.explode(F.expr(f"slice(hashes, w.first + 1, w.span - {n - 1})")).alias("hash"))
        .groupBy("text", "span", "first", "hash")
        .agg(F.count("*").alias("times"))
        .join(small(weights), "hash", "left")
        .withColumn("weight", F.coalesce("weight", F.lit(1)) * F.col("times"))
    )
    inside = materialise(inside, "leak-inside")
    item_sets = (
        hashes.groupBy("item", "span", "hash")
        .agg(F.count("*").alias("times"))
        .join(weights, "hash")
        .select("item", "span", "hash", (F.col("times") * F.col("weight")).alias("item_weight"))
    )
    sums, joined = _fingerprint(F.col("weight"), F.col("hash"))
    printed = inside.groupBy("text", "span", "first").agg(*sums).select(
        "text", "span", "first", "total", joined.alias("print")
    )
    sums, joined = _fingerprint(F.col("item_weight"), F.col("hash"))
    item_prints = item_sets.groupBy("item", "span").agg(*sums).select(
        "item", "span", F.col("total").alias("item_total"), joined.alias("item_print")
    )
    pairs = _within(printed, item_prints, options)
    common = (
        pairs.join(inside.select("text", "span", "first", "hash", "weight"), ["text", "span", "first"])
        .join(item_sets, ["item", "span", "hash"])
        .groupBy("text", "item", "span", "first", "total", "item_total")
        .agg(F.sum(F.least("weight", "item_weight")).alias("common"))
    )
    alike = common.select(
        "text",
        "item",
        "span",
        "first",
        (F.col("common") / (F.col("total") + F.col("item_total") - F.col("common"))).alias("similarity"),
    ).where(F.col("similarity") >= options.threshold)
    best = F.min_by(F.struct("similarity", "first", "span"), F.struct(-F.col("similarity"), "first")).alias("best")
    of_texts = alike.groupBy("text", "item").agg(best).select("text", "item", "best.*")
    # Each row that has the text, then the best of an id's texts.
    holders = anchors.select("key", "text").distinct()
    return (
        holders.join(small(materialise(of_texts, "leak-texts")), "text")
        .groupBy("key", "item")
        .agg(best)
        .select(
            unkeyed("key", "doc_id"),
            unkeyed("item", "item_id"),
            F.col("best.similarity").alias("similarity"),
            F.col("best.first").cast("long").alias("first_word"),
            F.col("best.span").cast("long").alias("n_words"),
        )
    )


def _within(printed: DataFrame, item_prints: DataFrame, options: LeakOptions) -> DataFrame:
    """Pairs of windows and items of the same length within the radius."""
    width = 64 // options.blocks
    share = options.radius // options.blocks
    flips = F.explode(
        F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)).cast("array<bigint>"), lambda x: F.bit_count(x) <= share)
    )
    listed = item_prints.select(
        "*", F.posexplode(_blocks(F.col("item_print"), options)).alias("block", "value")
    ).select("item", "span", "item_total", "item_print", "block", "value", flips.alias("flip"))
    listed = listed.withColumn("value", F.col("value").bitwiseXOR(F.col("flip"))).drop("flip")
    sought = printed.select("*", F.posexplode(_blocks(F.col("print"), options)).alias("block", "value"))
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= options.radius
    return (
        sought.join(listed, ["span", "block", "value"])
        .where(near)
        .select("text", "span", "first", "total", "item", "item_total")
        .distinct()
    )


def drop_leaks(docs: DataFrame, items: DataFrame, options: LeakOptions = LeakOptions()) -> DataFrame:
    """`docs` without the documents that repeat an item; rows sharing an id go together."""
    found = materialise(find_leaks(docs, items, options).select(F.col("doc_id").alias("_leaked")).distinct(), "leaks")
    found = small(found)
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_leaked"]), "left_anti")
