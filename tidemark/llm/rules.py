"""Quality rules with thresholds taken from the data, per language and source.

Quantiles come from log-bucketed histograms (relative error `accuracy`): counts
per bucket, which merge by addition, so the same table serves a source, a language and
the whole corpus, and does not depend on how rows were dealt out. DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, small, unkeyed
from tidemark.llm.mixing import SPACES
from tidemark.sources.shared import materialise


@dataclass(frozen=True)
class RuleOptions:
    """Mean word length: q25 - `spread` x IQR to q75 + `spread` x IQR. Symbols a word: at most
    q75 + `spread` x IQR, with one symbol in a document of median length as the least IQR,
    since most groups have none. Repeated lines: at most the `tail` quantile. A group under
    `least_docs` documents uses its language's thresholds, a language under it those of the
    corpus. No fence has a fixed value."""

    accuracy: float = 0.01
    spread: float = 6.0
    tail: float = 0.99
    least_docs: int = 200
    least_words: int = 10
    repeat_percent: int = 20


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, n: int = 5) -> Column:
    """Words inside windows of `n` words that occur twice or more, the first included."""

    def covered(hashes: Column) -> Column:
        def repeats(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]),
            )
            places = F.array_sort(F.transform(twice, lambda e: e["at"]))
            start = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("n"))
            step = F.aggregate(
                places,
                start,
                lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(n), at - acc["last"])).alias("n")),
            )
            return step["n"]

        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(placed, repeats))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n)))
    return F.when(F.size(words) < n, F.lit(0)).otherwise(_let(hashes, covered))


def measures(docs: DataFrame) -> DataFrame:
    """key, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.col("text")
    folded = F.translate(text, SPACES[1:], " " * (len(SPACES) - 1))
    words = F.array_remove(F.split(folded, " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counted = _let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeats")))
    lined = _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        "lang",
        "source",
    )
    return rows.select(
        "key",
        "lang",
        "source",
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        counted.alias("counted"),
        lined.alias("lined"),
    ).select(
        "key",
        "lang",
        "source",
        F.col("counted.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("lined.n").cast("long").alias("n_lines"),
        F.col("lined.dup").cast("long").alias("n_dup_lines"),
        F.col("counted.repeats").cast("long").alias("n_repeat_words"),
    )


METRICS = {
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "duplicates": ("n_dup_lines", "n_lines"),
    "words": ("n_words", None),
}
QUANTILES = ("low", "mid", "high", "tail")


def _ratio(name: str) -> Column:
    over, under = METRICS[name]
    return F.col(over) / (F.greatest(F.col(under), F.lit(1)) if under else F.lit(1))


def sketches(rows: DataFrame, options: RuleOptions) -> DataFrame:
    """(lang, source, metric, bucket, n): the mergeable histograms. Zero has a bucket of its own."""
    log = math.log((1 + options.accuracy) / (1 - options.accuracy))
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), _ratio(m).alias("value")) for m in METRICS)))
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / log)).cast("int").alias("bucket")
    return rows.select("lang", "source", values.alias("v")).select("lang", "source", "v.*").groupBy(
        "lang", "source", "metric", bucket
    ).agg(F.count("*").alias("n"))


def _quartiles(histograms: DataFrame, keys: list[str], options: RuleOptions) -> DataFrame:
    """Merged sketches of each group: docs, and the quartiles of each metric as columns, with
    the upper edge of the bucket the tail quantile lies in."""
    gamma = (1 + options.accuracy) / (1 - options.accuracy)
    merged = histograms.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    by = [*keys, "metric"]
    running = Window.partitionBy(*by).orderBy(F.col("bucket").asc_nulls_first())
    seen = merged.withColumn("seen", F.sum("n").over(running)).withColumn("docs", F.sum("n").over(Window.partitionBy(*by)))
    value = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1))
    # The margin keeps a value on the edge inside, whichever way its logarithm was rounded.
    edge = F.when(F.col("bucket").isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(gamma), F.col("bucket")) * (1 + 1e-9))
    quantiles = ((0.25, "low", value), (0.5, "mid", value), (0.75, "high", value), (options.tail, "tail", edge))
    quartile = [F.min(F.when(F.col("seen") >= F.col("docs") * q, v)).alias(name) for q, name, v in quantiles]
    return seen.groupBy(*by).agg(F.max("docs").alias("docs"), *quartile).groupBy(*keys).agg(
        F.max("docs").alias("docs"),
        *(F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in METRICS for c in QUANTILES),
    )


def thresholds(histograms: DataFrame, options: RuleOptions) -> DataFrame:
    """(t_lang, t_source, and the fences) for every group in the sketches."""
    names = [f"{m}_{c}" for m in METRICS for c in QUANTILES]
    own = _quartiles(histograms, ["lang", "source"], options)
    by_lang = _quartiles(histograms, ["lang"], options).select(F.col("lang").alias("l"), F.struct("docs", *names).alias("of_lang"))
    corpus = _quartiles(histograms.withColumn("all", F.lit(0)), ["all"], options).first()
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l")))

    def of(name: str) -> Column:
        return (
            F.when(F.col("docs") >= options.least_docs, F.col(name))
            .when(F.col("of_lang.docs") >= options.least_docs, F.col(f"of_lang.{name}"))
            .otherwise(F.lit(corpus[name] if corpus else None).cast("double"))
        )

    low, high = of("word_length_low"), of("word_length_high")
    # Quartiles in one bucket may be as far apart as the bucket is wide.
    lengths = F.greatest(high - low, high * (2 * options.accuracy))
    one_symbol = 1 / F.greatest(F.lit(1.0), of("words_mid"))
    symbols = F.greatest(of("symbols_high") - of("symbols_low"), one_symbol)
    return joined.select(
        F.col("lang").alias("t_lang"),
        F.col("source").alias("t_source"),
        (low - options.spread * lengths).alias("min_word_length"),
        (high + options.spread * lengths).alias("max_word_length"),
        (of("symbols_high") + options.spread * symbols).alias("max_symbols"),
        of("duplicates_tail").alias("max_duplicates"),
    )


def judge(docs: DataFrame, options: RuleOptions = RuleOptions()) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    NULL and empty texts have no word and fail. NULL languages and sources are groups of
    their own. Rows repeating an id are judged one by one. An empty table gives no row.
    """
    rows = materialise(measures(docs), "rules-measures")
    histograms = materialise(sketches(rows, options), "rules-sketches")
    fences = materialise(thresholds(histograms, options), "rules-thresholds")
    failed = (F.col("n_words") < options.least_words) | (
        100 * F.col("n_repeat_words") > options.repeat_percent * F.col("n_words")
    )
    inside = (
        _ratio("word_length").between(F.col("min_word_length"), F.col("max_word_length"))
        & (_ratio("symbols") <= F.col("max_symbols"))
        & (_ratio("duplicates") <= F.col("max_duplicates"))
    )
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    return rows.join(small(fences), same, "left").select(
        unkeyed("key", "doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.coalesce(inside, F.lit(True))).alias("kept"),
    )
