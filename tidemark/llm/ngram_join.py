"""N-gram Jaccard join: pairs of documents whose word-shingle sets are alike.

Candidates come from MinHash bands. Within a candidate cluster, pairs compare their
MinHash values piece by piece and are dropped as soon as the posterior probability of
reaching the threshold falls below a tolerance; what is left is verified exactly on
the shingle sets.

Copies (equal shingle sets) are one class and take part once, through their smallest
id. Clusters are compared in blocks of bounded size, so that neither a task nor a shuffle
row holds an unbounded group; a task returns one row per member, never its pairs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, components, groups, keyed, pieces_of, small, unkeyed
from tidemark.sources.shared import materialise


@dataclass(frozen=True)
class JoinOptions:
    """`bands` x `rows` MinHash values. With 26 x 5, a pair at similarity 0.8 shares no
    band with probability 3e-5. `tolerance` is the posterior below which a pair is
    dropped; `block` bounds the members compared in one group of rows."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 26
    rows: int = 5
    tolerance: float = 1e-5
    block: int = 256
    seed: int = 7


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_ROW = "_tidemark_row"
_NOT_WORD = re.compile(r"\W+")


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct hashed word shingles of texts (lower case, runs of `\\w` as words).

    A text of one to four words has one shingle, the whole text; a text without a word has
    none. Hashes are polynomials over the bytes, taken for all shingles of a text at once.
    """

    def __init__(self, words: int):
        self.words = words
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def __call__(self, text: str) -> np.ndarray:
        plain = _NOT_WORD.sub(" ", text.lower()).strip()
        if not plain:
            return np.empty(0, dtype=np.uint64)
        data = np.frombuffer(f"{plain} ".encode("utf-8", "replace"), dtype=np.uint8)
        if len(data) > len(self.up):
            self._grow(2 * len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        ends = np.flatnonzero(data == 32)
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = min(self.words, len(ends))
        first, last = starts[: len(starts) - n + 1], ends[n - 1 :]
        return np.unique(_mix((sums[last] - sums[first]) * self.down[first]))


def minhashes(sets: list[np.ndarray], n: int, seed: int) -> np.ndarray:
    """`n` 32-bit MinHash values for each non-empty set, a row each."""
    draw = np.random.default_rng(seed)
    scale = draw.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = draw.integers(0, 2**63, n, dtype=np.uint64)
    out = np.empty((len(sets), n), dtype=np.uint32)
    if not sets:
        return out
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    flat = np.concatenate(sets)
    room = np.empty_like(flat)
    for k in range(n):
        np.multiply(flat, scale[k], out=room)
        np.add(room, shift[k], out=room)
        out[:, k] = np.minimum.reduceat(room, at) >> np.uint64(32)
    return out


def _digest(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def _signed(batches: Iterator[pa.RecordBatch], options: JoinOptions) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(options.words)
    n = options.bands * options.rows
    band = np.arange(options.bands, dtype=np.uint64)
    for batch in batches:
        keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
        for low, high in pieces_of(texts):
            sets = [shingler(t) for t in texts[low:high]]
            live = [i for i, s in enumerate(sets) if len(s)]
            signs = minhashes([sets[i] for i in live], n, options.seed)
            parts = signs.reshape(len(live), options.bands, options.rows).astype(np.uint64)
            mark = np.broadcast_to(band + np.uint64(1), (len(live), options.bands)).copy()
            for r in range(options.rows):
                mark = _mix(mark * np.uint64(0x100000001B3) + parts[:, :, r])
            bands: list = [None] * len(sets)
            for row, i in enumerate(live):
                bands[i] = mark[row].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[low:high], pa.int64()),
                    pa.array([_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["key", "shingles", "n_shingles", "bands"],
            )


def _fewest(options: JoinOptions, step: int) -> dict[int, int]:
    """For each number of values compared, the fewest equal ones with which the
    posterior probability of reaching the threshold is not below the tolerance.

    With a uniform prior and m of n values equal, the posterior is Beta(m+1, n-m+1),
    whose tail above t is the chance of at most m successes in n+1 trials at t.
    """
    t, out = options.threshold, {}
    for n in range(step, options.bands * options.rows + 1, step):
        below, m = 0.0, -1
        while below < options.tolerance:
            m += 1
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


_STEP = 10
_COLUMNS = 8192


def alike(
    left: list[np.ndarray], right: list[np.ndarray], options: JoinOptions, same: bool
) -> np.ndarray:
    """Boolean matrix of the pairs at or above the threshold."""
    n = options.bands * options.rows
    a = minhashes(left, n, options.seed)
    b = a if same else minhashes(right, n, options.seed)
    na = np.array([len(s) for s in left])
    nb = np.array([len(s) for s in right])
    live = np.minimum(na[:, None], nb[None, :]) >= options.threshold * np.maximum(na[:, None], nb[None, :])
    if same:
        live &= np.triu(np.ones_like(live), 1)
    i, j = np.nonzero(live)
    equal = np.zeros(len(i), dtype=np.int32)
    for seen, fewest in _fewest(options, _STEP).items():
        part = slice(seen - _STEP, seen)
        equal += (a[i, part] == b[j, part]).sum(axis=1, dtype=np.int32)
        keep = equal >= fewest
        i, j, equal = i[keep], j[keep], equal[keep]
    out = np.zeros_like(live)
    if len(i):
        rows, cols = np.unique(i), np.unique(j)
        inner = _common([left[x] for x in rows], [right[x] for x in cols])
        shared = inner[np.searchsorted(rows, i), np.searchsorted(cols, j)]
        hit = shared >= options.threshold * (na[i] + nb[j] - shared) - 1e-9
        out[i[hit], j[hit]] = True
    return out


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices, a piece of the
    vocabulary at a time."""
    words, place = np.unique(np.concatenate(left + right), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for low in range(0, len(words), _COLUMNS):
        a, b = np.searchsorted(place, (low, low + _COLUMNS))
        has = np.zeros((len(left) + len(right), min(_COLUMNS, len(words) - low)), dtype=np.float32)
        has[owner[a:b], place[a:b] - low] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return np.rint(out).astype(np.int64)


def _compared(batches: Iterator[pa.RecordBatch], options: JoinOptions) -> Iterator[pa.RecordBatch]:
    """Per group (cluster, low block, high block): links and local root of each member."""
    for group in groups(batches, "cluster", "low", "high"):
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        key = np.array(group.column("key").to_pylist(), dtype=np.int64)
        weight = np.array(group.column("weight").to_pylist(), dtype=np.int64)
        block = np.array(group.column("block").to_pylist())
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("set").to_pylist()]
        first = np.flatnonzero(block == low)
        second = first if low == high else np.flatnonzero(block == high)
        hit = alike([sets[x] for x in first], [sets[x] for x in second], options, low == high)
        if not hit.any():
            continue
        i, j = (x[y] for x, y in zip((first, second), np.nonzero(hit), strict=True))
        texts = np.bincount(i, minlength=len(key)) + np.bincount(j, minlength=len(key))
        docs = np.zeros(len(key), dtype=np.int64)
        np.add.at(docs, i, weight[j])
        np.add.at(docs, j, weight[i])
        root, before = key.copy(), None
        while before is None or (root != before).any():
            before = root.copy()
            np.minimum.at(root, i, before[j])
            np.minimum.at(root, j, before[i])
        on = np.flatnonzero(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[on], pa.int64()) for x in (key, root, texts, docs)],
            names=["key", "root", "texts", "docs"],
        )


def _sets(batches: Iterator[pa.RecordBatch], options: JoinOptions) -> Iterator[pa.RecordBatch]:
    """Rows with their shingle sets, without those whose set is not the one their id stands for."""
    shingler = Shingler(options.words)
    names = ["key", "cluster", "block", "blocks", "weight", "shingles"]
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for low, high in pieces_of(texts):
            sets = [shingler(t).tobytes() for t in texts[low:high]]
            stands = batch.column("shingles").slice(low, high - low).to_pylist()
            own = pa.array([i for i, s in enumerate(sets) if _digest(s) == stands[i]], pa.int64())
            kept = [batch.column(n).slice(low, high - low).take(own) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sets, pa.binary()).take(own)], names=[*names, "set"])


def ngram_join(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """One row per document id: doc_id, copy_id (smallest id with the same
    shingle set), class_id (smallest id reachable over links and copies), n_links (other
    documents at or above the threshold, copies included).

    A text without a word is like nothing, not even another such text. Rows repeating an
    id count as one document, for which the row with the smallest shingle hash stands. A
    NULL id is an id like any other. An empty table gives no row.
    """
    every = materialise(
        keyed(docs).mapInArrow(
            lambda it: _signed(it, options),
            "key long, shingles binary, n_shingles long, bands array<long>",
        ),
        "ngram-signed",
    )
    signed = _one_row_per_key(every)
    wordy = signed.where("n_shingles > 0")
    classes = materialise(
        wordy.groupBy("shingles").agg(
            F.min(F.struct("key", "bands")).alias("first"), F.count("*").alias("weight")
        ).select("shingles", "weight", F.col("first.key").alias("rep"), F.col("first.bands").alias("bands")),
        "ngram-classes",
    )
    clusters = _clusters(classes, options)
    links = _links(docs, classes, clusters, options, repeated=signed is not every)
    per_text = links.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    found = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")), "ngram-class")
    rep = classes.select(
        "rep", "weight", F.col("shingles")
    ).join(found.withColumnRenamed("node", "rep"), "rep", "left").join(
        per_text.withColumnRenamed("key", "rep"), "rep", "left"
    )
    return signed.join(rep, "shingles", "left").select(
        unkeyed("key", "doc_id"),
        F.when(F.coalesce("rep", "key") != NO_ID, F.coalesce("rep", "key")).alias("copy_id"),
        F.when(F.coalesce("root", "rep", "key") != NO_ID, F.coalesce("root", "rep", "key")).alias("class_id"),
        (F.coalesce("docs", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).alias("n_links"),
    )


def _one_row_per_key(signed: DataFrame) -> DataFrame:
    """Ids are unique as a rule; only where one repeats are rows brought together."""
    total, ids = signed.select(F.count("*"), F.countDistinct("key")).first()
    if total == ids:
        return signed
    first = F.min(F.struct("shingles", "n_shingles", "bands")).alias("first")
    return materialise(signed.groupBy("key").agg(first).select("key", "first.*"), "ngram-keys")


def _clusters(classes: DataFrame, options: JoinOptions) -> DataFrame:
    """Components of the graph that ties the texts sharing a band to the first of them:
    every candidate pair lies within one. (key, cluster, block, blocks)"""
    banded = classes.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("least"), F.count("*").alias("n")).where("n > 1")
    ties = banded.join(shared, "band").where("rep <> least").select(
        F.col("rep").alias("a"), F.col("least").alias("b")
    )
    found = materialise(components(ties, "ngram-cluster"), "ngram-clusters")
    sizes = found.groupBy("root").agg(F.ceil(F.count("*") / options.block).cast("int").alias("blocks"))
    return found.join(sizes, "root").select(
        F.col("node").alias("key"),
        F.col("root").alias("cluster"),
        F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"),
        "blocks",
    )


def _links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, options: JoinOptions, repeated: bool) -> DataFrame:
    """(key, root, texts, docs) for each text and group it was compared in. Where ids are
    `repeated`, one of the rows with the set the id stands for is compared."""
    members = materialise(
        clusters.join(classes.select(F.col("rep").alias("key"), "weight", "shingles"), "key"), "ngram-members"
    )
    sets = (
        keyed(docs)
        .join(small(members), "key")
        .mapInArrow(
            lambda it: _sets(it, options),
            "key long, cluster long, block int, blocks int, weight long, shingles binary, set binary",
        )
    )
    if repeated:
        sets = materialise(sets.dropDuplicates(["key"]), "ngram-sets")
    pairs = sets.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "cluster",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "block",
        "key",
        "weight",
        "set",
    )
    spread = pairs.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "key")
    return materialise(
        spread.mapInArrow(
            lambda it: _compared(it, options), "key long, root long, texts long, docs long"
        ),
        "ngram-links",
    )


def keep_first(docs: DataFrame, options: JoinOptions = JoinOptions()) -> DataFrame:
    """`docs` without the documents whose class has a smaller id. Where ids repeat or are
    NULL, rows are documents of their own, in the order of id, then of the text's hash."""
    rows, ids = docs.select(F.count("*"), F.countDistinct("doc_id")).first()
    if rows == ids:
        found = materialise(ngram_join(docs, options), "ngram-found")
        gone = small(found.where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")))
        return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    order = [F.col("doc_id"), F.xxhash64("text")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Numbers ascend over the ranges, and are fixed once they are stored.
    numbered = materialise(ordered.withColumn(_ROW, F.monotonically_increasing_id()), "ngram-numbered")
    found = materialise(ngram_join(numbered.select(F.col(_ROW).alias("doc_id"), "text"), options), "ngram-found")
    gone = small(found.where("doc_id <> class_id").select(F.col("doc_id").alias(_ROW)))
    return numbered.join(gone, _ROW, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
